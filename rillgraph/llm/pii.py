"""Personal and secret data: a skip-chain conditional random field with loopy message passing.

Tokens are runs without white space; addresses and runs of Chinese, Japanese or Korean letters glued to other text are tokens of their own. Each
is labelled O, EMAIL, IP (4 and 6), CARD, PHONE, SECRET, IBAN or SSN (of the United States); names and postal addresses aren't looked for. Factors join neighbours (the
chain) and distant tokens of a document that are equal, or have the same shape of letters, digits and signs (the skips), so
that evidence at one place settles the label at others; repeated tokens are linked each to its next occurrence. Messages
pass along all factors of a batch of documents at once until they settle. Plain tokens (no digit, '@' or '=', no cue word, not
announced as a secret by 'password:' or the like, not equal to one that is, no group of an account number) all have the same factor, so a run of them
between two other tokens is the power of one matrix, taken exactly; only the other tokens are nodes. A plain token is O
whatever its neighbours are (a test compares all labels of both), so nothing is lost by not asking. Every document and its
whole text is searched.

The weights are fitted here, by pseudo-likelihood, on a seeded set of ``train_docs`` generated documents with known
labels: values of each kind in several formats, and numbers, dates, versions, prices and sums that are none.

Defined results: null text gives no entity and a null redacted text, empty text an empty one; ids may be null; equal rows
get equal results; tables may be empty; only doc_id and text are read; texts of any length are searched whole. Offsets count characters.
"""

from __future__ import annotations

import functools
import ipaddress
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

LABELS = ["O", "EMAIL", "IP", "CARD", "PHONE", "SECRET", "IBAN", "SSN"]
K = len(LABELS)
_TOKEN = re.compile(r"\S+")
_CANDIDATE = re.compile(r"[0-9@=]|::")
_EMAIL = r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_CJK = "\u1100-\u11ff\u2e80-\u303f\u3041-\u30ff\u3131-\u318e\u31f0-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_GLUED = re.compile(f"{_EMAIL}|[{_CJK}]+|(?:(?!{_EMAIL})[^{_CJK}])+")


_ASIAN = re.compile(f"[{_CJK}]")


def tokens_of(text: str) -> list[str]:
    """The tokens of a text, as spans has them."""
    out = text.split()
    if "@" in text or (not text.isascii() and _ASIAN.search(text)):
        return [x for t in out for x in (_GLUED.findall(t) if "@" in t or not t.isascii() else (t,))]
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """Where the tokens of a text are."""
    out = []
    for m in _TOKEN.finditer(text):
        t, a = m[0], m.start()
        if "@" in t or not t.isascii():
            out += [(a + x.start(), a + x.end()) for x in _GLUED.finditer(t)]
        else:
            out.append(m.span())
    return out


_CUE = re.compile(r"^[\"'(]*(password|passwd|pwd|secret|token|key|api|apikey|api_key|auth|bearer|phone|tel|call|mobile|fax|email|mail|card|visa|ip|version|page|section|chapter|no|nr|id|total|price)[\"'):.,]*$", re.I)
_ANNOUNCE = r"(?:password|passwd|passphrase|pwd|secret|token|api_?key)[\"')]*"
_ANNOUNCES = re.compile(r"^[\"'(]*[\w.-]*" + _ANNOUNCE + "[:=]$", re.I)
_NAMES_SECRET = re.compile(r"^[\"'(]*[\w.-]*" + _ANNOUNCE + "$", re.I)
_EDGE = ".,;:!?\"'`<>[]{}|"


_TAIL = re.compile(r"([*#&$%!?._-])\1+$")


def bare(token: str) -> tuple[int, int]:
    """Where a token begins and ends without the signs around it."""
    end = len(token)
    while True:
        cut = len(_TAIL.sub("", token[:end]).rstrip(_EDGE))
        if cut == end:
            break
        end = cut
    start = len(token[:end]) - len(token[:end].lstrip(_EDGE))
    return start, end


class Looks(dict):
    """What a token may be at first sight, by token: 1 no plain word, 2 a cue word, 4 it ends with ':' or '=', 8 it may begin an
    account number. Texts repeat their words, so few are looked at; the table is emptied when it grows too large."""

    def __missing__(self, t: str) -> int:
        if len(self) > 200_000:
            self.clear()
        head = len(t) < 9 and "0" <= t[-1] <= "9" and re.fullmatch(r"[A-Z]{2}\d{2}", t[slice(*bare(t))]) is not None
        got = self[t] = (1 if _CANDIDATE.search(t) else 0) | (2 if _CUE.match(t) else 0) | (4 if t[-1] in ":=" else 0) | (8 if head else 0)
        return got


_LOOKS = Looks()


def announced(tokens: list[str], after: list[int] | None = None) -> set[int]:
    """Tokens after 'password:', 'password =' and the like; after: those that end with ':' or '=', where it is known."""
    at = range(1, len(tokens)) if after is None else [i + 1 for i in after if i + 1 < len(tokens)]
    return {i for i in at if tokens[i - 1][-1] in ":=" and (_ANNOUNCES.match(tokens[i - 1]) or (i > 1 and len(tokens[i - 1]) == 1 and _NAMES_SECRET.match(tokens[i - 2]))) and tokens[i] not in ("=", ":")}


def grouped(tokens: list[str], i: int) -> str:
    """CARD or PHONE if token i is of a card number in groups or of a phone number in three; else empty."""
    for form in ((4, 4, 4, 4), (4, 6, 5), (3, 3, 4)):
        for a in range(max(0, i - len(form) + 1), i + 1):
            own = [t[slice(*bare(t))] for t in tokens[a : a + len(form)]]
            if tuple(map(len, own)) == form and re.fullmatch("[0-9]+", text := "".join(own)):
                if len(text) == 10:
                    return "PHONE"
                if text[0] in "3456" and _luhn(text):
                    return "CARD"
    return ""


def _iban(t: str) -> bool:
    """Whether a text without spaces is an account number with the right check digits."""
    return bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", t)) and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def ibans(tokens: list[str], heads: list[int]) -> set[int]:
    """Tokens that are groups of an account number written in groups of four, of which heads may be the first."""
    out: set[int] = set()
    for i in heads:
        whole = tokens[i][slice(*bare(tokens[i]))]
        for j in range(i + 1, min(len(tokens), i + 9)):
            group = tokens[j][slice(*bare(tokens[j]))]
            if not re.fullmatch("[A-Z0-9]{1,4}", group):
                break
            whole += group
            if _iban(whole):
                out |= set(range(i, j + 1))
            if len(group) < 4 or len(tokens[j]) > len(group):
                break
    return out


def _ipv6(t: str) -> bool:
    try:
        return t.count(":") > 1 and ipaddress.ip_address(t.strip("[]").split("%")[0]).version == 6
    except ValueError:
        return False


@dataclass(frozen=True)
class Settings:
    train_docs: int = 600
    steps: int = 250
    l2: float = 1e-3
    rounds: int = 40  #: most rounds of messages
    settle: float = 1e-5
    seed: int = 2


def _luhn(d: str) -> bool:
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def shape(token: str) -> str:
    """Letters, digits and signs of a token; runs of letters are one, of digits their number."""
    t = re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}", token[slice(*bare(token))])
    return re.sub(r"[^\W\d_]+", "a", t)


_FEATURES = [
    ("email", lambda t: re.fullmatch(r"[\w.+-]+@[\w-]+(\.[\w-]+)+", t)),
    ("at", lambda t: "@" in t),
    ("ipv4", lambda t: re.fullmatch(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(:\d+)?", t)),
    ("dotted", lambda t: re.fullmatch(r"\d+(\.\d+)+", t)),
    ("plus", lambda t: re.fullmatch(r"\+\d{1,3}", t)),
    ("paren", lambda t: re.fullmatch(r"\(\d{2,5}\)", t)),
    ("local", lambda t: re.fullmatch(r"\d{3,4}[-.]\d{4}", t)),
    ("phone", lambda t: re.fullmatch(r"(\+\d{1,3}[-.]?)?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}|\+\d{9,14}", t)),
    ("digits4", lambda t: re.fullmatch(r"\d{4}", t)),
    ("digits3", lambda t: re.fullmatch(r"\d{1,3}", t)),
    ("digits16", lambda t: re.fullmatch(r"\d{13,19}", t)),
    ("luhn", lambda t: re.fullmatch(r"(\d[ -]?){13,19}", t) and _luhn(re.sub(r"\D", "", t))),
    ("cardlike", lambda t: re.fullmatch(r"[3-6]\d{3}-?\d{4}-?\d{4}-?\d{4}", t)),
    ("digits", lambda t: re.fullmatch(r"\d+", t)),
    ("date", lambda t: re.fullmatch(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}:\d{2}(:\d{2})?", t)),
    ("money", lambda t: re.fullmatch(r"[$€£]\d[\d.,]*|\d{1,3}(,\d{3})+|\d+[.,]\d{1,2}|\d+%", t)),
    ("hexlong", lambda t: re.fullmatch(r"[0-9a-fA-F]{16,}", t) and re.search(r"[a-fA-F]", t) and re.search(r"\d", t)),
    ("mixed", lambda t: re.fullmatch(r"[A-Za-z0-9_+/\-]{16,}={0,2}", t) and re.search(r"\d", t) and re.search(r"[A-Za-z]", t)),
    ("upper", lambda t: re.fullmatch(r"[A-Z0-9]{16,}", t) and re.search(r"[A-Z]", t)),
    ("keyed", lambda t: re.match(r"(?i)[\w.-]*(pass(word|wd)?|pwd|secret|token|api_?key|auth)[\w-]*[=:].{4,}", t)),
    ("prefix", lambda t: re.match(r"(AKIA|ASIA|gh[opsu]_|sk-|xox[bp]-|AIza|eyJ)[A-Za-z0-9]", t)),
    ("equals", lambda t: t == "="),
    ("assign", lambda t: "=" in t and len(t) > 1),
    ("secretcue", lambda t: re.fullmatch(r"(?i)(password|passwd|pwd|secret|token|key|apikey|api_key|auth|bearer):?", t)),
    ("cue", lambda t: _CUE.match(t)),
    ("ipv6", _ipv6),
    ("iban", _iban),
    ("ibanlike", lambda t: re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", t)),
    ("ssn", lambda t: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", t)),
    ("url", lambda t: "://" in t),
    ("word", lambda t: not _CANDIDATE.search(t)),
]
_NAMES = ["bias", *(n for n, _ in _FEATURES)]
#: Each feature of the token itself, of the token just before, of the one just after, and of the one before that.
#: Then whether it is announced as a secret, whether it is a group of a card number, of a phone number, and whether it has eight letters or
#: more and equals one that is announced elsewhere; shorter ones, often common words, have only the skip for that. And whether it is a
#: group of an account number.
WIDE = 4 * len(_NAMES) + 5
#: The features of every plain token, whatever is beside it.
PLAIN = [0, _NAMES.index("word")]


@functools.lru_cache(100_000)
def _own(token: str) -> tuple[int, ...]:
    t = token[slice(*bare(token))]
    return (0, *(k + 1 for k, (_, f) in enumerate(_FEATURES) if f(t)))


class Graph:
    """Nodes, chain factors (by gap) and skip factors of a batch of documents."""

    def __init__(self, docs: list[list[str]], wanted: list[list[int]] | None = None, every: bool = False):
        """wanted: labels, for fitting; every: plain tokens are nodes too."""
        self.at: list[tuple[int, int]] = []
        self.features: list[list[int]] = []
        chain, same, alike, label, runs = [], [], [], [], []
        for d, tokens in enumerate(docs):
            last, seen_token, seen_shape = -1, {}, {}
            looks = list(map(_LOOKS.__getitem__, tokens))
            notable = [i for i, x in enumerate(looks) if x]
            told = announced(tokens, [i for i in notable if looks[i] & 4])
            account = ibans(tokens, [i for i in notable if looks[i] & 8])
            values = {tokens[i][slice(*bare(tokens[i]))].lower() for i in told} - {""}
            repeats = {i for i, t in enumerate(tokens) if t[slice(*bare(t))].lower() in values} if values else set()
            nodes = range(len(tokens)) if every else sorted({*(i for i in notable if looks[i] & 3), *told, *account, *repeats})
            for i in nodes:
                t = tokens[i]
                plain, value, cue = not looks[i] & 1, i in told or i in repeats, looks[i] & 2
                node = len(self.at)
                self.at.append((d, i))
                own = PLAIN
                if not plain or i in told or i in account or cue:
                    own = list(_own(t))
                    for off, step in ((-1, 1), (1, 2), (-2, 3)):
                        if 0 <= i + off < len(tokens):
                            own += [step * len(_NAMES) + k for k in _own(tokens[i + off])]
                    if i in told:
                        own.append(WIDE - 2)
                    if i in account:
                        own.append(WIDE - 5)
                    if "0" <= t.strip(_EDGE)[:1] <= "9" and (kind := grouped(tokens, i)):
                        own.append(WIDE - 1 if kind == "CARD" else WIDE - 4)
                elif value and len(t[slice(*bare(t))]) >= 8:
                    own = [*PLAIN, WIDE - 3]
                self.features.append(own)
                if last >= 0:
                    chain.append((node - 1, node, i - last - 1))
                elif i:
                    runs.append((node, i, 0))
                last = i
                if not plain or value:
                    core, form = t[slice(*bare(t))].lower(), None if plain else shape(t)
                    if core in seen_token:
                        same.append((seen_token[core], node))
                    elif form in seen_shape:
                        alike.append((seen_shape[form], node))
                    seen_token[core] = node
                    if not plain:
                        seen_shape[form] = node
                if wanted is not None:
                    label.append(wanted[d][i])
            if 0 <= last < len(tokens) - 1:
                runs.append((len(self.at) - 1, len(tokens) - 1 - last, 1))
        #: plain tokens before a document's first node (0) and after its last (1)
        self.runs = np.array(runs, np.int64).reshape(-1, 3)
        self.chain = np.array(chain, np.int64).reshape(-1, 3)
        self.same, self.alike = (np.array(x, np.int64).reshape(-1, 2) for x in (same, alike))
        self.label = np.array(label, np.int64)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        n = [len(f) for f in self.features]
        flat = np.fromiter((k for f in self.features for k in f), np.int64, sum(n))
        return np.add.reduceat(weights[flat], np.cumsum([0, *n[:-1]]), axis=0)


@dataclass
class Model:
    weights: np.ndarray  # (WIDE, K)
    chain: np.ndarray  # (K, K)
    same: float
    alike: float
    plain: np.ndarray  # (K,) of a plain token among plain ones

    def powers(self) -> np.ndarray:
        """Factors between nodes with 0, 1, 2, ... plain tokens between, until they no longer change."""
        t, d = np.exp(self.chain), np.exp(self.plain - self.plain.max())
        out = [t / t.sum()]
        while len(out) < 2 or np.abs(out[-1] - out[-2]).max() > 1e-13:
            x = (out[-1] * d) @ t
            out.append(x / x.sum())
        return np.array(out)


def fit(s: Settings = Settings()) -> Model:
    """Pseudo-likelihood by full-batch Adam on generated documents."""
    docs, labels = generated(s.train_docs, s.seed)
    g = Graph(docs, labels, every=True)
    n, y = len(g.label), g.label
    x = np.zeros((n, WIDE), np.float32)
    for k, f in enumerate(g.features):
        x[k, f] = 1
    hot = np.eye(K)[y]
    near = np.zeros((4, n, K))  # labels before, after, of equals, of alikes
    a, b = g.chain[:, 0], g.chain[:, 1]
    near[0][b], near[1][a] = hot[a], hot[b]
    for k, e in ((2, g.same), (3, g.alike)):
        np.add.at(near[k], e[:, 0], hot[e[:, 1]])
        np.add.at(near[k], e[:, 1], hot[e[:, 0]])
    p = {"w": np.zeros((WIDE, K)), "t": np.zeros((K, K)), "s": np.zeros(2)}
    m, v = ({k: np.zeros_like(z) for k, z in p.items()} for _ in range(2))
    for step in range(1, s.steps + 1):
        z = x @ p["w"] + near[0] @ p["t"] + near[1] @ p["t"].T + p["s"][0] * near[2] + p["s"][1] * near[3]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q = (q / q.sum(axis=1, keepdims=True) - hot) / n
        grad = {"w": x.T @ q + s.l2 / 10 * p["w"], "t": near[0].T @ q + q.T @ near[1] + s.l2 * p["t"], "s": np.array([(q * near[2]).sum(), (q * near[3]).sum()]) + s.l2 * p["s"]}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            p[k] -= 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    return Model(p["w"], p["t"], float(max(0, p["s"][0])), float(max(0, p["s"][1])), p["w"][PLAIN].sum(axis=0))


@functools.cache
def fitted(s: Settings = Settings()) -> Model:
    return fit(s)


def marginals(g: Graph, model: Model, powers: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product, all messages of a round at once."""
    u = g.unary(model.weights)
    u = np.exp(u - u.max(axis=1, keepdims=True))
    gap = np.minimum(g.chain[:, 2], len(powers) - 1)
    tie = [np.exp(w * np.eye(K)) for w in (model.same, model.alike)]
    table = np.concatenate([powers, powers.transpose(0, 2, 1), [t / t.sum() for t in tie]])
    n = len(powers)
    src = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.same[:, 0], g.same[:, 1], g.alike[:, 0], g.alike[:, 1]])
    dst = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.same[:, 1], g.same[:, 0], g.alike[:, 1], g.alike[:, 0]])
    kind = np.concatenate([gap, gap + n, np.full(2 * len(g.same), 2 * n), np.full(2 * len(g.alike), 2 * n + 1)])
    sizes = [len(g.chain)] * 2 + [len(g.same)] * 2 + [len(g.alike)] * 2
    ends = np.cumsum([0, *sizes])
    back = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in (1, 0, 3, 2, 5, 4)])
    message = np.full((len(src), K), -np.log(K))
    logu = np.log(u + 1e-300)
    d = np.exp(model.plain - model.plain.max())
    for side, ends_ in ((0, powers.transpose(0, 2, 1) @ d), (1, powers @ d)):
        own = g.runs[g.runs[:, 2] == side]
        np.add.at(logu, own[:, 0], np.log(ends_[np.minimum(own[:, 1], len(powers)) - 1]))
    for _ in range(s.rounds):
        belief = logu.copy()
        np.add.at(belief, dst, message)
        out = belief[src] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.einsum("ek,ekl->el", out, table[kind])
        new = np.log(new / new.sum(axis=1, keepdims=True))
        moved = np.abs(np.exp(new) - np.exp(message)).max() if len(src) else 0
        message = np.log(0.5 * np.exp(message) + 0.5 * np.exp(new)) if _ > 10 else new
        if moved < s.settle:
            break
    belief = logu.copy()
    np.add.at(belief, dst, message)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def found(texts: list[str], model: Model, powers: np.ndarray, s: Settings = Settings()) -> list[list[tuple[str, int, int]]]:
    """(label, start, end) of each text's entities in order."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for lo in range(0, len(texts), 200):
        own = range(lo, min(len(texts), lo + 200))
        g = Graph([tokens_of(texts[k]) for k in own])
        if not g.at:
            continue
        best = marginals(g, model, powers, s).argmax(axis=1).tolist()
        at: dict[int, list[tuple[int, int]]] = {}
        for (d, i), y in zip(g.at, best):
            if y:
                if d not in at:  # places only where something was found
                    at[d] = spans(texts[own[d]])
                a, b = at[d][i]
                t = texts[own[d]][a:b]
                left, right = bare(t)
                if left < right:
                    got = out[own[d]]
                    last = got[-1] if got else None
                    adjoins = last and i and last[0] == LABELS[y] and last[2] == at[d][i - 1][1]
                    if adjoins and LABELS[y] in ("PHONE", "CARD", "IBAN"):
                        got[-1] = (last[0], last[1], a + right)
                    else:
                        got.append((LABELS[y], a + left, a + right))
    return out


def redacted(text: str, entities: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for label, a, b in entities:
        out += [text[at:a], f"[{label}]"]
        at = b
    return "".join([*out, text[at:]])


ENTITY = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scrub(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_entities, entities, redacted) of every row."""
    model = docs.sparkSession.sparkContext.broadcast((m := fitted(s), m.powers()))
    entity = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        m, powers = model.value
        for b in batches:
            text = b.column(1)
            got = found([t or "" for t in text.to_pylist()], m, powers, s)
            hit = np.array([bool(e) for e in got], bool)
            if hit.any():
                new = pa.array([redacted(text[k].as_py(), got[k]) for k in np.flatnonzero(hit)], text.type)
                text = pc.replace_with_mask(text, pa.array(hit), new)
            rows = pa.array([[{"label": y, "start": a, "end": z} for y, a, z in e] for e in got], entity)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(e) for e in got], pa.int32()), rows, text], ["doc_id", "n_entities", "entities", "redacted"])

    rows = C.arrow(docs.select("doc_id", "text"))
    return rows.mapInArrow(run, T.StructType([rows.schema.fields[0], T.StructField("n_entities", T.IntegerType()), T.StructField("entities", ENTITY), T.StructField("redacted", T.StringType())]))


def generated(n: int, seed: int) -> tuple[list[list[str]], list[list[int]]]:
    """Documents of invented words with values of each kind, and with numbers that are none; the labels of their tokens."""
    r = np.random.default_rng(seed)
    syllables = ["ka", "lo", "mi", "ser", "tan", "vo", "ri", "den", "pu", "es", "or", "ha"]

    def word():
        return "".join(r.choice(syllables, r.integers(1, 4)))

    def digits(k):
        return "".join(map(str, r.integers(0, 10, k)))

    def hexa(k):
        return "".join(r.choice(list("0123456789abcdef"), k - 2)) + str(r.integers(10)) + r.choice(list("abcdef"))

    def alnum(k):
        return "".join(r.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ23456789"), k - 2)) + str(r.integers(2, 10)) + "Q"

    def card():
        body = str(r.choice(["4", "51", "37", "6011"]))
        body += digits(16 - len(body))
        body = next(body[:-1] + str(c) for c in range(10) if _luhn(body[:-1] + str(c)))
        groups = [body[i : i + 4] for i in range(0, 16, 4)]
        kind = r.random()
        return [body] if kind < 0.5 else ["-".join(groups)] if kind < 0.7 else groups

    def email():
        dot = r.choice(["", ".", "_", "+"])
        return [f"{word()}{dot}{r.choice([word(), digits(2)])}@{word()}{r.choice(['', digits(1)])}.{r.choice(['com', 'org', 'example.com', 'net', 'co.uk'])}"]

    def iban():
        land, body = str(r.choice(["GB", "DE", "FR", "NL", "ES"])), digits(int(r.integers(10, 18)))
        body = "".join(r.choice(list("ABCDEFGHKLMNPRSTWZ"), 4)) + body if r.random() < 0.5 else body
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        whole = f"{land}{check:02d}{body}"
        return [whole] if r.random() < 0.5 else [whole[i : i + 4] for i in range(0, len(whole), 4)]

    def ssn():
        return [f"{r.integers(1, 666):03d}-{r.integers(1, 100):02d}-{r.integers(1, 10000):04d}"]

    def ip():
        if r.random() < 0.3:
            groups = [f"{x:x}" for x in r.integers(0, 65536, 8)]
            return [":".join(groups) if r.random() < 0.5 else ":".join(groups[: int(r.integers(1, 4))]) + "::" + groups[7]]
        return [".".join(str(x) for x in r.integers(1, 255, 4)) + ("" if r.random() < 0.9 else ":8080")]

    def phone():
        kind = r.integers(6)
        if kind == 5:
            return [digits(3), digits(3), digits(4)]
        if kind < 2:
            return [f"+{r.integers(1, 99)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"]
        return [[f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{r.integers(1, 99)}{digits(10)}"]][kind - 2]

    def secret():
        kind = r.integers(9)
        letters = "".join(word() for _ in range(r.integers(3, 6))) if r.random() < 0.7 else "".join(r.choice(list("abcdefghijkmnopqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ"), r.integers(8, 24)))
        cue = str(r.choice(["password", "secret", "api_key", "token", "passwd"]))
        if kind == 0:
            return [f"{cue}={hexa(int(r.integers(8, 40)))}"], [1]
        if kind == 1:
            return ["AKIA" + alnum(16)], [1]
        if kind == 2:
            return [cue, "=", f'"{hexa(int(r.integers(16, 41)))}"'], [0, 0, 1]
        if kind == 3:
            return [cue + ":", hexa(int(r.integers(12, 41)))], [0, 1]
        if kind == 4:
            return [str(r.choice(["ghp_", "sk-"])) + hexa(32)], [1]
        if kind == 5:
            return [cue, "=", f'"{letters}"'], [0, 0, 1]
        if kind > 6:
            return [cue + ":", letters], [0, 1]
        return [f"{cue}={word()}{digits(3)}{word()}"], [1]

    def serial():
        """A long number that is no card: its check digit is wrong, or no card begins so."""
        body = digits(int(r.integers(13, 18)))
        return [body if not _luhn(body) else "0" + body]

    def none():
        kind = r.integers(25)
        return [
            lambda: [digits(int(r.integers(1, 5)))], lambda: [f"{r.integers(1, 12)}.{r.integers(0, 20)}."], lambda: [f"{r.integers(1, 12)}.{r.integers(0, 20)}.{r.integers(0, 20)}"],
            lambda: [f"20{digits(2)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}"], lambda: [f"{r.integers(1, 29)}/{r.integers(1, 13)}/20{digits(2)}"], lambda: [f"{r.integers(0, 24)}:{r.integers(10, 60)}"],
            lambda: [f"${r.integers(1, 9999)}.{digits(2)}"], lambda: [f"{r.integers(1, 999)},{digits(3)}"], lambda: [f"{r.integers(1, 100)}%"], lambda: ["version", f"{r.integers(1, 12)}.{r.integers(0, 20)}"],
            lambda: [f"{word()}={word()}"], lambda: [word(), "=", str(r.integers(1000))], lambda: [word() + digits(2)], lambda: ["token", word()],
            serial, serial, lambda: [digits(4), digits(4)], lambda: [digits(3), digits(3)], lambda: ["20" + digits(2) for _ in range(4)], lambda: [f"{r.integers(256, 999)}.{r.integers(1, 99)}.{r.integers(1, 99)}.{r.integers(256, 999)}"],
            lambda: [f"GB{digits(2)}" + "".join(r.choice(list("ABCDEFGHKLMNPRSTWZ"), 4)) + digits(13)], lambda: [f"{digits(2)}-{digits(3)}-{digits(3)}"], lambda: [f"000-{digits(2)}-{digits(4)}"],
            lambda: [f"https://{word()}.org/{word()}/{digits(3)}"], lambda: ["".join(r.choice(list("ABCDEFGHKLMNPRSTWZ"), 2)) + digits(2), word()],
        ][kind]()

    docs, labels = [], []
    for _ in range(n):
        tokens, y, used = [], [], []
        for _ in range(r.integers(2, 9)):
            for _ in range(r.integers(0, 6)):
                tokens.append(word() + str(r.choice(["", "", "", ",", "."])))
                y.append(0)
            pick = r.integers(10)
            if pick < 4:
                got = none()
                own = [0] * len(got)
            elif pick == 4 and used:
                got, own = used[r.integers(len(used))]
                got, own = list(got), list(own)
            else:
                kind = r.integers(1, K)
                if kind == 5:
                    got, own = secret()
                    own = [5 * v for v in own]
                else:
                    got = [None, email, ip, card, phone, None, iban, ssn][kind]()
                    own = [kind] * len(got)
                if kind == 5 and len(got) > 1 and got[-1].strip('"').isalpha():  # its value alone is repeated, here or later
                    used.append((got[-1:], own[-1:]))
                    if r.random() < 0.7:
                        between = [word() for _ in range(r.integers(1, 5))]
                        got, own = [*got, *between, got[-1].strip('"')], [*own, *[0] * len(between), 5]
                else:
                    used.append((got, own))
            got = list(got)
            got[-1] += str(r.choice(["", "", ".", ","]))
            tokens += got
            y += own
        docs.append(tokens)
        labels.append([int(v) for v in y])
    return docs, labels


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub(spark.read.parquet(f"{sf_dir}/documents.parquet"))
