"""Token counts of a byte-level BPE vocabulary by two compiled finite-state transducers.

The vocabulary file (ranks; its path is a parameter) is public and nothing is trained. A text is first cut into pieces by the
pattern that such vocabularies use (contractions, letters, digits and other signs each with an optional space before, runs
of white space with the last character left to what follows); each piece is then merged on its own.

``compiled`` turns the pattern into a deterministic transducer over character classes. Texts are cut into chunks of equal
length; all chunks run in lockstep from every state at once, which gives each chunk's state map (end state and pieces
by start state); the maps of a text compose by a parallel prefix scan, doubling their reach each round. Now the state at
each chunk's start is known, and a second pass over the chunks marks where the pieces begin.

``Machine`` turns the vocabulary into a transducer over bytes whose transitions carry the change in the number of tokens. It
rests on two facts: a sequence of tokens is what merging gives just if each two neighbours are what merging gives of the two
(``Vocabulary.together``), and so the tokens of a prefix are those of a shorter prefix and one more. A state holds, for each suffix
of the prefix that may still grow into a token, its node in the trie of tokens, the token before it (or, where few tokens can
follow, which of them may), and how many tokens that suffix costs. The states are compiled when they are first met and kept by the
worker; a table that grows too large is emptied but for the states in use. The pieces of a batch run in lockstep. Long pieces are cut
into chunks whose state maps are kept for the start states that occur and compose in order.

Defined results: null and empty texts have 0 tokens; a null doc_id is kept; equal rows get equal counts; empty tables give
empty results; strings of special tokens are ordinary text; only doc_id and text are read by the query, other columns pass through
``count_tokens``, one named n_tokens is replaced. Texts are counted whole.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

RANKS = os.environ.get("TOKEN_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CHUNK = 128
#: Bytes of a piece that run at once; longer pieces are cut.
LONG = 256
#: States that a worker keeps.
STATES_KEPT = 1 << 17
# character classes
OTHER, LETTER, DIGIT, BLANK, WHITE, QUOTE, STMD, RV, E_, L_, PAD = range(11)
# states: what is open
START, LETTERS, DIGITS, SIGNS, BLANK1, WHITE1, BLANKS, WHITES, QUOTED, QUOTED_RV, QUOTED_L, STATES = range(12)


@functools.cache
def classes() -> np.ndarray:
    """Class by code point."""
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            out[[ord(c) for c in m[0]]] = k
    out[ord(" ")], out[ord("'")] = BLANK, QUOTE
    for letters, k in (("stmd", STMD), ("rv", RV), ("e", E_), ("l", L_)):
        out[[ord(c) for c in letters]] = k
    return out


@functools.cache
def compiled() -> np.ndarray:
    """table[class * 16 + state] = next state + 16 * tokens emitted. A token is emitted when it begins, or when it is known
    that it does."""
    table = np.zeros((16, 16), np.uint8)

    def kind(c):
        return LETTER if c in (LETTER, STMD, RV, E_, L_) else c

    def fresh(c, emitted, blank_before=False):
        """A new token begins with class c."""
        after = {LETTER: LETTERS, DIGIT: DIGITS, OTHER: SIGNS, QUOTE: SIGNS if blank_before else QUOTED, BLANK: BLANK1, WHITE: WHITE1}
        return after[kind(c)], emitted

    for state in range(STATES):
        for c in range(PAD):
            k = kind(c)
            space = c in (BLANK, WHITE)
            if state in (BLANK1, WHITE1, BLANKS, WHITES):
                if space:
                    step = (BLANKS if c == BLANK else WHITES), 0
                elif state == BLANK1:  # the blank belongs to this token, which was counted with it
                    step = fresh(c, 0, True)
                elif state == BLANKS:  # all but the last blank are a token; the last begins this one
                    step = fresh(c, 1, True)
                else:
                    step = fresh(c, 1 if state == WHITE1 else 2)
            elif state == SIGNS:
                step = (SIGNS, 0) if k in (OTHER, QUOTE) else fresh(c, 1)
            elif state == QUOTED:
                if c == STMD:
                    step = START, 0
                elif c in (RV, L_):
                    step = (QUOTED_RV if c == RV else QUOTED_L), 0
                elif k in (OTHER, QUOTE):
                    step = SIGNS, 0
                else:
                    step = fresh(c, 1)
            elif state in (QUOTED_RV, QUOTED_L):
                if c == (E_ if state == QUOTED_RV else L_):
                    step = START, 0
                elif k == LETTER:  # the quote was a token, and a word began at the letter after it
                    step = LETTERS, 1
                else:
                    step = fresh(c, 2)
            elif (state, k) in ((LETTERS, LETTER), (DIGITS, DIGIT)):
                step = state, 0
            else:
                step = fresh(c, 1)
            table[c, state] = step[0] + 16 * step[1]
        table[PAD, state] = state
    return table.ravel()


@functools.cache
def marks() -> np.ndarray:
    """marks[class * 16 + state]: 1 if a piece begins at the character, 2 if one began at the character before, 3 if both."""
    emitted = compiled().reshape(16, 16) >> 4
    out = np.where(emitted == 1, 1, np.where(emitted == 2, 3, 0)).astype(np.uint8)
    for c in range(PAD):
        if emitted[c, BLANKS] == 1:
            out[c, BLANKS] = 2
        for s in (QUOTED_RV, QUOTED_L):
            if emitted[c, s] == 1:
                out[c, s] = 2
    return out.ravel()


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """State maps (end state, pieces), a row each: first, then then."""
    return np.take_along_axis(then[0], first[0], 1), first[1] + np.take_along_axis(then[1], first[0], 1)


def _chunked(cp: np.ndarray, length: np.ndarray, chunk: int):
    """Chunks of each text, the first of each, where the characters lie in them, and 16 * class by place and chunk."""
    n = (length + chunk - 1) // chunk
    first = np.cumsum(n) - n
    total = int(n.sum())
    at = np.repeat(first * chunk - (np.cumsum(length) - length), length) + np.arange(len(cp))
    row = np.full(total * chunk, PAD, np.uint8)
    row[at] = classes()[cp]
    return n, first, at, np.ascontiguousarray(row.reshape(total, chunk).T).astype(np.intp) * 16


def _maps(column: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's map from its text's start, by lockstep and a prefix scan."""
    chunk, total = column.shape
    table = compiled()
    state = np.repeat(np.arange(STATES)[:, None], total, axis=1).astype(np.uint8)
    pieces = np.zeros((STATES, total), np.uint16)
    for t in range(chunk):
        step = table[column[t] + state]
        pieces += step >> 4
        state = step & 15
    now = state.T.astype(np.intp), pieces.T.astype(np.int64)
    # after round r a map covers the 2**r chunks up to its own
    place = np.arange(total) - np.repeat(first, n)
    reach = 1
    while reach < n.max(initial=0):
        late = np.flatnonzero(place >= reach)
        both = compose((now[0][late - reach], now[1][late - reach]), (now[0][late], now[1][late]))
        now[0][late], now[1][late] = both
        reach *= 2
    return now


def begins(cp: np.ndarray, length: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a piece begins at each of the code points cp of texts of the lengths given."""
    if not len(cp):
        return np.zeros(0, bool)
    n, first, at, column = _chunked(cp, length, chunk)
    end, _ = _maps(column, n, first)
    state = np.zeros(column.shape[1], np.uint8)
    state[1:] = end[:-1, START]
    state[first[n > 0]] = START
    table, mark = compiled(), marks()
    out = np.zeros(column.shape, np.uint8)
    for t in range(chunk):
        key = column[t] + state
        out[t] = mark[key]
        state = table[key] & 15
    flat = np.ascontiguousarray(out.T).ravel()[at]
    got = (flat & 1).astype(bool)
    got[:-1] |= (flat[1:] & 2).astype(bool)
    # a letter after a quote at the end of a text: the quote was a piece
    last = first[n > 0] + n[n > 0] - 1
    got[np.cumsum(length)[n > 0] - 1] |= np.isin(state[last], (QUOTED_RV, QUOTED_L))
    return got


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(t) for t in texts], np.int64)


def pieces(texts: list[str], chunk: int = CHUNK) -> np.ndarray:
    """How many pieces the pattern cuts each text into; no vocabulary is needed for that."""
    cp, length = code_points(texts)
    at = np.append(0, np.cumsum(length))
    return np.diff(np.append(0, np.cumsum(begins(cp, length, chunk)))[at])


class Vocabulary:
    """Tokens by rank, and the two tokens that each was merged from (-1 for bytes)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.path, self.tokens = path, sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in self.tokens] != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the ranks must count from 0 and have every byte")
        self.left, self.right = (np.full(len(ranks), -1, np.int64) for _ in range(2))
        for k, t in enumerate(self.tokens):
            if len(t) > 1:
                parts = [bytes([b]) for b in t]
                while len(parts) > 2:
                    joined = [ranks.get(a + b, k) for a, b in zip(parts, parts[1:])]
                    least = min(joined)
                    if least >= k:
                        raise ValueError(f"token {k} isn't made by merges of earlier ones")
                    at = joined.index(least)
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                self.left[k], self.right[k] = (ranks[p] for p in parts)
                if max(self.left[k], self.right[k]) >= k:
                    raise ValueError(f"token {k} isn't made by merges of earlier ones")


@functools.cache
def vocabulary(path: str = RANKS) -> Vocabulary:
    return Vocabulary(path)


class Machine:
    """The transducer of a vocabulary, compiled as far as it was met."""

    def __init__(self, v: Vocabulary, most: int = STATES_KEPT):
        self.most, self.tokens = most, v.tokens
        self.id = {t: k for k, t in enumerate(v.tokens)}
        self.left, self.right = v.left.tolist(), v.right.tolist()
        # the trie: children of each node, the token that ends there
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for k, t in enumerate(v.tokens):
            node = 0
            for b in t:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = k
        self.after: list[tuple[int, ...] | None] = [None] * len(self.child)  # a node's tokens further down, where few
        for node in range(len(self.child) - 1, -1, -1):  # children come after their parents
            got: tuple[int, ...] | None = ()
            for c in self.child[node].values():
                below = self.after[c]
                if got is None or below is None:
                    got = None
                    break
                got = got + below + ((self.ends[c],) if self.ends[c] >= 0 else ())
            self.after[node] = got if got is not None and len(got) <= 16 else None
        self.known: dict[tuple[int, int], bool] = {}
        self.clear([])

    def together(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b gives a and b: undo the merges on both sides of the border, the last
        first, and see whether the two tokens at the border would have merged before the merge that was undone."""
        key = (a, b)
        got = self.known.get(key)
        if got is None:
            limit, got = len(self.tokens), True
            left, right, tokens, find = self.left, self.right, self.tokens, self.id.get
            x, y = a, b
            while True:
                r = find(tokens[x] + tokens[y])
                if r is not None and r < limit:
                    got = False
                    break
                fx, fy = (x if left[x] >= 0 else -1), (y if left[y] >= 0 else -1)
                if fx < 0 and fy < 0:
                    break
                if fx > fy:
                    limit, x = x, right[x]
                else:
                    limit, y = y + 1, left[y]
            if len(self.known) > 2_000_000:
                self.known.clear()
            self.known[key] = got
        return got

    def clear(self, used: list[int]) -> np.ndarray:
        """Forget all states but the start and the used ones; gives their new numbers."""
        keep = [self.state[k] for k in used]
        self.state: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.next = np.full((4096, 256), -1, np.int32)
        self.delta = np.zeros((4096, 256), np.int16)
        self.intern(((0, -1, 0),))
        return np.array([self.intern(s) for s in keep], np.int32)

    def intern(self, state: tuple) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.state)
            self.state.append(state)
            if k >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
        return k

    def compile(self, state: int, byte: int) -> None:
        """The transition of a state on a byte. A state: (node, before, cost) of each suffix that may grow into a token; before is the
        token before it, -1 at the piece's start, or the tokens that may follow; cost is relative to that of the whole prefix."""
        new, last, cost = [], None, 0
        for node, before, rel in self.state[state]:
            c = self.child[node].get(byte)
            if c is None:
                continue
            new.append((c, before, rel))
            t = self.ends[c]
            if t >= 0 and (before == -1 or (t in before if isinstance(before, tuple) else self.together(before, t))):
                last, cost = t, rel + 1
        live = []
        for node, before, rel in new:
            if not self.child[node]:
                continue
            below = self.after[node]
            if below is not None and before != -1:
                before = tuple(t for t in below if (t in before if isinstance(before, tuple) else self.together(before, t)))
                if not before:
                    continue
            live.append((node, before, rel - cost))
        k = self.intern((*live, (0, last, 0)))
        self.next[state, byte], self.delta[state, byte] = k, cost

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End states and tokens of the runs data[start:start + size] from the states given, all in lockstep."""
        order = np.argsort(-size, kind="stable")
        at, now, left = start[order], state[order].astype(np.int64), size[order]
        tokens = np.zeros(len(order), np.int64)
        active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), "right")
        for j, k in enumerate(active.tolist()):
            key = now[:k] * 256 + data[at[:k] + j]
            got = self.next.ravel()[key]
            if (new := np.flatnonzero(got < 0)).size:
                for x in np.unique(key[new]).tolist():
                    self.compile(x >> 8, x & 255)
                got = self.next.ravel()[key]
            tokens[:k] += self.delta.ravel()[key]
            now[:k] = got
            if len(self.state) > self.most:
                used, back = np.unique(now, return_inverse=True)
                now = self.clear(used.tolist())[back].astype(np.int64)
        out, n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        out[order], n[order] = now, tokens
        return out, n

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, cut: int = LONG) -> np.ndarray:
        """Tokens of each piece data[start:start + size]."""
        out = np.zeros(len(start), np.int64)
        short = np.flatnonzero(size <= cut)
        if len(short):
            out[short] = self.run(data, start[short], size[short], np.zeros(len(short), np.int64))[1]
        for k in np.flatnonzero(size > cut).tolist():
            out[k] = self.long(data, int(start[k]), int(size[k]), cut)
        return out

    def long(self, data: np.ndarray, start: int, size: int, cut: int) -> int:
        """Tokens of one long piece. Each chunk's map holds the start states that occurred: one guessed by running over the bytes before
        it, then the true one, which every later chunk tries at once, since runs of one sign come back to the same state."""
        first = start + np.arange(0, size, cut)
        length = np.minimum(cut, start + size - first)
        before = np.minimum(cut // 4, first - start)
        guess, _ = self.run(data, first - before, before, np.zeros(len(first), np.int64))
        state_of = self.state  # a cleared table has another list, and then what the maps hold is void
        maps = [{} for _ in first]

        def learn(chunks: np.ndarray, states: np.ndarray) -> None:
            end, n = self.run(data, first[chunks], length[chunks], states)
            for k, s, e, c in zip(chunks.tolist(), states.tolist(), end.tolist(), n.tolist()):
                maps[k][s] = (e, c)

        learn(np.arange(len(first)), guess)
        if self.state is not state_of:
            return self.plain(data, start, size)
        state, total, k = 0, 0, 0
        while k < len(first):
            if state not in maps[k]:
                rest = np.arange(k, len(first))
                learn(rest, np.full(len(rest), state))
                if self.state is not state_of:
                    return self.plain(data, start, size)
            state, n = maps[k][state]
            total += n
            k += 1
        return total

    def plain(self, data: np.ndarray, start: int, size: int) -> int:
        """The same without maps, for when the table was cleared on the way."""
        return int(self.run(data, np.array([start]), np.array([size]), np.zeros(1, np.int64))[1][0])


_MACHINES: dict[str, Machine] = {}


def machine(v: Vocabulary) -> Machine:
    """This worker's transducer of a vocabulary."""
    if v.path not in _MACHINES:
        _MACHINES[v.path] = Machine(v)
    return _MACHINES[v.path]


def counts(texts: pa.Array, m: Machine, chunk: int = CHUNK) -> np.ndarray:
    """Tokens of each text."""
    data, off = C.text_buffer(texts, lower=False)
    out = []
    for lo, hi in C.steps(off):
        cp, length = code_points([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
        own = data[off[lo] : off[hi]]
        place = np.flatnonzero((own & 0xC0) != 0x80)  # the characters' first bytes
        start = place[begins(cp, length, chunk)]
        n = m.counts(own, start, np.diff(np.append(start, len(own))))
        out.append(C.sums(n, np.searchsorted(start, off[lo : hi + 1] - off[lo])))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_tokens(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """docs with n_tokens."""
    docs = docs.drop("n_tokens")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        m = machine(shared.value)
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts(text, m))], [*b.schema.names, "n_tokens"])

    return C.arrow(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_tokens")
