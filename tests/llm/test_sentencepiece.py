import os

import numpy as np
import pytest
from helpers import prose
from rillgraph.llm import sentencepiece_codec as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no model file")


def texts():
    r = np.random.default_rng(12)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABC  ..,0123456789éßñ中文日本😀\t\n'\"-")
    noise = ["".join(r.choice(alphabet, int(n))) for n in r.integers(0, 300, 150)]
    long = ["a" * 3000, "ab" * 900, "".join(r.choice(list("etaoin"), 2500)), "=" * 777, "é" * 500, " " * 50, "  x  y  "]
    return [prose(r, int(n)) for n in r.integers(1, 60, 50)] + noise + long + ["", "a", " ", "\n", "\x00", "�", "Straße naïve ﬁ"]


def test_against_the_library(docs):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.MODEL)
    t = texts()
    got = {x.doc_id: x for x in P.encode(docs(t)).collect()}
    for i, text in enumerate(t):
        assert got[i].token_ids == lib.encode(text), text[:60]
        assert got[i].n_tokens == len(got[i].token_ids)


def test_round_trip(docs):
    out = P.decode(P.encode(docs(texts())))
    assert all(x.round_trip and x.decoded_text == x.text for x in out.collect())


def _one_by_one(m, pair, word):
    """Merges of one word, the leftmost of the least rank each time."""
    sym = [m.id.get(c, m.n + ord(c)) for c in word]
    while True:
        got = [(*pair[a * m.n + b], i) for i, (a, b) in enumerate(zip(sym, sym[1:])) if a < m.n and b < m.n and a * m.n + b in pair]
        if not got:
            return sym
        _, new, i = min(got, key=lambda x: (x[0], x[2]))
        sym[i : i + 2] = [new]


def test_rounds_against_merges_one_by_one():
    m, r = P.model(), np.random.default_rng(18)
    words = [P.SPACE + w[:300] for t in texts() for w in t.replace("▁", "").split()] + ["".join(r.choice(list("aehtin"), 120)) for _ in range(60)] + ["", "a", "a" * 257, "ab" * 100 + "a"]
    pair = dict(zip(m.key.tolist(), zip(m.rank.tolist(), m.merged.tolist())))
    assert m.merge_rounds(words) == [_one_by_one(m, pair, w) for w in words]
    assert m.merge_rounds([]) == []


def test_very_long_words():
    """100,000 characters without a space take rounds by the number of different merges, not by their length."""
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.MODEL)
    r = np.random.default_rng(19)
    for word in ("x" * 100_000, "".join(r.choice(list("etaoinshrdlu"), 100_000)), "".join(map(chr, r.integers(0x4E00, 0x9FFF, 30_000)))):
        ids, _ = P.model().encoder()([word])
        assert ids.tolist() == lib.encode(word)


def test_known_words_may_be_forgotten(monkeypatch):
    m = P.model()
    want = [x.tolist() for x in m.encoder()(texts())]
    monkeypatch.setattr(P, "KNOWN", 40)
    enc, got = m.encoder(), []
    for t in texts():
        got += enc([t])[0].tolist()
    assert got == want[0]


def test_odd(odd):
    out = P.encode(odd)
    assert out.columns == [c for c in odd.columns if c not in ("token_ids", "n_tokens", "round_trip")] + ["token_ids", "n_tokens", "round_trip"]
    for x in out.collect():
        if x.text is None:
            assert x.token_ids is None and x.n_tokens is None and x.round_trip is None
        elif x.text == "":
            assert x.token_ids == [] and x.n_tokens == 0 and x.round_trip
        else:
            assert x.round_trip == ("▁" not in x.text)


def test_empty(empty):
    assert P.encode(empty).count() == 0 and P.decode(P.encode(empty)).count() == 0
