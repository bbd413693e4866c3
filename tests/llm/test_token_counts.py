import base64
import functools
import os

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from helpers import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from rillgraph.llm import token_counts as K

TEXT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PATTERN = regex.compile(TEXT)
FILES = [K.RANKS, os.path.join(os.path.dirname(K.RANKS), "byte_bpe_multi_50k.tiktoken")]


@functools.cache
def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=TEXT.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={})


@functools.cache
def machine(path=K.RANKS):
    return K.Machine(K.vocabulary(path))


def _counts(texts, path=K.RANKS, **how):
    return K.counts(pa.array(texts, pa.string()), machine(path), **how).tolist()


def _want(t, path=K.RANKS):
    return len(library(path).encode_ordinary(t or ""))


ALPHABET = st.text(alphabet=list("abslvret'1 .\t\n\xa0\x1c　é中😀-"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=6), st.integers(1, 9))
def test_pieces_against_the_pattern(texts, chunk):
    assert K.pieces(texts, chunk).tolist() == [len(PATTERN.findall(t)) for t in texts]


def test_pieces_of_long_texts_and_all_chunk_lengths():
    r = np.random.default_rng(14)
    texts = [prose(r, 8000), "a" * 70_000, "'ll" * 9000, " " * 50_001 + "x", "", "\n \n" * 999, "'r", "'rat 'l"]
    for chunk in (1, 7, 128, 5000):
        assert K.pieces(texts, chunk).tolist() == [len(PATTERN.findall(t)) for t in texts]


@pytest.mark.parametrize("path", FILES)
def test_equal_to_the_library_on_every_document(path):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    assert _counts(texts, path) == [_want(t, path) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.text(max_size=80), st.text(alphabet=list("etaoinsthe xé0"), max_size=200)), max_size=5), st.sampled_from(FILES))
def test_equal_to_the_library_on_any_text(texts, path):
    assert _counts(texts, path) == [_want(t, path) for t in texts]


@pytest.mark.parametrize("path", FILES)
def test_long_pieces(path):
    r = np.random.default_rng(15)
    letters = "".join(r.choice(list("etaoinshrdlucmfw"), 3000))
    texts = [letters, "x" * 5001, " " + "ab" * 2500, "中文字" * 700, "0" * 3333, "." * 2049, " " * 4100, "".join(map(chr, r.integers(0x4E00, 0x9FFF, 900))), letters + " " + letters[::-1]]
    assert _counts(texts, path) == [_want(t, path) for t in texts]


def test_a_small_table_of_states_gives_the_same():
    r = np.random.default_rng(16)
    texts = [prose(r, 300), "".join(r.choice(list("etaoinshrdlucmfw"), 3000)), "x" * 3000]
    small = K.Machine(K.vocabulary(), most=50)
    assert K.counts(pa.array(texts), small).tolist() == [_want(t) for t in texts]
    assert len(small.state) < 4000


def test_every_pair_of_neighbours_is_what_merging_gives():
    r = np.random.default_rng(17)
    m, lib = machine(), library(K.RANKS)
    for a, b in r.integers(0, len(m.tokens), (3000, 2)).tolist():
        whole = m.tokens[a] + m.tokens[b]
        assert m.together(a, b) == (lib._encode_single_piece(whole) == [a, b])


def test_no_vocabulary_of_merges(tmp_path):
    every = [bytes([b]) for b in range(256)] + [b"abc"]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(every)))
    with pytest.raises(ValueError, match="merges"):
        K.Vocabulary(str(tmp_path / "v"))


def test_odd(odd):
    out = K.count_tokens(odd)
    assert out.columns == [c for c in odd.columns if c != "n_tokens"] + ["n_tokens"]
    assert all(x.n_tokens == _want(x.text) for x in out.collect())


def test_empty(empty):
    assert K.count_tokens(empty).count() == 0
