import numpy as np
import pyarrow as pa
from helpers import prose
from rillgraph.llm import common as C
from rillgraph.llm import simhash as S


def _fp(texts):
    return S.fingerprints(*C.text_buffer(pa.array(texts, pa.string())))


def _distances(fp):
    x = fp[:, None, :] ^ fp[None, :, :]
    return np.bitwise_count(x).sum(axis=2)


def test_fingerprints_are_the_signs_of_the_bits():
    r = np.random.default_rng(2)
    texts = [prose(r, int(n)) for n in (1, 5, 254, 255, 256, 700, 3000)] + ["", "..."]
    fp, some = _fp(texts)
    assert some.tolist() == [True] * 7 + [False] * 2
    for t, f in zip(texts[:7], fp):
        h = np.unique(C.word_hashes([t])[0])
        for w in range(S.WORDS):
            with np.errstate(over="ignore"):
                x = C.mix(h + np.uint64(w + 1) * np.uint64(0x9E3779B97F4A7C15))
            bits = sum(((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int))
            assert [(int(f[w]) >> k) & 1 for k in range(64)] == (2 * bits > len(h)).astype(int).tolist()


def test_bit_slices_against_brute_force():
    r = np.random.default_rng(3)
    for n, radius in ((2, 0), (63, 3), (64, 7), (65, 8), (500, 44), (700, 90)):
        fp = r.integers(0, 2**63, (n, S.WORDS)).astype(np.uint64)
        for k in range(0, n - 1, 3):  # near ones at all distances about the radius
            fp[k + 1] = fp[k]
            for b in r.choice(256, int(r.integers(0, 2 * radius + 2)), replace=False):
                fp[k + 1, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        got = {(int(a), int(b)) for i, j in S.within(fp, radius, rows=64) for a, b in zip(i, j)}
        d = _distances(fp)
        assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= radius)) if a < b}


def test_recall_against_all_pairs(docs):
    r = np.random.default_rng(4)
    texts = []
    for _ in range(250):
        words = prose(r, int(r.integers(60, 300))).split()
        for _ in range(int(r.integers(1, 4))):
            w = list(words)
            for k in r.choice(len(w), len(w) // 30, replace=False):
                w[k] = "edit" + str(r.integers(1000))
            texts.append(" ".join(w))
    s = S.Settings(block=16)  # several choices of bits
    assert len(S.plan(len(texts), s)) > 1
    fp, _ = _fp(texts)
    near = _distances(fp) <= s.radius
    label = np.arange(len(texts))
    while True:
        new = np.where(near, label[None, :], len(texts)).min(axis=1)
        if (new == label).all():
            break
        label = new
    want = {(i, int(l)) for i, l in enumerate(label) if i != l}
    got = {tuple(x) for x in S.near_duplicates(docs(texts), s).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(want) > 100 and not {i for i, _ in got} - {i for i, _ in want}
    assert {x.doc_id for x in S.near_dedup(docs(texts), s).collect()} == set(range(len(texts))) - {i for i, _ in got}


def test_recall_up_to_the_radius_in_large_corpora():
    """Pairs at each distance meet in a block of some choice, with the choices that large corpora get."""
    r, s = np.random.default_rng(5), S.Settings()
    for n in (10**5, 10**6, 10**7, 10**10):
        choices = S.plan(n, s)
        for d in range(37, s.radius + 1):
            differ = np.zeros((2000, S.BITS), bool)
            np.put_along_axis(differ, r.random(differ.shape).argpartition(d, axis=1)[:, :d], True, axis=1)
            met = np.zeros(len(differ), bool)
            for bits in choices:
                met |= ~differ[:, bits].any(axis=1)
            assert met.mean() >= 0.9, (n, d, met.mean())


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (200, 200), (7, 3)]
    got = {x.node: x.root for x in S.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert S.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd(odd):
    out = S.near_dedup(odd)
    assert out.columns == odd.columns
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert (6, "one two three") in got and (None, "one two three") not in got and len(got) == 10


def test_empty(empty):
    assert S.near_duplicates(empty).count() == 0 and S.near_dedup(empty).count() == 0


def test_large_blocks_are_divided_and_lose_no_pair(spark, docs):
    """A template with many fillings: one block holds all, is cut into chunks, and gives the same groups."""
    r = np.random.default_rng(6)
    words = prose(r, 200).split()
    texts = []
    for k in range(400):
        w = list(words)
        for at in r.choice(len(w), 3, replace=False):
            w[at] = f"filled{k}"
        texts.append(" ".join(w))
    texts += [prose(r, 100) for _ in range(100)]
    whole, cut = S.Settings(), S.Settings(most=40)
    reps = spark.createDataFrame([(i, *map(int, f.view(np.int64))) for i, f in enumerate(_fp(texts)[0])], "rep long, f0 long, f1 long, f2 long, f3 long")
    choices = S.plan(len(texts), cut)
    bands = S.blocks(reps, choices)
    cells = S.divided(bands, S.blocks(reps.filter("pmod(xxhash64(rep), 16) = 0"), choices), cut).groupBy("_block", "_cell").count().toPandas()
    assert cells["count"].max() < 4 * cut.most < bands.groupBy("_block").count().toPandas()["count"].max()
    assert {tuple(x) for x in S.near_duplicates(docs(texts), cut).collect()} == {tuple(x) for x in S.near_duplicates(docs(texts), whole).collect()}
