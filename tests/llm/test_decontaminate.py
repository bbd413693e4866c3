import numpy as np
from helpers import prose
from pyspark.sql import functions as F
from rillgraph.llm import common as C
from rillgraph.llm import decontaminate as D

BENCH = "item_id long, text string"


def smith_waterman(a, b):
    """The best local score, cell by cell."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def _words(t):
    return C.word_hashes([t])[0].tolist()


def _cases(r):
    items = [prose(r, int(r.integers(12, 40))) for _ in range(12)]
    texts = [prose(r, int(r.integers(5, 200))) for _ in range(60)]
    for t in items:
        w = t.split()
        whole = " ".join([prose(r, 30), t.upper() + "!", prose(r, 30)])
        edited = [x if r.random() > 0.12 else "new" for x in w]
        half = w[: len(w) // 3]
        texts += [whole, " ".join([prose(r, 10), *edited, prose(r, 50)]), " ".join([prose(r, 20), *half, prose(r, 20)])]
    return items, texts


def test_against_whole_alignment(docs, spark):
    """All documents against all items, without seeds: the same matches, with the same scores."""
    items, texts = _cases(np.random.default_rng(7))
    s = D.Settings()
    got = {(x.doc_id, x.item_id): x.score for x in D.matches(docs(texts), spark.createDataFrame(list(enumerate(items)), BENCH), s).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, q in enumerate(items):
            score = smith_waterman(_words(q), _words(t)) / (2 * len(_words(q)))
            if score >= s.threshold:
                want[i, k] = round(score, 4)
    assert len(want) >= 24 and set(got) == set(want)
    assert all(got[k] == want[k] for k in want)


def test_align_against_cells():
    r = np.random.default_rng(8)
    h = r.integers(0, 6, 400).astype(np.uint64)
    lo = r.integers(0, 300, 50)
    hi = lo + r.integers(1, 100, 50)
    items = [r.integers(0, 6, int(n)).astype(np.uint64) for n in r.integers(1, 30, 50)]
    got = D.align(h, lo, hi, items, cells=500)
    assert got.tolist() == [smith_waterman(q.tolist(), h[a:b].tolist()) for a, b, q in zip(lo, hi, items)]


def test_a_large_benchmark_is_joined_with_the_same_result(docs, spark):
    """Beyond the bound of the broadcast: the same pairs and scores, also for edited copies, long insertions, and null ids."""
    items, texts = _cases(np.random.default_rng(9))
    r = np.random.default_rng(15)
    w = items[0].split()
    texts += [_edited(items[1], 6), " ".join([*w[: len(w) // 2], prose(r, len(w) // 2), *w[len(w) // 2 :]]), None, "", "two words", items[2] + " " + items[2]]
    d = docs([*enumerate(texts), (None, items[3])])
    bench = spark.createDataFrame([*enumerate(items), (None, items[4]), (900, "two words"), (901, None)], BENCH)
    whole, joined = (sorted(map(tuple, D.matches(d, bench, D.Settings(part_bytes=n)).collect()), key=str) for n in (10**9, 500))
    assert whole == joined and len(whole) > 5
    kept = [sorted(map(str, D.decontaminated(d, bench, D.Settings(part_bytes=n)).collect())) for n in (10**9, 500)]
    assert kept[0] == kept[1] and len(kept[0]) < d.count()


def test_bloom_filter_misses_no_seed(spark):
    r = np.random.default_rng(16)
    seeds = r.integers(-(2**63), 2**63 - 1, 3000)
    f = D.bloom(spark.createDataFrame([(int(x),) for x in seeds], "seed long"))
    assert D.passes(f, seeds.view(np.uint64)).all()
    assert D.passes(f, r.integers(0, 2**63 - 1, 20_000).astype(np.uint64)).mean() < 0.05


def test_decontaminated_drops_what_matches(docs, spark):
    items, texts = _cases(np.random.default_rng(10))
    bench = spark.createDataFrame(list(enumerate(items)), BENCH)
    bad = {x.doc_id for x in D.matches(docs(texts), bench).collect()}
    assert {x.doc_id for x in D.decontaminated(docs(texts), bench).collect()} == set(range(len(texts))) - bad


def test_many_copies_of_an_item_are_all_found(docs, spark):
    r = np.random.default_rng(11)
    item = prose(r, 30)
    texts = [prose(r, 20) + " " + item for _ in range(40)] + [prose(r, 40) for _ in range(40)]
    got = D.matches(docs(texts), spark.createDataFrame([(1, item), (2, item)], BENCH)).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, k) for i in range(40) for k in (1, 2)}


def _edited(item, every):
    """Every so-manieth word replaced."""
    return " ".join("new" + str(k) if k % every == every - 1 else w for k, w in enumerate(item.split()))


def test_items_that_occur_only_edited(docs, spark):
    """Lone and repeated edited copies, in small and larger corpora, where no whole copy makes some seed rare."""
    for clean, copies in ((5, 1), (40, 30), (2500, 1), (2500, 300)):
        r = np.random.default_rng(12)
        item, other = prose(r, 30), prose(r, 25)
        texts = [prose(r, 20) for _ in range(clean)] + [" ".join([prose(r, 15), _edited(item, 6), prose(r, 15)]) for _ in range(copies)] + [other]
        got = {(x.doc_id, x.item_id) for x in D.matches(docs(texts), spark.createDataFrame([(1, item), (2, other)], BENCH)).collect()}
        assert got == {(clean + i, 1) for i in range(copies)} | {(clean + copies, 2)}, (clean, copies)


def test_shared_words_bound_the_score():
    r = np.random.default_rng(13)
    items = D.Items(None, [prose(r, int(n)) for n in r.integers(3, 40, 30)], 3)
    h = np.concatenate([*items.words, *C.word_hashes([prose(r, 2000)])])
    lo = r.integers(0, len(h) - 1, 300)
    hi = np.minimum(len(h), lo + r.integers(1, 90, 300))
    item = r.integers(0, 30, 300)
    got = items.shared(h, lo, hi, item, most=500)
    assert (2 * got >= D.align(h, lo, hi, [items.words[k] for k in item])).all()
    for a, b, k, n in zip(lo, hi, item, got):
        assert n == sum(min((h[a:b] == w).sum(), (items.words[k] == w).sum()) for w in np.unique(items.words[k]))


def test_odd(odd, spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "one two three"), (None, "one two three"), (4, "one two three"), (5, "!!!")], BENCH).withColumn("doc_id", F.lit("own"))
    got = {(x.doc_id, x.item_id) for x in D.matches(odd, bench).collect()}
    assert got == {(None, 4), (None, None), (6, 4), (6, None)}
    out = D.decontaminated(odd, bench)
    assert out.columns == odd.columns and out.count() == odd.count() - 3


def test_empty(empty, docs, spark):
    none, one = spark.createDataFrame([], BENCH), spark.createDataFrame([(1, "a b c d")], BENCH)
    assert D.matches(empty, one).count() == 0 and D.matches(docs(["a b c d"]), none).count() == 0
    assert D.decontaminated(docs(["a b c d"]), none).count() == 1 and D.decontaminated(empty, none).count() == 0


def test_long_insertions_are_aligned(docs, spark):
    """Nearly an item's length between its halves still leaves a score above the threshold, found from either half's seeds."""
    r = np.random.default_rng(14)
    item = prose(r, 40)
    w = item.split()
    texts = [" ".join([prose(r, 60), *w[:20], prose(r, n), *w[20:], prose(r, 60)]) for n in (10, 25, 34, 70)]
    got = {x.doc_id: x.score for x in D.matches(docs(texts), spark.createDataFrame([(1, item)], BENCH)).collect()}
    want = {i: round(float(D.align(h, np.array([0]), np.array([len(h)]), [C.word_hashes([item])[0]])[0]) / 80, 4) for i, h in enumerate(C.word_hashes(texts))}
    assert want[2] > 0.5 and got == {i: s for i, s in want.items() if s >= 0.5}
