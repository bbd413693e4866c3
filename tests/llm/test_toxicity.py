import os

import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F
from rillgraph.llm import toxicity as X

DIR = "/root/testdata/sf0.1"


def test_fit_is_ftrl():
    """Against the algorithm written out, coordinate by coordinate."""
    r = np.random.default_rng(5)
    rows = [(np.unique(r.integers(0, 40, 6)), int(r.integers(2))) for _ in range(60)]
    s = X.Settings(epochs=2, l1=0.2)
    seen = {f: sum(f in x for x, _ in rows) for f in range(40)}
    z, n = {}, {}

    def w(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= s.l1 else -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for x, y in rows:
            f = [i for i in x.tolist() if seen[i] > 2] + [2**X.BITS]
            p = 1 / (1 + np.exp(-sum(w(i) for i in f)))
            for i, wi in [(i, w(i)) for i in f]:
                g = p - y
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / s.alpha * wi
                n[i] = old + g * g
    i, v = X.fit(rows, s)
    assert dict(zip(i.tolist(), np.round(v, 9))) == {k: round(w(k), 9) for k in z if w(k)}


@pytest.mark.skipif(not os.path.exists(DIR), reason="no tables")
def test_held_out(spark):
    """With some 2,600 labelled rows, of which 300 are toxic, in four languages; with 16,000 it finds 0.98 (see the README)."""
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod("doc_id", F.lit(3)) == 0
    model = X.toxicity(docs.select("doc_id", "text"), labels.filter(~held)).select("doc_id", F.col("toxic").alias("said"))
    got = model.join(labels.filter(held), "doc_id").groupBy("said", "toxic").count().collect()
    n = {(x.said, x.toxic): x["count"] for x in got}
    hit, miss, wrong, right = (n.get(k, 0) for k in ((True, 1), (False, 1), (True, 0), (False, 0)))
    assert hit / (hit + miss) >= 0.75 and wrong / (wrong + right) <= 0.01, n


def _labelled(docs, spark):
    r = np.random.default_rng(6)
    bad = ["vile slur filth " * int(r.integers(1, 3)) + prose(r, 15) for _ in range(30)]
    d = docs(bad + [prose(r, 20) for _ in range(90)])
    return d, spark.createDataFrame([(i, int(i < 30)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, toxic int")


def test_odd(odd, docs, spark):
    d, labels = _labelled(docs, spark)
    both = d.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    got = X.toxicity(both, labels)
    assert got.columns == [c for c in both.columns if c not in ("toxic", "toxicity")] + ["toxicity", "toxic"]
    rows = got.collect()
    assert all(x.toxicity == 0 and not x.toxic for x in rows if x.text in (None, "", " \t\n", "?! ..."))
    assert {x.doc_id for x in rows if x.toxic} == set(range(30))
    kept = X.without_toxic(both, labels)
    assert kept.columns == both.columns and kept.count() == len(rows) - 30


def test_empty(empty, docs, spark):
    d, labels = _labelled(docs, spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.toxicity(empty, labels).count() == 0 and X.without_toxic(empty, none).count() == 0
    assert {x.toxicity for x in X.toxicity(d, none).collect()} == {0.0} and X.without_toxic(d, none).count() == 120
    assert X.without_toxic(d, labels.filter("toxic = 0")).count() == 120


def test_rare_features_are_a_setting():
    """A feature of one document gets a weight if the setting says so and the L1 term lets it."""
    rows = [(np.array([1, 7]), 1)] + [(np.array([1]), 1)] * 5 + [(np.array([2]), 0)] * 6
    assert 7 not in X.fit(rows, X.Settings(l1=0.1))[0] and 7 in X.fit(rows, X.Settings(l1=0.1, least_docs=1))[0]
