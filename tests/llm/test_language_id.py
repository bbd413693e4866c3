import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from rillgraph.llm import language_id as L

DIR = "/root/testdata/sf0.01"


def _bucket(gram, s):
    """The bucket of one n-gram, in whole numbers."""
    h = None
    for k, c in enumerate(map(ord, gram)):
        x = (c + 1) * 0x9E3779B1 % 2**32
        h = x if h is None else ((h ^ (h >> 15)) * (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)[k % 3] + x) % 2**32
    return (((h ^ (h >> 16)) * 0xC2B2AE35) % 2**32) >> (32 - s.bits)


def test_ngrams_against_whole_numbers():
    s = L.Settings()
    for t in ("Wasser des Flusses", "é中😀 a", "x", ""):
        low = t.lower()
        want = [[_bucket(low[i : i + k + 1], s) for i in range(len(low) - k)] for k in range(s.orders)]
        assert [p.tolist() for p in L.ngrams([t], s)[0]] == want[: len(L.ngrams([t], s)[0])]


def _brute(texts, names, counts, prior, s):
    """Naive Bayes n-gram by n-gram."""
    total = counts.sum(axis=0)
    out = []
    for t in texts:
        score = np.array(prior)
        for per in L.ngrams([t], s)[0]:
            for b in per:
                score += np.log(counts[b] + s.smooth) - np.log(total + s.smooth * 2**s.bits)
        out.append(names[int(score.argmax())] if t.strip() else "und")
    return out


SENTENCES = {
    "en": ["the water of the river is cold", "she went to the market with her brother", "what do you think of this", "there is nothing that we could have done"],
    "de": ["das wasser des flusses ist kalt", "sie ging mit ihrem bruder auf den markt", "was denkst du darüber", "wir hätten nichts dagegen tun können"],
    "fr": ["l'eau de la rivière est froide", "elle est allée au marché avec son frère", "que penses-tu de cela", "nous n'aurions rien pu faire"],
}


def test_against_brute_force(docs):
    texts = [t for v in SENTENCES.values() for t in v] + ["", "x", "ab", "é", "water wasser eau"]
    langs = [k for k, v in SENTENCES.items() for _ in v] + [None] * 5
    s = L.Settings()
    names, counts = sorted(SENTENCES), np.zeros((2**s.bits, 3))
    for t, k in zip(texts, langs):
        if k:
            for per in L.ngrams([t], s)[0]:
                np.add.at(counts[:, names.index(k)], per, 1)
    got = {x.doc_id: x.predicted for x in L.identify(docs(texts, langs), s).collect()}
    assert [got[i] for i in range(len(texts))] == _brute(texts, names, counts, np.log([1 / 3] * 3), s)


def test_ngrams_stay_in_their_text():
    s = L.Settings()
    m = np.random.default_rng(13).random((2**s.bits, 2))
    texts = ["abc", "", "d", "ef", "ghij", ""]
    together = L.totals(*L.ngrams(texts, s), m)
    alone = np.concatenate([L.totals(*L.ngrams([t], s), m) for t in texts])
    assert np.allclose(together, alone)


@pytest.mark.skipif(not os.path.exists(DIR), reason="no tables")
def test_held_out(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    hidden = d.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("lang")))
    got = L.identify(hidden).join(d.select("doc_id", F.col("lang").alias("truth")), "doc_id").filter("lang is null and predicted <> 'und'")
    right, n = got.agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")), F.count("*")).first()
    assert n > 300 and right >= 0.95


def test_odd(odd):
    got = L.identify(odd.withColumn("lang", F.when(F.col("doc_id") == 6, "en").when(F.col("doc_id") == 7, "xx")).withColumn("predicted", F.lit("own"))).collect()
    assert len(got) == odd.count()
    assert all((x.predicted, x.confidence) == ("und", 0.0) for x in got if x.doc_id in (1, 2, 3))
    assert all(x.predicted in ("en", "xx", "und") for x in got)
    assert len({(x.predicted, x.confidence) for x in got if x.doc_id == 6}) == 1


def test_no_labels_and_empty(docs, empty):
    assert {x.predicted for x in L.identify(docs(["a b", "c"])).collect()} == {"und"}
    assert L.identify(empty).count() == 0


def test_priors_decide_where_texts_do_not(docs):
    """A character that no labelled text has is as likely in each language but for their sizes; the more frequent wins."""
    texts = ["abc def"] * 9 + ["abc def"] * 3 + ["abc"]
    got = {x.doc_id: x for x in L.identify(docs(texts, ["b"] * 9 + ["a"] * 3 + [None])).collect()}
    assert got[12].predicted == "b" and got[12].confidence > 0.7


def test_sample_size_of_any_number_of_rows():
    s = L.Settings()
    assert L.share(10, s) == L.HASHES
    for rows in (10**4, 10**9, 1_500_000_000, 3 * 10**9, 10**12):
        assert abs(rows * L.share(rows, s) / L.HASHES - s.train_rows) < 1, rows
