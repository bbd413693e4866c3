"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and the L1 term leave few weights that are not zero; only those are broadcast. Fitting uses a
bounded sample of labelled rows (``train_rows``, by the order of a hash of the id), in one task; scoring covers every
document and every word.

Defined results: a null, empty or wordless text scores 0.0 and is not toxic; a null doc_id is scored like any other; each
of several equal rows gets its own, equal, result; without labels of both kinds, or without documents, every score is 0.0.
Labels with a null id or a null flag are left out; of contradicting labels of one id the toxic one counts. Other columns of
documents are not read. The features of a document are a set, so repeated words count once; texts of any length are scored whole.
Features that fewer than ``least_docs`` of the labelled rows have get no weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

BITS = 20
_SALT = np.uint64(0x51_7C_C1_B7_27_22_0A_95)


@dataclass(frozen=True)
class Settings:
    train_rows: int = 16_000  #: most labelled rows that fitting reads
    epochs: int = 4
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    threshold: float = 0.3
    least_docs: int = 3  #: labelled documents that must have a feature for it to get a weight; 1 leaves all to the L1 term


def features(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their documents: words, pairs of neighbours, and pairs with one or two words between."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out, at = [h], [doc]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            out.append(C.mix(h[:-gap] * _SALT + h[gap:] + np.uint64(gap))[same])
            at.append(doc[gap:][same])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(at)


def distinct(f: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct features of each of n documents, sorted."""
    order = np.argsort(doc, kind="stable")
    f, cut = f[order].astype(np.int32), np.searchsorted(doc[order], np.arange(n + 1))
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        own = np.sort(f[a:b])
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not zero, the bias at index 2**BITS. rows: (distinct features, label)."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    # a feature of fewer documents can't be told from chance; leaving it out keeps the updates short
    common = np.zeros(2**BITS, np.int32)
    for f, _ in rows:
        common[f] += 1
    rows = [(np.append(f[common[f] >= s.least_docs], 2**BITS), y) for f, y in rows]

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for i, y in rows:
            w = weights(i)
            g = _sigmoid(w.sum()) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(2**BITS + 1))
    keep = np.flatnonzero(w)
    return keep, w[keep]


def score(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Scores of the documents in buf; table: weight by feature, the bias last."""
    out = []
    for lo, hi in C.steps(off):
        _, _, h, bounds = C.words(buf, off[lo : hi + 1])
        f, doc = features(h, bounds)
        hit = np.flatnonzero(table[f])
        key = np.unique(doc[hit] * 2**BITS + f[hit])
        total = np.bincount(key >> BITS, table[key & (2**BITS - 1)], minlength=hi - lo) + table[-1]
        out.append(np.where(np.diff(bounds) > 0, _sigmoid(total), 0.0))
    return np.concatenate(out) if out else np.zeros(0)


def train(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most train_rows labelled documents, in one task; only the weights come back."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.train_rows)
    )
    # the sample's size is bounded by train_rows, whatever the tables' size
    sample = C.arrow(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").select("doc_id", "text", "y"))

    def one(batches):
        rows = []
        for b in batches:
            buf, off = C.text_buffer(b.column(1))
            ids, y = b.column(0).to_pylist(), b.column(2).to_pylist()
            for lo, hi in C.steps(off):
                _, _, h, bounds = C.words(buf, off[lo : hi + 1])
                f, doc = features(h, bounds)
                for d, own in enumerate(distinct(f, doc, hi - lo)):
                    rows.append((ids[lo + d], own, y[lo + d]))
        rows.sort(key=lambda r: (hash_id(r[0]), len(r[1]), r[1].tobytes()))
        if len({r[2] for r in rows}) == 2:
            i, w = fit([(f, v) for _, f, v in rows], s)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w)], ["i", "w"])

    got = sample.repartition(1).mapInArrow(one, "i long, w double").toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def hash_id(i: int) -> int:
    """A fixed shuffling of the ids, for the order of fitting."""
    return int(C.mix(np.array([i], np.int64).view(np.uint64))[0])


def toxicity(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """documents with two more columns: toxicity (probability) and toxic (at least the threshold)."""
    spark: SparkSession = documents.sparkSession
    model = spark.sparkContext.broadcast(train(documents, labels, s))
    schema = documents.schema

    def run(batches):
        i, w = model.value
        table = np.zeros(2**BITS + 1)
        table[i] = w
        names = None
        for b in batches:
            names = names or b.schema.names
            buf, off = C.text_buffer(b.column(names.index("text")))
            p = score(buf, off, table) if len(i) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(p >= s.threshold)], [*names, "toxicity", "toxic"])

    clash = [c for c in documents.columns if c in ("toxicity", "toxic")]
    out = C.arrow(documents.drop(*clash))
    kept = T.StructType([f for f in schema.fields if f.name not in clash])
    return out.mapInArrow(run, T.StructType([*kept.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic", T.BooleanType())]))


def without_toxic(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """documents without the toxic ones, its columns unchanged."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, s))
    at = documents.columns.index("text")

    def run(batches):
        i, w = model.value
        table = np.zeros(2**BITS + 1)
        table[i] = w
        for b in batches:
            yield b.filter(pa.array(score(*C.text_buffer(b.column(at)), table) < s.threshold)) if len(i) else b

    return C.arrow(documents).mapInArrow(run, documents.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs.select("doc_id", "text"), labels).select("doc_id", "toxicity", "toxic")
