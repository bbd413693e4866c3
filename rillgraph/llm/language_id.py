"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points in lower case; runs of 1 to 3 of them are hashed into ``2**bits`` buckets. Fitting counts buckets
by language over a bounded sample of labelled rows (about ``train_rows`` of each language, chosen by a hash of the id),
partly in each task; the log-probability matrix is broadcast. The priors are the languages' shares of all labelled rows. Scoring treats a batch as a sparse matrix (documents by
buckets, one entry for each n-gram) and multiplies it by that matrix in numpy: gathered rows are summed by document.
Scoring covers every document and its whole text.

Defined results: texts that are null or hold no character but white space, and all texts where no labelled row exists, get
'und' and confidence 0; ties go to the language first in order; null labels and null texts aren't fitted on; a null doc_id
is classified like others and not fitted on; equal rows get equal results; only doc_id, text and lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C


#: Fine enough for a sample of any number of rows.
HASHES = 1 << 62


@dataclass(frozen=True)
class Settings:
    train_rows: int = 2000  #: expected labelled rows of each language that fitting reads
    orders: int = 3
    bits: int = 15
    smooth: float = 0.5


_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def ngrams(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams in text order, those of one order after another for each text, and the texts' bounds."""
    low = [t.lower() for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t) for t in low], np.int64)
    bounds = np.append(0, np.cumsum(length))
    per, h = [], None
    for k in range(s.orders):
        with np.errstate(over="ignore"):
            h = (cp + np.uint32(1)) * _MULT[0] if h is None else ((h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MULT[k % 3] + (cp[k:] + np.uint32(1)) * _MULT[0])
        per.append((((h ^ (h >> np.uint32(16))) * _MULT[2]) >> np.uint32(32 - s.bits)).astype(np.intp))
        if k >= len(cp):
            break
    return per, bounds


def totals(per: list[np.ndarray], bounds: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The sparse product: for each text the sum of the matrix rows of its n-grams."""
    out = np.zeros((len(bounds) - 1, matrix.shape[1]))
    for k, buckets in enumerate(per):
        if len(buckets):
            lo = np.minimum(bounds[:-1], len(buckets))
            hi = np.maximum(lo, bounds[1:] - k)  # an n-gram may not reach into the next text
            some = np.flatnonzero(hi > lo)
            if len(some):
                edge = np.stack([lo[some], hi[some]], axis=1).ravel()
                rows = matrix[buckets]
                if edge[-1] == len(rows):
                    edge = edge[:-1]
                out[some] += np.add.reduceat(rows, edge, axis=0)[::2]
    return out


def share(rows: int, s: Settings) -> int:
    """Of the HASHES values of a row's hash, how many put a row of so many into the sample."""
    return int(min(1.0, s.train_rows / rows) * HASHES)


def train(docs: DataFrame, s: Settings = Settings()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, the log-probability matrix (buckets, languages) and the log priors."""
    known = docs.filter("lang is not null and doc_id is not null")
    langs = sorted(known.groupBy("lang").count().collect())  # a row for each language
    names = [r[0] for r in langs]
    if not names:
        return [], np.zeros((1 << s.bits, 0)), np.zeros(0)
    part = F.lit(None).cast("long")
    for name, n in langs:
        part = F.when(F.col("lang") == name, F.lit(share(n, s))).otherwise(part)
    sample = known.filter((F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < part) & F.col("text").isNotNull()).select("lang", "text")
    at = {name: i for i, name in enumerate(names)}

    def run(batches):
        count = np.zeros((len(names), 1 << s.bits), np.int64)
        for b in batches:
            lang = np.array([at[x] for x in b.column(0).to_pylist()])
            _, off = C.text_buffer(b.column(1))
            for lo, hi in C.steps(off):
                own = lang[lo:hi]
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                for k in np.unique(own):
                    for t in (t for t, x in zip(texts, own) if x == k):
                        per, bounds = ngrams([t], s)
                        for buckets in per:
                            count[k] += np.bincount(buckets, minlength=1 << s.bits)
        k, bucket = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(count[k, bucket])], ["k", "bucket", "n"])

    got = C.arrow(sample).mapInArrow(run, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros((1 << s.bits, len(names)))
    count[got.column(1).to_numpy(), got.column(0).to_numpy()] = got.column(2).to_numpy()
    rows = np.array([n for _, n in langs], float)
    return names, np.log(count + s.smooth) - np.log(count.sum(axis=0) + s.smooth * (1 << s.bits)), np.log(rows / rows.sum())


def classify(texts: list[str], names: list[str], matrix: np.ndarray, prior: np.ndarray, s: Settings) -> tuple[list[str], np.ndarray]:
    if not names:
        return ["und"] * len(texts), np.zeros(len(texts))
    per, bounds = ngrams(texts, s)
    score = totals(per, bounds, matrix) + prior
    best = score.argmax(axis=1)
    p = 1 / np.exp(np.minimum(score - score.max(axis=1, keepdims=True), 0)).sum(axis=1)
    blank = np.array([not t.strip() for t in texts], bool)
    return ["und" if e else names[k] for k, e in zip(best.tolist(), blank)], np.where(blank, 0.0, p)


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, lang, predicted, confidence) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, s))

    def run(batches):
        names, matrix, prior = model.value
        for b in batches:
            text = b.column(2)
            _, off = C.text_buffer(text)
            lang, p = [], []
            for lo, hi in C.steps(off, C.STEP_BYTES // 2):
                x, y = classify([t or "" for t in text.slice(lo, hi - lo).to_pylist()], names, matrix, prior, s)
                lang += x
                p.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(np.concatenate(p) if p else np.zeros(0))], ["doc_id", "lang", "predicted", "confidence"])

    rows = C.arrow(docs.select("doc_id", "lang", "text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("predicted", T.StringType()), T.StructField("confidence", T.DoubleType())]))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
