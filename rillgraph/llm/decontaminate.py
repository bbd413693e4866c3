"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

Every place where a seed (run of ``n`` words) of an item occurs leads to a passage, however many documents have that seed: to follow
only the rare ones lost items that occur in edited form alone. An alignment counts +2 for equal words, -1 for others and for gaps; the score is its share
of a whole match. No score is above the share of the item's words that the passage has at all, so passages where that
share is under the threshold aren't aligned; nothing is lost by it. A passage ends where no alignment that reaches the
threshold could go on, so insertions are aligned as long as they may be.

Documents and items are joined on their seeds in one of two ways, with the same result. Benchmarks of at most ``part_bytes`` of text, as all known ones
together, are broadcast as an index: one scan of the corpus, no shuffle, alignment where the text is. Larger ones are joined by a shuffle: a
Bloom filter of the items' seeds (at most 32 MB, however large the benchmark) is broadcast, one scan of the corpus sends on the seeds that pass it, they
meet the items' seeds in an equi-join, whose hot keys adaptive execution splits, and only documents with a candidate are read again, to
cut out its passages, which are joined with their items and aligned.

Defined results: null and wordless texts match nothing, on either side; items of fewer than ``n`` words have no seed and
match nothing; equal items with different ids each match; each of several equal rows is judged alike; ids may be null;
words are compared in lower case without punctuation; texts of any length are searched whole, a text's passages one by
one; empty tables give an empty result. Only doc_id and text of
documents, item_id and text of the benchmark are read; other columns pass through decontaminated unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common as C


def _of_item(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A hash of a word and the item it is looked for in."""
    return C.mix(h + (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Settings:
    n: int = 3
    threshold: float = 0.5
    part_bytes: int = 32_000_000  #: text of a benchmark that is broadcast


class Items:
    """Items' words and seeds; what is broadcast."""

    def __init__(self, ids: pa.Array, texts: list[str | None], n: int):
        self.n, self.ids, self.words = n, ids, C.word_hashes(texts)
        seeds, item, at = [], [], []
        for k, h in enumerate(self.words):
            s, first = C.shingles(h, np.array([0, len(h)]), n)
            seeds.append(s)
            item.append(np.full(len(s), k))
            at.append(first)
        seeds, item, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, item, at))
        order = np.argsort(seeds.astype(np.uint64), kind="stable")
        self.seed, self.item, self.at = seeds.astype(np.uint64)[order], item[order], at[order]
        self.distinct, self.first = np.unique(self.seed, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.seed)))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seed >> np.uint64(44)).astype(np.int64)] = True
        self.size = np.array([len(w) for w in self.words], np.int64)
        own = _of_item(np.concatenate([*self.words, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(self.words)), self.size))
        #: each item's distinct words and how often it has them
        self.own, self.times = np.unique(own, return_counts=True)

    def found(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words at which a seed begins, and the seed's index in distinct."""
        s, first = C.shingles(h, bounds, self.n)
        could = np.flatnonzero(self.maybe[(s >> np.uint64(44)).astype(np.int64)])
        if not len(could) or not len(self.distinct):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.distinct, s[could]), len(self.distinct) - 1)
        hit = self.distinct[k] == s[could]
        return first[could[hit]], k[hit]

    def shared(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, most: int = 1_000_000) -> np.ndarray:
        """How many words passages h[lo:hi] and items have in common, in any order; repeated words count as often as both have them."""
        out = np.zeros(len(lo), np.int64)
        for a, b in C.steps(np.append(0, np.cumsum(hi - lo)), most):
            n = hi[a:b] - lo[a:b]
            passage = np.repeat(np.arange(a, b), n)
            word = h[np.arange(n.sum()) + np.repeat(lo[a:b] - (np.cumsum(n) - n), n)]
            key = _of_item(word, item[passage])
            k = np.minimum(np.searchsorted(self.own, key), len(self.own) - 1)
            hit = self.own[k] == key
            pair, times = np.unique(passage[hit] * len(self.own) + k[hit], return_counts=True)
            np.add.at(out, pair // len(self.own), np.minimum(times, self.times[pair % len(self.own)]))
        return out

    def matches(self, h: np.ndarray, bounds: np.ndarray, threshold: float, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, score) of every document and item that share a seed and reach the threshold; the best of its passages."""
        place, k = self.found(h, bounds)
        doc = np.searchsorted(bounds, place, "right") - 1
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        # whole documents with so many seeds of items, or one document
        before = np.append(0, np.cumsum(self.count[k]))
        cut = np.searchsorted(doc, np.arange(len(bounds)))
        for lo, hi in C.steps(before[cut], most):
            if cut[lo] < cut[hi]:
                got.append(self._matches(h, bounds, place[cut[lo] : cut[hi]], k[cut[lo] : cut[hi]], threshold))
        return tuple(np.concatenate(x) for x in zip(*got))

    def _matches(self, h: np.ndarray, bounds: np.ndarray, place: np.ndarray, k: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        times = self.count[k]
        entry = np.repeat(self.first[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        place, item, at = np.repeat(place, times), self.item[entry], self.at[entry]
        doc = np.searchsorted(bounds, place, "right") - 1
        begin = place - at  # where the item would begin
        order = np.lexsort((begin, item, doc))
        doc, item, begin = doc[order], item[order], begin[order]
        size = self.size[item]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        doc, item, size = doc[first], item[first], size[first]
        # an alignment that reaches the threshold has gaps of at most 2 * (1 - threshold) * size words, on both sides together
        slack = np.ceil(2 * (1 - threshold) * size).astype(np.int64)
        lo = np.maximum(bounds[doc], begin[first] - slack)
        hi = np.minimum(bounds[doc + 1], begin[last] + size + slack)
        could = self.shared(h, lo, hi, item) / size >= threshold
        doc, item, size, lo, hi = doc[could], item[could], size[could], lo[could], hi[could]
        score = align(h, lo, hi, [self.words[x] for x in item]) / (2 * size)
        good = score >= threshold
        doc, item, score = doc[good], item[good], score[good]
        order = np.lexsort((-score, item, doc))
        doc, item, score = doc[order], item[order], score[order]
        best = np.ones(len(doc), bool)
        best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        return doc[best], item[best], score[best]


def align(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, items: list[np.ndarray], cells: int = 2_000_000) -> np.ndarray:
    """Smith-Waterman scores of passages h[lo:hi] against items, many pairs at once, an item's word at a time."""
    best = np.zeros(len(lo))
    if not len(lo):
        return best
    wide, tall = hi - lo, np.array([len(x) for x in items])
    order = np.lexsort((tall, wide))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * wide[order[b]] <= cells:
            b += 1
        own = order[a:b]
        w, t = int(wide[own].max()), int(tall[own].max())
        col = np.arange(w)
        text = np.where(col < wide[own][:, None], h[np.minimum(lo[own][:, None] + col, len(h) - 1)], np.uint64(0))
        there = col < wide[own][:, None]
        row = np.zeros((len(own), w + 1), np.int32)
        top = np.zeros(len(own), np.int32)
        slope = np.arange(w + 1, dtype=np.int32)
        for j in range(t):
            word = np.array([items[p][j] if j < len(items[p]) else 0 for p in own], np.uint64)
            live = (tall[own] > j)[:, None]
            gain = np.where((text == word[:, None]) & there & live, 2, -1).astype(np.int32)
            fresh = np.zeros_like(row)
            fresh[:, 1:] = np.maximum(row[:, :-1] + gain, row[:, 1:] - 1)
            np.maximum(fresh, 0, out=fresh)
            fresh = np.maximum.accumulate(fresh + slope, axis=1) - slope  # gaps along the passage
            row = np.where(live, np.maximum(fresh, 0), row)
            top = np.maximum(top, row.max(axis=1))
        best[own] = top
        a = b
    return best


def index(benchmark: DataFrame, s: Settings):
    """A broadcast index of the benchmark's seeds, or None if it is too large."""
    known = benchmark.filter("text is not null").select("item_id", "text")
    if (known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > s.part_bytes:
        return None
    own = known.toArrow().sort_by("item_id")  # at most part_bytes
    return benchmark.sparkSession.sparkContext.broadcast(Items(own.column(0).combine_chunks(), own.column(1).to_pylist(), s.n))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32)), pa.array(flat))


def _words_of(column: pa.Array) -> list[np.ndarray]:
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(off[:-1], off[1:])]


def item_words(benchmark: DataFrame) -> DataFrame:
    """item (a number of its own), item_id and words (hashes) of each item with a text."""
    kind = dict(benchmark.dtypes)["item_id"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(C.word_hashes(b.column(1).to_pylist()))], ["item_id", "words"])

    rows = C.arrow(benchmark.filter("text is not null").select("item_id", "text")).mapInArrow(run, f"item_id {kind}, words array<long>")
    return C.saved(rows.withColumn("item", F.monotonically_increasing_id()))


def item_seeds(items: DataFrame, n: int) -> DataFrame:
    """(seed, item, at, size) of every place of a seed in an item of so many words."""

    def run(batches):
        for b in batches:
            out = [(*C.shingles(h, np.array([0, len(h)]), n), k, len(h)) for k, h in zip(b.column(0).to_pylist(), _words_of(b.column(1)))]
            times = [len(x[0]) for x in out]
            seed, at = (np.concatenate([*(x[j] for x in out), np.zeros(0, t)]) for j, t in ((0, np.uint64), (1, np.int64)))
            columns = [pa.array(seed.view(np.int64)), *(pa.array(np.repeat([x[j] for x in out], times).astype(np.int64)) for j in (2, 3)), pa.array(at)]
            yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[3], columns[2]], ["seed", "item", "at", "size"])

    return C.arrow(items.select("item", "words")).mapInArrow(run, "seed long, item long, at long, size long")


def bloom(seeds: DataFrame, most_bits: int = 28) -> np.ndarray:
    """A Bloom filter of the seeds with two bits each, of at most 2**most_bits bits."""
    bits = 1 << min(most_bits, max(16, (16 * seeds.count()).bit_length()))
    where = F.explode(F.array(F.col("seed"), F.shiftrightunsigned("seed", 32))).alias("p")
    at = seeds.select(where).select(F.col("p").bitwiseAND(F.lit(bits - 1)).alias("p"))
    got = at.groupBy((F.shiftright("p", 6)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out


def passes(filter_: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    ok = np.ones(len(seeds), bool)
    for x in (seeds, seeds >> np.uint64(32)):
        p = x & np.uint64(64 * len(filter_) - 1)
        ok &= (filter_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def joined(docs: DataFrame, benchmark: DataFrame, s: Settings) -> DataFrame:
    """(_key, doc_id, item_id, item, score) by shuffles, for benchmarks of any size; _key is the row_key."""
    items = item_words(benchmark)
    seeds = C.saved(item_seeds(items, s.n))
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom(seeds))

    def hits(batches):
        for b in batches:
            buf, off = C.text_buffer(b.column(1))
            for lo, hi in C.steps(off):
                _, _, h, bounds = C.words(buf, off[lo : hi + 1])
                seed, first = C.shingles(h, bounds, s.n)
                ok = passes(filter_.value, seed)
                doc = np.searchsorted(bounds, first[ok], "right") - 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + lo)), pa.array(seed[ok].view(np.int64)), pa.array(first[ok] - bounds[doc])], ["_key", "seed", "place"])

    keyed = docs.select(C.row_key().alias("_key"), "doc_id", "text").filter("text is not null")
    found = C.arrow(keyed.select("_key", "text").dropDuplicates(["_key"])).mapInArrow(hits, "_key binary, seed long, place long")
    begins = found.join(seeds, "seed").select("_key", "item", "size", (F.col("place") - F.col("at")).alias("begin"))
    w = Window.partitionBy("_key", "item").orderBy("begin")
    new = F.coalesce((F.col("begin") - F.lag("begin").over(w) > F.col("size")).cast("int"), F.lit(1))
    cut = begins.withColumn("_new", new).withColumn("_passage", F.sum("_new").over(w)).groupBy("_key", "item", "_passage")
    slack = F.ceil(2 * (1 - s.threshold) * F.col("size"))
    ends = cut.agg(F.min("begin").alias("a"), F.max("begin").alias("b"), F.first("size").alias("size")).select("_key", F.struct("item", (F.col("a") - slack).alias("lo"), (F.col("b") + F.col("size") + slack).alias("hi")).alias("c"))
    wanted = C.saved(ends.groupBy("_key").agg(F.collect_list("c").alias("cs")))  # the passages of one document
    kind = dict(docs.dtypes)["doc_id"]

    def passages(batches):
        for b in batches:
            buf, off = C.text_buffer(b.column(2))
            for lo, hi in C.steps(off):
                _, _, h, bounds = C.words(buf, off[lo : hi + 1])
                rows = []
                for d, cs in enumerate(b.column(3).slice(lo, hi - lo).to_pylist()):
                    own = h[bounds[d] : bounds[d + 1]]
                    rows += [(lo + d, c["item"], own[max(0, c["lo"]) : c["hi"]]) for c in cs]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows], pa.int64()), _lists([r[2] for r in rows])], ["_key", "doc_id", "item", "passage"])

    # row by row: of equal rows each gives its own
    some = keyed.join(wanted, "_key").select("_key", "doc_id", "text", "cs")
    cut_out = C.arrow(some).mapInArrow(passages, f"_key binary, doc_id {kind}, item long, passage array<long>")

    def scored(batches):
        for b in batches:
            texts, own = _words_of(b.column("passage")), _words_of(b.column("words"))
            end = np.cumsum([len(t) for t in texts])
            start = end - [len(t) for t in texts]
            score = align(np.concatenate([*texts, np.zeros(0, np.uint64)]), start, end, own) / (2 * np.array([len(x) for x in own]))
            yield b.select(["_key", "doc_id", "item_id", "item"]).append_column("score", pa.array(np.round(score, 4))).filter(pa.array(score >= s.threshold))

    pairs = C.arrow(cut_out.join(items, "item").select("_key", "doc_id", "item_id", "passage", "words", "item"))
    kinds = T.StructType([*pairs.schema.fields[:3], pairs.schema["item"], T.StructField("score", T.DoubleType())])
    return pairs.mapInArrow(scored, kinds)


def matches(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, score) of every document and item whose best alignment reaches the threshold. Of equal rows each is
    reported where the index is broadcast, and one where the benchmark is joined by a shuffle."""
    at = index(benchmark, s)
    if at is None:
        best = joined(docs, benchmark, s).groupBy("_key", "doc_id", "item_id", "item").agg(F.max("score").alias("score"))
        return best.select("doc_id", "item_id", "score")
    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, score double"

    def run(batches):
        for b in batches:
            buf, off = C.text_buffer(b.column(1))
            for lo, hi in C.steps(off):
                _, _, h, bounds = C.words(buf, off[lo : hi + 1])
                doc, item, score = at.value.matches(h, bounds, s.threshold)
                if len(doc):
                    columns = [b.column(0).take(pa.array(doc + lo)), at.value.ids.take(pa.array(item)), pa.array(np.round(score, 4))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score"])

    return C.arrow(docs.select("doc_id", "text")).mapInArrow(run, kinds)


def decontaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without those that match an item."""
    found = index(benchmark, s)
    if found is None:
        return C.without(docs, C.saved(joined(docs, benchmark, s).select("_key").distinct()))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            buf, off = C.text_buffer(b.column(at))
            clean = np.ones(b.num_rows, bool)
            for lo, hi in C.steps(off):
                _, _, h, bounds = C.words(buf, off[lo : hi + 1])
                doc, _, _ = found.value.matches(h, bounds, s.threshold)
                clean[doc + lo] = False
            yield b.filter(pa.array(clean))

    return C.arrow(docs).mapInArrow(run, T.StructType(docs.schema.fields))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
