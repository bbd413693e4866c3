"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has 256 bits, the signs of the sums of its distinct words' hash bits. Documents meet in blocks
that share some random bits of the fingerprint; the number of bits grows with the corpus so that blocks keep their size,
and the number of such choices is what pairs at ``radius`` differing bits, the hardest to find, need for the wanted recall. A block stores its
bit planes vertically, 64 documents to a machine word; each plane's differences are added to carry-save counters that
overflow just above the radius; queries all of whose counters have overflowed are abandoned. Blocks send one edge per
document that has a partner, and connected components of the edges are the groups.

Equal fingerprints are one node, so copies cost nothing here however many there are. A block of more than ``most`` unlike
fingerprints, as a template with many fillings makes, is cut into chunks by a hash, and every two chunks of it meet in a
task of their own: no task holds more than about twice ``most`` and every pair of a block is still compared, so no partner or
candidate is capped. Which blocks are that large is estimated from the counts of every sixteenth fingerprint; the estimate decides
only how the comparing is divided, not what is compared. The work in such a block stays quadratic.

Defined results: texts without a word (null and empty ones too) have no fingerprint and are in no group; rows equal in id
and text are one document; a null doc_id takes part, is last in order and so is kept only if all ids of its group are null;
equal fingerprints are distance 0; an empty table gives an empty result. The smallest doc_id of a group is kept. Only
doc_id and text are read; other columns pass through near_dedup unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS = 4
BITS = 64 * WORDS
_LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


@dataclass(frozen=True)
class Settings:
    radius: int = 44  #: most bits that differ between near-duplicates
    recall: float = 0.95  #: of pairs at the radius; nearer ones have more
    block: int = 256  #: documents of a block, if bits were even
    most: int = 16_384  #: fingerprints of a block that one task compares
    seed: int = 5


def fingerprints(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) fingerprints of the documents in buf, and whether each has a word."""
    out, some = [], []
    for lo, hi in C.steps(off, C.STEP_BYTES // 2):
        _, _, h, bounds = C.words(buf, off[lo : hi + 1])
        n, doc = hi - lo, np.repeat(np.arange(hi - lo), np.diff(bounds))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        cut = np.searchsorted(doc, np.arange(n + 1))
        count = np.diff(cut)
        # runs of at most 255 words, whose bits are added eight lanes of a byte at a time
        runs = (count + 254) // 255
        starts = np.repeat(cut[:-1], runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        docs = np.repeat(np.arange(n), runs)
        fp = np.zeros((n, WORDS), np.uint64)
        if len(starts):
            first = np.searchsorted(docs, np.arange(n)[count > 0])
            for w in range(WORDS):
                with np.errstate(over="ignore"):
                    x = C.mix(h + np.uint64(w + 1) * np.uint64(0x9E3779B97F4A7C15))
                lanes = np.add.reduceat(_LANES[x.view(np.uint8).reshape(-1, 8)], starts, axis=0)
                ones = np.add.reduceat(lanes.view(np.uint8).reshape(len(starts), 64).astype(np.int32), first, axis=0)
                fp[count > 0, w] = np.packbits(2 * ones > count[count > 0, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        out.append(fp)
        some.append(count > 0)
    return (np.concatenate(out), np.concatenate(some)) if out else (np.zeros((0, WORDS), np.uint64), np.zeros(0, bool))


def _carry_save(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(fp: np.ndarray, radius: int, every: int = 32, rows: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of the fingerprints that differ in at most radius bits, by vertical counters."""
    n = len(fp)
    width, bits = (n + 63) // 64, fp.view(np.uint8).reshape(n, -1)
    level = max(4, (radius + 1).bit_length() if (radius + 1) & radius else radius.bit_length())
    start = 2**level - 1 - radius  # so that a counter overflows at radius + 1
    spread = np.unpackbits(bits, axis=1, bitorder="little")
    padded = np.zeros((width * 64, BITS), np.uint8)
    padded[:n] = spread
    planes = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    flips = np.where(spread.T == 1, full, np.uint64(0))
    tail = np.full(width, full, np.uint64)
    if n % 64:
        tail[-1] = np.uint64((1 << (n % 64)) - 1)
    step = max(1, min(n, rows // width))
    for a in range(0, n, step):
        b, left = min(n, a + step), a // 64
        q = np.arange(a, b)
        shape = (b - a, width - left)
        value = [np.full(shape, full if (start >> k) & 1 else np.uint64(0), np.uint64) for k in range(level)]
        over = np.zeros(shape, np.uint64)
        for p in range(0, BITS, 8):
            x = [planes[p + k, left:][None, :] ^ flips[p + k, q][:, None] for k in range(8)]
            ones, two_a = _carry_save(value[0], x[0], x[1])
            ones, two_b = _carry_save(ones, x[2], x[3])
            twos, four_a = _carry_save(value[1], two_a, two_b)
            ones, two_a = _carry_save(ones, x[4], x[5])
            value[0], two_b = _carry_save(ones, x[6], x[7])
            value[1], four_b = _carry_save(twos, two_a, two_b)
            value[2], carry = _carry_save(value[2], four_a, four_b)
            for k in range(3, level):
                carry, value[k] = carry & value[k], carry ^ value[k]
            over |= carry
            if p + 8 >= 2 * radius and (p + 8) % every == 0:
                alive = ((~over & tail[left:]) != 0).sum(axis=1) > (1 if p + 8 < BITS else 0)  # beside itself
                one = ~alive
                if one.any():  # one word may hold both the query and partners
                    own = ~over[one] & tail[left:]
                    own[np.arange(len(own)), q[one] // 64 - left] &= ~(np.uint64(1) << (q[one] % 64).astype(np.uint64))
                    alive[one] = own.any(axis=1)
                if not alive.any():
                    q = q[:0]
                    break
                if alive.mean() < 0.7:
                    q, over, value = q[alive], over[alive], [v[alive] for v in value]
        if len(q):
            near = ~over & tail[left:]
            r, w = np.nonzero(near)
            i = np.repeat(q[r], 64)
            j = (np.repeat((w + left) * 64, 64).reshape(-1, 64) + np.arange(64)).ravel()
            hit = np.unpackbits(near[r, w].view(np.uint8), bitorder="little").astype(bool) & (j > i)
            yield i[hit], j[hit]


def roots(n: int, fp: np.ndarray, radius: int) -> np.ndarray:
    """For each of n fingerprints the smallest index in its component of pairs within radius."""
    label = np.arange(n)
    for i, j in within(fp, radius):
        while len(i):
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while not np.array_equal(label, label[label]):
                label = label[label]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    return label


def plan(n: int, s: Settings) -> list[np.ndarray]:
    """The bits of each choice for n fingerprints."""
    k = min(32, max(4, round(math.log2(max(2, n) / s.block))))
    q = math.prod((BITS - s.radius - i) / (BITS - i) for i in range(k))  # that none of the bits differs
    m = max(1, math.ceil(math.log(1 - s.recall) / math.log(1 - q)))
    rng = np.random.default_rng(s.seed)
    return [np.sort(rng.choice(BITS, k, replace=False)) for _ in range(m)]


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, _key and f0..f3 of the documents that have a word."""

    def run(batches):
        for b in batches:
            buf, off = C.text_buffer(b.column(2))
            fp, some = fingerprints(buf, off)
            keep = pa.array(some)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(fp[:, w].view(np.int64)) for w in range(WORDS))], ["doc_id", "_key", *PRINT]).filter(keep)

    kind = dict(docs.dtypes)["doc_id"]
    return C.arrow(docs.select("doc_id", C.row_key().alias("_key"), "text")).mapInArrow(run, f"doc_id {kind}, _key binary, f0 long, f1 long, f2 long, f3 long")


PRINT = ["f0", "f1", "f2", "f3"]
SAMPLED = 16


def blocks(reps: DataFrame, choices: list[np.ndarray]) -> DataFrame:
    """_block, rep and f0..f3: a row for each choice of bits."""

    def run(batches):
        for b in batches:
            fp = np.stack([b.column(k).to_numpy() for k in range(1, 5)], axis=1)
            spread = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
            for band, bits in enumerate(choices):
                block = (spread[:, bits].astype(np.int64) << np.arange(len(bits))).sum(axis=1) * len(choices) + band
                yield pa.RecordBatch.from_arrays([pa.array(block), *b.columns], ["_block", "rep", *PRINT])

    return reps.select("rep", *PRINT).mapInArrow(run, "_block long, rep long, f0 long, f1 long, f2 long, f3 long")


def divided(bands: DataFrame, sample: DataFrame, s: Settings) -> DataFrame:
    """bands with _cell: rows of a block that meet. Large blocks have a cell for every two of their chunks."""
    large = C.saved(sample.groupBy("_block").agg((F.count("*") * SAMPLED).alias("_n")).filter(F.col("_n") > s.most).select("_block", F.ceil(F.col("_n") / s.most).cast("int").alias("_chunks")))
    if large.isEmpty():
        return bands.withColumn("_cell", F.lit(0).cast("long"))
    own = F.pmod(F.xxhash64("rep", F.lit(1)), F.coalesce("_chunks", F.lit(1))).cast("long")
    cells = F.transform(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1), lambda j: F.least(own, j.cast("long")) * F.lit(1 << 31) + F.greatest(own, j.cast("long")))
    return bands.join(C.checked_broadcast(large, 16), "_block", "left").withColumn("_cell", F.explode(cells)).drop("_chunks")


def edges(reps: DataFrame, n: int, s: Settings) -> DataFrame:
    """(u, v) with v the root of u in some block, for fingerprints reps(rep, f0..f3) without equals."""
    choices = plan(n, s)
    # each of these small rows becomes one of about 50 bytes for every choice
    tasks = max(n * len(choices) * 50 // 128_000_000, min(n // 5000, 2 * reps.sparkSession.sparkContext.defaultParallelism))
    reps = reps.repartition(1 + tasks, "rep")
    sample = blocks(reps.filter(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0), choices)
    bands = divided(blocks(reps, choices), sample, s).select("_block", "_cell", "rep", *PRINT)

    def run(batches):
        def compared(block):
            keys = block[:, 2]
            if len(keys) > 1:
                label = roots(len(keys), np.ascontiguousarray(block[:, 3:]).view(np.uint64), s.radius)
                m = label != np.arange(len(label))
                return keys[m], keys[label[m]]
            return keys[:0], keys[:0]

        rest: list[np.ndarray] = []  # the pieces of the block that isn't over yet
        u, v = [], []
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in b.columns], axis=1)
            cut = np.append(0, np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1)
            if rest and not (rest[-1][-1, :2] == rows[0, :2]).all():
                cut = np.append(0, cut)  # the block that was open ended with the last batch
            for x, y in zip(cut[:-1], cut[1:]):
                p, q = compared(np.concatenate([*rest, rows[x:y]]))
                rest = []
                u.append(p)
                v.append(q)
            rest.append(rows[cut[-1] :])
            if sum(map(len, u)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])
                u, v = [], []
        if rest:
            p, q = compared(np.concatenate(rest))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*u, p])), pa.array(np.concatenate([*v, q]))], ["u", "v"])

    return bands.repartition("_block", "_cell").sortWithinPartitions("_block", "_cell").mapInArrow(run, "u long, v long")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected pairs(u, v), root the smallest; alternating large and small stars."""
    now = C.saved(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = C.saved(small.filter("u <> v").distinct())


def grouped(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, _key, and id and key of the one kept, of every document in a group of two or more rows."""
    prints = C.saved(fingerprint_table(docs))
    # ids of the distinct fingerprints; the checkpoint fixes them
    reps = C.saved(prints.groupBy(*PRINT).agg(F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    near = edges(reps, reps.count(), s)
    roots_ = components(near)
    label = reps.join(roots_, F.col("rep") == F.col("node"), "left").filter("n > 1 or root is not null").select(*PRINT, F.coalesce("root", "rep").alias("root"))
    members = C.saved(prints.join(label, PRINT).select("doc_id", "_key", "root"))
    keep = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("k"))
    return members.join(keep, "root").select("doc_id", "_key", F.col("k.doc_id").alias("keep_id"), F.col("k._key").alias("keep_key"))


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, duplicate_of) of every document of a group but the one that is kept."""
    return grouped(docs, s).filter("doc_id is not null and doc_id <> keep_id").select("doc_id", F.col("keep_id").alias("duplicate_of")).distinct()


def near_dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with one document of each group."""
    return C.without(docs, C.saved(grouped(docs, s).filter("_key <> keep_key").select("_key")))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
