"""Incremental ingestion. Micro-batches upsert by key into the store, so a batch that is run again changes nothing.

The file source doesn't see deletions; ``reconcile`` compares a whole listing with what was scanned and drops the rest.
Matching across domains depends on all candidates, so ``restitch`` runs it on the stored snapshot after a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stitch as M
from ..operators.store import Store, scan_states
from ..shared import saved
from ..sources import documents, files
from ..sources.files import MAX_BYTES, skipped

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """The stream of files under root, new and changed ones."""
    s = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    relative = F.regexp_replace("path", "^(?:[a-z]+:)?/*" + root.split(":", 1)[-1].strip("/") + "/", "")
    rows = s.filter(F.col("length") <= MAX_BYTES).select(relative.alias("path"), F.decode("content", "UTF-8").alias("text"), F.hex(F.xxhash64("content")).alias("hash"), F.col("modificationTime").alias("modified"))
    return rows.filter(~skipped())


def store_batch(store: Store) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what the files of a batch hold replaces what the store has of them."""

    def batch(df: DataFrame, _: int) -> None:
        latest = saved(df.groupBy("path").agg(F.max_by("text", "modified").alias("text"), F.max_by("hash", "modified").alias("hash"), F.max("modified").alias("modified")))
        nodes, edges = documents.ingested(latest)
        now = F.current_timestamp()
        scans = latest.select(F.col("path").alias("file_path"), F.col("hash").alias("file_hash"), F.col("modified").alias("last_scanned"))
        store.replace_files(latest.select("path"), nodes.withColumn("created_at", now), edges.withColumn("created_at", now), scans)

    return batch


def start(stream: DataFrame, store: Store, checkpoint: str, every: str | None = None):
    """The running query; without ``every`` it ends when all files there are done."""
    w = stream.writeStream.foreachBatch(store_batch(store)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def reconcile(spark: SparkSession, store: Store, root: str) -> DataFrame:
    """Drop files that are gone; gives the (path, state) of all.

    The listing reads no content; only files whose time isn't that of their last scan, and new ones, are read and hashed."""
    scans = saved(store.read("scan_metadata"))
    listing = files.listed(spark, root)
    same = listing.join(scans.select(F.col("file_path").alias("path"), F.col("last_scanned").alias("modified"), F.col("file_hash").alias("hash")), ["path", "modified"])
    rest = listing.join(same.select("path"), "path", "left_anti").select("path")
    read = files.discover(spark, root, only=rest).select("path", "hash")
    states = saved(scan_states(same.select("path", "hash").unionByName(read), scans))
    store.delete_files(states.filter("state = 'deleted'").select("path"))
    return states


def restitch(store: Store, min_confidence: float = 0.5) -> None:
    """Replace the matched edges by those of the current snapshot."""
    plain = store.read("edges").filter("match_strategy is null")
    found = M.stitch(store.read("nodes"), min_confidence)
    missing = [c for c in plain.columns if c not in found.columns]
    found = found.select("*", *(F.lit(None).cast(plain.schema[c].dataType).alias(c) for c in missing)).select(*plain.columns)
    store.write("edges", plain.unionByName(found))


def lineage_events(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """A stream of OpenLineage events, each (run, type) once within the watermark."""
    raw = spark.readStream.schema("value string").text(folder)
    e = raw.select(F.from_json("value", documents.EVENT).alias("e")).filter("e.job.name is not null")
    timed = e.withColumn("time", F.to_timestamp("e.eventTime")).withColumn("run", F.col("e.run.runId")).withColumn("type", F.col("e.eventType"))
    return timed.withWatermark("time", late).dropDuplicatesWithinWatermark(["run", "type"])


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """An extension: counts and sums by event type in tumbling or sliding windows; later events than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: events of a user in sessions that a gap ends."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
