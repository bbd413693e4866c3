"""The folder that all executors share, and lineage cut there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, local mode gets a folder of its own; on a
    cluster that is an error, since executors can't share a machine's folder."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if there is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="rillgraph-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(there)
    return there


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, which outlives executors. Unlike a checkpoint it is computed once, is
    columnar, and its size is known to the optimiser. ``sweep`` removes such tables."""
    folder = fresh_folder(df.sparkSession, "saved")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_MADE: list[str] = []


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared folder; sweep removes it."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    return _MADE[-1]


def sweep(spark: SparkSession) -> int:
    """Remove every folder this program made in the shared folder; results that haven't been read yet are lost. Gives their number."""
    for folder in _MADE:
        removed(spark, folder)
    n = len(_MADE)
    _MADE.clear()
    return n


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _MADE:
        try:
            sweep(spark)
        except Exception:  # noqa: BLE001  the session may be gone already
            _MADE.clear()


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores. A table of small rows is few scan tasks, whatever work each of its rows is."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def parts(*dfs: DataFrame, each: int = 2 << 20) -> int:
    """How many partitions a shuffle of dfs needs for a task's memory to stay the same as they grow: by the bytes the optimiser
    expects (a table's files, for columns that are read), the session's number at least, and that number where it expects nothing sensible."""
    least = int(dfs[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in dfs)
    return least if size > 1 << 42 else max(least, min(100 * least, size // each))


def fresh(df: DataFrame) -> str:
    """A column name that df doesn't have."""
    return "_" * (1 + max((len(c) for c in df.columns), default=0))


def known(df: DataFrame, schema: str) -> DataFrame:
    """Only those columns of df that a schema names."""
    names = [f.split()[0] for f in schema.split(", ")]
    return df.select(*(c for c in names if c in df.columns))
