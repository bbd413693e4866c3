"""Source files as a DataFrame: discovery with pruning, size and content guards, hashes, languages, change listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 512_000
SKIPPED_FOLDERS = [".git", ".hg", ".idea", ".mypy_cache", ".pytest_cache", ".svn", ".terraform", ".tox", ".venv", "__pycache__", "build", "dist", "env", "node_modules", "site-packages", "target", "vendor", "venv"]
BINARY = "(?i)\\.(?:7z|a|avi|bin|bmp|bz2|class|db|dll|dylib|exe|gif|gz|ico|jar|jpe?g|lock|mov|mp[34]|o|otf|parquet|pdf|png|pyc|pyo|rar|so|sqlite3?|svg|tar|tiff?|ttf|war|wasm|webp|woff2?|xz|zip)$"

#: Language by path; a file has every language whose pattern its path matches.
LANGUAGES = {
    "python": r"\.pyi?$", "javascript": r"\.(?:[cm]?jsx?|[cm]?tsx?)$", "go": r"\.go$", "java": r"\.java$", "terraform": r"\.tf$", "terraform_plan": r"(?:^|/|[._-])(?:tf)?plan[^/]*\.json$",
    "kubernetes": r"\.ya?ml$", "spark_yaml": r"\.ya?ml$", "dbt_schema": r"\.ya?ml$", "dbt_manifest": r"(?:^|/)manifest\.json$", "dbt_sql": r"\.sql$", "openlineage": r"\.json$", "package_json": r"(?:^|/)package\.json$",
}


def skipped(path: str | Column = "path", folders: list[str] = SKIPPED_FOLDERS) -> Column:
    """Whether discovery leaves a path out."""
    p = F.col(path) if isinstance(path, str) else path
    return F.arrays_overlap(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))), F.array(*map(F.lit, folders))) | p.rlike(BINARY)


def minified(text: str | Column = "text") -> Column:
    """Whether a script looks generated: no line end among much text, or a very long line near the top."""
    t = F.col(text) if isinstance(text, str) else text
    head = F.substring(t, 1, 20_000)
    return ((F.length(head) > 1000) & (F.instr(head, "\n") == 0)) | F.exists(F.slice(F.split(t, "\n"), 1, 10), lambda x: F.length(x) > 10_000)


def _relative(root: str) -> Column:
    return F.regexp_replace(F.col("path"), "^(?:[a-z]+:)?/*" + root.rstrip("/").split(":", 1)[-1].strip("/") + "/", "")


def listed(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, modified) of the files under root that extraction reads, without reading any."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= max_bytes)
    return rows.select(_relative(root).alias("path"), "length", F.col("modificationTime").alias("modified")).filter(~skipped())


def discover(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int = MAX_BYTES, repo: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """(path, text, length, hash, modified, source_repo) of the files under root that extraction reads; path is relative.

    The size limit is pushed down to the listing, so large files are never read. With ``only`` (a table of relative paths) no others are.
    """
    if only is not None:
        base = root.rstrip("/")
        names = [f"{base}/{r[0]}" for r in only.collect()]  # the changed files' names, which the reader needs on the driver
        if not names:
            return spark.createDataFrame([], "path string, text string, length bigint, hash string, modified timestamp, source_repo string")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    relative, root = _relative(root), root if only is None else names
    rows = reader.load(root).filter(F.col("length") <= max_bytes).select(relative.alias("path"), "content", "length", F.col("modificationTime").alias("modified"))
    return rows.filter(~skipped()).select("path", F.decode("content", "UTF-8").alias("text"), "length", F.hex(F.xxhash64("content")).alias("hash"), "modified", F.lit(repo).cast("string").alias("source_repo"))


def routed(files: DataFrame) -> DataFrame:
    """files with languages, all that the path matches; minified scripts have none."""
    hits = F.filter(F.array(*(F.when(F.col("path").rlike(p), F.lit(k)) for k, p in LANGUAGES.items())), lambda x: x.isNotNull())
    return files.withColumn("languages", F.when(F.col("path").rlike(LANGUAGES["javascript"]) & minified(), F.array().cast("array<string>")).otherwise(hits))


def many(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """The files of several repositories by name."""
    frames = [discover(spark, root, repo=name) for name, root in sorted(roots.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def changed_files(lines: DataFrame) -> DataFrame:
    """(path, status, old_path) of the lines(value) of a version control's name and status listing."""
    f = F.split("value", "\t")
    moved = F.col("value").rlike("^[RC]")
    rows = lines.filter(F.col("value").rlike("^[ACDMRTU?][0-9]*\t."))
    return rows.select(F.when(moved, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("path"), F.substring("value", 1, 1).alias("status"), F.when(moved, F.get(f, F.lit(1))).alias("old_path"))


def diffed_files(diffs: DataFrame) -> DataFrame:
    """(path) of the files that unified diffs(value) touch."""
    return diffs.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^diff --git a/.*? b/(.*)$"), F.lit(1))).alias("path")).distinct()


def stale_locks(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """(name, state) missing, stale or extra of dependencies(name, ref) against a lock file's (name, ref)."""
    j = manifest.alias("m").join(lock.alias("l"), "name", "full_outer")
    state = F.when(F.col("l.ref").isNull(), "missing").when(F.col("m.ref").isNull(), "extra").when(F.col("m.ref") != F.col("l.ref"), "stale")
    return j.select("name", state.alias("state")).filter("state is not null")


def dependencies(path: str) -> list[tuple[str, str, str]]:
    """(name, kind, place) of a TOML manifest's dependencies, local paths before repositories."""
    import tomllib

    with open(path, "rb") as f:
        listed = tomllib.load(f).get("dependencies", {})
    return [(n, "local", d["path"]) if isinstance(d, dict) and "path" in d else (n, "git", d.get("git", "") if isinstance(d, dict) else str(d)) for n, d in sorted(listed.items())]
