"""The graph store: Parquet tables with last-wins upserts, cascading deletes and incremental scans."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_path
from ..schema import EDGE_KEY, EDGES, NODES, SCANS, columns
from ..shared import fresh, removed, saved


def last_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: the latest by created_at (nulls first), then the greatest by all columns as text."""
    rest = F.struct(*(F.col(c).cast("string") for c in rows.columns if c not in keys and c != "created_at"))
    w = Window.partitionBy(*keys).orderBy(F.col("created_at").desc_nulls_last(), rest.desc())
    nr = fresh(rows)
    return rows.withColumn(nr, F.row_number().over(w)).filter(F.col(nr) == 1).drop(nr)


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in place of those with their keys."""
    new = last_wins(rows, keys)
    cond = [table[k].eqNullSafe(new[k]) for k in keys]
    return table.join(new, cond, "left_anti").unionByName(new)


def deleted(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    from .graph import remove_nodes

    return remove_nodes(nodes, edges, ids)


def without_edges_of(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """edges without those that begin at sources(id)."""
    return edges.join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_anti").select(*edges.columns)


def scan_of(scans: DataFrame, path: str) -> DataFrame:
    """The scan record of one file."""
    return scans.filter(normal_path("file_path") == normal_path(F.lit(path)))


def without_scans(scans: DataFrame, paths: DataFrame) -> DataFrame:
    """scans without the records of paths(path)."""
    gone = paths.select(normal_path("path").alias("_p")).distinct()
    return scans.withColumn("_p", normal_path("file_path")).join(gone, "_p", "left_anti").drop("_p")


def deleted_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of paths(path) and the edges that touch them."""
    gone = nodes.join(paths.select(F.col("path")).distinct(), "path", "left_semi").select("id")
    return deleted(nodes, edges, gone)


def scan_states(listing: DataFrame, scans: DataFrame, root: str = "") -> DataFrame:
    """(path, state) new, changed, unchanged or deleted, of listing(path, hash) against scans(file_path, file_hash); files
    outside root are never deleted."""
    a = listing.select(normal_path("path").alias("path"), "hash")
    b = scans.select(normal_path("file_path").alias("old"), "file_hash")
    j = a.join(b, F.col("path") == F.col("old"), "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("path").isNull(), F.when(F.col("old").startswith(root), "deleted").otherwise("unchanged")).when(F.col("hash").eqNullSafe(F.col("file_hash")), "unchanged").otherwise("changed")
    return j.select(F.coalesce("path", "old").alias("path"), state.alias("state"))


def content_hash(c: str | Column = "content") -> Column:
    """Hash of a file's bytes; only equality matters."""
    return F.hex(F.xxhash64(c))


def storage_stats(nodes: DataFrame, edges: DataFrame, scans: DataFrame, tokens: DataFrame) -> DataFrame:
    """(table, rows) in one union."""
    one = lambda n, d: d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows")
    return one("nodes", nodes).unionByName(one("edges", edges)).unionByName(one("scan_metadata", scans)).unionByName(one("token_index", tokens))


class Store:
    """Tables under a folder, each cut into ``parts`` partitions by a hash of its key: nodes and scans by path (nodes without one by
    id), edges by source_id.

    A commit writes the partitions it touches, for as many tables as it changes, to a new folder, and then one manifest that says for
    each table where each partition lies. The manifest's name holds its number and is created only if there is none of that name, so
    readers see either all of a commit or nothing of it, and of two commits at once the second fails. ``clean`` removes what no manifest but the last names.
    A batch of few files rewrites few partitions, however large the store is. The token index of nodes is a table of its own (node_id,
    token), written with them.

    Defined results: upserted rows with a null key are kept as rows of that key; missing columns become null; an empty store reads as empty tables.
    """

    SCHEMAS = {"nodes": NODES, "edges": EDGES, "scan_metadata": SCANS, "token_index": "node_id string, token string"}
    KEYS = {"nodes": ["id"], "edges": EDGE_KEY, "scan_metadata": ["file_path"]}
    PART_BY = {"nodes": "id", "edges": "source_id", "scan_metadata": "file_path", "token_index": "node_id"}

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def manifest(self) -> tuple[int, dict[str, dict[str, str]]]:
        """Number of the last commit, and the folder of each partition of each table."""
        done = [n for n in self._names(f"{self.folder}/manifests") if n.endswith(".json")]
        if not done:
            return 0, {}
        fs, p = self._fs(f"{self.folder}/manifests/{done[-1]}")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(done[-1].split(".")[0]), json.loads(text)

    def part(self, table: str) -> Column:
        """The partition of a row."""
        return F.pmod(F.xxhash64(self.PART_BY[table]), F.lit(self.parts)).cast("int")

    def read(self, table: str, parts: list[int] | None = None) -> DataFrame:
        """A table, or the partitions asked for."""
        where = self.manifest()[1].get(table, {})
        folders = [f"{self.folder}/{v}" for k, v in where.items() if parts is None or int(k) in parts]
        return self.spark.read.schema(self.SCHEMAS[table]).parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMAS[table])

    def commit(self, changed: dict[str, tuple[DataFrame, list[int] | None]]) -> None:
        """Put the rows in place of the partitions named (None: of all) of each table; rows of other partitions aren't allowed."""
        number, where = self.manifest()
        at = f"data/{number + 1:012d}-{uuid.uuid4().hex[:8]}"
        for table, (rows, parts) in changed.items():
            new = rows.select(*columns(self.SCHEMAS[table])).withColumn("_part", self.part(table))
            new.repartition("_part").write.partitionBy("_part").parquet(f"{self.folder}/{at}/{table}")
            kept = {k: v for k, v in where.get(table, {}).items() if parts is not None and int(k) not in parts}
            made = {n.split("=")[1]: f"{at}/{table}/{n}" for n in self._names(f"{self.folder}/{at}/{table}") if n.startswith("_part=")}
            where[table] = kept | made
        fs, p = self._fs(f"{self.folder}/manifests/{number + 1:012d}.json")
        fs.mkdirs(p.getParent())
        out = fs.create(p, False)  # fails if another commit has that number
        out.write(bytearray(json.dumps(where).encode()))
        out.close()

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The partitions that rows with the table's key columns fall into; at most ``parts`` numbers."""
        return sorted(r[0] for r in rows.select(self.part(table).alias("p")).distinct().collect())

    def write(self, table: str, rows: DataFrame) -> None:
        """Put rows in place of a whole table."""
        self.commit({table: (rows, None)} | self._tokens(table, rows, None))

    def _tokens(self, table: str, rows: DataFrame, parts: list[int] | None) -> dict:
        """The token index is cut as the nodes are, so the same partitions change."""
        return {"token_index": (rows.select(F.col("id").alias("node_id"), F.explode("tokens").alias("token")).distinct(), parts)} if table == "nodes" else {}

    def _typed(self, table: str, rows: DataFrame | None) -> DataFrame:
        """rows with the table's columns, missing ones null; saved, since they are read more than once."""
        none = self.spark.createDataFrame([], self.SCHEMAS[table])
        if rows is None:
            return none
        return saved(rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in none.schema)))

    def _merged(self, table: str, now: DataFrame, rows: DataFrame) -> DataFrame:
        if table != "scan_metadata":
            return upserted(now, rows, self.KEYS[table])
        timed = lambda df: df.withColumn("created_at", F.col("last_scanned"))
        return upserted(timed(now), timed(rows), self.KEYS[table]).drop("created_at")

    def upsert(self, table: str, rows: DataFrame) -> None:
        rows = self._typed(table, rows)
        parts = self.touched(table, rows)
        out = self._merged(table, self.read(table, parts), rows)
        self.commit({table: (out, parts)} | self._tokens(table, out, parts))

    def replace_files(self, paths: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, scans: DataFrame | None = None) -> None:
        """Drop the nodes of paths(path), the edges that touch them and their scan records, and put in the rows given, in one commit."""
        new = {"nodes": self._typed("nodes", nodes), "edges": self._typed("edges", edges), "scan_metadata": self._typed("scan_metadata", scans)}
        gone = saved(self.read("nodes").join(paths.select("path").distinct(), "path", "left_semi").select("id"))
        ends = self.read("edges").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id").unionByName(gone.select(F.col("id").alias("source_id")))
        files = paths.select(F.col("path").alias("file_path"))
        parts = {t: sorted({*self.touched(t, old), *self.touched(t, new[t])}) for t, old in (("nodes", gone), ("edges", ends), ("scan_metadata", files))}
        now = dict(zip(("nodes", "edges"), deleted(self.read("nodes", parts["nodes"]), self.read("edges", parts["edges"]), gone)))
        now["scan_metadata"] = self.read("scan_metadata", parts["scan_metadata"]).join(files, "file_path", "left_anti")
        out = {t: (self._merged(t, now[t], new[t]), parts[t]) for t in new}
        self.commit(out | self._tokens("nodes", *out["nodes"]))

    def delete_files(self, paths: DataFrame) -> None:
        self.replace_files(paths)

    def delete_edges(self, sources: DataFrame) -> None:
        """Drop the edges that begin at sources(id)."""
        parts = self.touched("edges", sources.select(F.col("id").alias("source_id")))
        self.commit({"edges": (without_edges_of(self.read("edges", parts), sources), parts)})

    def edges(self, min_confidence: float | None = None) -> DataFrame:
        """Edges of at least the confidence asked for; those without confidence only if none is."""
        e = self.read("edges")
        return e if min_confidence is None else e.filter(F.col("confidence") >= min_confidence)

    def clear(self) -> None:
        self.commit({t: (self.spark.createDataFrame([], s), None) for t, s in self.SCHEMAS.items()})

    def clean(self) -> None:
        """Remove manifests but the last, and folders that it doesn't name; not while a reader uses an older one."""
        number, where = self.manifest()
        used = {"/".join(v.split("/")[:2]) for parts in where.values() for v in parts.values()}
        for name in self._names(f"{self.folder}/manifests"):
            if int(name.split(".")[0]) < number:
                removed(self.spark, f"{self.folder}/manifests/{name}")
        for name in self._names(f"{self.folder}/data"):
            if f"data/{name}" not in used:
                removed(self.spark, f"{self.folder}/data/{name}")


def export_json(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as JSON lines, a folder each; read_json reads them, and whole-graph documents."""
    nodes.write.json(f"{folder}/nodes")
    edges.write.json(f"{folder}/edges")


def read_export(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that export_json wrote."""
    return spark.read.schema("id string, name string, type string, path string").json(f"{folder}/nodes"), spark.read.schema("source_id string, target_id string, type string, confidence double").json(f"{folder}/edges")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a document {"nodes": [...], "edges": [...]}; edges may name their ends source and target."""
    raw = spark.read.schema(
        "nodes array<struct<id:string,name:string,type:string,path:string>>, edges array<struct<source_id:string,target_id:string,source:string,target:string,type:string,confidence:double>>"
    ).json(path, multiLine=True)
    e = raw.select(F.explode("edges").alias("e")).select(F.coalesce("e.source_id", "e.source").alias("source_id"), F.coalesce("e.target_id", "e.target").alias("target_id"), F.coalesce("e.type", F.lit("unknown")).alias("type"), F.col("e.confidence").alias("confidence"))
    return raw.select(F.inline("nodes")), e


def export_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) of a Graphviz document's statements, coloured by domain, reads dashed; ordered by ``nr``."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    colour = F.when(F.col("id").startswith("env:"), "gold").when(F.col("id").rlike("^(infra|k8s):"), "skyblue").when(F.col("id").startswith("data:"), "palegreen").otherwise("white")
    n = nodes.select(F.lit(1).alias("nr"), F.concat(q("id"), F.lit(" [label="), q(F.coalesce("name", "id")), F.lit(", fillcolor="), colour, F.lit("];")).alias("line"))
    e = edges.select(F.lit(2).alias("nr"), F.concat(q("source_id"), F.lit(" -> "), q("target_id"), F.when(F.col("type") == "reads", " [style=dashed];").otherwise(";")).alias("line"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "digraph lineage {"), (3, "}")], "nr int, line string")
    return ends.unionByName(n).unionByName(e)
