"""The driver's tables seen as a dependency graph, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokenize
from ..shared import parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix + ":"), F.col(c))


def g_edges(spark: SparkSession, d: str, distinct: bool = True) -> DataFrame:
    """source_id, target_id, type, confidence of customers, suppliers, parts and orders; acyclic. Edges of several lines are
    repeated unless distinct, for operators to which equal edges don't matter."""
    t = lambda n: table(spark, d, n)

    def e(df, a, b, kind):
        return df.select(a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("type"))

    def lines(*keys):  # nearly all distinct, so they are shuffled as they are
        df = t("lineitem").select(*keys)
        return df.repartition(parts(df), *keys).distinct() if distinct else df

    rows = [
        e(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "depends_on"),
        e(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "depends_on"),
        e(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "depends_on"),
        e(t("orders"), _id("order", "o_orderkey"), _id("customer", "o_custkey"), "reads"),
        e(lines("l_suppkey", "l_partkey"), _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "provides"),
        e(lines("l_partkey", "l_orderkey"), _id("part", "l_partkey"), _id("order", "l_orderkey"), "provides"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def g_nodes(spark: SparkSession, d: str) -> DataFrame:
    def n(name, key, label, kind, prefix):
        return table(spark, d, name).select(_id(prefix, key).alias("id"), F.col(label).cast("string").alias("name"), F.lit(kind).alias("type"))

    rows = [
        n("region", "r_regionkey", "r_name", "config_key", "region"), n("nation", "n_nationkey", "n_name", "config_key", "nation"), n("customer", "c_custkey", "c_name", "code_entity", "customer"),
        n("supplier", "s_suppkey", "s_name", "infra_resource", "supplier"), n("part", "p_partkey", "p_name", "infra_resource", "part"), n("orders", "o_orderkey", "o_orderkey", "data_asset", "order"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


EDGES_SQL = """g_edges AS (
  SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'depends_on' AS type FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'depends_on' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'depends_on' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'reads' FROM orders
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'provides' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'order:' || l_orderkey, 'provides' FROM lineitem)"""

IMPACT_SQL = """pairs AS (
  SELECT DISTINCT CASE WHEN type IN ('reads', 'depends_on') THEN target_id ELSE source_id END AS u,
         CASE WHEN type IN ('reads', 'depends_on') THEN source_id ELSE target_id END AS v FROM g_edges)"""

NODES_SQL = """g_nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'config_key' AS type FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'config_key' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'code_entity' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'infra_resource' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'infra_resource' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, CAST(o_orderkey AS VARCHAR), 'data_asset' FROM orders)"""


def named_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Infrastructure and variables with names made of the parts' names and types; distinct."""
    p = table(spark, d, "part")
    under = F.replace("p_name", F.lit(" "), F.lit("_"))
    a = p.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"))
    b = p.select(F.concat(F.lower("p_type"), F.lit("_"), under).alias("name"))
    infra = a.union(b).distinct().select(F.concat(F.lit("infra:"), "name").alias("id"), "name", F.lit("infra_resource").alias("type"))
    env = p.select(F.upper(under).alias("name")).distinct().select(F.concat(F.lit("env:"), "name").alias("id"), "name", F.lit("env_var").alias("type"))
    return infra.unionByName(env)


NAMED_SQL = """named AS (
  SELECT DISTINCT 'infra:' || name AS id, name, 'infra_resource' AS type FROM (
    SELECT replace(p_name, ' ', '-') AS name FROM part UNION SELECT lower(p_type) || '_' || replace(p_name, ' ', '_') FROM part)
  UNION ALL SELECT DISTINCT 'env:' || upper(replace(p_name, ' ', '_')), upper(replace(p_name, ' ', '_')), 'env_var' FROM part)"""


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    """(u, v) of event types that follow each other for some user; with cycles and self-loops."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("u"), F.lead("event_type").over(w).alias("v")).filter("v is not null").distinct()


EVENT_SQL = """t_edges AS (
  SELECT DISTINCT u, v FROM (SELECT event_type AS u, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events) WHERE v IS NOT NULL)"""


def snapshot(spark: SparkSession, d: str, head: bool) -> DataFrame:
    """Orders as nodes of two snapshots: the base has none of priority 1, the head none of priority 5; those of status P
    changed their tokens."""
    o = table(spark, d, "orders").filter(~F.startswith("o_orderpriority", F.lit("5" if head else "1")))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.month("o_orderdate") % len(KINDS) + 1)
    name = F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.when((F.col("o_orderstatus") == "P") & F.lit(head), " x").otherwise(""))
    return o.select(_id("order", "o_orderkey").alias("id"), name.alias("name"), kind.alias("type"), F.lit("orders.sql").alias("path"), F.lit(None).cast("string").alias("file_hash"), tokenize(name).alias("tokens"), F.lit(None).cast("string").alias("metadata"))


KINDS = ["infra_resource", "env_var", "config_key", "code_entity", "data_asset"]
SNAPSHOT_SQL = f"""snap AS (
  SELECT * FROM (SELECT 'order:' || o_orderkey AS id, (ARRAY{KINDS})[month(o_orderdate) % {len(KINDS)} + 1] AS type,
    CASE WHEN starts_with(o_orderpriority, '1') THEN 'added' WHEN starts_with(o_orderpriority, '5') THEN 'removed' WHEN o_orderstatus = 'P' THEN 'modified' END AS change FROM orders)
  WHERE change IS NOT NULL)"""
