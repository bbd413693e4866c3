"""Named queries over the driver's tables, one or more for each operator family, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as X
from ..operators import analysis as A
from ..operators import diff as D
from ..operators import graph as G
from ..operators import stitch as M
from ..operators import store as R
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _seeds(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return V.g_nodes(spark, d).filter(F.col("id").startswith(kind + ":")).select(F.col("id").alias("seed"))


CORE = f"WITH RECURSIVE {V.EDGES_SQL}, {V.IMPACT_SQL}, "
BACK = f"WITH RECURSIVE {V.EDGES_SQL}, {V.IMPACT_SQL}, "

# --- closures


@query(CORE + "r(node) AS (SELECT v FROM pairs WHERE u = 'region:0' UNION SELECT v FROM r JOIN pairs ON u = node) SELECT node FROM r")
def impact_of_region(spark, d):
    """What is impacted if region 0 changes."""
    return G.impacted(V.g_edges(spark, d), spark.createDataFrame([("region:0",)], "seed string")).select("node")


@query(CORE + "r(seed, node) AS (SELECT u, v FROM pairs WHERE starts_with(u, 'region:') UNION SELECT seed, v FROM r JOIN pairs ON u = node) SELECT seed, count(*) AS impacted FROM r GROUP BY seed")
def impact_by_region(spark, d):
    """Size of the closure of every region, all seeds in one run."""
    return G.reach(G.impact_edges(V.g_edges(spark, d), "core", distinct=False), _seeds(spark, d, "region")).withColumnRenamed("count", "impacted")


@query(
    CORE
    + """lv AS (SELECT u AS seed, v AS node, 1 AS depth FROM pairs WHERE starts_with(u, 'region:')
  UNION SELECT seed, v, depth + 1 FROM lv JOIN pairs ON u = node WHERE depth < 2)
SELECT seed, node, min(depth) AS depth FROM lv GROUP BY seed, node"""
)
def impact_two_levels(spark, d):
    return G.impacted(V.g_edges(spark, d), _seeds(spark, d, "region"), max_depth=2)


@query(BACK + "r(seed, node) AS (SELECT v, u FROM pairs WHERE starts_with(v, 'supplier:') UNION SELECT seed, u FROM r JOIN pairs ON v = node) SELECT seed, node FROM r")
def upstream_of_suppliers(spark, d):
    return G.upstream(V.g_edges(spark, d), _seeds(spark, d, "supplier")).select("seed", "node")


@query(f"WITH RECURSIVE {V.EDGES_SQL}, r(seed, node) AS (SELECT source_id, target_id FROM g_edges WHERE starts_with(source_id, 'customer:') UNION SELECT seed, target_id FROM r JOIN g_edges ON source_id = node) SELECT seed, node FROM r")
def descendants_of_customers(spark, d):
    return G.descendants(V.g_edges(spark, d), _seeds(spark, d, "customer")).select("seed", "node")


@query(f"WITH RECURSIVE {V.EDGES_SQL}, r(seed, node) AS (SELECT target_id, source_id FROM g_edges WHERE starts_with(target_id, 'region:') UNION SELECT seed, source_id FROM r JOIN g_edges ON target_id = node) SELECT seed, node FROM r")
def ancestors_of_regions(spark, d):
    return G.ancestors(V.g_edges(spark, d), _seeds(spark, d, "region")).select("seed", "node")


@query(
    CORE
    + """r(seed, node) AS (SELECT u, v FROM pairs WHERE starts_with(u, 'nation:') UNION SELECT seed, v FROM r JOIN pairs ON u = node)
SELECT n.id AS seed, count(r.node) AS impacted
FROM (SELECT 'nation:' || n_nationkey AS id FROM nation) n LEFT JOIN r ON r.seed = n.id GROUP BY n.id"""
)
def blast_radius_of_nations(spark, d):
    return G.blast_radius(V.g_edges(spark, d), _seeds(spark, d, "nation"))


@query(CORE + """up AS (SELECT v AS seed, u AS node FROM pairs WHERE starts_with(v, 'nation:') UNION SELECT seed, u FROM up JOIN pairs ON v = node),
down AS (SELECT u AS seed, v AS node FROM pairs WHERE starts_with(u, 'nation:') UNION SELECT seed, v FROM down JOIN pairs ON u = node),
a AS (SELECT seed, count(*) AS n FROM up GROUP BY seed), b AS (SELECT seed, count(*) AS n FROM down GROUP BY seed)
SELECT s.seed, coalesce(a.n, 0) AS upstream, coalesce(b.n, 0) AS downstream, coalesce(a.n, 0) + coalesce(b.n, 0) AS total
FROM (SELECT 'nation:' || n_nationkey AS seed FROM nation) s LEFT JOIN a USING (seed) LEFT JOIN b USING (seed)""")  # fmt: skip
def impact_summary(spark, d):
    return G.impact_summary(V.g_edges(spark, d), _seeds(spark, d, "nation"))


@query(f"""WITH RECURSIVE {V.EDGES_SQL}, r(node) AS (SELECT target_id FROM g_edges WHERE starts_with(source_id, 'supplier:') UNION SELECT target_id FROM r JOIN g_edges ON source_id = node)
SELECT 'unknown' AS bucket, node FROM r""")
def blast_artifacts(spark, d):
    """All that suppliers reach; blast_breakdown_of_kinds has every bucket."""
    return G.blast_artifacts(V.g_edges(spark, d), _seeds(spark, d, "supplier"))


# --- paths and cycles


@query(
    f"""WITH RECURSIVE {V.EVENT_SQL}, p AS (SELECT 'signup' AS seed, 'signup' AS node, ['signup'] AS path
  UNION ALL SELECT seed, v, list_append(path, v) FROM p JOIN t_edges ON u = node WHERE NOT list_contains(path, v) AND node <> 'purchase')
SELECT seed, array_to_string(path, '>') AS path FROM p WHERE node = 'purchase'"""
)
def simple_paths(spark, d):
    got = G.simple_paths(V.event_edges(spark, d), spark.createDataFrame([("signup",)], "seed string"), "purchase")
    return got.select("seed", F.array_join("path", ">").alias("path"))


@query(
    f"""WITH RECURSIVE {V.EVENT_SQL}, p AS (SELECT u AS first, v AS node, [u, v] AS path FROM t_edges WHERE u < v
  UNION ALL SELECT first, t.v, list_append(path, t.v) FROM p JOIN t_edges t ON t.u = node WHERE t.v > first AND NOT list_contains(path, t.v) AND len(path) < 5)
SELECT u AS cycle, 1 AS length FROM t_edges WHERE u = v
UNION ALL SELECT array_to_string(path, '>'), CAST(len(path) AS INTEGER) FROM p WHERE EXISTS (SELECT 1 FROM t_edges t WHERE t.u = node AND t.v = first)"""
)
def cycles(spark, d):
    return G.cycles(V.event_edges(spark, d)).select(F.array_join("cycle", ">").alias("cycle"), "length")


@query(f"WITH {V.EVENT_SQL} SELECT DISTINCT u AS node FROM t_edges t WHERE u = v OR EXISTS (SELECT 1 FROM t_edges b WHERE b.u = t.v AND b.v = t.u)")
def on_cycle(spark, d):
    return G.on_cycle(V.event_edges(spark, d))


@query(
    f"""WITH RECURSIVE {V.EDGES_SQL}, s AS (SELECT 'order:' || o_orderkey AS seed, 'customer:' || o_custkey AS c FROM orders)
SELECT seed, seed || '>' || c || '>nation:' || c_nationkey || '>region:' || n_regionkey AS path
FROM s JOIN customer ON c = 'customer:' || c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1"""
)
def shortest_paths(spark, d):
    """From every order to region 1 along edges as they point."""
    got = G.shortest_paths(G.impact_edges(V.g_edges(spark, d, distinct=False), "untyped", distinct=False), _seeds(spark, d, "order"), "region:1")
    return got.select("seed", F.array_join("path", ">").alias("path"))


# --- look-ups, sets, statistics


@query(f"""WITH {V.EDGES_SQL}, {V.NODES_SQL}
SELECT 'nodes_by_type' AS metric, type AS key, count(*) AS value FROM g_nodes GROUP BY type UNION ALL SELECT 'edges_by_type', type, count(*) FROM g_edges GROUP BY type
UNION ALL SELECT 'nodes', NULL, count(*) FROM g_nodes UNION ALL SELECT 'edges', NULL, count(*) FROM g_edges
UNION ALL SELECT 'orphans', NULL, count(*) FROM g_nodes WHERE id NOT IN (SELECT source_id FROM g_edges UNION SELECT target_id FROM g_edges)""")
def graph_stats(spark, d):
    return G.stats(V.g_nodes(spark, d), V.g_edges(spark, d))


@query(f"WITH {V.EDGES_SQL}, {V.NODES_SQL} SELECT id, name, type FROM g_nodes WHERE id NOT IN (SELECT source_id FROM g_edges WHERE type = 'reads' UNION SELECT target_id FROM g_edges WHERE type = 'reads')")
def orphans(spark, d):
    """Nodes that neither read nor are read."""
    return G.orphans(V.g_nodes(spark, d), V.g_edges(spark, d).filter("type = 'reads'"))


@query(f"WITH {V.EDGES_SQL} SELECT source_id, target_id, type FROM g_edges WHERE NOT starts_with(source_id, 'part:') AND NOT starts_with(target_id, 'part:')")
def hydrate(spark, d):
    """Edges whose ends both exist in a graph that lost its parts."""
    e = V.g_edges(spark, d)
    return G.hydrate(V.g_nodes(spark, d).filter(~F.col("id").startswith("part:")), e.withColumn("confidence", F.lit(1.0))).select("source_id", "target_id", "type")


@query(f"WITH {V.EDGES_SQL}, {V.NODES_SQL} SELECT 'out' AS direction, e.type AS edge_type, n.id, n.name, n.type FROM g_edges e JOIN g_nodes n ON n.id = target_id WHERE source_id = 'nation:3' UNION ALL SELECT 'in', e.type, n.id, n.name, n.type FROM g_edges e JOIN g_nodes n ON n.id = source_id WHERE target_id = 'nation:3'")
def neighbours(spark, d):
    return G.neighbours(V.g_nodes(spark, d), V.g_edges(spark, d), "nation:3")


@query(f"WITH {V.NODES_SQL} SELECT id, name, type FROM g_nodes WHERE lower(id) LIKE '%customer#0000001%' OR lower(name) LIKE '%customer#0000001%'")
def find_nodes(spark, d):
    return G.find_nodes(V.g_nodes(spark, d), "Customer#0000001")


TOK = "list_distinct(list_filter(string_split_regex(lower(name), '[_.\\-/:\\s]+'), lambda x: x <> ''))"


@query(f"WITH {V.NODES_SQL} SELECT DISTINCT id, unnest({TOK}) AS token FROM g_nodes WHERE name IS NOT NULL")
def token_index(spark, d):
    n = V.g_nodes(spark, d).withColumn("tokens", X.tokenize("name"))
    return G.token_index(n).select(F.col("node_id").alias("id"), "token")


@query(f"WITH {V.EDGES_SQL}, {V.NODES_SQL} SELECT id FROM (SELECT id FROM g_nodes WHERE starts_with(id, 'nation:') OR starts_with(id, 'region:')) WHERE id NOT IN (SELECT 'nation:' || c_nationkey FROM customer)")
def remove_node(spark, d):
    """What is left of nations and regions without the nations that have customers."""
    n, e = V.g_nodes(spark, d), V.g_edges(spark, d)
    gone = e.filter(F.col("source_id").startswith("customer:")).select(F.col("target_id").alias("id"))
    left, _ = G.remove_nodes(n, e, gone)
    return left.filter(F.col("id").rlike("^(nation|region):")).select("id")


@query("SELECT 'part:' || p_partkey AS id, lower(replace(p_name, ' ', '')) AS flat, array_to_string(list_sort(list_distinct(string_split(lower(p_name || '_' || p_type), '_'))), ',') AS parts, CASE WHEN p_retailprice / 2500 >= 0.8 THEN 'HIGH' WHEN p_retailprice / 2500 >= 0.6 THEN 'MEDIUM' WHEN p_retailprice / 2500 >= 0.4 THEN 'LOW' ELSE 'VERY LOW' END AS level, starts_with(p_brand, 'Brand#1') AS hit FROM part")
def scalars(spark, d):
    p = V.table(spark, d, "part")
    parts = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(F.concat("p_name", F.lit("_"), "p_type")), "_"))), ",")
    return p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), X.normalize("p_name", spaces=True).alias("flat"), parts.alias("parts"), X.confidence_level(F.col("p_retailprice") / 2500).alias("level"), F.col("p_brand").rlike(X.glob_regex("Brand#1*")).alias("hit"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS line FROM events")
def json_metadata(spark, d):
    return V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("line"))


@query("SELECT event_type AS type, CAST(user_id AS VARCHAR) AS source_repo, grouping(event_type, user_id) AS level, count(*) AS nodes FROM events GROUP BY CUBE (event_type, user_id)")
def stats_cube(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("source_repo"))
    return G.stats_cube(e)


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    """An extension: event-time windows of an hour."""
    return V.table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@query("SELECT id, type, last_id FROM (SELECT 'user:' || user_id AS id, event_type AS type, event_id AS last_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(spark, d):
    e = V.table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("id"), F.col("event_id").alias("last_id"), F.col("event_type").alias("type"), F.col("ts").alias("created_at"))
    return R.last_wins(e, ["id"]).select("id", "type", "last_id")


@query("SELECT CAST(coalesce(o_orderkey, l.k) AS VARCHAR) AS path, CASE WHEN l.k IS NULL THEN 'new' WHEN o_orderkey IS NULL THEN 'deleted' WHEN h = o_orderstatus THEN 'unchanged' ELSE 'changed' END AS state FROM orders FULL OUTER JOIN (SELECT l_orderkey AS k, max(l_linestatus) AS h FROM lineitem GROUP BY 1) l ON o_orderkey = l.k")
def incremental_scan(spark, d):
    """Orders as listed files against what line items recorded of them."""
    listing = V.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("hash"))
    scans = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("file_path")).agg(F.max("l_linestatus").alias("file_hash"))
    return R.scan_states(listing, scans)


@query(f"WITH {V.EDGES_SQL}, {V.NODES_SQL} SELECT 'nodes' AS \"table\", count(*) AS rows FROM g_nodes UNION ALL SELECT 'edges', count(*) FROM g_edges UNION ALL SELECT 'scan_metadata', count(*) FROM orders UNION ALL SELECT 'token_index', count(*) FROM (SELECT DISTINCT id, unnest({TOK}) FROM g_nodes)")
def storage_stats(spark, d):
    n = V.g_nodes(spark, d)
    return R.storage_stats(n, V.g_edges(spark, d), V.table(spark, d, "orders"), G.token_index(n.withColumn("tokens", X.tokenize("name"))))


# --- stitching

_LIST = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
T = lambda c: f"list_filter(string_split_regex(lower({c}), '[_.\\-/:\\s]+'), lambda x: x <> '')"
PAIRS_SQL = f"""{V.NAMED_SQL},
keyed AS (SELECT DISTINCT id, type, unnest(list_append(list_filter({T("name")}, lambda x: len(x) >= 2), '=' || translate(lower(name), '._-/:', ''))) AS k FROM named),
cand AS (SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM keyed a JOIN keyed b USING (k) WHERE a.type = 'infra_resource' AND b.type = 'env_var'),
alts AS (SELECT left_id, right_id, count(*) OVER (PARTITION BY right_id) - 1 AS alt FROM cand)"""


def score_sql(pairs: str) -> str:
    """CTEs ending in ``scored`` (left_id, right_id, score, matched) for a relation with left_id, right_id, s, t, alt."""
    w, m = S.DEFAULT.weights, S.DEFAULT.multipliers
    return f"""x1 AS (SELECT *, translate(lower(s), '._-/:', '') AS sn, translate(lower(t), '._-/:', '') AS tn, list_sort(list_distinct(list_intersect({T("s")}, {T("t")}))) AS matched FROM {pairs}),
x2 AS (SELECT *, list_filter(matched, lambda x: NOT list_contains({_LIST(S.COMMON)}, x)) AS plain, len(list_filter(matched, lambda x: list_contains({_LIST(S.LOW_VALUE)}, x))) AS low, len(sn) >= 4 AND sn <> tn AS lng FROM x1),
x3 AS (SELECT *, len(list_filter(plain, lambda x: len(x) >= 4)) AS strong, s = t AS exact_, sn = tn AND s <> t AS norm_, lng AND ends_with(tn, sn) AS suf, lng AND starts_with(tn, sn) AS pre FROM x2),
x4 AS (SELECT *, len(sn) >= 4 AND contains(tn, sn) AND NOT (exact_ OR norm_ OR suf OR pre) AS ins FROM x3),
x5 AS (SELECT *, len(matched) > 0 AND NOT (exact_ OR norm_ OR suf OR pre OR ins) AND strong < 2 AS sing FROM x4),
x6 AS (SELECT *, greatest(CASE WHEN exact_ THEN {w["exact"]} ELSE 0 END, CASE WHEN norm_ THEN {w["normalized"]} ELSE 0 END, CASE WHEN strong >= 3 THEN {w["overlap_high"]} WHEN strong = 2 THEN {w["overlap_medium"]} ELSE 0 END,
    CASE WHEN suf OR pre THEN {w["suffix"]} ELSE 0 END, CASE WHEN ins THEN {w["contains"]} ELSE 0 END, CASE WHEN sing THEN {w["single"]} ELSE 0 END) AS top,
    exact_::INT + norm_::INT + (strong >= 2)::INT + suf::INT + pre::INT + ins::INT + sing::INT AS k FROM x5),
scored AS (SELECT left_id, right_id, matched, round(CASE WHEN k = 0 THEN 0 ELSE least(1.0, top + least(0.1, 0.02 * (k - 1)))::DOUBLE
    * CASE WHEN list_contains({_LIST(S.GENERIC)}, sn) THEN {m["generic"]}::DOUBLE ELSE 1 END * CASE WHEN len(matched) > len(plain) AND len(plain) = 0 THEN {m["common"]}::DOUBLE ELSE 1 END
    * CASE WHEN len(matched) > 0 AND len(list_filter(matched, lambda x: len(x) >= 4)) = 0 THEN {m["short"]}::DOUBLE ELSE 1 END
    * CASE WHEN alt > 1 AND sn <> tn THEN greatest(0.2, pow({m["ambiguity"]}, alt - 1))::DOUBLE ELSE 1 END
    * CASE WHEN low >= 1 AND low >= len(plain) THEN {m["low_value"]}::DOUBLE ELSE 1 END END, 4) AS score FROM x6)"""


STITCH_SQL = f"WITH {PAIRS_SQL}, pr AS (SELECT left_id, right_id, a.name AS s, b.name AS t, alt FROM alts JOIN named a ON a.id = left_id JOIN named b ON b.id = right_id), {score_sql('pr')}"
BEST_SQL = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY right_id ORDER BY score DESC, len(matched) DESC, left_id) AS n FROM scored) WHERE n = 1 AND score >= 0.5)"


@query(f"WITH {PAIRS_SQL} SELECT left_id, right_id FROM cand")
def token_candidates(spark, d):
    n = V.named_nodes(spark, d)
    return M.candidates(n.filter("type = 'infra_resource'"), n.filter("type = 'env_var'"))


@query(STITCH_SQL + " SELECT left_id, right_id, score FROM scored")
def match_scores(spark, d):
    n = V.named_nodes(spark, d)
    return M.scored(n.filter("type = 'infra_resource'"), n.filter("type = 'env_var'")).select("left_id", "right_id", "score")


@query(STITCH_SQL + f", {BEST_SQL} SELECT left_id AS source_id, right_id AS target_id, score AS confidence, array_to_string(matched, ',') AS matched FROM best")
def stitch_env_to_infra(spark, d):
    return M.env_to_infra(V.named_nodes(spark, d)).select("source_id", "target_id", "confidence", F.array_join("matched_tokens", ",").alias("matched"))


_H = lambda c: "CASE " + " ".join(f"WHEN contains(lower({c}), '{p}') THEN {r}" for p, r in (("vpc", 10), ("subnet", 9), ("security_group", 8), ("iam", 7), ("rds", 5), ("db", 5), ("instance", 4), ("lambda", 3), ("s3", 3))) + " ELSE 0 END"


@query(
    f"""WITH {V.NAMED_SQL}, tk AS (SELECT DISTINCT id, name, unnest(list_filter({T("name")}, lambda x: len(x) >= 2)) AS k FROM named WHERE type = 'infra_resource'),
pr AS (SELECT DISTINCT a.id AS left_id, b.id AS right_id, a.name AS s, b.name AS t, 0 AS alt FROM tk a JOIN tk b USING (k) WHERE a.id < b.id), {score_sql("pr")}
SELECT CASE WHEN {_H("p.t")} > {_H("p.s")} THEN right_id ELSE left_id END AS source_id, CASE WHEN {_H("p.t")} > {_H("p.s")} THEN left_id ELSE right_id END AS target_id, score AS confidence
FROM scored JOIN pr p USING (left_id, right_id) WHERE score >= 0.5"""
)
def stitch_infra_to_infra(spark, d):
    return M.infra_to_infra(V.named_nodes(spark, d)).select("source_id", "target_id", "confidence")


@query(STITCH_SQL + f", {BEST_SQL} SELECT id, name FROM named WHERE type = 'env_var' AND id NOT IN (SELECT right_id FROM best)")
def missing_providers(spark, d):
    n = V.named_nodes(spark, d)
    return A.missing_providers(n, M.env_to_infra(n)).select("id", "name")


@query(
    f"""WITH {V.NAMED_SQL}, tk AS (SELECT id, type, list_distinct(list_filter({T("name")}, lambda x: len(x) > 2)) AS ts FROM named),
j AS (SELECT a.id AS orphan, b.id AS suggestion, round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))), 4) AS similarity FROM tk a JOIN tk b ON a.type = 'env_var' AND b.type = 'infra_resource' AND list_has_any(a.ts, b.ts))
SELECT orphan, suggestion, similarity FROM (SELECT *, row_number() OVER (PARTITION BY orphan ORDER BY similarity DESC, suggestion) AS n FROM j WHERE similarity >= 0.3) WHERE n = 1"""
)
def suggest_mappings(spark, d):
    n = V.named_nodes(spark, d)
    return M.suggest_mappings(n, spark.createDataFrame([], "source_id string, target_id string, type string"))


@query(STITCH_SQL + f", {BEST_SQL} SELECT left_id AS source_id, right_id AS target_id, score AS confidence FROM best WHERE NOT (left_id LIKE 'infra:%-%' AND right_id LIKE 'env:A%')")
def suppressions(spark, d):
    rules = spark.createDataFrame([("1", "infra:*-*", "env:A*", "dashes", None, True), ("2", "*", "*", "disabled", None, False)], "id string, source_pattern string, target_pattern string, reason string, expires_at timestamp, enabled boolean")
    return M.unsuppressed(M.env_to_infra(V.named_nodes(spark, d)), rules).select("source_id", "target_id", "confidence")


@query(STITCH_SQL + f", {BEST_SQL} SELECT left_id AS source_id, right_id AS target_id, round(least(1.0, score + least(0.3, CASE WHEN right_id LIKE 'env:B%' THEN 0.05 ELSE 0 END + CASE WHEN left_id LIKE '%-%' THEN 0.01 ELSE 0 END)), 4) AS confidence FROM best")
def pack_boost(spark, d):
    e = M.boosted(M.env_to_infra(V.named_nodes(spark, d)), [("env:B*", 0.05, ""), ("infra:*-*", 0.01, "")])
    return e.select("source_id", "target_id", "confidence")


@query("SELECT p_brand AS source, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS targets FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def mapping_conflicts(spark, d):
    m = V.table(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("target"), F.lit("provides").alias("mapping_type"))
    return M.mapping_conflicts(m).select("source", F.array_join("targets", ",").alias("targets"))


# --- differences, risk, findings


@query(f"WITH {V.SNAPSHOT_SQL} SELECT id, type, change FROM snap")
def node_diff(spark, d):
    return D.node_diff(V.snapshot(spark, d, False), V.snapshot(spark, d, True)).select("id", "type", "change")


@query("SELECT 'order:' || o_orderkey AS source_id, 'customer:' || o_custkey AS target_id, 'reads' AS type, CASE WHEN starts_with(o_orderpriority, '1') THEN 'added' ELSE 'removed' END AS change FROM orders WHERE o_orderpriority[1] IN ('1', '5')")
def edge_diff(spark, d):
    o = V.table(spark, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("source_id"), F.concat(F.lit("customer:"), "o_custkey").alias("target_id"), F.lit("reads").alias("type"), "o_orderpriority")
    return D.edge_diff(o.filter(~F.startswith("o_orderpriority", F.lit("1"))).drop("o_orderpriority"), o.filter(~F.startswith("o_orderpriority", F.lit("5"))).drop("o_orderpriority"))


RADIUS_SQL = f"{V.SNAPSHOT_SQL}, ch AS (SELECT id, type, change, CAST(0 AS BIGINT) AS blast_radius FROM snap)"
PEN = "CASE " + " ".join(f"WHEN type = '{k}' AND change = '{c}' THEN {p}" for k, by in D.PENALTY.items() for c, p in by.items()) + " ELSE 5 END"


@query(f"WITH {RADIUS_SQL} SELECT count(*) AS changes, count(*) FILTER (b) AS breaking, CAST(greatest(0, least(100, 100 - sum(p) - least(20, 5 * count(*) FILTER (b)))) AS BIGINT) AS score, 'CRITICAL' AS level, max_by(id, (p, id)) AS top_factor FROM (SELECT *, {PEN} AS p, change = 'removed' AND type IN ('env_var', 'infra_resource') AS b FROM ch)")
def risk(spark, d):
    changes = D.node_diff(V.snapshot(spark, d, False), V.snapshot(spark, d, True))
    return D.risk(D.with_radius(changes, V.g_edges(spark, d)))


@query(f"WITH RECURSIVE {V.EDGES_SQL}, {V.IMPACT_SQL}, r AS (SELECT u AS seed, v AS node FROM pairs WHERE starts_with(u, 'supplier:') UNION SELECT seed, v FROM r JOIN pairs ON u = node) SELECT 'supplier:' || s_suppkey AS id, count(node) AS blast_radius, CAST(CASE WHEN count(node) >= 50 THEN 80 WHEN count(node) >= 20 THEN 60 WHEN count(node) >= 5 THEN 48 ELSE 40 END AS INTEGER) AS penalty, true AS breaking FROM supplier LEFT JOIN r ON seed = 'supplier:' || s_suppkey GROUP BY 1")
def risk_of_removed_suppliers(spark, d):
    """The removal of every supplier: one closure for all."""
    gone = V.g_nodes(spark, d).filter(F.col("id").startswith("supplier:")).withColumn("change", F.lit("removed"))
    return D.risk_factors(D.with_radius(gone, V.g_edges(spark, d))).select("id", "blast_radius", "penalty", "breaking")


FIND_SQL = STITCH_SQL + f""", {BEST_SQL}, n AS (SELECT left_id, count(*) AS k FROM best GROUP BY 1)"""


@query(FIND_SQL + """ SELECT CASE WHEN k > 1 THEN 'ambiguous_match' WHEN score >= 0.8 THEN 'high_confidence_link' ELSE 'cross_domain_chain' END AS kind, left_id AS source_id, right_id AS target_id,
  CASE WHEN score >= 0.8 THEN 2.0 WHEN score >= 0.6 THEN 1.0 ELSE 0 END + CASE WHEN k > 1 THEN 2.5 ELSE 0 END + 1.5 AS interest FROM best JOIN n USING (left_id)
  UNION ALL SELECT 'missing_provider', id, NULL, 1.5 FROM named WHERE type = 'env_var'""")
def findings(spark, d):
    n = G.saved(V.named_nodes(spark, d))
    return A.findings(n, M.env_to_infra(n)).select("kind", "source_id", "target_id", "interest")


@query(FIND_SQL + " SELECT count(*) AS total, count(*) FILTER (score >= 0.7) AS high, count(*) FILTER (score < 0.7 AND score >= 0.4) AS medium, count(*) FILTER (score < 0.4) AS low, count(*) FILTER (k > 1) AS ambiguous FROM best JOIN n USING (left_id)")
def finding_counts(spark, d):
    return A.finding_counts(M.env_to_infra(V.named_nodes(spark, d)))


@query(FIND_SQL + " SELECT source_id, target_id, interest FROM (SELECT left_id AS source_id, right_id AS target_id, CASE WHEN score >= 0.8 THEN 2.0 WHEN score >= 0.6 THEN 1.0 ELSE 0 END + CASE WHEN k > 1 THEN 2.5 ELSE 0 END + 1.5 AS interest FROM best JOIN n USING (left_id) UNION ALL SELECT id, NULL, 1.5 FROM named WHERE type = 'env_var') ORDER BY interest DESC, source_id, target_id LIMIT 5")
def top_findings(spark, d):
    """The five most interesting findings: a top-n report."""
    n = G.saved(V.named_nodes(spark, d))
    return A.top_findings(A.findings(n, M.env_to_infra(n))).select("source_id", "target_id", "interest")


@query(f"WITH {V.NAMED_SQL}, pr AS (SELECT a.id AS left_id, b.id AS right_id, a.name AS s, b.name AS t, 0 AS alt FROM named a JOIN named b ON a.type = 'infra_resource' AND b.type = 'env_var'), {score_sql('pr')} SELECT left_id AS source_id, right_id AS target_id, score, CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' WHEN score >= 0.4 THEN 'LOW' ELSE 'VERY LOW' END AS level FROM scored WHERE score > 0")
def explain(spark, d):
    """Every infrastructure name with every variable that it can score against, by names only."""
    n = V.named_nodes(spark, d)
    pairs = M.comparable(n.filter("type = 'infra_resource'"), n.filter("type = 'env_var'")).toDF("source_id", "target_id")
    return A.explain(pairs).filter("score > 0").select("source_id", "target_id", "score", "level")


@query(STITCH_SQL + f", {BEST_SQL} SELECT left_id AS source_id, right_id AS target_id FROM best WHERE score BETWEEN 0.0 AND 0.9")
def review_queue(spark, d):
    none = spark.createDataFrame([], "id string, source_pattern string, target_pattern string, reason string, expires_at timestamp, enabled boolean")
    return A.review_queue(M.env_to_infra(V.named_nodes(spark, d)), none, 0.0, 0.9).select("source_id", "target_id")


# --- extraction


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def page_links(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
