"""Nulls in any column, equal rows, empty tables and columns of clashing names: nothing fails, and results are as stated."""

import pytest
from pyspark.sql import functions as F
from rillgraph.operators import analysis as A
from rillgraph.operators import diff as D
from rillgraph.operators import graph as G
from rillgraph.operators import stitch as M
from rillgraph.operators import store as R

NODE = "id string, name string, type string, path string, file_hash string, tokens array<string>, metadata string, source_repo string"
EDGE = "source_id string, target_id string, type string, confidence double, match_strategy string"
CLASH = ["seed", "node", "depth", "u", "v", "_n", "_key", "_p", "kind", "score", "change", "rule", "left_id", "right_id", "parent", "blast_radius"]


@pytest.fixture(params=["odd", "empty", "nulls"])
def graph(spark, request):
    nodes = [("env:PAY_HOST", "PAY_HOST", "env_var", "a.py", None, ["a", "b"], '{"line":1}', None), ("env:PAY_HOST", "PAY_HOST", "env_var", "a.py", None, ["a", "b"], '{"line":1}', None), ("infra:pay_host", "pay_host", "infra_resource", "a.tf", "h", [], "{", "r"), ("infra:c", None, "infra_resource", None, None, None, None, None), (None,) * 8, ("", "", "", "", "", [""], "", "")]
    edges = [("infra:pay_host", "env:PAY_HOST", "provides", 0.9, "semantic"), ("infra:pay_host", "env:PAY_HOST", "provides", 0.9, "semantic"), ("env:PAY_HOST", "env:PAY_HOST", "reads", None, None), (None, "env:PAY_HOST", None, None, None), ("infra:c", None, "reads", 0.0, None), (None,) * 5, ("", "x", "", 0.5, "")]
    if request.param == "empty":
        nodes, edges = [], []
    if request.param == "nulls":
        nodes, edges = [(None,) * 8] * 2, [(None,) * 5] * 2
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    for c in CLASH:
        n, e = n.withColumn(c, F.lit("own")), e.withColumn(c, F.lit("own"))
    return request.param, n, e


def test_graph_operators(graph, spark):
    kind, n, e = graph
    seeds = n.select(F.col("id").alias("seed")).distinct()
    assert {x.node for x in G.impacted(e, seeds).collect()} == ({"env:PAY_HOST"} if kind == "odd" else set())
    for df in (G.orphans(n, e), G.hydrate(n, e), G.latest_type(e.withColumn("created_at", F.current_timestamp())), G.neighbours(n, e, "env:PAY_HOST"), G.find_nodes(n, "a"), G.find_by_tokens(n, ["a"]), G.token_index(n), G.stats(n, e), G.lineage_stats(n), G.file_dependencies(n, e, "a.py"), G.search_artifacts(n, "a"), G.files_of(n), G.lint(n, e), G.impact_summary(e, seeds), G.blast_radius(e, seeds), G.blast_breakdown(e, seeds), G.resolve(n, n.select(F.col("id").alias("query")))):
        df.collect()
    left, cut = G.remove_nodes(n, e, n.select("id"))
    assert left.filter("id is not null").count() == 0 and cut.filter("source_id = 'infra:pay_host'").count() == 0
    assert G.simple_paths(G.impact_edges(e, "untyped"), seeds).count() == (2 if kind == "odd" else 0)
    assert G.shortest_paths(G.impact_edges(e, "untyped"), seeds, "env:PAY_HOST").filter("size(path) > 1").count() == (1 if kind == "odd" else 0)
    assert G.cycles(e.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).filter("u is not null and v is not null")).count() == (1 if kind == "odd" else 0)


def test_stitching(graph, spark):
    kind, n, _ = graph
    found = M.stitch(n)
    assert {(x.source_id, x.target_id) for x in found.collect()} == ({("infra:pay_host", "env:PAY_HOST")} if kind == "odd" else set())
    maps = spark.createDataFrame([(None, None, None, None), ("infra:*", "env:*", "provides", None), ("env:Z*", None, "ignore", "")], "source string, target string, mapping_type string, reason string")
    for df in (M.stitch_with_mappings(n, maps), M.invalid_mappings(maps, n), M.mapping_conflicts(maps), M.suggest_mappings(n, found), M.expanded(maps, n), M.stitch_counts(found)):
        df.collect()
    none = spark.createDataFrame([(None,) * 6, ("1", "*", None, None, None, True)], "id string, source_pattern string, target_pattern string, reason string, expires_at timestamp, enabled boolean")
    assert M.unsuppressed(found, none).count() == found.count()
    assert M.detected_packs(n.select("path", F.col("name").alias("text")), spark.createDataFrame([("p", "any", "*.py", None)], "pack string, mode string, path_glob string, content string")).first().matched == (kind == "odd")


def test_differences_and_findings(graph, spark):
    kind, n, e = graph
    n, e = n.drop("change", "blast_radius", "kind", "score"), e.drop("kind", "score", "blast_radius")
    assert D.node_diff(n.distinct(), n.distinct()).filter("id is not null").count() == 0
    assert D.edge_diff(e, e.filter("false")).filter("source_id = 'infra:pay_host'").count() == (1 if kind == "odd" else 0)
    ch = D.with_radius(n.select("id", "type", F.lit("removed").alias("change")), e)
    assert len(ch.collect()) == n.count()
    for df in (D.risk(ch), D.risk_summary(ch), D.top_factors(ch), D.ordered_report(ch), D.file_diff(n, spark.createDataFrame([("a.py", "M"), (None, None)], "path string, status string"))):
        df.collect()
    files = spark.createDataFrame([("a.py",), (None,), ("",)], "path string")
    for df in (A.findings(n, e), A.finding_counts(e), A.missing_providers(n, e), A.check(n, e, files), A.hover(n, e, "a.py", 1), A.providers_for_file(n, e, "a.py"), A.orphan_diagnostics(n, e), A.source_file(n, e, n.select("id")), A.alternatives(n, "env:PAY_HOST"), A.reviewers(files, [("*.py", ["x"])]), A.explain(e)):
        df.collect()
    assert A.missing_providers(n, e).count() == 0


def test_store(graph, spark, tmp_path):
    kind, n, e = graph
    s = R.Store(spark, f"file://{tmp_path}/s", parts=4)
    s.upsert("nodes", n.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    s.upsert("edges", e.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    assert s.read("nodes").filter("id is not null").count() == (4 if kind == "odd" else 0)
    s.delete_files(spark.createDataFrame([("a.py",), (None,)], "path string"))
    assert s.read("nodes").filter("id = 'env:PAY_HOST'").count() == 0 and s.read("edges").filter("target_id = 'env:PAY_HOST' and source_id is not null").count() == 0
