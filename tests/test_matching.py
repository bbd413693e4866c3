import datetime as dt

import pytest
from pyspark.sql import functions as F
from rillgraph.functions import text as X
from rillgraph.functions.score import score
from rillgraph.operators import analysis as A
from rillgraph.operators import diff as D
from rillgraph.operators import stitch as M

NODE = "id string, name string, type string, path string, file_hash string, tokens array<string>, metadata string"


def _score(spark, s, t, **more):
    return spark.range(1).select(score(F.lit(s), F.lit(t), **more).alias("r")).first().r


def test_scores(spark):
    assert _score(spark, "payment_db_host", "PAYMENT_DB_HOST").score > 0.8
    x = _score(spark, "id", "id")
    assert x.score < 0.2 + 0.15 and {"common"} <= {p.penalty for p in x.penalties}
    x = _score(spark, "DB_HOST", "db_host", source_type=F.lit("env_var"), target_type=F.lit("infra_resource"))
    assert x.score < 0.5 and "direction" in {p.penalty for p in x.penalties}
    assert _score(spark, "alpha", "omega").score == 0
    assert _score(spark, None, "a") is None


@pytest.mark.parametrize("pattern,hits,misses", [("env:DB_*", ["env:DB_HOST", "env:DB_"], ["env:XDB_HOST", "Env:DB_A"]), ("a.b?", ["a.bc"], ["axbc", "a.b"]), ("[ab]*", ["ax"], ["cx"]), ("[!ab]*", ["cx"], ["ax"])])
def test_globs(spark, pattern, hits, misses):
    df = spark.createDataFrame([(x,) for x in hits + misses], "x string")
    assert {r.x for r in df.filter(F.col("x").rlike(X.glob_regex(pattern))).collect()} == set(hits)


def test_text(spark):
    one = spark.createDataFrame([("getUser_Name-x/db:host 9",)], "s string")
    r = one.select(X.tokenize("s").alias("a"), X.tokenize_context("s").alias("b"), X.tokenize_suggest("s").alias("c"), X.normalize("s").alias("n"), X.name_of(F.lit("file://a/b")).alias("f"), X.last_name_of(F.lit("a:b:c")).alias("l")).first()
    assert r.a == ["getuser", "name", "x", "db", "host", "9"] and r.b == ["get", "user", "name", "db", "host"]
    assert r.c == ["getuser", "name", "host"] and r.n == "getusernamexdbhost 9" and (r.f, r.l) == ("a/b", "c")


def _nodes(spark):
    rows = [("infra:payment-db-host", "payment-db-host", "infra_resource"), ("infra:orders_queue", "orders_queue", "infra_resource"), ("env:PAYMENT_DB_HOST", "PAYMENT_DB_HOST", "env_var"), ("env:LONELY", "LONELY", "env_var"), ("env:N", None, "env_var")]
    return spark.createDataFrame(rows, "id string, name string, type string")


def test_best_match_and_missing_providers(spark):
    n = _nodes(spark)
    e = M.env_to_infra(n)
    assert [(x.source_id, x.target_id, x.type) for x in e.collect()] == [("infra:payment-db-host", "env:PAYMENT_DB_HOST", "provides")]
    assert {x.id for x in A.missing_providers(n, e).collect()} == {"env:LONELY", "env:N"}
    assert M.env_to_infra(n.filter("false")).count() == 0


def test_suppressions_expire(spark):
    e = spark.createDataFrame([("infra:a", "env:B", "provides", 0.9)], "source_id string, target_id string, type string, confidence double")
    past, ahead = dt.datetime(2000, 1, 1), dt.datetime(2100, 1, 1)
    kind = "id string, source_pattern string, target_pattern string, reason string, expires_at timestamp, enabled boolean"
    left = lambda *r: M.unsuppressed(e, spark.createDataFrame([r], kind)).count()
    assert left("1", "infra:*", "env:*", "", None, True) == 0 and left("1", "infra:*", "env:*", "", ahead, True) == 0
    assert left("1", "infra:*", "env:*", "", past, True) == 1 and left("1", "infra:*", "env:*", "", None, False) == 1 and left("1", "env:*", "*", "", None, True) == 1


def test_node_changes(spark):
    base = spark.createDataFrame([("a", "a", "env_var", "p", "1", ["x"], None), ("b", "b", "infra_resource", "p", None, ["x", "y"], '{"line":1}'), ("c", "c", "job", "p", None, ["x"], None)], NODE)
    head = spark.createDataFrame([("a", "a", "env_var", "p", "1", ["z"], None), ("b", "b", "infra_resource", "p", None, ["y", "x"], '{"line":2}'), ("d", "d", "job", "p", None, None, None)], NODE)
    got = {x.id: x for x in D.node_diff(base, head).collect()}
    assert {k: v.change for k, v in got.items()} == {"b": "modified", "c": "removed", "d": "added"}
    assert (got["b"].old_line, got["b"].new_line, got["b"].added_tokens) == ("1", "2", [])
    assert D.node_diff(base, base).count() == 0


def test_accuracy_and_reviewers(spark):
    f = spark.createDataFrame([("src/a.py",), ("docs/x.md",)], "path string")
    got = A.reviewers(f, [("*", ["@all"]), ("src/", ["@core"])]).collect()
    assert {x[0] for x in got} == {"@all", "@core"}
