"""The work on rows is spread over tasks and each of its parts is done once."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from rillgraph.functions.score import score
from rillgraph.functions.text import match_quality, weighted_overlap
from rillgraph.operators import analysis as A
from rillgraph.sources import documents as D
from rillgraph.sources import extract as E

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.exists(DIR), reason="no tables")
@pytest.mark.parametrize("name", ["column_confidence", "directed_scores", "extract_services", "extract_terraform_references", "match_quality", "routed_files", "suggested_patterns", "weighted_overlap"])
def test_a_small_table_is_worked_on_by_all_cores(spark, name):
    assert "Repartition" in plan(entry.queries()[name](spark, DIR))


def test_names_are_split_once(spark):
    """Each expression is bound, not repeated wherever its value is used."""
    names = spark.createDataFrame([("payment_db_host", "PAYMENT_DB_HOST")], "a string, b string")
    assert plan(names.select(score("a", "b"))).count("split(") <= 4
    lists = spark.createDataFrame([(["a", "db"], ["db"])], "a array<string>, b array<string>")
    assert plan(lists.select(weighted_overlap("a", "b"))).count("array_distinct(") == 2
    assert plan(lists.select(match_quality("a", "b"))).count("array_intersect(") <= 3


def test_a_script_is_looked_at_once_for_being_minified(spark):
    files = spark.createDataFrame([("a.js", "process.env.AB")], "path string, text string")
    assert plan(E.hits(files)).count("split(") <= 1


def test_yaml_is_read_once_for_all_extractors():
    text, before = "job_name: read_once\noutputs: [w.t]\n", D._loaded.cache_info().misses
    assert [r for f in (D.kubernetes_rows, D.spark_rows, D.dbt_schema_rows) for r in f("j.yml", text)]
    assert D._loaded.cache_info().misses == before + 1


def test_hints_by_sets_of_words_are_those_of_all_pairs(spark):
    """Also for names of more words than have sets, and among equals the first by name."""
    long = "_".join(f"w{i}" for i in range(9))
    lone = ["P_1", "P_2", "W1_W2", "NONE", long.upper(), "A_B_C_D_E_F"]
    outs = ["p_1", "p_3", "p_2_1", "w1_w2_w3", long, long + "_x", "b_d_f", "a_b_f", "z"]
    nodes = spark.createDataFrame([(f"env:{x}", x, "env_var") for x in lone] + [(f"infra:output:{x}", x, "config_key") for x in outs], "id string, name string, type string")
    edges = spark.createDataFrame([], "source_id string, target_id string, type string")
    words = lambda x: set(x.lower().split("_"))
    want = {x: min(outs, key=lambda o: (-len(words(x) & words(o)), o)) for x in lone}
    assert {x.name: x.hint for x in A.orphan_diagnostics(nodes, edges).collect()} == want


def test_sets_of_words(spark):
    got = spark.createDataFrame([(["a", "b", "c"],), ([],)], "t array<string>").select(A.word_sets("t").alias("s")).collect()
    assert Counter(map(tuple, got[0].s)) == Counter([("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]) and got[1].s == []
