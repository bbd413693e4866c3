import hashlib
import json
import os

import pytest

from rillgraph.operators.store import Store
from rillgraph.ship import ship
from rillgraph.sources import column_lineage as L
from rillgraph.sources import documents as D
from rillgraph.sources import extract as E
from rillgraph.sources import files as S
from rillgraph.sources.rules import RULES
from rillgraph.streaming import ingest as I

FILE = "path string, text string"


def hits(spark, path, text):
    return {(RULES[x.rule].name, x.name, x.line) for x in E.hits(spark.createDataFrame([(path, text)], FILE)).collect()}


def names(spark, path, text, prefix="env:"):
    nodes, _ = E.graph(spark.createDataFrame([(path, text)], FILE))
    return {x.name for x in nodes.collect() if x.id.startswith(prefix)}


def test_python_variables(spark):
    code = '''
import os

import pytest
from os import environ
from pydantic_settings import BaseSettings
HOST = os.getenv("APP_HOST", "x")
a = os.environ.get('APP_PORT'); b = os.environ["APP_USER"]
c = environ["BARE_NAME"]
if "APP_FLAG" in os.environ: pass
d = os.getenv("9"), os.getenv("http://x")
@click.option("--x", envvar="CLI_ONE")
class Settings(BaseSettings):
    model_config = SettingsConfigDict(env_prefix="SVC_")
    db_url: str
    named: str = Field(..., env="FIELD_NAME")
    _private: int = 1

vals = dotenv_values(".env")
k = vals["DOT_KEY"], other["NOT_KEY"]
env = environ.Env()
e = env.bool("DJANGO_DEBUG"), Variable.get("air_var")
API_TOKEN = config("tok")
PLAIN_URL = "http://x"
'''
    assert names(spark, "a.py", code) == {"APP_HOST", "APP_PORT", "APP_USER", "BARE_NAME", "APP_FLAG", "CLI_ONE", "SVC_DB_URL", "FIELD_NAME", "DOT_KEY", "DJANGO_DEBUG", "air_var", "API_TOKEN"}


def test_lines_and_first_of_scope(spark):
    got = hits(spark, "a.py", 'x\n\nos.getenv("AA_1")\nos.environ["AA_1"]\nos.getenv(\n  "BB_2")\n')
    assert got == {("py_getenv", "AA_1", 3), ("py_getenv", "BB_2", 5)}


def test_long_text_takes_linear_time(spark):
    text = "x = 1\n" * 80_000 + 'os.getenv("LAST_ONE")\n' + "y = 2\n" * 80_000
    assert hits(spark, "a.py", text) == {("py_getenv", "LAST_ONE", 80_001)}


def test_spark_tables(spark):
    code = """import pytest
from pyspark.sql import SparkSession
from x.y import z
df = (spark.read
      .format("delta")
      .load("s3://lake/a"))
spark.sql('SELECT * FROM db.one o JOIN db.two t ON o.id = t.id')
spark.sql("CREATE TABLE IF NOT EXISTS db.three AS SELECT 1")
df.write.format("delta").mode("append").save("s3://out/b")
df.write.insertInto("db.four")
"""
    _, e = E.graph(spark.createDataFrame([("j.py", code)], FILE))
    got = {(x.type, x.target_id) for x in e.collect() if x.target_id.startswith("data:")}
    assert got == {("reads", "data:s3://lake/a"), ("reads", "data:db.one"), ("reads", "data:db.two"), ("writes", "data:db.three"), ("writes", "data:s3://out/b"), ("writes", "data:db.four")}


def test_dbt_sql(spark):
    code = "{{ config(materialized='table') }} select {{ var('days') }}, '{{ env_var(\"DBT_X\") }}' from {{ ref('orders') }} join {{ source('raw', 'users') }}"
    _, e = E.graph(spark.createDataFrame([("models/m.sql", code)], FILE))
    assert {(x.source_id, x.type, x.target_id) for x in e.collect()} == {
        ("data:model:m", "depends_on", "data:model:orders"), ("data:model:m", "reads", "data:source:raw.users"), ("file://models/m.sql", "reads", "env:DBT_X"), ("file://models/m.sql", "reads", "config:dbt:days"), ("file://models/m.sql", "contains", "data:model:m"),
    }
    n, _ = E.graph(spark.createDataFrame([("models/m.sql", code)], FILE))
    assert json.loads(n.filter("id = 'data:model:m'").first().metadata)["materialized"] == "table"


def test_dbt_columns():
    sql = "{{ config(x=1) }} with a as (select p, q from {{ ref('z') }}) select distinct a.p, q as r, count(*) total, coalesce(x, 'from, y') as s, {{ var('v') }}, *, case when 1 then 2 end from a where (select 1) -- as t"
    assert E.selected(sql) == ["p", "r", "total", "s"]
    assert E.selected("select a from b union select c from d") == [] and E.selected("") == [] and E.selected("delete from x") == []


def test_minified_scripts_give_their_file_only(spark):
    n, e = E.graph(spark.createDataFrame([("a.min.js", "var a=process.env.SECRET_MIN;" * 60), ("b.js", "process.env.PLAIN_ONE")], FILE))
    assert {x.id for x in n.collect()} == {"file://a.min.js", "file://b.js", "env:PLAIN_ONE"} and e.count() == 1


def test_next_routes_and_flags(spark):
    f = spark.createDataFrame([("web/pages/api/users/[id].ts", "process.env.NEXT_PUBLIC_A"), ("web/next.config.js", "x"), ("app/api/items/route.ts", "y")], FILE)
    n, e = E.graph(f)
    ids = {x.id: x for x in n.collect()}
    assert {"api:/api/users/[id]", "api:/api/items", "config:nextjs:next.config.js"} <= set(ids)
    m = json.loads(ids["env:NEXT_PUBLIC_A"].metadata)
    assert (m["framework"], m["public"]) == ("nextjs", True)
    assert ("file://web/next.config.js", "config:nextjs:next.config.js", "contains") in {(x.source_id, x.target_id, x.type) for x in e.collect()}


def test_lineage_of_long_files_and_exact_lines():
    code = 'a = df.select("x1")\nb = df.filter("q > 1").withColumn("z", F.lit(1))\n' + "# pad\n" * 20_000 + 'c = df.withColumn("w", F.col("v"))\n'
    got = L.references(code)
    assert {(r[1], r[5]) for r in got if r[0] == "flow"} == {("z", "q"), ("w", "v")} and [r[4] for r in got if r[1] == "v"] == [20_003]
    far = 't = spark.table("db.t")\nd = (t' + " " * 500 + '.select("k"))\n'
    assert ("read", "k", "db.t", "select", 2, None) in L.references(far)


def test_odd_files(spark):
    f = spark.createDataFrame([(None, "x"), ("a.py", None), ("b.py", ""), ("c.unknown", 'os.getenv("A_B")'), ("d.py", "\x00 ퟿ é")], FILE)
    n, e = E.graph(f)
    assert {x.id for x in n.collect()} == {"file://a.py", "file://b.py", "file://c.unknown", "file://d.py"} and e.count() == 0
    n, e = D.ingested(f)
    assert n.count() == 4 and e.count() == 0
    n, e = D.ingested(f.filter("false"))
    assert n.count() == 0 and e.count() == 0


def test_broken_documents_give_nothing(spark):
    ship(spark)
    f = spark.createDataFrame([("manifest.json", "{"), ("x.yaml", "a: [b"), ("plan.json", "[]"), ("package.json", "null"), ("y.yml", "- 1\n- 2"), ("z.yaml", "apiVersion: v1\nkind: Service")], FILE)
    _, e = D.ingested(f)
    assert e.count() == 0


def test_openlineage_gates(spark):
    event = lambda t: {"eventType": t, "job": {"name": f"j{t}"}, "inputs": [{"name": "in", "facets": {"schema": {"fields": [{"name": "c"}]}}}, {"namespace": "n"}]}
    f = spark.createDataFrame([("a.json", json.dumps([event("COMPLETE"), event("RUNNING")])), ("b.json", json.dumps(event("START")))], FILE)
    got = {(x.kind, x.a) for x in D.openlineage(D.events(f)).collect()}
    assert got == {("node", "job:default/jCOMPLETE"), ("node", "job:default/jRUNNING"), ("node", "data:default/in"), ("edge", "job:default/jCOMPLETE"), ("edge", "job:default/jRUNNING"), ("node", "column:default/in/c"), ("edge", "data:default/in")}


def test_kubernetes_and_schema_rows():
    text = "apiVersion: v1\nkind: Service\nmetadata: {name: s}\nspec: {selector: {app: x}}\n"
    assert ("edge", "k8s:default/service/s", "k8s:default/selector/" + hashlib.md5(b'{"app": "x"}').hexdigest()[:8], "routes_to") in list(D.kubernetes_rows("a.yaml", text))
    schema = "models:\n- name: m\n  columns:\n  - name: id\n    tests: [unique, {accepted_values: {values: [1]}}]\n"
    assert {r[1] for r in D.dbt_schema_rows("a.yml", schema) if r[0] == "node"} == {"data:model:m", "column:m/id", "test:unique_m_id", "test:accepted_values_m_id"}
    job = "pipeline_a: {schedule: x, env: {A: '${B_C}'}, reads: [t.a]}\n"
    assert {r[2] for r in D.spark_rows("a.yml", job) if r[0] == "edge"} == {"job:spark/pipeline_a", "env:A", "env:B_C", "data:t.a"}


def test_column_references():
    code = 'q = spark.sql("""SELECT a.x AS y, count(b.z) AS n FROM t1 a JOIN t2 b ON a.k = b.k WHERE a.w > 1 GROUP BY a.x""")\nd = d.select("p", F.col("q").alias("r")).filter(F.col(name) > 1).join(e, ["k"], "left")\n'
    got = {(r[0], r[1], r[2], r[5]) for r in L.references(code)}
    assert {("read", "x", "t1", None), ("read", "z", "t2", None), ("read", "w", "t1", None), ("flow", "y", None, "x"), ("flow", "n", None, "z"), ("read", "k", "t1", None)} <= got
    assert {("read", "p", None, None), ("read", "q", None, None), ("flow", "r", None, "q"), ("dynamic", "name", None, None)} <= got
    assert not any(r[1] == "left" for r in L.references(code))


def test_change_listings(spark):
    lines = spark.createDataFrame([("M\ta.py",), ("R100\told.py\tnew.py",), ("D\tb.py",), ("",), ("noise",)], "value string")
    assert {tuple(x) for x in S.changed_files(lines).collect()} == {("a.py", "M", None), ("new.py", "R", "old.py"), ("b.py", "D", None)}
    diff = spark.createDataFrame([("diff --git a/x.py b/y.py\n--- a/x.py\n+++ b/y.py\ndiff --git a/z b/z\n",)], "value string")
    assert {x.path for x in S.diffed_files(diff).collect()} == {"y.py", "z"}


def _tree(root):
    os.makedirs(f"{root}/src/node_modules")
    for p, t in (("src/a.py", 'import os\nos.getenv("DB_HOST")\n'), ("src/main.tf", 'resource "aws_db" "db_host" {\n}\n'), ("src/node_modules/x.js", "process.env.NO_NO"), ("src/big.py", "x" * 600_000)):
        with open(f"{root}/{p}", "w") as f:
            f.write(t)


def test_discovery_scan_and_stream(spark, tmp_path):
    """Files into the store as a stream; a change, a deletion, and matching on the snapshot."""
    root = f"{tmp_path}/repo"
    _tree(root)
    assert {x.path for x in S.discover(spark, root).collect()} == {"src/a.py", "src/main.tf"}
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda: I.start(I.watch(spark, root), store, f"{tmp_path}/state").awaitTermination()
    ship(spark)
    run()
    ids = {x.id for x in store.read("nodes").collect()}
    assert {"env:DB_HOST", "file://src/a.py"} <= ids and any(i.startswith("infra:") for i in ids)
    I.restitch(store)
    assert [x.target_id for x in store.read("edges").filter("match_strategy = 'semantic'").collect()] == ["env:DB_HOST"]
    with open(f"{root}/src/b.py", "w") as f:
        f.write('os.getenv("NEW_NAME")')
    run()
    assert {"env:NEW_NAME", "env:DB_HOST"} <= {x.id for x in store.read("nodes").collect()}
    os.remove(f"{root}/src/b.py")
    assert {(x.path, x.state) for x in I.reconcile(spark, store, root).collect()} >= {("src/b.py", "deleted"), ("src/a.py", "unchanged")}
    assert "env:NEW_NAME" not in {x.id for x in store.read("nodes").collect()}


def _events(spark, folder, name, rows):
    spark.createDataFrame(rows, "ts string, event_type string, user_id long, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "user_id", "value").coalesce(1).write.parquet(f"{folder}/{name}")


def test_events_after_the_watermark_are_dropped(spark, tmp_path):
    """Three batches; the last has an event later than the watermark allows and one that isn't."""
    schema = "ts timestamp, event_type string, user_id long, value double"
    os.makedirs(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    rows: dict = {}

    def batch(df, _):
        for x in df.collect():
            rows[x.event_type, str(x.start)] = x.n

    _events(spark, f"{tmp_path}/in", "1", [("2024-01-01 00:10:00", "a", 1, 1.0), ("2024-01-01 05:00:00", "a", 1, 1.0)])
    go = lambda: I.event_windows(stream).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    go()
    _events(spark, f"{tmp_path}/in", "2", [("2024-01-01 00:20:00", "a", 1, 1.0), ("2024-01-01 05:30:00", "a", 1, 1.0)])
    go()
    assert rows["a", "2024-01-01 00:00:00"] == 1 and rows["a", "2024-01-01 05:00:00"] == 2


def test_sessions_and_lineage_events(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-01 00:20:00", 1), ("2024-01-01 01:00:00", 1), ("2024-01-01 00:05:00", 2)], "ts string, user_id long")
    assert sorted((x.user_id, x.n) for x in I.sessions(e.withColumn("event_type", e.ts)).collect()) == [(1, 1), (1, 2), (2, 1)]
    event = {"eventType": "COMPLETE", "eventTime": "2024-01-01T00:00:00Z", "run": {"runId": "r"}, "job": {"name": "j"}}
    os.makedirs(f"{tmp_path}/ev")
    with open(f"{tmp_path}/ev/a.json", "w") as f:
        f.write("\n".join(json.dumps(x) for x in (event, event, {**event, "eventType": "START"}, {"job": {}})))
    got = []
    I.lineage_events(spark, f"{tmp_path}/ev").writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(x["type"] for x in got) == ["COMPLETE", "START"]


def test_store_upserts_and_filters(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    e = lambda c: spark.createDataFrame([("a", "b", "reads", c)], "source_id string, target_id string, type string, confidence double")
    store.upsert("edges", e(0.4))
    store.upsert("edges", e(0.6))
    assert [x.confidence for x in store.read("edges").collect()] == [0.6]
    assert store.edges(0.65).count() == 0 and store.edges(0.6).count() == 1
    store.clear()
    assert store.read("edges").count() == 0


def test_a_small_batch_rewrites_few_partitions(spark, tmp_path):
    """Ten files of thousands; one manifest for all tables; the token index follows; old versions can be removed."""
    store = Store(spark, f"file://{tmp_path}/s", parts=64)
    node = "id string, name string, type string, path string, tokens array<string>"
    rows = [(f"env:V_{i}", f"V_{i}", "env_var", f"f{i}.py", ["v", str(i)]) for i in range(3000)]
    store.upsert("nodes", spark.createDataFrame(rows, node))
    store.upsert("edges", spark.createDataFrame([(f"file://f{i}.py", f"env:V_{i}", "reads") for i in range(3000)], "source_id string, target_id string, type string"))
    number, before = store.manifest()
    assert number == 2 and len(before["nodes"]) == 64
    store.replace_files(spark.createDataFrame([(f"f{i}.py",) for i in range(10)], "path string"), spark.createDataFrame([(f"env:N_{i}", f"N_{i}", "env_var", f"f{i}.py", ["n"]) for i in range(10)], node),
        spark.createDataFrame([(f"file://f{i}.py", f"env:N_{i}", "reads") for i in range(10)], "source_id string, target_id string, type string"), spark.createDataFrame([(f"f{i}.py", "h") for i in range(10)], "file_path string, file_hash string"))
    number, after = store.manifest()
    assert number == 3
    for t in ("nodes", "edges", "token_index"):
        changed = [k for k in after[t] if after[t][k] != before[t].get(k)]
        assert 0 < len(changed) <= 20, (t, len(changed))
    assert store.read("nodes").count() == 3000 and store.read("edges").count() == 3000 and store.read("scan_metadata").count() == 10
    assert {x.node_id for x in store.read("token_index").filter("token = 'n'").collect()} == {f"env:N_{i}" for i in range(10)}
    assert store.read("token_index").filter("token = '3'").count() == 0
    store.delete_edges(spark.createDataFrame([("file://f20.py",)], "id string"))
    store.clean()
    assert store.read("edges").count() == 2999 and len(store._names(f"{store.folder}/manifests")) == 1


def test_of_two_commits_at_once_the_second_fails(spark, tmp_path):
    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = spark.createDataFrame([("a", "b", "reads")], "source_id string, target_id string, type string")
    seen = two.manifest
    two.manifest = lambda found=seen(): found
    one.upsert("edges", rows)
    with pytest.raises(Exception, match="exist"):
        two.upsert("edges", rows)
