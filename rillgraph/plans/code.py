"""Queries of the extractors: files made from the driver's rows, so that SQL knows what must be found in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import fresh_folder, removed, spread
from ..sources import column_lineage as L
from ..sources import documents as D
from ..sources import extract as E
from ..streaming import ingest as I
from .queries import query
from .views import table


def _files(df, path: str, text: str):
    """Files of a template for each row; {c} stands for a column."""

    def filled(s: str):
        parts = F.lit("")
        for i, piece in enumerate(s.replace("{", "\0{").replace("}", "\0").split("\0")):
            if piece:
                parts = F.concat(parts, F.col(piece[1:]).cast("string") if piece[0] == "{" else F.lit(piece.replace("‹", "{").replace("›", "}")))
        return parts

    return df.select(filled(path).alias("path"), filled(text).alias("text"))


def _parts(spark, d):
    return spread(table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("n")))


_PART = "(SELECT p_partkey AS k, upper(replace(p_name, ' ', '_')) AS n FROM part)"


def _found(files, languages=None):
    return E.hits(files).select("path", F.element_at(F.array(*(F.lit(r.name) for r in E.RULES)), F.col("rule") + 1).alias("rule"), "name", "line")


@query(f"""SELECT 'src/p' || k || '.py' AS path, r AS rule, replace(replace(x, '$n', n), '$k', k::VARCHAR) AS name, l AS line FROM {_PART},
  (VALUES ('py_import', 'os', 1), ('py_getenv', '$n_$k', 3), ('py_environ', 'B_$k', 5), ('py_definition', 'load_$k', 7), ('py_envvars', 'C_$k', 8), ('py_envvars', 'D_$k', 8)) v(r, x, l)""")  # fmt: skip
def extract_python(spark, d):
    text = 'import os\n\nA = os.getenv("{n}_{k}", "x")\n# os.getenv("{n}_{k}") again\nB = os.environ[\n  "B_{k}"]\ndef load_{k}():\n    return option(envvar=["C_{k}", "D_{k}"]), os.getenv("a b")\n'
    return _found(_files(_parts(spark, d), "src/p{k}.py", text))


@query(f"""SELECT 'web/p' || k || '.ts' AS path, r AS rule, replace(replace(x, '$n', n), '$k', k::VARCHAR) AS name, l AS line FROM {_PART},
  (VALUES ('js_import', './m$k', 1), ('js_dot', '$n_$k', 2), ('js_index', 'I_$k', 3), ('js_destructured', 'X_$k', 4), ('js_destructured', 'Y_$k', 4), ('js_meta', 'VITE_$k', 5), ('js_definition', 'f$k', 6), ('js_arrow', 'g$k', 7), ('js_require', 'r$k', 7)) v(r, x, l)""")  # fmt: skip
def extract_javascript(spark, d):
    text = "import ‹ a › from './m{k}';\nconst u = process.env.{n}_{k};\nconst i = process.env['I_{k}'];\nconst ‹ X_{k}, Y_{k}: y = 1 › = process.env;\nconst v = import.meta.env.VITE_{k};\nexport function f{k}() ‹›\nconst g{k} = (a) => require('r{k}');\n"
    return _found(_files(_parts(spark, d), "web/p{k}.ts", text))


@query(f"""SELECT f || k || e AS path, r AS rule, replace(x, '$k', k::VARCHAR) AS name, l AS line FROM {_PART},
  (VALUES ('m', '.go', 'go_imports', 'os', 2), ('m', '.go', 'go_imports', 'net/m$k', 2), ('m', '.go', 'go_function', 'Run$k', 3), ('m', '.go', 'go_env', 'GO_$k', 4), ('m', '.go', 'go_tag', 'TAG_$k', 6), ('m', '.go', 'go_type', 'T$k', 6),
          ('J', '.java', 'java_import', 'a.b.C$k', 1), ('J', '.java', 'java_type', 'J$k', 2), ('J', '.java', 'java_env', 'JV_$k', 3), ('J', '.java', 'java_value', 'app.k$k', 4)) v(f, e, r, x, l)""")  # fmt: skip
def extract_go_and_java(spark, d):
    p = _parts(spark, d)
    go = _files(p, "m{k}.go", 'package m\nimport ( "os"; "net/m{k}" )\nfunc Run{k}(a int) ‹\n x := os.Getenv("GO_{k}")\n›\ntype T{k} struct ‹ A string `env:"TAG_{k},required"` ›\n')
    java = _files(p, "J{k}.java", 'import a.b.C{k};\npublic class J{k} ‹\n  String v = System.getenv("JV_{k}");\n  @Value("$‹app.k{k}:none›") String w;\n›\n')
    return _found(go.unionByName(java))


@query(f"""SELECT 't' || k || '.tf' AS path, s AS source_id, t AS target_id, y AS type FROM {_PART}, LATERAL (VALUES
  ('infra:aws_db_instance.d' || k, 'infra:var:v' || k, 'reads'), ('infra:aws_db_instance.d' || k, 'infra:data.aws_vpc.main', 'reads'), ('infra:output:o' || k, 'infra:aws_db_instance.d' || k, 'depends_on'), ('infra:local.l' || k, 'infra:module:m' || k, 'depends_on')) v(s, t, y)""")  # fmt: skip
def extract_terraform_references(spark, d):
    text = 'variable "v{k}" ‹ type = string ›\nresource "aws_db_instance" "d{k}" ‹\n  name = "x-$‹var.v{k}›" # var.none\n  vpc  = data.aws_vpc.main.id\n›\noutput "o{k}" ‹\n  value = aws_db_instance.d{k}.address\n›\nlocals ‹\n  l{k} = module.m{k}.id\n  plain = "var.text"\n›\n'
    return E.terraform_references(_files(_parts(spark, d), "t{k}.tf", text))


@query(f"""SELECT 'jobs/j' || k || '.py' AS path, 'file://jobs/j' || k || '.py' AS source_id, replace(t, '$k', k::VARCHAR) AS target_id, e AS type FROM {_PART}, (VALUES ('data:raw.in_$k', 'reads'), ('data:s3://lake/p$k', 'reads'), ('data:dim.users_$k', 'reads'), ('data:pub.users', 'reads'),
  ('data:delta:/lake/d$k', 'reads'), ('config:spark:spark.sql.shuffle.partitions', 'reads'), ('data:out.t_$k', 'writes'), ('data:out.merged_$k', 'writes'), ('data:pub.out_$k', 'writes'), ('py:pyspark.sql', 'imports')) v(t, e)""")  # fmt: skip
def extract_spark_tables(spark, d):
    """Tables by call, path, JDBC and SQL; plain lower-case words (a view, a common table expression, a variable) are no tables."""
    text = 'from pyspark.sql import SparkSession\nspark.conf.set("spark.sql.shuffle.partitions", 8)\na = spark.table("raw.in_{k}")\nu = spark.table("users")\nb = spark.read.option("x", "y").parquet("s3://lake/p{k}")\nj = spark.read.jdbc(url, "pub.users")\nd = DeltaTable.forPath(spark, "/lake/d{k}")\nspark.sql("""WITH recent AS (SELECT 1) INSERT INTO out.merged_{k} SELECT * FROM recent JOIN dim.users_{k} u""")\na.write.mode("append").saveAsTable("out.t_{k}")\na.write.mode("append").jdbc(url=u, table="pub.out_{k}")\n'
    _, edges = E.graph(_files(_parts(spark, d), "jobs/j{k}.py", text))
    return edges.select(F.replace("source_id", F.lit("file://"), F.lit("")).alias("path"), "source_id", "target_id", "type")


@query(f"""SELECT 'a/s' || k || '.py' AS path, replace(v.n, '$k', k::VARCHAR) AS name, r AS source, c AS confidence, l AS line FROM {_PART}, (VALUES ('APP_HOST', 'py_settings', 1.0::DOUBLE, NULL), ('APP_SIZE_$k', 'py_settings', 1.0, NULL), ('F_$k', 'py_field', 1.0, 7), ('KEY_$k', 'py_dotenv', 1.0, NULL),
  ('DEBUG_$k', 'py_env_object', 1.0, 10), ('path_$k', 'py_variable', 1.0, 11), ('API_URL', 'py_heuristic', 0.7, 12), ('IN_$k', 'py_in_environ', 1.0, 13)) v(n, r, c, l)""")  # fmt: skip
def extract_settings(spark, d):
    """Settings classes, fields, dotenv files, environment objects, schedulers' variables and likely names."""
    text = 'from pydantic_settings import BaseSettings\nclass S(BaseSettings):\n    host: str = "x"\n    size_{k}: int = 1\n    class Config:\n        env_prefix = "APP_"\nf = Field(1, env="F_{k}")\nc = dotenv_values(".env")\nc["KEY_{k}"]\nenv.bool("DEBUG_{k}")\nVariable.get("path_{k}")\nAPI_URL = settings.url\n"IN_{k}" in os.environ\n'
    nodes, edges = E.graph(_files(_parts(spark, d), "a/s{k}.py", text))
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    own = nodes.filter("type = 'env_var'").select("path", "id", "name", meta("source").alias("source"), meta("line").cast("int").alias("line"))
    return own.join(edges.select(F.col("target_id").alias("id"), F.substring("source_id", 8, 1 << 20).alias("path"), "confidence"), ["id", "path"]).select("path", "name", "source", "confidence", "line")


@query(f"""SELECT replace(s, '$k', k::VARCHAR) AS source_id, replace(t, '$k', k::VARCHAR) AS target_id, y AS type FROM {_PART}, (VALUES ('file://models/m$k.sql', 'data:model:m$k', 'contains'), ('data:model:m$k', 'data:model:base_$k', 'depends_on'), ('data:model:m$k', 'data:source:raw.users', 'reads'),
  ('file://models/m$k.sql', 'env:DBT_$k', 'reads'), ('file://models/m$k.sql', 'config:dbt:days', 'reads'), ('data:model:m$k', 'column:m$k/id', 'contains'), ('data:model:m$k', 'column:m$k/total', 'contains'), ('data:model:s$k', 'column:s$k/id', 'contains'), ('test:unique_s$k_id', 'data:model:s$k', 'depends_on')) v(s, t, y)""")  # fmt: skip
def extract_dbt_sql(spark, d):
    """Models with what they refer to and their columns, and a schema file's."""
    sql = "‹‹ config(materialized='table') ››\nselect id, sum(x) as total from ‹‹ ref('base_{k}') ›› join ‹‹ source('raw', 'users') ›› where d > ‹‹ var('days') ›› and '‹‹ env_var(\"DBT_{k}\") ››' <> ''\n"
    yml = "models:\n- name: s{k}\n  columns:\n  - name: id\n    tests: [unique]\n"
    p = _parts(spark, d)
    _, edges = D.ingested(_files(p, "models/m{k}.sql", sql).unionByName(_files(p, "models/s{k}.yml", yml)))
    return edges.select("source_id", "target_id", "type")


@query(f"""SELECT replace(s, '$k', k::VARCHAR) AS source_id, CASE WHEN t = '$h' THEN 'k8s:shop/selector/' || substr(md5('{{"app": "a' || k || '", "tier": "web"}}'), 1, 8) ELSE replace(t, '$k', k::VARCHAR) END AS target_id, y AS type FROM {_PART}, (VALUES ('file://s$k.yaml', 'k8s:shop/service/s$k', 'provisions'), ('k8s:shop/service/s$k', '$h', 'routes_to'),
  ('file://s$k.yaml', 'k8s:shop/ingress/i$k', 'provisions'), ('k8s:shop/ingress/i$k', 'k8s:shop/service/s$k', 'routes_to'), ('k8s:shop/ingress/i$k', 'k8s:shop/service/old$k', 'routes_to')) v(s, t, y)""")  # fmt: skip
def extract_services(spark, d):
    """Services with their selector's hash, ingress routes of both forms."""
    text = "apiVersion: v1\nkind: Service\nmetadata: ‹name: s{k}, namespace: shop›\nspec: ‹selector: ‹tier: web, app: a{k}››\n---\napiVersion: networking.k8s.io/v1\nkind: Ingress\nmetadata: ‹name: i{k}, namespace: shop›\nspec: ‹rules: [‹http: ‹paths: [‹backend: ‹service: ‹name: s{k}›››, ‹backend: ‹serviceName: old{k}››]››]›\n"
    return D.graph(D.yaml_documents(_files(_parts(spark, d), "s{k}.yaml", text)))[1].select("source_id", "target_id", "type")


@query(f"""SELECT replace(p, '$k', k::VARCHAR) AS path, replace(i, '$k', k::VARCHAR) AS id, t AS type, f AS framework, b AS public FROM {_PART}, (VALUES ('web/pages/api/u/$k.ts', 'file://web/pages/api/u/$k.ts', 'code_file', NULL, NULL), ('web/pages/api/u/$k.ts', 'api:/api/u/$k', 'code_entity', NULL, NULL), ('web/pages/api/u/$k.ts', 'env:NEXT_PUBLIC_$k', 'env_var', 'nextjs', 'true'),
  ('web/pages/api/u/$k.ts', 'env:PLAIN_$k', 'env_var', NULL, 'false'), ('web/$k/next.config.js', 'file://web/$k/next.config.js', 'code_file', NULL, NULL), ('web/$k/next.config.js', 'config:nextjs:next.config.js', 'config_key', NULL, NULL), ('web/$k.min.js', 'file://web/$k.min.js', 'code_file', NULL, NULL)) v(p, i, t, f, b)""")  # fmt: skip
def extract_scripts(spark, d):
    """Routes and configuration by path, the frameworks of variables, and of minified scripts only the file."""
    p = _parts(spark, d)
    code = _files(p, "web/pages/api/u/{k}.ts", "const a = process.env.NEXT_PUBLIC_{k};\nconst b = process.env.PLAIN_{k};\n").unionByName(_files(p, "web/{k}/next.config.js", "module.x = 1\n")).unionByName(_files(p, "web/{k}.min.js", "var a=process.env.HIDDEN_ONE;" * 50))
    nodes, _ = E.graph(code)
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    return nodes.select("path", "id", "type", meta("framework").alias("framework"), meta("public").alias("public"))


@query(f"""SELECT 'm/d' || k || '.py' AS path, c AS "column", x AS context, s AS sources, f AS confidence FROM {_PART}, (VALUES ('a', 'withColumn', 'x', 'high'), ('b', 'withColumn', 'x,y', 'medium'), ('c', 'withColumn', '', 'low'), ('n', 'withColumnRenamed', 'o', 'high')) v(c, x, s, f)""")
def column_confidence(spark, d):
    text = 'd = d.withColumn("a", F.col("x"))\n\n\nd = d.withColumn("b", F.col("x") + F.col("y"))\n\n\nd = d.withColumn("c", F.lit({k}))\n\n\nd = d.withColumnRenamed("o", "n")\n'
    return L.confidence(L.column_lineage(_files(_parts(spark, d), "m/d{k}.py", text))).select("path", "column", "context", F.array_join(F.coalesce("sources", F.array().cast("array<string>")), ",").alias("sources"), "confidence")


@query(f"""SELECT 'm/c' || k || '.py' AS path, kind, replace(c, '$k', k::VARCHAR) AS "column", l AS line, source FROM {_PART}, (VALUES ('read', 'amount', 2, NULL), ('read', 'rate', 2, NULL), ('write', 'net_$k', 2, NULL), ('flow', 'net_$k', 2, 'amount'), ('flow', 'net_$k', 2, 'rate'),
  ('read', 'region', 3, NULL), ('read', 'net', 3, NULL), ('write', 'total_$k', 3, NULL), ('flow', 'total_$k', 3, 'net')) v(kind, c, l, source)""")  # fmt: skip
def extract_column_lineage(spark, d):
    text = 'df = spark.table("t{k}")\ndf = df.withColumn("net_{k}", F.col("amount") * (1 - F.col("rate")))\nx = df.groupBy("region").agg(F.sum("net").alias("total_{k}"))\n'
    return L.column_lineage(_files(_parts(spark, d), "m/c{k}.py", text)).select("path", "kind", "column", "line", "source")


@query("""WITH e AS (SELECT 'job:shop/load_' || o_orderstatus AS job, 'data:shop/customer_' || o_custkey AS i, 'data:shop/order_' || o_orderkey AS o FROM orders WHERE o_orderpriority NOT LIKE '1%')
SELECT source_id, target_id, type FROM (SELECT job AS source_id, i AS target_id, 'reads' AS type FROM e UNION SELECT job, o, 'writes' FROM e UNION SELECT o, replace(o, 'data:', 'column:') || '/total', 'contains' FROM e
  UNION SELECT replace(i, 'data:', 'column:') || '/price', replace(o, 'data:', 'column:') || '/total', 'transforms' FROM e)""")  # fmt: skip
def extract_openlineage(spark, d):
    """An event for each order; those of priority 1 failed."""
    text = '‹"eventType":"{s}","job":‹"namespace":"shop","name":"load_{o_orderstatus}"›,"inputs":[‹"namespace":"shop","name":"customer_{o_custkey}"›],"outputs":[‹"namespace":"shop","name":"order_{o_orderkey}","facets":‹"schema":‹"fields":[‹"name":"total","type":"double"›]›,"columnLineage":‹"fields":‹"total":‹"inputFields":[‹"namespace":"shop","name":"customer_{o_custkey}","field":"price"›]›››››]›'
    o = table(spark, d, "orders").withColumn("s", F.when(F.startswith("o_orderpriority", F.lit("1")), "FAIL").otherwise("COMPLETE"))
    _, edges = D.graph(D.openlineage(D.events(_files(o, "e/{o_orderkey}.json", text))))
    return edges.select("source_id", "target_id", "type").distinct()


@query(f"""SELECT s AS source_id, t AS target_id, y AS type FROM {_PART}, LATERAL (VALUES ('data:model:mart.m' || k, 'data:source:raw.s' || k, 'reads'), ('data:model:mart.n' || k, 'data:model:mart.m' || k, 'depends_on'), ('test:t' || k, 'data:model:mart.m' || k, 'depends_on'),
  ('exposure:x' || k, 'data:model:mart.n' || k, 'consumes'), ('data:model:mart.m' || k, 'column:mart.m' || k || '/id', 'contains')) v(s, t, y)""")  # fmt: skip
def extract_dbt_manifest(spark, d):
    text = '‹"nodes":‹"model.p.m{k}":‹"name":"m{k}","schema":"mart","depends_on":‹"nodes":["source.p.raw.s{k}","macro.none"]›,"columns":‹"id":‹"name":"id"›››,"model.p.n{k}":‹"name":"n{k}","schema":"mart","depends_on":‹"nodes":["model.p.m{k}"]››,"test.p.t{k}":‹"name":"t{k}","depends_on":‹"nodes":["model.p.m{k}"]›››,"sources":‹"source.p.raw.s{k}":‹"name":"s{k}","source_name":"raw"››,"exposures":‹"exposure.p.x{k}":‹"name":"x{k}","depends_on":‹"nodes":["model.p.n{k}"]››››'
    return D.graph(D.dbt_manifest(_files(_parts(spark, d), "{k}/manifest.json", text)))[1].select("source_id", "target_id", "type")


@query(f"""SELECT s AS source_id, t AS target_id, y AS type FROM {_PART}, LATERAL (VALUES ('file://k' || k || '.yaml', 'k8s:shop/deployment/d' || k, 'provisions'), ('k8s:shop/deployment/d' || k, 'k8s:shop/secret/s' || k, 'reads'), ('k8s:shop/deployment/d' || k, 'env:KEY_' || k, 'provides'),
  ('file://k' || k || '.yaml', 'k8s:default/ingress/i' || k, 'provisions'), ('k8s:default/ingress/i' || k, 'k8s:default/service/b' || k, 'routes_to'), ('file://j' || k || '.yml', 'job:spark/j' || k, 'contains'), ('job:spark/j' || k, 'job:spark/up', 'depends_on'), ('job:spark/j' || k, 'env:HOST_' || k, 'reads'), ('job:spark/j' || k, 'data:w.t' || k, 'writes')) v(s, t, y)""")  # fmt: skip
def extract_yaml(spark, d):
    """Kubernetes manifests and Spark job files."""
    k8s = "apiVersion: apps/v1\nkind: Deployment\nmetadata: ‹name: d{k}, namespace: shop›\nspec: ‹template: ‹spec: ‹containers: [‹name: a, env: [‹name: PLAIN, value: x›, ‹name: KEY_{k}, valueFrom: ‹secretKeyRef: ‹name: s{k}, key: k›››]›]›››\n---\napiVersion: networking.k8s.io/v1\nkind: Ingress\nmetadata: ‹name: i{k}›\nspec: ‹defaultBackend: ‹service: ‹name: b{k}›››\n"
    job = 'job_name: j{k}\nschedule: "0 6 * * *"\ndependencies: [up]\nenvironment: ‹HOST_{k}: x›\noutputs: [w.t{k}]\n'
    p = _parts(spark, d)
    return D.graph(D.yaml_documents(_files(p, "k{k}.yaml", k8s).unionByName(_files(p, "j{k}.yml", job))))[1].select("source_id", "target_id", "type")


@query(f"""SELECT kind, a, b, c FROM {_PART}, LATERAL (VALUES ('node', 'infra:aws_s3_bucket.b' || k, 'b' || k, 'infra_resource'), ('action', 'infra:aws_s3_bucket.b' || k, 'create,delete', 'aws_s3_bucket.b' || k), ('node', 'npm:lib' || k, 'lib' || k, 'code_entity'), ('edge', 'file://' || k || '/package.json', 'npm:lib' || k, 'depends_on'),
  ('node', 'script:app' || k || ':build', 'build', 'job'), ('edge', 'file://' || k || '/package.json', 'script:app' || k || ':build', 'contains')) v(kind, a, b, c)""")  # fmt: skip
def extract_plans_and_packages(spark, d):
    p = _parts(spark, d)
    plan = _files(p, "{k}/plan.json", '‹"resource_changes":[‹"address":"aws_s3_bucket.b{k}","type":"aws_s3_bucket","name":"b{k}","change":‹"actions":["create","delete"]››,‹"address":"x","type":"t","name":"n","change":‹"actions":["read"]››]›')
    pack = _files(p, "{k}/package.json", '‹"name":"app{k}","dependencies":‹"lib{k}":"^1"›,"scripts":‹"build":"x"››')
    return D.terraform_plan(plan).unionByName(D.package_json(pack)).select("kind", "a", "b", "c")


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", count(*) AS n FROM events GROUP BY ALL")
def streamed_windows(spark, d):
    """The events table as a stream into hourly windows; each batch's whole result replaces the last."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return _streamed(spark, I.event_windows(stream), "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def _streamed(spark, rows, mode: str):
    """All that a stream gives when what is there now has been read: the last batch in complete mode, else all batches."""
    folder = fresh_folder(spark, "windows")

    def batch(df, n):
        df.write.parquet(f"{folder}/batch={n}", mode="overwrite")

    w = rows.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    w.awaitTermination()
    removed(spark, f"{folder}-state")
    got = spark.read.schema(rows.schema.add("batch", "long")).parquet(folder)
    return (got.filter(F.col("batch") == int(w.lastProgress["batchId"])) if mode == "complete" and w.lastProgress else got).drop("batch")


def _stream(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("SELECT event_type, s AS start, s + INTERVAL '1 hour' AS \"end\", count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY ALL")
def streamed_sliding_windows(spark, d):
    """Windows of an hour that begin every half hour."""
    return _streamed(spark, I.event_windows(_stream(spark, d), slide="30 minutes"), "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, nr""")
def streamed_sessions(spark, d):
    """Events of a user in sessions that half an hour without an event ends."""
    return _streamed(spark, I.sessions(_stream(spark, d)), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
