"""Queries over a mixed graph of files, variables, infrastructure, tables, columns and jobs made of the parts table.

The graph's rows are made by one piece of SQL that both engines run; what the operators do with them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.score import score
from ..operators import analysis as A
from ..operators import diff as D
from ..operators import graph as G
from ..operators import stitch as M
from ..operators import store as R
from ..shared import fresh_folder, saved, spread
from ..sources import files as S
from .queries import query, score_sql
from .views import table

# --- the graph

_ROW = "SELECT {id} AS id, {name} AS name, '{type}' AS type, {path} AS path, {meta} AS metadata FROM part"
_NODES = " UNION ALL ".join(
    [
        _ROW.format(id="'file://src/p' || p_partkey || '.py'", name="'src/p' || p_partkey || '.py'", type="code_file", path="'src/p' || p_partkey || '.py'", meta="CAST(NULL AS STRING)"),
        _ROW.format(id="'env:P_' || p_partkey", name="'P_' || p_partkey", type="env_var", path="'src/p' || p_partkey || '.py'", meta="'{\"line\":' || (p_partkey % 9) || '}'"),
        _ROW.format(id="'infra:output:p_' || p_partkey", name="'p_' || p_partkey", type="config_key", path="'tf/p' || p_partkey || '.tf'", meta="CAST(NULL AS STRING)"),
        _ROW.replace("SELECT", "SELECT DISTINCT").format(id="'infra:aws_db.d' || (p_partkey % 50)", name="'aws_db_d' || (p_partkey % 50)", type="infra_resource", path="'tf/db.tf'", meta="CAST(NULL AS STRING)"),
        _ROW.replace("SELECT", "SELECT DISTINCT").format(id="'data:mart.t' || (p_partkey % 40)", name="'mart.t' || (p_partkey % 40)", type="data_asset", path="CAST(NULL AS STRING)", meta="CAST(NULL AS STRING)"),
        _ROW.format(id="'column:mart.t' || (p_partkey % 40) || '/c' || p_partkey", name="'c' || p_partkey", type="data_asset", path="CAST(NULL AS STRING)", meta="CAST(NULL AS STRING)"),
        _ROW.replace("SELECT", "SELECT DISTINCT").format(id="'job:load_' || (p_partkey % 20)", name="'load_' || (p_partkey % 20)", type="job", path="'jobs.yaml'", meta="CAST(NULL AS STRING)"),
        _ROW.format(id="'entity:src/p' || p_partkey || '.py:f'", name="'f'", type="code_entity", path="'src/p' || p_partkey || '.py'", meta="CAST(NULL AS STRING)"),
    ]
)
_EDGE = "SELECT {s} AS source_id, {t} AS target_id, '{type}' AS type, {conf} AS confidence, {how} AS match_strategy FROM part WHERE {where}"
_FILE, _DATA, _COLUMN, _NONE = "'file://src/p' || p_partkey || '.py'", "'data:mart.t' || (p_partkey % 40)", "'column:mart.t' || (p_partkey % 40) || '/c' || p_partkey", "CAST(NULL AS STRING)"
_EDGES = " UNION ALL ".join(
    [
        _EDGE.format(s=_FILE, t="'env:P_' || p_partkey", type="reads", conf="CAST(1.0 AS DOUBLE)", how=_NONE, where="p_partkey % 7 <> 0"),
        _EDGE.format(s="'infra:output:p_' || p_partkey", t="'env:P_' || p_partkey", type="provides", conf="CAST(0.3 + (p_partkey % 8) / 10.0 AS DOUBLE)", how="'semantic'", where="p_partkey % 3 = 0"),
        _EDGE.format(s="'infra:aws_db.d' || (p_partkey % 50)", t="'infra:output:p_' || p_partkey", type="provisions", conf="CAST(1.0 AS DOUBLE)", how=_NONE, where="p_partkey % 2 = 0"),
        _EDGE.format(s=_FILE, t=_DATA, type="reads", conf="CAST(NULL AS DOUBLE)", how=_NONE, where="p_partkey % 4 = 1"),
        _EDGE.format(s=_FILE, t=_DATA, type="writes", conf="CAST(1.0 AS DOUBLE)", how=_NONE, where="p_partkey % 4 = 3"),
        _EDGE.replace("SELECT", "SELECT DISTINCT").format(s="'job:load_' || (p_partkey % 20)", t=_DATA, type="writes", conf="CAST(0.9 AS DOUBLE)", how=_NONE, where="p_size > 25"),
        _EDGE.format(s=_DATA, t=_COLUMN, type="contains", conf="CAST(1.0 AS DOUBLE)", how=_NONE, where="p_partkey % 5 <> 0"),
        _EDGE.format(s=_FILE, t="'entity:src/p' || p_partkey || '.py:f'", type="contains", conf="CAST(1.0 AS DOUBLE)", how=_NONE, where="p_partkey > 0"),
    ]
)
W = f"w_nodes AS ({_NODES}), w_edges AS ({_EDGES})"
RW = f"WITH RECURSIVE {W}, "
#: What a change reaches by the core policy, for SQL.
CORE_SQL = "core AS (SELECT DISTINCT CASE WHEN type IN ('calls', 'depends_on', 'reads') THEN target_id ELSE source_id END AS u, CASE WHEN type IN ('calls', 'depends_on', 'reads') THEN source_id ELSE target_id END AS v FROM w_edges WHERE type IN ('calls', 'depends_on', 'flows_to', 'outputs', 'provides', 'provisions', 'reads', 'writes'))"


def _sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM part", f"FROM parquet.`{d}/part.parquet`"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, _NODES).withColumn("tokens", X.tokenize("name"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, _EDGES)


def _values(words: list[str]) -> str:
    return ", ".join("('" + w.replace("'", "''") + "')" for w in words)


def _names(spark: SparkSession, d: str, words: list[str]) -> DataFrame:
    """(k, name): each part's key with each of the words, of which {k} is the key."""
    w = spark.createDataFrame([(x,) for x in words], "w string")
    return spread(table(spark, d, "part").select(F.col("p_partkey").alias("k"))).join(F.broadcast(w)).select("k", F.replace("w", F.lit("{k}"), F.col("k").cast("string")).alias("name"))


def _names_sql(words: list[str]) -> str:
    return f"(SELECT p_partkey AS k, replace(w, '{{k}}', p_partkey::VARCHAR) AS name FROM part, (VALUES {_values(words)}) v(w))"


# --- predicates on names; the SQL has word lists of its own

ENV_NAMES = "P_{k}|X{k}|{k}abc|prod|Production|a|AB|debug|database|data_base|data-base|DataBase|my name|./x|/etc|.env|a/b|http://x|redis://h|utf-8|LOCALHOST|port|user|User|USER_{k}|é|VAR|name|NAME|value|key|KEY|options|config|data|A(B)|a[b]|${A}|A$B|A\\B|abc|abc_d|PATH|HOME".split("|")


@query(f"""SELECT k, name, length(name) >= 2 AND lower(name) NOT IN ('admin', 'app', 'ascii', 'critical', 'default', 'dev', 'dev-secret', 'development', 'disabled', 'enabled', 'error', 'false', 'info', 'localhost', 'main', 'myapp', 'no', 'none', 'null', 'off', 'on', 'prod', 'production', 'root', 'secret', 'staging', 'test', 'true', 'user', 'utf-8', 'utf8', 'warning', 'yes') AND NOT contains(name, ' ') AND NOT regexp_matches(name, '^[0-9]') AND NOT starts_with(name, '.') AND NOT contains(name, '/')
  AND NOT (lower(name) = name AND upper(name) <> name AND NOT contains(name, '_') AND NOT contains(name, '-') AND length(name) > 6) AS ok FROM {_names_sql(ENV_NAMES)}""")  # fmt: skip
def valid_env_names(spark, d):
    return _names(spark, d, ENV_NAMES).select("k", "name", X.valid_env_name("name").alias("ok"))


@query(f"""SELECT k, name, length(name) >= 3 AND NOT regexp_matches(name, '[\\\\${{}}()\\[\\]]') AND name NOT IN ('VAR', 'config', 'data', 'key', 'name', 'options', 'value') AND NOT (lower(name) = name AND upper(name) <> name AND NOT contains(name, '_')) AS ok
FROM {_names_sql(ENV_NAMES)}""")  # fmt: skip
def checked_env_names(spark, d):
    return _names(spark, d, ENV_NAMES).select("k", "name", X.checked_env_name("name").alias("ok"))


TABLE_NAMES = "users|Users|USERS|t{k}|T{k}|raw.t{k}|s3://b/t{k}|a/b|a_b|x|path|PATH|data|Data.x|tmp|output|Source|Ünder".split("|")


@query(f"""SELECT k, name, length(name) >= 2 AND lower(name) NOT IN ('data', 'file', 'input', 'output', 'path', 'source', 'table', 'target', 'temp', 'tmp')
  AND (contains(name, '.') OR contains(name, '/') OR contains(name, '_') OR NOT (lower(name) = name AND upper(name) <> name)) AS ok FROM {_names_sql(TABLE_NAMES)}""")
def valid_table_names(spark, d):
    return _names(spark, d, TABLE_NAMES).select("k", "name", X.valid_table_name("name").alias("ok"))


PATHS = "src/p{k}.py|Tests/p{k}.py|a/e2e/x{k}.ts|a\\fixtures\\b|contest/{k}|node_modules/x/{k}.js|lib/latest/{k}|x/__tests__/a|corpus/{k}|.git/{k}".split("|")


@query(f"""SELECT k, name, len(list_intersect(string_split_regex(lower(name), '[/\\\\]'), ['.git', '.tox', '.venv', '__pycache__', '__tests__', 'build', 'corpus', 'dist', 'e2e', 'e2e_live', 'fixtures', 'node_modules', 'site-packages', 'test', 'tests', 'venv'])) > 0 AS ignored
FROM {_names_sql(PATHS)}""")  # fmt: skip
def ignored_paths(spark, d):
    return _names(spark, d, PATHS).select("k", "name", X.ignored_path("name").alias("ignored"))


_BLOCKED = "['and', 'api', 'app', 'auth', 'bool', 'config', 'data', 'db', 'dict', 'dir', 'dst', 'env', 'err', 'file', 'for', 'get', 'host', 'id', 'in', 'info', 'int', 'key', 'list', 'log', 'map', 'msg', 'name', 'new', 'not', 'num', 'old', 'out', 'password', 'path', 'port', 'secret', 'set', 'setting', 'src', 'str', 'temp', 'test', 'the', 'token', 'type', 'url', 'user', 'val', 'var']"
_WEAK = "['aws', 'azure', 'backup', 'bucket', 'cache', 'cloud', 'cluster', 'default', 'dev', 'development', 'external', 'gcp', 'group', 'instance', 'internal', 'local', 'main', 'master', 'pool', 'primary', 'private', 'prod', 'production', 'public', 'queue', 'read', 'remote', 'replica', 'secondary', 'service', 'slave', 'stage', 'staging', 'worker', 'write']"
OVERLAPS = [("payment_db_host_{k}", "PAYMENT_DATABASE_HOST"), ("main_service_queue", "service_queue_{k}"), ("id_key", "id_key"), ("p{k}", "P{k}"), ("ab_cd_payment", "cd_payment_prod"), ("db", "url"), ("order_payment_x{k}", "payment_order")]


def _overlap_names(spark, d):
    w = spark.createDataFrame(OVERLAPS, "a string, b string")
    k = F.col("p_partkey").cast("string")
    return spread(table(spark, d, "part").select("p_partkey")).join(F.broadcast(w)).select(F.col("p_partkey").alias("k"), *(F.replace(c, F.lit("{k}"), k).alias(c) for c in ("a", "b")))


_OVERLAP_SQL = f"""WITH p AS (SELECT p_partkey AS k, replace(a, '{{k}}', p_partkey::VARCHAR) AS a, replace(b, '{{k}}', p_partkey::VARCHAR) AS b FROM part, (VALUES {", ".join(map(str, OVERLAPS))}) v(a, b)),
t AS (SELECT *, list_distinct(string_split(lower(a), '_')) AS ta, list_distinct(string_split(lower(b), '_')) AS tb FROM p),
s AS (SELECT *, list_filter(ta, lambda x: len(x) >= 3 AND NOT list_contains({_BLOCKED}, x)) AS sa, list_filter(tb, lambda x: len(x) >= 3 AND NOT list_contains({_BLOCKED}, x)) AS sb FROM t),
w AS (SELECT *, list_sum(list_transform(ta, lambda x: CASE WHEN list_contains({_BLOCKED}, x) THEN 0.0 ELSE (CASE WHEN list_contains({_WEAK}, x) THEN 0.5 ELSE 1.0 END) * (CASE WHEN len(x) < 3 THEN 0.3 ELSE 1.0 END) END::DOUBLE)) AS wa,
  list_sum(list_transform(tb, lambda x: CASE WHEN list_contains({_BLOCKED}, x) THEN 0.0 ELSE (CASE WHEN list_contains({_WEAK}, x) THEN 0.5 ELSE 1.0 END) * (CASE WHEN len(x) < 3 THEN 0.3 ELSE 1.0 END) END::DOUBLE)) AS wb,
  coalesce(list_sum(list_transform(list_intersect(ta, tb), lambda x: CASE WHEN list_contains({_BLOCKED}, x) THEN 0.0 ELSE (CASE WHEN list_contains({_WEAK}, x) THEN 0.5 ELSE 1.0 END) * (CASE WHEN len(x) < 3 THEN 0.3 ELSE 1.0 END) END::DOUBLE)), 0) AS wo FROM s)"""


@query(_OVERLAP_SQL + " SELECT k, a, b, CASE WHEN wa + wb - wo > 0 THEN round(wo / (wa + wb - wo), 6) ELSE 0 END AS weighted FROM w")
def weighted_overlap(spark, d):
    return _overlap_names(spark, d).select("k", "a", "b", F.round(X.weighted_overlap(X.tokenize("a"), X.tokenize("b")), 6).alias("weighted"))


@query(_OVERLAP_SQL + """ SELECT k, a, b, array_to_string(list_sort(list_intersect(sa, sb)), ',') AS overlap, len(list_intersect(sa, sb)) AS n, CASE WHEN len(list_distinct(list_concat(sa, sb))) > 0 THEN round(len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))), 6) ELSE 0 END AS jaccard,
  len(list_intersect(sa, sb)) >= 2 AS sufficient, len(sa) AS significant FROM w""")  # fmt: skip
def match_quality(spark, d):
    q = F.col("q")
    rows = _overlap_names(spark, d).withColumn("q", X.match_quality(F.array_distinct(X.tokenize("a")), F.array_distinct(X.tokenize("b"))))
    return rows.select("k", "a", "b", F.array_join(q.overlap, ",").alias("overlap"), q.overlap_count.cast("long").alias("n"), F.round(q.jaccard, 6).alias("jaccard"), q.sufficient.alias("sufficient"), F.size(q.significant_source).cast("long").alias("significant"))


CAMEL = ["getUserName_{k}", "a-bC.d", "HTTPServer", "x", "paymentDb/hostX"]


@query(f"""SELECT k, name, array_to_string(list_filter(string_split_regex(lower(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[_.\\-/:\\s]+'), lambda x: len(x) >= 2), ',') AS tokens FROM {_names_sql(CAMEL)}""")
def context_tokens(spark, d):
    return _names(spark, d, CAMEL).select("k", "name", F.array_join(X.tokenize_context("name"), ",").alias("tokens"))


IDS = ["env:PAYMENT_API_KEY", "infra:aws_db.main_{k}", "env:P_{k}", "data:x", "plain", "env:_ID", "k8s:a/b", "file://a:b/c", "job:load_ID"]


@query(f"""WITH i AS (SELECT k, name AS id, split_part(name, ':', 1) AS p, regexp_extract(name, '^[^:]*:(.*)$', 1) AS n FROM {_names_sql(IDS)}),
g AS (SELECT k, id, unnest([id, CASE WHEN contains(n, '.') AND split_part(n, '.', 1) <> '' THEN p || ':' || split_part(n, '.', 1) || '.*' END, CASE WHEN contains(n, '_') AND split_part(n, '_', 1) <> '' THEN p || ':' || split_part(n, '_', 1) || '_*' END,
  CASE WHEN regexp_matches(n, '_(ID|KEY|SECRET|TOKEN|URL|HOST|PORT|ARN|NAME)$') THEN p || ':*' || regexp_extract(n, '_[A-Z]+$') END, CASE WHEN contains(id, ':') THEN p || ':*' END]) AS pattern FROM i)
SELECT DISTINCT k, id, pattern FROM g WHERE pattern IS NOT NULL""")  # fmt: skip
def suggested_patterns(spark, d):
    # equal rows go before they are multiplied; the patterns of one id are distinct
    return _names(spark, d, IDS).distinct().select("k", F.col("name").alias("id"), F.explode(X.suggest_patterns("name")).alias("pattern"))


@query(f"""SELECT k, name AS id, CASE WHEN name LIKE 'env:%' THEN 'env_var' WHEN name LIKE 'infra:%' OR name LIKE 'k8s:%' THEN 'infra_resource' WHEN name LIKE 'data:%' THEN 'data_asset' WHEN name LIKE 'job:%' THEN 'job' WHEN name LIKE 'file://%' THEN 'code_file' ELSE 'unknown' END AS type,
  CASE WHEN name LIKE 'data:%' THEN 'data' WHEN name LIKE 'file:%' OR name LIKE 'job:%' THEN 'code' WHEN name LIKE 'env:%' THEN 'config' WHEN name LIKE 'infra:%' THEN 'infra' ELSE 'other' END AS bucket, list_last(string_split(name, ':')) AS last,
  CASE WHEN contains(name, '://') THEN regexp_extract(name, '://(.*)$', 1) WHEN contains(name, ':') THEN regexp_extract(name, '^[^:]*:(.*)$', 1) ELSE name END AS label FROM {_names_sql(IDS)}""")  # fmt: skip
def id_parts(spark, d):
    return _names(spark, d, IDS).select("k", F.col("name").alias("id"), X.type_of("name").alias("type"), X.lineage_bucket("name").alias("bucket"), X.last_name_of("name").alias("last"), X.name_of("name").alias("label"))


@query("""SELECT p_partkey AS k, c >= 0.3 AS discovery, c >= 0.2 AS low, c >= 0.5 AS enforcement, CASE WHEN c = 0 THEN 0.5 ELSE c END AS assumed FROM (SELECT p_partkey, (p_partkey % 11) / 10.0::DOUBLE AS c FROM part)""")
def visible_edges(spark, d):
    c = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 11 / 10.0).alias("c"))
    return c.select(F.col("p_partkey").alias("k"), X.visible("c").alias("discovery"), X.visible("c", show_low=True).alias("low"), X.visible("c", "enforcement").alias("enforcement"), X.confidence("c").alias("assumed"))


SCRIPTS = ["NEXT_PUBLIC_{k}", "NEXT_{k}", "VITE_A", "REACT_APP_B", "PORT"]


@query(f"""SELECT k, name, CASE WHEN name LIKE 'NEXT\\_%' ESCAPE '\\' THEN 'nextjs' WHEN name LIKE 'VITE\\_%' ESCAPE '\\' THEN 'vite' WHEN starts_with(name, 'REACT_APP_') THEN 'create-react-app' END AS framework,
  starts_with(name, 'NEXT_PUBLIC_') OR starts_with(name, 'VITE_') OR starts_with(name, 'REACT_APP_') AS public FROM {_names_sql(SCRIPTS)}""")
def script_variables(spark, d):
    return _names(spark, d, SCRIPTS).select("k", "name", X.js_framework("name").alias("framework"), X.js_public("name").alias("public"))


CALLS = ["spark.read.parquet", "DeltaTable.forPath", "spark.read.csv", "write.json", "spark.read.orc", "spark.read.jdbc", "spark.table"]


@query(f"""SELECT k, name, CASE WHEN contains(name, 'parquet') THEN 'parquet' WHEN contains(lower(name), 'delta') THEN 'delta' WHEN contains(name, 'csv') THEN 'csv' WHEN contains(name, 'json') THEN 'json' WHEN contains(name, 'orc') THEN 'orc' WHEN contains(name, 'jdbc') THEN 'jdbc' ELSE 'table' END AS format FROM {_names_sql(CALLS)}""")
def source_formats(spark, d):
    return _names(spark, d, CALLS).select("k", "name", X.source_format("name").alias("format"))


@query("""SELECT p_partkey AS k, substr(md5('{"app": "p' || p_partkey || '", "tier": "' || p_size || '"}'), 1, 8) AS hash FROM part""")
def selector_hashes(spark, d):
    p = table(spark, d, "part")
    labels = F.create_map(F.lit("tier"), F.col("p_size").cast("string"), F.lit("app"), F.concat(F.lit("p"), "p_partkey"))
    return p.select(F.col("p_partkey").alias("k"), X.selector_hash(labels).alias("hash"))


# --- look-ups


@query(f"WITH {W} SELECT CASE WHEN id LIKE 'data:%' THEN 'data' WHEN id LIKE 'file:%' OR id LIKE 'job:%' THEN 'code' WHEN id LIKE 'env:%' THEN 'config' WHEN id LIKE 'infra:%' THEN 'infra' ELSE 'other' END AS bucket, count(*) AS nodes FROM w_nodes GROUP BY 1")
def lineage_stats(spark, d):
    return G.lineage_stats(nodes(spark, d))


@query(f"WITH {W} SELECT id FROM w_nodes WHERE contains(id, 'P_1')")
def find_ids(spark, d):
    return G.find_nodes(nodes(spark, d), "P_1", ignore_case=False).select("id")


@query(f"WITH {W} SELECT id, name FROM w_nodes WHERE list_has_any(string_split_regex(lower(name), '[_.\\-/:\\s]+'), ['d7', 'load', 'p5'])")
def find_by_tokens(spark, d):
    return G.find_by_tokens(nodes(spark, d), ["d7", "load", "p5"]).select("id", "name")


@query(f"WITH {W} SELECT id FROM w_nodes WHERE (contains(lower(id), 'p_1') OR contains(lower(name), 'p_1')) AND type = 'env_var' ORDER BY id LIMIT 20")
def search_artifacts(spark, d):
    """The first twenty variables by id: a top-n report."""
    return G.search_artifacts(nodes(spark, d), "P_1", "env_var").select("id")


@query(f"WITH {W} SELECT DISTINCT path FROM w_nodes WHERE path IS NOT NULL")
def files_of_nodes(spark, d):
    return G.files_of(nodes(spark, d))


@query(f"""WITH {W}, own AS (SELECT id FROM w_nodes WHERE path = 'src/p3.py' OR path LIKE '%/src/p3.py'), o AS (SELECT DISTINCT CASE WHEN e.type IN ('provides', 'provisions', 'writes') THEN 'provides' WHEN n.type IN ('config_key', 'data_asset', 'env_var', 'infra_resource', 'secret') THEN 'consumes' ELSE 'internal' END AS bucket, target_id
  FROM w_edges e JOIN own ON own.id = e.source_id JOIN w_nodes n ON n.id = e.target_id) SELECT bucket, string_agg(target_id, ',' ORDER BY target_id) AS ids FROM o GROUP BY bucket""")  # fmt: skip
def file_dependencies(spark, d):
    return G.file_dependencies(nodes(spark, d), edges(spark, d), "src/p3.py").select("bucket", F.array_join("ids", ",").alias("ids"))


@query(f"""WITH {W}, q AS (SELECT DISTINCT 'P_' || p_partkey AS query FROM part UNION SELECT 'src/p' || p_partkey || '.py' FROM part WHERE p_partkey % 2 = 0 UNION SELECT 'aws_db.d' || (p_partkey % 60) FROM part UNION SELECT 'no_' || p_partkey FROM part WHERE p_partkey < 5 UNION SELECT 'd49' UNION SELECT 'oad_1'),
x AS (SELECT query, 1 AS r, query AS id FROM q UNION ALL SELECT query, 2, replace(query, '.', ':') FROM q UNION ALL SELECT query, 3 + i, p || query FROM q, (VALUES (0, 'infra:output:'), (1, 'infra:'), (2, 'env:'), (3, 'file://'), (4, 'data:'), (5, 'k8s:'), (6, 'job:')) v(i, p)
  UNION ALL SELECT query, 10 + i, p || replace(query, '.', ':') FROM q, (VALUES (0, 'infra:output:'), (1, 'infra:'), (2, 'env:'), (3, 'file://'), (4, 'data:'), (5, 'k8s:'), (6, 'job:')) v(i, p)),
a AS (SELECT query, arg_min(x.id, r) AS id FROM x JOIN w_nodes USING (id) GROUP BY query)
SELECT query, id FROM a UNION ALL SELECT query, min_by(id, (NOT ends_with(id, query), id)) FROM q JOIN w_nodes ON contains(id, query) WHERE query NOT IN (SELECT query FROM a) GROUP BY query""")  # fmt: skip
def resolved(spark, d):
    """Names as people write them, to ids."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    asked = p.select(F.concat(F.lit("P_"), k).alias("query")).union(p.filter(k % 2 == 0).select(F.concat(F.lit("src/p"), k, F.lit(".py")))).union(p.select(F.concat(F.lit("aws_db.d"), k % 60))).union(p.filter(k < 5).select(F.concat(F.lit("no_"), k)))
    more = spark.createDataFrame([("d49",), ("oad_1",)], "query string")
    return G.resolve(nodes(spark, d), asked.union(more).distinct())


@query(f"WITH {W} SELECT n.id, n.name, n.type, e.source_id, e.confidence FROM w_nodes n LEFT JOIN w_edges e ON e.type = 'provides' AND e.target_id = n.id WHERE n.path = 'src/p12.py' AND json_extract(n.metadata, '$.line')::INTEGER = 3")
def hover(spark, d):
    return A.hover(nodes(spark, d), edges(spark, d), "src/p12.py", 3).select("id", "name", "type", "source_id", "confidence")


@query(f"WITH {W} SELECT e.target_id, n.name, e.source_id, p.name AS provider, p.path AS provider_path, e.confidence FROM w_edges e JOIN w_nodes n ON n.id = e.target_id JOIN w_nodes p ON p.id = e.source_id WHERE e.type = 'provides' AND n.path = 'src/p9.py'")
def providers_for_file(spark, d):
    return A.providers_for_file(nodes(spark, d), edges(spark, d), "src/p9.py")


@query(f"""WITH {W}, lone AS (SELECT id, name FROM w_nodes WHERE type = 'env_var' AND id NOT IN (SELECT target_id FROM w_edges WHERE type = 'provides')), outs AS (SELECT name AS hint FROM w_nodes WHERE id LIKE 'infra:output:%'),
lw AS (SELECT DISTINCT id, unnest(string_split(lower(name), '_')) AS w FROM lone), ow AS (SELECT DISTINCT hint, unnest(string_split(lower(hint), '_')) AS w FROM outs),
b AS (SELECT id, hint, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, hint) AS r FROM lw JOIN ow USING (w) GROUP BY id, hint)
SELECT l.id, l.name, coalesce(b.hint, (SELECT min(hint) FROM outs)) AS hint FROM lone l LEFT JOIN b ON b.id = l.id AND r = 1""")  # fmt: skip
def orphan_diagnostics(spark, d):
    return A.orphan_diagnostics(nodes(spark, d), edges(spark, d))


@query(f"""WITH {W}, a AS (SELECT DISTINCT id FROM w_nodes WHERE id LIKE 'data:%' OR id LIKE 'env:%'), o AS (SELECT id, min(path) AS path FROM a JOIN w_nodes USING (id) WHERE path IS NOT NULL GROUP BY id)
SELECT id, path FROM o UNION ALL SELECT target_id, min(substr(source_id, 8)) FROM w_edges WHERE source_id LIKE 'file://%' AND type IN ('contains', 'provisions', 'reads') AND target_id IN (SELECT id FROM a) AND target_id NOT IN (SELECT id FROM o) GROUP BY target_id""")  # fmt: skip
def source_files(spark, d):
    n = nodes(spark, d)
    return A.source_file(n, edges(spark, d), n.filter("id like 'data:%' or id like 'env:%'").select("id").distinct())


# --- reach, findings and the gate with all their branches


@query(RW + "r(node) AS (SELECT target_id FROM w_edges WHERE source_id LIKE 'infra:aws_db%' OR source_id LIKE 'job:%' OR source_id LIKE 'file://src/p1%' UNION SELECT target_id FROM r JOIN w_edges ON source_id = node) SELECT CASE WHEN node LIKE 'infra:%' THEN 'infra' WHEN node LIKE 'data:%' OR node LIKE 'column:%' THEN 'data' WHEN node LIKE 'file:%' OR node LIKE 'entity:%' OR node LIKE 'env:%' OR node LIKE 'job:%' THEN 'code' ELSE 'unknown' END AS bucket, count(*) AS count FROM r GROUP BY 1")
def blast_breakdown_of_kinds(spark, d):
    n = nodes(spark, d).filter("id like 'infra:aws_db%' or id like 'job:%' or id like 'file://src/p1%'").select(F.col("id").alias("seed"))
    return G.blast_breakdown(edges(spark, d), n)


_RISK = RW + f"""{CORE_SQL}, ch AS (SELECT id, type, CASE WHEN hash_ % 3 = 0 THEN 'removed' WHEN hash_ % 3 = 1 THEN 'modified' ELSE 'added' END AS change FROM (SELECT *, length(id) AS hash_ FROM w_nodes WHERE type <> 'code_file')),
r(seed, node) AS (SELECT u, v FROM core WHERE u IN (SELECT id FROM ch) UNION SELECT seed, v FROM r JOIN core ON u = node),
f AS (SELECT id, type, change, (SELECT count(*) FROM r WHERE seed = ch.id AND node <> ch.id) AS radius FROM ch),
g AS (SELECT *, (change = 'removed' AND (type IN ('env_var', 'infra_resource') OR radius > 0)) OR (change = 'modified' AND type = 'infra_resource' AND radius > 5) AS breaking,
  CASE type || change WHEN 'infra_resourceremoved' THEN 40 WHEN 'infra_resourcemodified' THEN 25 WHEN 'infra_resourceadded' THEN 5 WHEN 'env_varremoved' THEN 30 WHEN 'env_varmodified' THEN 15 WHEN 'env_varadded' THEN 3 WHEN 'config_keyremoved' THEN 20 WHEN 'config_keymodified' THEN 10 WHEN 'config_keyadded' THEN 2
    WHEN 'code_entityremoved' THEN 10 WHEN 'code_entitymodified' THEN 5 WHEN 'code_entityadded' THEN 1 ELSE 5 END AS base FROM f),
h AS (SELECT *, CAST(trunc(base * CASE WHEN radius >= 50 THEN 2.0 WHEN radius >= 20 THEN 1.5 WHEN radius >= 5 THEN 1.2 ELSE 1.0 END) AS INTEGER) AS penalty, CASE WHEN radius >= 50 THEN 'CRITICAL' WHEN radius >= 20 THEN 'HIGH' WHEN radius >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM g)"""  # fmt: skip


def _changes(spark, d, keep: str = "true") -> DataFrame:
    n = nodes(spark, d).filter("type <> 'code_file'").filter(keep)
    k = F.length("id") % 3
    ch = n.select("id", "type", F.when(k == 0, "removed").when(k == 1, "modified").otherwise("added").alias("change"))
    return D.with_radius(ch, edges(spark, d))


@query(_RISK + " SELECT id, change, radius AS blast_radius, penalty, severity, breaking, CASE WHEN breaking THEN 'red' WHEN radius > 5 THEN 'orange' WHEN radius > 0 THEN 'yellow' ELSE 'green' END AS indicator FROM h")
def risk_of_kinds(spark, d):
    """Changes of every kind of node with their true radius."""
    return D.risk_factors(_changes(spark, d)).select("id", "change", "blast_radius", "penalty", "severity", "breaking", D.indicator().alias("indicator"))


_SCORED_RISK = ", ".join(
    f"s{k} AS (SELECT {k} AS part, count(*) AS n, count(*) FILTER (breaking) AS b, count(*) FILTER (radius > 5) AS wide, coalesce(bool_or(type = 'infra_resource'), false) AS infra, greatest(0, least(100, 100 - coalesce(sum(penalty), 0) - least(20, 5 * count(*) FILTER (breaking)))) AS score, max_by(change || ' ' || type || ' ' || id, (penalty, id)) AS top FROM h WHERE {w})"
    for k, w in enumerate(["id LIKE 'entity:src/p12%'", "id LIKE 'env:P_1'", "id LIKE 'infra:aws_db.d1%'", "id LIKE 'env:P_2' OR id LIKE 'entity:src/p2.py:f'"])
)
_PARTS = ["id like 'entity:src/p12%'", "id like 'env:P_1'", "id like 'infra:aws_db.d1%'", "id like 'env:P_2' or id like 'entity:src/p2.py:f'"]


@query(_RISK + f", {_SCORED_RISK}, u AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)" + """ SELECT CAST(part AS INTEGER) AS part, CAST(score AS BIGINT) AS score, CASE WHEN score < 40 THEN 'CRITICAL' WHEN score < 60 THEN 'HIGH' WHEN score < 80 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN score >= 90 THEN 'Low risk: little depends on these changes.' WHEN infra OR b > 0 OR wide > 0 THEN 'Risky for: ' || concat_ws('; ', CASE WHEN infra THEN 'changed infrastructure' END, CASE WHEN b > 0 THEN b || ' change(s) that may break something' END, CASE WHEN wide > 0 THEN wide || ' change(s) that reach far' END) || '.'
  ELSE 'Most of the score comes from: ' || coalesce(top, 'nothing') END AS summary FROM u""")  # fmt: skip
def risk_summaries(spark, d):
    """Four sets of changes: each has another score, level and text."""
    all_ = saved(_changes(spark, d))
    out = None
    for k, keep in enumerate(_PARTS):
        own = all_.filter(keep)
        one = D.risk(own).select(F.lit(k).alias("part"), "score", "level").join(F.broadcast(D.risk_summary(own).withColumn("part", F.lit(k))), "part")
        out = one if out is None else out.unionByName(one)
    return out


@query(_RISK + " SELECT id, penalty FROM h ORDER BY penalty DESC, id LIMIT 2")
def top_factors(spark, d):
    """The two changes with the largest penalty: a top-n report."""
    return D.top_factors(_changes(spark, d)).select("id", "penalty")


@query(_RISK + " SELECT id, change, row_number() OVER (ORDER BY CASE change WHEN 'added' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END, id) AS nr FROM ch")
def ordered_report(spark, d):
    n = nodes(spark, d).filter("type <> 'code_file'")
    k = F.length("id") % 3
    return D.ordered_report(n.select("id", F.when(k == 0, "removed").when(k == 1, "modified").otherwise("added").alias("change"))).select("id", "change", F.col("nr").cast("long").alias("nr"))


@query(RW + """e AS (SELECT source_id, target_id, coalesce(nullif(confidence, 0), 0.5) AS c, count(*) OVER (PARTITION BY source_id) AS n FROM w_edges), j AS (SELECT e.*, s.type AS st, t.type AS tt, s.name AS sn, t.name AS tn FROM e LEFT JOIN w_nodes s ON s.id = source_id LEFT JOIN w_nodes t ON t.id = target_id),
i AS (SELECT *, CASE WHEN c >= 0.8 THEN 2.0 WHEN c >= 0.6 THEN 1.0 ELSE 0.0 END + CASE WHEN n > 1 THEN 2.5 ELSE 0 END + CASE WHEN st <> tt THEN 1.5 ELSE 0 END + CASE WHEN tt = 'infra_resource' THEN 1 ELSE 0 END + CASE WHEN c < 0.5 AND st <> tt THEN 1 ELSE 0 END AS interest,
  CASE WHEN n > 1 THEN 'ambiguous_match' WHEN c >= 0.8 THEN 'high_confidence_link' WHEN st <> tt THEN 'cross_domain_chain' WHEN c < 0.4 THEN 'potential_risk' ELSE 'high_confidence_link' END AS kind FROM j),
r(seed, node) AS (SELECT source_id, target_id FROM w_edges WHERE source_id IN (SELECT target_id FROM i WHERE interest > 2) UNION SELECT seed, w.target_id FROM r JOIN w_edges w ON w.source_id = node), k AS (SELECT seed, count(*) AS radius FROM r GROUP BY seed)
SELECT kind, CASE kind WHEN 'ambiguous_match' THEN sn || ': several matches' WHEN 'high_confidence_link' THEN sn || ' -> ' || tn WHEN 'cross_domain_chain' THEN 'across domains: ' || sn || ' -> ' || tn ELSE sn END AS title, source_id, target_id, c AS confidence, interest::DOUBLE AS interest, n AS match_count, CASE WHEN interest > 2 THEN coalesce(radius, 0) ELSE 0 END AS blast_radius
FROM i LEFT JOIN k ON seed = target_id UNION ALL SELECT 'missing_provider', name || ': no provider', id, NULL, 0.0, 1.5, 0, 0 FROM w_nodes WHERE type = 'env_var' AND id NOT IN (SELECT source_id FROM w_edges WHERE target_id LIKE 'infra:%')""")  # fmt: skip
def findings_of_kinds(spark, d):
    """Every kind of finding with its title and radius."""
    return A.findings(nodes(spark, d), edges(spark, d))


@query(RW + f"""{CORE_SQL}, f AS (SELECT 'src/p' || p_partkey || '.py' AS path FROM part WHERE p_partkey < 40 UNION SELECT 'tests/p1.py' UNION SELECT 'tf/db.tf' UNION SELECT 'db/schema_1.sql' UNION SELECT './src/p41.py'), g AS (SELECT ltrim(path, './') AS p FROM f WHERE path <> 'tests/p1.py'),
t AS (SELECT id FROM w_nodes WHERE path IN (SELECT p FROM g)), lone AS (SELECT id FROM w_nodes WHERE type = 'env_var' AND id NOT IN (SELECT target_id FROM w_edges WHERE type = 'provides')),
r(node) AS (SELECT v FROM core WHERE u IN (SELECT id FROM t) UNION SELECT v FROM r JOIN core ON u = node)
SELECT 'critical' AS severity, 'missing_provider' AS rule, id AS subject FROM lone WHERE id IN (SELECT id FROM t) OR id IN (SELECT target_id FROM w_edges WHERE type = 'reads' AND source_id IN (SELECT id FROM t))
UNION ALL SELECT * FROM (SELECT 'high', 'infra_impact', id FROM w_nodes WHERE type = 'infra_resource' AND id IN (SELECT node FROM r) ORDER BY id LIMIT 5)
UNION ALL SELECT 'high', 'infra_change', p FROM g WHERE p LIKE '%.tf' UNION ALL SELECT 'medium', 'schema_change', p FROM g WHERE p LIKE '%.sql'""")  # fmt: skip
def check_gate(spark, d):
    p = table(spark, d, "part").filter("p_partkey < 40").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".py")).alias("path"))
    more = spark.createDataFrame([("tests/p1.py",), ("tf/db.tf",), ("db/schema_1.sql",), ("./src/p41.py",)], "path string")
    return A.check(nodes(spark, d), edges(spark, d), p.unionByName(more))


@query(RW + "t AS (SELECT id FROM w_nodes WHERE id NOT IN (SELECT source_id FROM w_edges UNION SELECT target_id FROM w_edges)) SELECT 'orphan' AS issue, id AS subject FROM t")
def lint(spark, d):
    """Orphans; this graph has no cycle (cycles have queries of their own)."""
    return G.lint(nodes(spark, d), edges(spark, d))


_SCORES = f"WITH pr AS (SELECT p_partkey::VARCHAR AS left_id, v.t AS right_id, replace(v.s, '{{k}}', p_partkey::VARCHAR) AS s, replace(v.t, '{{k}}', p_partkey::VARCHAR) AS t, 0 AS alt FROM part, (VALUES ('payment_db_host_{{k}}', 'PAYMENT_DB_HOST'), ('p_{{k}}', 'P_{{k}}'), ('id', 'ID_{{k}}'), ('main', 'MAIN_DB'), ('redis_cluster_endpoint', 'REDIS_URL'), ('none', 'OTHER_{{k}}')) v(s, t)), {score_sql('pr')}"


@query(_SCORES + " SELECT left_id AS k, right_id, round(CASE WHEN right_id = 'MAIN_DB' THEN score * 0.1 ELSE score END, 4) AS score FROM scored")
def directed_scores(spark, d):
    """Scores where the direction between the two kinds counts: one pair goes from a variable to infrastructure."""
    w = spark.createDataFrame([("payment_db_host_{k}", "PAYMENT_DB_HOST"), ("p_{k}", "P_{k}"), ("id", "ID_{k}"), ("main", "MAIN_DB"), ("redis_cluster_endpoint", "REDIS_URL"), ("none", "OTHER_{k}")], "s string, t string")
    k = F.col("p_partkey").cast("string")
    rows = spread(table(spark, d, "part").select("p_partkey")).join(F.broadcast(w)).select(k.alias("k"), F.col("t").alias("right_id"), F.replace("s", F.lit("{k}"), k).alias("s"), F.replace("t", F.lit("{k}"), k).alias("t2"))
    a, b = F.when(F.col("right_id") == "MAIN_DB", "env_var").otherwise("infra_resource"), F.when(F.col("right_id") == "MAIN_DB", "infra_resource").otherwise("env_var")
    return rows.select("k", "right_id", score("s", "t2", source_type=a, target_type=b)["score"].alias("score"))


@query(f"WITH {W}, pr AS (SELECT id AS left_id, 'env:P_12' AS right_id, name AS s, 'P_12' AS t, 0 AS alt FROM w_nodes WHERE type = 'config_key'), {score_sql('pr')} SELECT left_id AS id, score FROM scored WHERE score > 0 ORDER BY score DESC, left_id LIMIT 5")
def alternatives(spark, d):
    """The five best providers for one variable: a top-n report."""
    return A.alternatives(nodes(spark, d), "env:P_12", "config_key").select("id", "score")


# --- reviewers, accuracy


@query("""WITH f AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'src/core/p' WHEN 1 THEN 'docs/p' WHEN 2 THEN 'src/p' ELSE 'lib/p' END || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.md' ELSE '.py' END AS path, p_partkey AS k FROM part),
o AS (SELECT *, CASE WHEN path LIKE '%.md' THEN '@docs' WHEN path LIKE 'src/core/%' THEN '@core' WHEN path LIKE 'src/%' THEN '@src' END AS owner FROM f),
b AS (SELECT path, 'dev ' || (k % 3) AS who, k % 50 AS lines FROM o WHERE owner IS NULL UNION ALL SELECT path, 'dev' || (k % 2), 1 FROM o WHERE owner IS NULL),
r AS (SELECT owner AS who, 10 AS points FROM o WHERE owner IS NOT NULL UNION ALL SELECT CASE WHEN contains(who, ' ') THEN who ELSE '@' || who END, lines FROM b)
SELECT who AS reviewer, CAST(sum(points) AS BIGINT) AS score FROM r GROUP BY who ORDER BY score DESC, who LIMIT 5""")
def reviewers(spark, d):
    """Owners by rules and, for files without, authors by lines: a top-n report."""
    k = F.col("p_partkey")
    f = table(spark, d, "part").select(F.concat(F.element_at(F.array(F.lit("src/core/p"), F.lit("docs/p"), F.lit("src/p"), F.lit("lib/p")), (k % 4 + 1).cast("int")), k, F.when(k % 3 == 0, ".md").otherwise(".py")).alias("path"), k.alias("k"))
    blame = f.select("path", F.concat(F.lit("dev "), F.col("k") % 3).alias("author"), (F.col("k") % 50).alias("lines")).unionByName(f.select("path", F.concat(F.lit("dev"), F.col("k") % 2).alias("author"), F.lit(1).cast("long").alias("lines")))
    return A.reviewers(f.select("path"), [("src/", ["src"]), ("/src/core/**", ["@core"]), ("*.md", ["docs"])], blame).select("reviewer", "score")


@query("SELECT '@platform-team' AS reviewer, 5 AS score, 'team of the folder' AS reason UNION ALL SELECT '@data-team', 5, 'team of the folder'")
def team_reviewers(spark, d):
    """Where neither rules nor authors name anyone, teams by folder."""
    f = table(spark, d, "part").select(F.concat(F.element_at(F.array(F.lit("terraform/p"), F.lit("dbt/p"), F.lit("k8s/p")), (F.col("p_partkey") % 3 + 1).cast("int")), "p_partkey").alias("path"))
    return A.reviewers(f, []).select("reviewer", F.col("score").cast("int").alias("score"), F.array_join("reasons", ",").alias("reason"))


@query("""WITH e AS (SELECT 'p' || (p_partkey % 3) AS parser, 'c' || (p_partkey % 7) AS c, p_partkey AS item FROM part WHERE p_partkey % 4 <> 0), f AS (SELECT 'p' || (p_partkey % 3) AS parser, 'c' || (p_partkey % 7) AS c, p_partkey AS item FROM part WHERE p_partkey % 5 <> 0),
j AS (SELECT coalesce(e.parser, f.parser) AS parser, e.item AS e, f.item AS f FROM e FULL JOIN f USING (parser, c, item)), n AS (SELECT parser, count(*) FILTER (e IS NOT NULL AND f IS NOT NULL) AS tp, count(*) FILTER (e IS NULL) AS fp, count(*) FILTER (f IS NULL) AS fn FROM j GROUP BY parser)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM n""")  # fmt: skip
def accuracy(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k, F.concat(F.lit("p"), k % 3).alias("parser"), F.concat(F.lit("c"), k % 7).alias("case"), k.alias("item"))
    return A.accuracy(rows.filter(k % 4 != 0), rows.filter(k % 5 != 0))


# --- packs, mappings, suppressions


@query(f"WITH {W} SELECT source_id, target_id FROM w_edges WHERE type = 'provides' AND NOT (source_id LIKE 'infra:output:p\\_1%' ESCAPE '\\' AND target_id LIKE 'env:%') AND NOT target_id LIKE 'env:P\\__' ESCAPE '\\'")
def auto_suppressed(spark, d):
    return M.auto_suppressed(edges(spark, d).filter("type = 'provides'"), [("infra:output:p_1*", "env:*", ""), ("*", "env:P_?", "")]).select("source_id", "target_id")


@query("""SELECT * FROM (VALUES ('django', (SELECT bool_or(p_partkey % 3 = 0) FROM part)), ('spark', (SELECT count(*) > 0 FROM part)), ('none', false), ('half', false)) v(pack, matched)""")
def detected_packs(spark, d):
    k = F.col("p_partkey")
    f = table(spark, d, "part").select(F.concat(F.lit("src/p"), k, F.lit(".py")).alias("path"), F.when(k % 3 == 0, "import django\nx = 1").otherwise("from pyspark import SparkContext").alias("text"))
    rules = [("django", "any", "*.rb", None), ("django", "any", "src/*", "import django"), ("spark", "all", "*.py", None), ("spark", "all", "*", "pyspark"), ("none", "any", "*.rb", None), ("half", "all", "*.py", None), ("half", "all", "*.rb", None)]
    return M.detected_packs(f, spark.createDataFrame(rules, "pack string, mode string, path_glob string, content string"))


MAPPINGS = [("infra:output:p_1*", "env:P_1*", "provides", "ones"), ("infra:output:p_2", "env:P_3", "alias", "one"), ("infra:output:p_2", "env:P_4", "alias", "two"), ("infra:output:gone", "env:P_5", "provides", "x"), ("infra:output:p_5", "env:GONE", "provides", "y"), ("env:P_6*", "", "ignore", "no")]
def _mappings(spark) -> DataFrame:
    return spark.createDataFrame(MAPPINGS, "source string, target string, mapping_type string, reason string")


_EXPLICIT = f"WITH {W}, ex AS (SELECT id AS source_id, CASE WHEN id LIKE 'infra:output:p\\_1%' ESCAPE '\\' THEN 'env:P_1' || substr(id, 17) END AS target_id FROM w_nodes WHERE id LIKE 'infra:output:p\\_1%' ESCAPE '\\' UNION SELECT 'infra:output:p_2', 'env:P_3' UNION SELECT 'infra:output:p_2', 'env:P_4'), ok AS (SELECT DISTINCT source_id, target_id FROM ex WHERE source_id IN (SELECT id FROM w_nodes) AND target_id IN (SELECT id FROM w_nodes))"


@query(_EXPLICIT + " SELECT source_id, target_id, 'provides' AS type, 1.0::DOUBLE AS confidence FROM ok")
def explicit_edges(spark, d):
    """Mappings with and without wildcards, applied to the nodes; those to nodes that don't exist give nothing."""
    return M.explicit_edges(_mappings(spark), nodes(spark, d)).select("source_id", "target_id", "type", "confidence")


@query(f"WITH {W} SELECT id AS source_id, 'env:P_1' || substr(id, 17) AS target_id, 'provides' AS mapping_type, 'ones' AS reason FROM w_nodes WHERE id LIKE 'infra:output:p\\_1%' ESCAPE '\\' UNION ALL SELECT 'infra:output:p_2', 'env:P_3', 'alias', 'one' UNION ALL SELECT 'infra:output:p_2', 'env:P_4', 'alias', 'two' UNION ALL SELECT 'infra:output:p_5', 'env:GONE', 'provides', 'y'")
def expanded_mappings(spark, d):
    return M.expanded(_mappings(spark).filter("mapping_type <> 'ignore'"), nodes(spark, d))


@query("SELECT * FROM (VALUES ('infra:output:gone', 'env:P_5', 'source not found'), ('infra:output:p_5', 'env:GONE', 'target not found'), ('infra:output:p_2', 'env:P_3', 'conflict'), ('infra:output:p_2', 'env:P_4', 'conflict')) v(source, target, problem)")
def invalid_mappings(spark, d):
    return M.invalid_mappings(_mappings(spark), nodes(spark, d))


_FUZZY = f"""{_EXPLICIT}, tk AS (SELECT DISTINCT id, type, unnest(list_append(list_filter(string_split(lower(name), '_'), lambda x: len(x) >= 2), '=' || replace(lower(name), '_', ''))) AS k FROM w_nodes WHERE type IN ('infra_resource', 'config_key', 'env_var')),
cand AS (SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM tk a JOIN tk b USING (k) WHERE a.type <> 'env_var' AND b.type = 'env_var'),
pr AS (SELECT left_id, right_id, a.name AS s, b.name AS t, count(*) OVER (PARTITION BY right_id) - 1 AS alt FROM cand JOIN w_nodes a ON a.id = left_id JOIN w_nodes b ON b.id = right_id), {score_sql("pr")},
best AS (SELECT left_id AS source_id, right_id AS target_id, score FROM (SELECT *, row_number() OVER (PARTITION BY right_id ORDER BY score DESC, len(matched) DESC, left_id) AS n FROM scored) WHERE n = 1 AND score >= 0.5)"""


@query(_FUZZY + """, inf AS (SELECT DISTINCT id, name, unnest(list_filter(string_split(lower(name), '_'), lambda x: len(x) >= 2)) AS k FROM w_nodes WHERE type = 'infra_resource'),
pairs_ AS (SELECT DISTINCT a.id AS source_id, b.id AS target_id FROM inf a JOIN inf b USING (k) WHERE a.id < b.id)
SELECT source_id, target_id, 'exact' AS how FROM ok UNION ALL SELECT source_id, target_id, 'semantic' FROM best WHERE target_id NOT IN (SELECT target_id FROM ok) AND target_id NOT LIKE 'env:P\\_6%' ESCAPE '\\'""")
def stitched_with_mappings(spark, d):
    """Explicit edges first, then fuzzy ones for what isn't mapped or ignored; the databases' names are too unlike to link."""
    got = M.stitch_with_mappings(nodes(spark, d), _mappings(spark))
    return got.filter("match_strategy <> 'token_overlap'").select("source_id", "target_id", F.col("match_strategy").alias("how"))


@query(_FUZZY + " SELECT count(*) FILTER (how) AS explicit, count(*) FILTER (NOT how) AS fuzzy, count(*) AS total FROM (SELECT true AS how FROM ok UNION ALL SELECT false FROM best WHERE target_id NOT IN (SELECT target_id FROM ok) AND target_id NOT LIKE 'env:P\\_6%' ESCAPE '\\')")
def stitch_counts(spark, d):
    return M.stitch_counts(M.stitch_with_mappings(nodes(spark, d), _mappings(spark)).filter("match_strategy <> 'token_overlap'"))


@query(_EXPLICIT + ", e AS (SELECT source_id, target_id, confidence FROM w_edges WHERE type = 'provides') SELECT o.source_id, o.target_id AS mapped, e.target_id, e.confidence FROM (SELECT source_id, replace(target_id, 'P_1', 'P_9') AS target_id FROM ok) o JOIN e USING (source_id) WHERE o.target_id <> e.target_id")
def mapping_vs_fuzzy(spark, d):
    ex = M.explicit_edges(_mappings(spark), nodes(spark, d)).withColumn("target_id", F.replace("target_id", F.lit("P_1"), F.lit("P_9")))
    return M.mapping_vs_fuzzy(ex, edges(spark, d).filter("type = 'provides'"))


RULES = [("1", "infra:output:p_1*", "env:*", "old", None, "2001-01-01 00:00:00", True), ("2", "infra:output:p_2*", "env:*", "twos", None, None, True), ("3", "*", "env:P_2?", "two digits", None, "2101-01-01 00:00:00", True), ("4", "*", "*", "off", None, None, False)]


def _rules(spark) -> DataFrame:
    r = spark.createDataFrame(RULES, "id string, source_pattern string, target_pattern string, reason string, created_by string, expires_at string, enabled boolean")
    return r.withColumn("expires_at", F.col("expires_at").cast("timestamp"))


@query(f"WITH {W}, e AS (SELECT source_id, target_id FROM w_edges WHERE type = 'provides'), a AS (SELECT source_id LIKE 'infra:output:p\\_2%' ESCAPE '\\' AS two, target_id LIKE 'env:P\\_2_' ESCAPE '\\' AS digits, * FROM e) SELECT source_id, target_id, CASE WHEN two THEN '2' ELSE '3' END AS rule, CASE WHEN two THEN 'twos' ELSE 'two digits' END AS reason FROM a WHERE two OR digits")
def suppressed_edges(spark, d):
    """Edges that a rule hides, with the first rule that does; an expired and a disabled rule hide nothing."""
    return M.suppressed(edges(spark, d).filter("type = 'provides'").select("source_id", "target_id"), _rules(spark))


@query("SELECT 'listed' AS what, id FROM (VALUES ('2'), ('3'), ('4')) v(id) UNION ALL SELECT 'all', id FROM (VALUES ('1'), ('2'), ('3'), ('4')) v(id) UNION ALL SELECT 'active', id FROM (VALUES ('2'), ('3')) v(id) UNION ALL SELECT 'matching', id FROM (VALUES ('2'), ('3')) v(id)")
def suppression_lists(spark, d):
    r = _rules(spark)
    one = lambda what, rows: rows.select(F.lit(what).alias("what"), "id")
    return one("listed", M.listed(r)).unionByName(one("all", M.listed(r, with_expired=True))).unionByName(one("active", M.active(r))).unionByName(one("matching", M.rules_for(r, "infra:output:p_27", "env:P_27")))


@query(f"WITH {W} SELECT source_id, target_id FROM w_edges WHERE match_strategy IS NOT NULL AND confidence BETWEEN 0.0 AND 0.8 AND NOT (source_id LIKE 'infra:output:p\\_2%' ESCAPE '\\') AND NOT target_id LIKE 'env:P\\_2_' ESCAPE '\\'")
def review_queue_with_rules(spark, d):
    return A.review_queue(edges(spark, d), _rules(spark)).select("source_id", "target_id")


# --- differences by file


@query(f"WITH {W} SELECT id, CASE p_partkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'removed' END AS change FROM w_nodes JOIN part ON path = 'src/p' || p_partkey || '.py' WHERE p_partkey % 2 = 0")
def file_diff(spark, d):
    k = F.col("p_partkey")
    f = table(spark, d, "part").filter(k % 2 == 0).select(F.concat(F.lit("./src/p"), k, F.lit(".py")).alias("path"), F.element_at(F.array(F.lit("A"), F.lit("M"), F.lit("D")), (k % 3 + 1).cast("int")).alias("status"))
    return D.file_diff(nodes(spark, d), f).select("id", "change")


@query(f"WITH {W}, c AS (SELECT 'src/p' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 10 = 0) SELECT id, name FROM w_nodes WHERE path IS NULL OR path NOT IN (SELECT path FROM c) UNION ALL SELECT 'env:OLD_' || p_partkey, 'OLD_' || p_partkey FROM part WHERE p_partkey % 10 = 0")
def virtual_base(spark, d):
    """The head without what changed files hold now, and with what they held before."""
    n, p = nodes(spark, d), table(spark, d, "part").filter("p_partkey % 10 = 0")
    path = F.concat(F.lit("src/p"), "p_partkey", F.lit(".py"))
    name = F.concat(F.lit("OLD_"), "p_partkey")
    before = p.select(F.concat(F.lit("env:"), name).alias("id"), name.alias("name"), F.lit("env_var").alias("type"), path.alias("path"), F.lit(None).cast("string").alias("metadata"), X.tokenize(name).alias("tokens"))
    return D.virtual_base(n, p.select(path.alias("path")), before).select("id", "name")


@query(f"""WITH {W}, b AS (SELECT * FROM w_nodes WHERE type = 'env_var'), h AS (SELECT id, CASE WHEN k % 4 = 1 THEN name || '_new' ELSE name END AS name, CASE WHEN k % 4 = 2 THEN '{{"line":99}}' ELSE metadata END AS metadata, k FROM (SELECT *, CAST(substr(id, 7) AS INTEGER) AS k FROM b))
SELECT id, CASE WHEN k % 4 = 1 THEN 'new' ELSE '' END AS added, CASE WHEN k % 4 = 2 THEN '99' ELSE CAST(k % 9 AS VARCHAR) END AS new_line, CAST(k % 9 AS VARCHAR) AS old_line FROM h WHERE k % 4 IN (1, 2)""")
def changed_nodes(spark, d):
    """What changed in nodes that are in both snapshots: tokens and lines."""
    b = nodes(spark, d).filter("type = 'env_var'").withColumn("file_hash", F.lit(None).cast("string"))
    k = F.substring("id", 7, 20).cast("int")
    name = F.when(k % 4 == 1, F.concat("name", F.lit("_new"))).otherwise(F.col("name"))
    h = b.withColumns({"metadata": F.when(k % 4 == 2, '{"line":99}').otherwise(F.col("metadata")), "tokens": X.tokenize(name)}).withColumn("name", name)
    return D.node_diff(b, h).filter("change = 'modified'").select("id", F.array_join("added_tokens", ",").alias("added"), "new_line", "old_line")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'R' WHEN p_partkey % 3 = 1 THEN 'M' ELSE 'A' END AS status, 'b/p' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'a/p' || p_partkey END AS old_path FROM part")
def changed_files(spark, d):
    """A version control's listing; a line that is none is left out."""
    k = F.col("p_partkey").cast("string")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("R100\ta/p"), k, F.lit("\tb/p"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("M\tb/p"), k)).otherwise(F.concat(F.lit("A\tb/p"), k))
    p = table(spark, d, "part")
    got = S.changed_files(p.select(line.alias("value")).union(p.limit(1).select(F.lit("nothing of it"))))
    return got.select(F.regexp_extract("path", r"(\d+)$", 1).cast("int").alias("k"), "status", "path", "old_path")


@query("SELECT 'x/p' || p_partkey AS path FROM part UNION SELECT 'y/q' || p_partkey FROM part WHERE p_partkey % 2 = 0")
def diffed_files(spark, d):
    k = F.col("p_partkey").cast("string")
    one = F.concat(F.lit("diff --git a/x/p"), k, F.lit(" b/x/p"), k, F.lit("\n--- a/x/p"), k, F.lit("\n+++ b\n@@ -1 +1 @@\n-a\n+b\n"))
    two = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("diff --git a/y/o b/y/q"), k, F.lit("\n"))).otherwise("")
    return S.diffed_files(table(spark, d, "part").select(F.concat(one, two).alias("value")))


@query("SELECT 'n' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 5 = 1 THEN 'extra' ELSE 'stale' END AS state FROM part WHERE p_partkey % 5 < 3")
def lock_states(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.concat(F.lit("n"), k).alias("name"), k)
    return S.stale_locks(p.filter(k % 5 != 1).select("name", F.lit("1").alias("ref")), p.filter(k % 5 != 0).select("name", F.when(k % 5 == 2, "2").otherwise("1").alias("ref")))


FILES = ["src/p{k}.py", "web/a{k}.min.js", "web/b{k}.ts", "tf/m{k}.tf", "k8s/d{k}.yaml", "x/manifest.json", "node_modules/p{k}.js", "img/p{k}.PNG", "a/plan{k}.json", "package.json", "build/p{k}.py", "q/build"]


@query(f"""SELECT k, name AS path, name LIKE 'node_modules/%' OR name LIKE 'build/%' OR name LIKE '%.PNG' AS skipped, CASE WHEN name LIKE 'src/%' OR name LIKE 'build/%' THEN 'python' WHEN name LIKE 'web/b%' OR name LIKE 'node_modules/%' THEN 'javascript' WHEN name LIKE '%.tf' THEN 'terraform' WHEN name LIKE '%.yaml' THEN 'kubernetes,spark_yaml,dbt_schema'
  WHEN name LIKE '%manifest.json' THEN 'dbt_manifest,openlineage' WHEN name LIKE 'a/plan%' THEN 'terraform_plan,openlineage' WHEN name = 'package.json' THEN 'openlineage,package_json' ELSE '' END AS languages FROM {_names_sql(FILES)}""")
def routed_files(spark, d):
    """Which files discovery leaves out and which extractors the others go to; minified scripts go to none."""
    text = F.when(F.col("name").contains(".min."), F.repeat(F.lit("var a=1;"), 300)).otherwise("a\nb\n")
    f = _names(spark, d, FILES).select("k", F.col("name").alias("path"), text.alias("text"))
    return S.routed(f).select("k", "path", S.skipped().alias("skipped"), F.array_join("languages", ",").alias("languages"))


# --- the store and its exports


@query(f"WITH {W} SELECT 'node' AS what, id AS a, CASE WHEN id LIKE 'env:%' THEN 'again' ELSE name END AS b FROM w_nodes WHERE path IS NULL OR path NOT IN ('src/p1.py', 'src/p2.py') UNION ALL SELECT DISTINCT 'edge', source_id, target_id FROM w_edges WHERE coalesce(confidence, 0) >= 0.7 AND NOT regexp_matches(source_id || target_id, '(p1\\.py|p2\\.py|env:P_[12]$)')")
def stored_graph(spark, d):
    """Written, written again with other names, two files deleted, read back; edges by least confidence."""
    s = R.Store(spark, fresh_folder(spark, "store"))
    n, e = nodes(spark, d), edges(spark, d)
    s.upsert("nodes", n.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    s.upsert("edges", e.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    s.upsert("nodes", n.filter("type = 'env_var'").withColumns({"name": F.lit("again"), "created_at": F.lit("2024-01-02").cast("timestamp")}))
    s.delete_files(spark.createDataFrame([("src/p1.py",), ("src/p2.py",)], "path string"))
    return s.read("nodes").select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("name").alias("b")).unionByName(s.edges(0.7).select(F.lit("edge").alias("what"), F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@query(f"WITH {W} SELECT source_id, target_id, type FROM w_edges WHERE source_id NOT LIKE 'file://src/p1%'")
def edges_without_sources(spark, d):
    n = nodes(spark, d).filter("id like 'file://src/p1%'")
    return R.without_edges_of(edges(spark, d), n).select("source_id", "target_id", "type")


@query("SELECT 'f' || p_partkey AS file_path, CAST(p_partkey AS VARCHAR) AS file_hash FROM part WHERE p_partkey % 6 <> 0")
def scans_without_files(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    scans = p.select(F.concat(F.lit("f"), k).alias("file_path"), k.cast("string").alias("file_hash"))
    return R.without_scans(scans, p.filter(k % 6 == 0).select(F.concat(F.lit("./f"), k).alias("path")))


@query(f"""WITH {W} SELECT 0 AS nr, 'digraph lineage {{' AS line UNION ALL SELECT 3, '}}' UNION ALL SELECT 1, '"' || id || '" [label="' || name || '", fillcolor=' || CASE WHEN id LIKE 'env:%' THEN 'gold' WHEN id LIKE 'infra:%' THEN 'skyblue' WHEN id LIKE 'data:%' THEN 'palegreen' ELSE 'white' END || '];' FROM w_nodes
UNION ALL SELECT 2, '"' || source_id || '" -> "' || target_id || '"' || CASE WHEN type = 'reads' THEN ' [style=dashed];' ELSE ';' END FROM w_edges""")
def exported_dot(spark, d):
    return R.export_dot(nodes(spark, d), edges(spark, d))


@query(f"WITH {W} SELECT 'node' AS what, id AS a, name AS b FROM w_nodes UNION ALL SELECT 'edge', source_id, target_id FROM w_edges")
def exported_json(spark, d):
    """Exported as JSON lines and read back."""
    folder = fresh_folder(spark, "json")
    R.export_json(nodes(spark, d).select("id", "name", "type", "path"), edges(spark, d), folder)
    n, e = R.read_export(spark, folder)
    return n.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("name").alias("b")).unionByName(e.select(F.lit("edge").alias("what"), F.col("source_id").alias("a"), F.col("target_id").alias("b")))
