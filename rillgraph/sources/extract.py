"""Nodes and edges of source text.

All rules run in the JVM in one pass over the files, without a shuffle. The regular expression functions return no offsets, so a
rule is wrapped as \\G(gap)(rule): consecutive matches then cover the text up to the last one, and the gaps' line ends give
the line of every match in linear time. Rules of one scope keep a name once in a file, by a window within the file.

Defined results: files with null path or text give nothing, empty files their own node; equal rows of files give the same
nodes and edges once; names are used as written; other columns of files aren't read. Minified scripts give their file's node
only.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..shared import saved
from .column_lineage import split_arguments
from .files import LANGUAGES, minified
from .rules import RULES, SPARK_FILE, Rule


def _lines(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def found(text: Column, pattern: Column) -> Column:
    """array<struct<name, line>> of a pattern's matches; the name is its first group."""
    whole = F.concat(F.lit(r"\G([\s\S]*?)(?:"), pattern, F.lit(")"))
    every = lambda k: F.regexp_extract_all(text, whole, F.lit(k))
    # lines up to the end of each match; a running sum, which starts at line 1
    ends = F.transform(every(0), _lines)
    sums = F.aggregate(ends, F.array(F.lit(1)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    starts = F.zip_with(sums, F.transform(every(1), _lines), lambda a, g: a + F.coalesce(g, F.lit(0)))
    return F.zip_with(every(2), starts, lambda n, at: F.struct(n.alias("name"), at.alias("line")))


def _among(rules: list[Rule], test) -> Column:
    return F.col("rule").isin([i for i, r in enumerate(rules) if test(r)])


def hits(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(path, rule, name, line): first of each scope, name and file; rule is the index in rules.

    Which rules match a file at all is one cheap look each; only those are asked for places.
    """
    text = F.col("text")
    # what a file is, is found once and not for each rule
    languages = sorted({r.language for r in rules})
    is_ = {k: F.col("path").rlike(LANGUAGES[k]) for k in languages}
    on = [(is_[k] & ~minified() if k == "javascript" else is_[k]).alias(f"_{k}") for k in languages]
    files = files.filter("path is not null and text is not null").select("path", "text", *on, (F.col("path").rlike(LANGUAGES["python"]) & text.rlike(SPARK_FILE)).alias("_spark"))
    where = lambda r: F.col("_spark" if r.check == "table" or r.scope == "spark-conf" else f"_{r.language}")
    some = [F.when(where(r) & text.rlike(r.pattern), F.lit(i)) for i, r in enumerate(rules)]
    asked = files.select("path", "text", F.explode(F.array_compact(F.array(*some))).alias("rule"))
    rows = asked.select("path", "rule", F.explode(found(text, _by_rule(rules, lambda r: r.pattern))).alias("h")).select("path", "rule", "h.name", "h.line")
    # a list in code: of quoted imports, or of words, where of 'a: b' and 'a = b' the first counts; other names lose quotes
    words = F.when(_among(rules, lambda r: r.several and r.language == "go"), F.regexp_extract_all("name", F.lit('"([^"]+)"'), F.lit(1))).when(
        _among(rules, lambda r: r.several), F.regexp_extract_all("name", F.lit(r"(?:^|[,\[(])\s*[\"']?([A-Za-z_$][\w$]*)"), F.lit(1))
    )
    single = F.regexp_replace("name", r"[\"'`]\s*,?\s*[\"'`]", ".")
    rows = rows.select("path", "rule", F.explode(words.otherwise(F.array(single))).alias("name"), "line").filter("name <> ''")
    ok = F.when(_among(rules, lambda r: r.check == "env"), X.valid_env_name("name")).when(_among(rules, lambda r: r.check == "table"), X.valid_table_name("name")).otherwise(F.lit(True))
    w = Window.partitionBy("path", _by_rule(rules, lambda r: r.scope or r.name), "name").orderBy(_by_rule(rules, lambda r: r.priority).desc(), "line", "rule")
    return rows.filter(ok).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _by_rule(rules: list[Rule], value) -> Column:
    return F.element_at(F.array(*(F.lit(value(r)) for r in rules)), F.col("rule") + 1)


def graph(files: DataFrame, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the files: file nodes, what the rules found, and pydantic settings, dotenv and Terraform references."""
    h = saved(hits(files, rules))  # nodes and edges both come of it
    prefix = F.replace(_by_rule(rules, lambda r: r.prefix), F.lit("{path}"), F.col("path"))
    label = F.when(_among(rules, lambda r: r.name in ("tf_resource", "tf_data")), F.substring_index("name", ".", -1)).otherwise(F.col("name"))
    ids = h.select("path", "line", label.alias("name"), F.concat(prefix, "name").alias("id"), _by_rule(rules, lambda r: r.kind).alias("type"), _by_rule(rules, lambda r: r.edge).alias("edge"), _by_rule(rules, lambda r: r.confidence).alias("confidence"), _by_rule(rules, lambda r: r.name).alias("source"))
    more = settings(files).unionByName(dotenv(files)).select("path", F.lit(None).cast("int").alias("line"), "name", F.concat(F.lit("env:"), "name").alias("id"), F.lit("env_var").alias("type"), F.lit("reads").alias("edge"), F.lit(1.0).alias("confidence"), "source")
    more = more.join(ids.filter("type = 'env_var'").select("path", "id"), ["path", "id"], "left_anti")
    ids = ids.unionByName(more.select(*ids.columns))
    table, script = F.col("source").rlike("^(spark|sql|delta)_"), F.col("source").startswith("js_") & (F.col("type") == "env_var")
    meta = F.to_json(
        F.struct(
            "line", "source", F.when(table & (F.col("type") == "data_asset"), X.source_format(F.concat(F.col("source"), F.lit(" "), F.col("name")))).alias("format"),
            F.when(script, X.js_framework("name")).alias("framework"), F.when(script, X.js_public("name")).alias("public"),
        )
    ).alias("metadata")
    ids = ids.unionByName(next_nodes(files).select(*ids.columns))
    own = files.filter("path is not null").select(F.concat(F.lit("file://"), "path").alias("id"), F.col("path").alias("name"), F.lit("code_file").alias("type"), "path", F.lit(None).cast("string").alias("metadata")).distinct()
    nodes = own.unionByName(ids.select("id", "name", "type", "path", meta))
    # what a dbt model refers to is its own; the file only contains it
    stem = F.regexp_extract("path", r"([^/]*)\.sql$", 1)
    own_ref = F.col("source").isin("dbt_ref", "dbt_source")
    model = files.filter(F.col("path").rlike(LANGUAGES["dbt_sql"]) & F.contains("text", F.lit("{{"))).select("path", stem.alias("name"), "text").distinct()
    config = F.regexp_extract("text", r"\{\{\s*config\s*\(([^)]*)\)", 1)
    kept = F.regexp_extract(config, r"materialized\s*=\s*['\"]([^'\"]+)['\"]", 1)
    kind = F.when(kept != "", kept).when(F.contains(config, F.lit("materialized")), "derived")
    nodes = nodes.unionByName(model.select(F.concat(F.lit("data:model:"), "name").alias("id"), "name", F.lit("data_asset").alias("type"), "path", F.to_json(F.struct(F.lit("model").alias("resource_type"), kind.alias("materialized"))).alias("metadata")))
    edges = ids.select(F.when(own_ref, F.concat(F.lit("data:model:"), stem)).otherwise(F.concat(F.lit("file://"), "path")).alias("source_id"), F.col("id").alias("target_id"), F.col("edge").alias("type"), "confidence", meta)
    edges = edges.unionByName(model.select(F.concat(F.lit("file://"), "path").alias("source_id"), F.concat(F.lit("data:model:"), "name").alias("target_id"), F.lit("contains").alias("type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("metadata")))
    refs = terraform_references(files).select("source_id", "target_id", "type", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("metadata"))
    return nodes.withColumn("tokens", X.tokenize("name")), edges.unionByName(refs)


# --- extractors of two steps


def settings(files: DataFrame) -> DataFrame:
    """(path, name, source): variables of pydantic settings classes, the class's prefix and its fields in capitals."""
    cls = r"(?m)^class\s+\w+\s*\([^)]*\bBaseSettings\b[^)]*\)\s*:[^\n]*\n((?:[ \t]+[^\n]*(?:\n|\z)|[ \t]*\n)+)"
    body = files.filter(F.col("path").rlike(LANGUAGES["python"]) & F.contains("text", F.lit("BaseSettings"))).select("path", F.explode(F.regexp_extract_all("text", F.lit(cls), F.lit(1))).alias("_b"))
    prefix = F.regexp_extract("_b", r"\benv_prefix\s*=\s*[\"']([^\"']*)", 1)
    field = F.regexp_extract_all("_b", F.lit(r"(?m)^(?: {4}|\t)([A-Za-z]\w*)\s*:(?!.*\b(?:env|validation_alias)\s*=)"), F.lit(1))
    rows = body.select("path", prefix.alias("_p"), F.explode(field).alias("_f")).filter(~F.col("_f").isin("model_config", "class"))
    return rows.select("path", F.upper(F.concat("_p", "_f")).alias("name"), F.lit("py_settings").alias("source")).distinct()


def dotenv(files: DataFrame) -> DataFrame:
    """(path, name, source): keys read from names bound to dotenv_values()."""
    py = files.filter(F.col("path").rlike(LANGUAGES["python"]) & F.contains("text", F.lit("dotenv_values")))
    bound = F.regexp_extract_all("text", F.lit(r"(\w+)\s*(?::[^=\n]+)?=\s*(?:\{\s*\*\*\s*)?(?:dotenv\s*\.\s*)?dotenv_values\s*\("), F.lit(1))
    use = r"(\w+)\s*(?:\[|\.\s*get\s*\()\s*[\"'](\w+)[\"']"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(use), F.lit(1)).alias("v"), F.regexp_extract_all("text", F.lit(use), F.lit(2)).alias("k"))
    rows = py.select("path", bound.alias("_b"), F.explode(both).alias("_u")).filter("array_contains(_b, _u.v)")
    return rows.select("path", F.col("_u.k").alias("name"), F.lit("py_dotenv").alias("source")).distinct()


_BLOCK = r"(?m)^(resource|data|output|module|variable|locals)[ \t]*(?:\"([^\"]*)\"[ \t]*)?(?:\"([^\"]*)\"[ \t]*)?\{([^\n{}]*\}|[\s\S]*?^\})"
_REFERENCE = r"(?<![\w.\"-])((?:var|local|module|data\.\w+|[a-z]\w*_\w+)\.[A-Za-z_][\w-]*)"


def terraform_blocks(files: DataFrame) -> DataFrame:
    """(path, id, body) of top-level blocks; each local value is a block of its own."""
    tf = files.filter(F.col("path").rlike(LANGUAGES["terraform"]))
    g = lambda k: F.regexp_extract_all("text", F.lit(_BLOCK), F.lit(k)).alias(f"g{k}")
    b = tf.select("path", F.explode(F.arrays_zip(g(1), g(2), g(3), g(4))).alias("b")).select("path", "b.*")
    local = F.col("g1") == "locals"
    ident = (
        F.when(F.col("g1") == "resource", F.concat(F.lit("infra:"), "g2", F.lit("."), "g3")).when(F.col("g1") == "data", F.concat(F.lit("infra:data."), "g2", F.lit("."), "g3"))
        .when(F.col("g1") == "output", F.concat(F.lit("infra:output:"), "g2")).when(F.col("g1") == "module", F.concat(F.lit("infra:module:"), "g2")).otherwise(F.concat(F.lit("infra:var:"), "g2"))
    )
    pair = r"(?m)^\s*(\w+)\s*=\s*([^\n]*(?:\n(?!\s*\w+\s*=)[^\n]*)*)"
    inner = F.arrays_zip(F.regexp_extract_all("g4", F.lit(pair), F.lit(1)).alias("k"), F.regexp_extract_all("g4", F.lit(pair), F.lit(2)).alias("v"))
    single = b.filter(local).select("path", F.explode(inner).alias("x")).select("path", F.concat(F.lit("infra:local."), "x.k").alias("id"), F.col("x.v").alias("body"))
    return b.filter(~local).select("path", ident.alias("id"), F.col("g4").alias("body")).unionByName(single)


def terraform_references(files: DataFrame) -> DataFrame:
    """(path, source_id, target_id, type): what each block refers to; variables are read, others depended on."""
    r = F.col("r")
    plain = F.regexp_replace("body", "(?m)(?:#|//).*$", "")
    # inside a string only interpolations count
    code = F.regexp_replace(F.regexp_replace(plain, r"\$\{([^}]*)\}", "\" $1 \""), "\"[^\"\\n]*\"", " ")
    rows = terraform_blocks(files).select("path", F.col("id").alias("source_id"), F.explode(F.array_distinct(F.regexp_extract_all(code, F.lit(_REFERENCE), F.lit(1)))).alias("r"))
    parts = F.split(r, r"\.")
    target = F.when(r.startswith("var."), F.concat(F.lit("infra:var:"), parts[1])).when(r.startswith("local."), F.concat(F.lit("infra:local."), parts[1])).when(r.startswith("module."), F.concat(F.lit("infra:module:"), parts[1])).otherwise(F.concat(F.lit("infra:"), r))
    data = F.regexp_extract_all(code, F.lit(r"(?<![\w.\"-])(data\.\w+\.[A-Za-z_][\w-]*)"), F.lit(1))
    more = terraform_blocks(files).select("path", F.col("id").alias("source_id"), F.explode(F.array_distinct(data)).alias("r")).select("path", "source_id", F.concat(F.lit("infra:"), "r").alias("target_id"), F.lit("reads").alias("type"))
    out = rows.filter(~r.startswith("data.")).select("path", "source_id", target.alias("target_id"), F.when(r.startswith("var."), "reads").otherwise("depends_on").alias("type"))
    return out.unionByName(more).filter("source_id <> target_id").distinct()


def next_routes(files: DataFrame) -> DataFrame:
    """(path, id, name) of API routes by path."""
    route = F.regexp_extract("path", r"(?:^|/)(?:pages|app)/api/(.+?)(?:/route)?\.[cm]?[jt]sx?$", 1)
    name = F.regexp_replace(route, "(?:^|/)index$", "")
    return files.select("path", name.alias("name"), (route != "").alias("_is")).filter("_is").select("path", F.concat(F.lit("api:/api/"), "name").alias("id"), "name")


def next_nodes(files: DataFrame) -> DataFrame:
    """What paths say of a Next.js project: a node for each API route and each configuration file, contained in the file."""
    config = files.filter(F.col("path").rlike(r"(?:^|/)next\.config\.[cm]?[jt]s$")).select("path", F.concat(F.lit("config:nextjs:"), F.substring_index("path", "/", -1)).alias("id"), F.lit("next.config").alias("name"))
    rows = next_routes(files).select("*", F.lit("code_entity").alias("type"), F.lit("next_route").alias("source")).unionByName(config.select("*", F.lit("config_key").alias("type"), F.lit("next_config").alias("source")))
    return rows.distinct().select("path", F.lit(1).alias("line"), "name", "id", "type", F.lit("contains").alias("edge"), F.lit(1.0).alias("confidence"), "source")


def selected(sql: str) -> list[str]:
    """Names of what the outermost SELECT gives: aliases and plain columns; nothing for set operations and other statements."""
    sql = re.sub(r"\{\{\s*config\s*\([^)]*\)\s*\}\}|\{%.*?%\}|\{#.*?#\}|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    sql = re.sub(r"\{\{.*?\}\}", "x", sql, flags=re.S)
    depth, begin, end = 0, -1, len(sql)
    for m in re.finditer(r"'(?:[^']|'')*'|[()]|\b(?:select|from|union|intersect|except)\b", sql, re.I):
        word = m[0].lower()
        if word in "()":
            depth += 1 if word == "(" else -1
        elif depth == 0 and word == "select" and begin < 0:
            begin = m.end()
        elif depth == 0 and word == "from" and begin >= 0 and end == len(sql):
            end = m.start()
        elif depth == 0 and word in ("union", "intersect", "except"):
            return []
    if begin < 0:
        return []
    out = []
    for item in split_arguments(re.sub(r"(?i)^\s*distinct\b", "", sql[begin:end])):
        m = re.search(r"(?is)\bas\s+[\"`]?(\w+)[\"`]?$", item) or re.search(r"(?is)[)\w'\"]\s+[\"`]?([A-Za-z_]\w*)[\"`]?$", item) or re.fullmatch(r"(?:\w+\.)*[\"`]?([A-Za-z_]\w*)[\"`]?", item)
        if m and m[1].lower() not in ("end", "x"):
            out.append(m[1])
    return list(dict.fromkeys(out))


def dbt_columns(files: DataFrame) -> DataFrame:
    """Rows (path, kind, a, b, c) as documents give: the columns of each model and that the model contains them."""

    def run(batches):
        for b in batches:
            out = []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p is not None and t:
                    model = p.rsplit("/", 1)[-1].removesuffix(".sql")
                    for c in selected(t):
                        out += [(p, "node", f"column:{model}/{c}", c, "data_asset"), (p, "edge", f"data:model:{model}", f"column:{model}/{c}", "contains")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(5)], ["path", "kind", "a", "b", "c"])

    return files.filter(F.col("path").rlike(LANGUAGES["dbt_sql"])).select("path", "text").mapInArrow(run, "path string, kind string, a string, b string, c string")
