"""Nodes and edges of structured documents: OpenLineage events, dbt manifests, Terraform plans, package files by from_json in
the JVM; YAML (Kubernetes, Spark jobs, dbt schemas) in Arrow batches.

Defined results: null texts and texts that don't parse give nothing; missing optional parts leave out what depends on them.
Every function returns (path, kind, a, b, c): kind 'node' with id, name, type or kind 'edge' with source, target, type.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .files import LANGUAGES

ROW = "path string, kind string, a string, b string, c string"
_FIELDS = "array<struct<name:string,type:string>>"
_LINEAGE = "struct<fields:map<string,struct<inputFields:array<struct<namespace:string,name:string,field:string>>>>>"
_SETS = f"array<struct<namespace:string,name:string,facets:struct<schema:struct<fields:{_FIELDS}>,columnLineage:{_LINEAGE}>>>"
EVENT = f"struct<eventType:string,eventTime:string,run:struct<runId:string>,job:struct<namespace:string,name:string>,inputs:{_SETS},outputs:{_SETS}>"


def _node(path, i, name, kind):
    return [path, F.lit("node").alias("kind"), i.alias("a"), name.alias("b"), F.lit(kind).alias("c") if isinstance(kind, str) else kind.alias("c")]


def _edge(path, a, b, kind):
    return [path, F.lit("edge").alias("kind"), a.alias("a"), b.alias("b"), F.lit(kind).alias("c") if isinstance(kind, str) else kind.alias("c")]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.filter("a is not null and b is not null").distinct()


# --- OpenLineage


def events(files: DataFrame) -> DataFrame:
    """(path, e): the events of files with one object or an array of them."""
    one = F.from_json("text", EVENT)
    several = F.from_json("text", f"array<{EVENT}>")
    e = F.when(F.trim("text").startswith("["), several).otherwise(F.array(one))
    return files.filter("text is not null").select("path", F.explode(e).alias("e")).filter("e.job.name is not null")


def _set_id(c: str) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(F.col(f"{c}.namespace"), F.lit("default")), F.lit("/"), F.col(f"{c}.name"))


def openlineage(events_: DataFrame) -> DataFrame:
    """Jobs and datasets of COMPLETE and RUNNING events, columns and their transformations of COMPLETE ones."""
    on = events_.filter(F.col("e.eventType").isin("COMPLETE", "RUNNING"))
    job = F.concat(F.lit("job:"), F.coalesce("e.job.namespace", F.lit("default")), F.lit("/"), "e.job.name")
    frames = [on.select(*_node("path", job, F.col("e.job.name"), "job"))]
    for side, kind in (("inputs", "reads"), ("outputs", "writes")):
        d = on.select("path", job.alias("job"), "e.eventType", F.explode(f"e.{side}").alias("d")).filter("d.name is not null")
        frames += [d.select(*_node("path", _set_id("d"), F.col("d.name"), "data_asset")), d.select(*_edge("path", F.col("job"), _set_id("d"), kind))]
        done = d.filter("eventType = 'COMPLETE'")
        column = lambda f: F.concat(F.lit("column:"), F.substring(_set_id("d"), 6, 1 << 30), F.lit("/"), f)
        c = done.select("path", "d", F.explode("d.facets.schema.fields").alias("f"))
        frames += [c.select(*_node("path", column(F.col("f.name")), F.col("f.name"), "data_asset")), c.select(*_edge("path", _set_id("d"), column(F.col("f.name")), "contains"))]
        if side == "outputs":
            t = done.select("path", "d", F.explode("d.facets.columnLineage.fields").alias("to", "v")).select("path", "d", "to", F.explode("v.inputFields").alias("i"))
            source = F.concat(F.lit("column:"), F.coalesce("i.namespace", F.lit("default")), F.lit("/"), "i.name", F.lit("/"), "i.field")
            frames.append(t.select(*_edge("path", source, column(F.col("to")), "transforms")))
    return _union(frames)


# --- dbt

MANIFEST = (
    "nodes map<string,struct<resource_type:string,name:string,schema:string,depends_on:struct<nodes:array<string>>,columns:map<string,struct<name:string>>>>,"
    "sources map<string,struct<name:string,source_name:string,schema:string>>,exposures map<string,struct<name:string,type:string,depends_on:struct<nodes:array<string>>>>"
)


def _dbt_id(uid: Column, name: Column, schema: Column) -> Column:
    kind = F.substring_index(uid, ".", 1)
    return (
        F.when(kind.isin("analysis", "model", "seed", "snapshot"), F.concat(F.lit("data:"), kind, F.lit(":"), F.concat_ws(".", schema, name)))
        .when(kind == "source", F.concat(F.lit("data:source:"), F.concat_ws(".", schema, name))).when(kind == "test", F.concat(F.lit("test:"), name)).when(kind == "exposure", F.concat(F.lit("exposure:"), name))
    )


def dbt_manifest(files: DataFrame) -> DataFrame:
    """Models, sources, seeds, snapshots, analyses, tests and exposures; dependencies resolved by a join on unique ids."""
    m = files.filter("text is not null").select("path", F.from_json("text", MANIFEST).alias("m"))
    n = m.select("path", F.explode("m.nodes").alias("uid", "v")).select("path", "uid", "v.name", _dbt_id(F.col("uid"), F.col("v.name"), F.col("v.schema")).alias("id"), F.col("v.depends_on.nodes").alias("deps"), "v.columns")
    s = m.select("path", F.explode("m.sources").alias("uid", "v")).select("path", "uid", "v.name", _dbt_id(F.col("uid"), F.concat_ws(".", "v.source_name", "v.name"), F.lit(None).cast("string")).alias("id"))
    e = m.select("path", F.explode("m.exposures").alias("uid", "v")).select("path", "uid", "v.name", _dbt_id(F.col("uid"), F.col("v.name"), F.lit(None).cast("string")).alias("id"), F.col("v.depends_on.nodes").alias("deps"))
    every = n.select("path", "uid", "name", "id").unionByName(s).unionByName(e.select("path", "uid", "name", "id")).filter("id is not null")
    kind = F.when(F.col("id").startswith("test:"), "job").when(F.col("id").startswith("exposure:"), "unknown").otherwise("data_asset")
    deps = n.select("path", "id", "deps").unionByName(e.select("path", "id", "deps")).filter("id is not null").select("path", F.col("id").alias("a"), F.explode("deps").alias("uid"))
    to = deps.join(every.select("path", "uid", F.col("id").alias("b")), ["path", "uid"])
    edge = F.when(F.col("a").startswith("exposure:"), "consumes").when(F.col("uid").startswith("source."), "reads").otherwise("depends_on")
    col = n.filter("id is not null").select("path", "id", F.explode(F.map_keys("columns")).alias("c"))
    cid = F.concat(F.lit("column:"), F.regexp_replace("id", "^data:[^:]*:", ""), F.lit("/"), "c")
    return _union([every.select(*_node("path", F.col("id"), F.col("name"), kind)), to.select(*_edge("path", F.col("a"), F.col("b"), edge)), col.select(*_node("path", cid, F.col("c"), "data_asset")), col.select(*_edge("path", F.col("id"), cid, "contains"))])


def model_aliases(nodes: DataFrame) -> DataFrame:
    """(a, b): ids of one model that come from its file (name only) and from a manifest (schema and name)."""
    m = nodes.filter(F.col("id").startswith("data:model:")).select("id", F.substring_index(F.substring_index("id", ":", -1), ".", -1).alias("k"), F.contains("id", F.lit(".")).alias("full")).distinct()
    return m.filter("not full").select(F.col("id").alias("a"), "k").join(m.filter("full").select(F.col("id").alias("b"), "k"), "k").select("a", "b")


# --- Terraform plans, package files


def terraform_plan(files: DataFrame) -> DataFrame:
    """Resources with their actions; those that only read give nothing."""
    kind = "struct<resource_changes:array<struct<address:string,type:string,name:string,change:struct<actions:array<string>>>>>"
    r = files.filter("text is not null").select("path", F.explode(F.from_json("text", kind)["resource_changes"]).alias("r"))
    i = F.concat(F.lit("infra:"), "r.type", F.lit("."), "r.name")
    acted = r.filter("not array_contains(r.change.actions, 'read')")
    change = acted.select("path", F.lit("action").alias("kind"), i.alias("a"), F.array_join("r.change.actions", ",").alias("b"), F.col("r.address").alias("c"))
    return _union([acted.select(*_node("path", i, F.col("r.name"), "infra_resource")), change])


def package_json(files: DataFrame) -> DataFrame:
    kind = "struct<name:string,scripts:map<string,string>,dependencies:map<string,string>,devDependencies:map<string,string>>"
    p = files.filter("text is not null").select("path", F.from_json("text", kind).alias("p"))
    file = F.concat(F.lit("file://"), "path")
    out = []
    for part in ("dependencies", "devDependencies"):
        d = p.select("path", F.explode(f"p.{part}").alias("k", "v"))
        i = F.concat(F.lit("npm:"), "k")
        out += [d.select(*_node("path", i, F.col("k"), "code_entity")), d.select(*_edge("path", file, i, "depends_on"))]
    s = p.select("path", "p.name", F.explode("p.scripts").alias("k", "v"))
    i = F.concat(F.lit("script:"), F.coalesce("name", F.lit("package")), F.lit(":"), "k")
    return _union([*out, s.select(*_node("path", i, F.col("k"), "job")), s.select(*_edge("path", file, i, "contains"))])


# --- YAML

Emit = Iterator[tuple[str, str | None, str | None, str | None]]


@functools.lru_cache(maxsize=1)  # the extractors of a file, one after the other, read it once; they change nothing in it
def _loaded(text: str) -> list:
    import yaml

    try:
        return [d for d in yaml.load_all(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if isinstance(d, dict)]
    except yaml.YAMLError:
        return []


def _get(d, *keys):
    for k in keys:
        d = d.get(k) if isinstance(d, dict) else d[k] if isinstance(d, list) and isinstance(k, int) and len(d) > k else None
    return d


def _list(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def kubernetes_rows(path: str, text: str) -> Emit:
    """Resources, variables, what containers refer to, service selectors, ingress routes with the default backend."""
    file = f"file://{path}"
    for d in _loaded(text):
        kind, name = d.get("kind"), _get(d, "metadata", "name")
        if not (kind and name and d.get("apiVersion")):
            continue
        ns = _get(d, "metadata", "namespace") or "default"
        me = f"k8s:{ns}/{str(kind).lower()}/{name}"
        yield "node", me, str(name), {"ConfigMap": "config_key", "Secret": "secret"}.get(kind, "infra_resource")
        yield "edge", file, me, "provisions"
        spec = d.get("spec") or {}
        pod = _get(spec, "jobTemplate", "spec", "template", "spec") or _get(spec, "template", "spec") or (spec if kind == "Pod" else {})
        for c in _list(_get(pod, "containers")):
            for v in _list(_get(c, "env")):
                if not isinstance(v, dict) or not v.get("name"):
                    continue
                yield "node", f"env:{v['name']}", v["name"], "env_var"
                for ref, short, kind_ in (("configMapKeyRef", "configmap", "config_key"), ("secretKeyRef", "secret", "secret")):
                    if target := _get(v, "valueFrom", ref, "name"):
                        other = f"k8s:{ns}/{short}/{target}"
                        yield "node", other, target, kind_
                        yield "edge", me, other, "reads"
                        yield "edge", me, f"env:{v['name']}", "provides"
            for v in _list(_get(c, "envFrom")):
                for ref, short, kind_ in (("configMapRef", "configmap", "config_key"), ("secretRef", "secret", "secret")):
                    if target := _get(v, ref, "name"):
                        other = f"k8s:{ns}/{short}/{target}"
                        yield "node", other, target, kind_
                        yield "edge", me, other, "reads"
        if kind == "Service" and isinstance(spec.get("selector"), dict):
            short = hashlib.md5(json.dumps(spec["selector"], sort_keys=True).encode()).hexdigest()[:8]  # as text.selector_hash
            yield "node", f"k8s:{ns}/selector/{short}", ",".join(f"{k}={v}" for k, v in sorted(spec["selector"].items())), "infra_resource"
            yield "edge", me, f"k8s:{ns}/selector/{short}", "routes_to"
        if kind == "Ingress":
            backs = [_get(p, "backend") for r in _list(spec.get("rules")) for p in _list(_get(r, "http", "paths"))] + [spec.get("defaultBackend"), spec.get("backend")]
            for b in backs:
                if service := _get(b, "service", "name") or _get(b, "serviceName"):
                    yield "node", f"k8s:{ns}/service/{service}", service, "infra_resource"
                    yield "edge", me, f"k8s:{ns}/service/{service}", "routes_to"


_NAME, _INPUT, _OUTPUT = ("job_name", "name", "app_name", "id"), ("inputs", "reads", "sources"), ("outputs", "writes", "targets")
_DEPEND, _ENV, _SPARK = ("dependencies", "depends_on", "upstream"), ("environment", "env", "env_vars"), ("schedule", "cron", "entry_point", "spark_config", "main_class", "script")


def _first(d: dict, keys: tuple[str, ...]):
    return next((d[k] for k in keys if d.get(k) is not None), None)


def _is_job(d) -> bool:
    return isinstance(d, dict) and any(k in d for k in (*_SPARK, *_DEPEND, *_INPUT, *_OUTPUT, *_ENV, "job_name")) and "apiVersion" not in d and "models" not in d


def spark_rows(path: str, text: str) -> Emit:
    """Jobs with dependencies, variables, tables and configuration; a document is a job, a list of them or a map by name."""
    for d in _loaded(text):
        jobs = [(None, d)] if _is_job(d) and _first(d, _NAME) else [(None, j) for j in d["jobs"]] if isinstance(d.get("jobs"), list) else list((d.get("jobs") if isinstance(d.get("jobs"), dict) else d).items())
        for key, j in jobs:
            name = (_first(j, _NAME) or key) if _is_job(j) else None
            if not name:
                continue
            me = f"job:spark/{name}"
            yield "node", me, str(name), "job"
            yield "edge", f"file://{path}", me, "contains"
            for other in _list(_first(j, _DEPEND)):
                other = _first(other, (*_NAME, "job")) if isinstance(other, dict) else other
                if other:
                    yield "node", f"job:spark/{other}", str(other), "job"
                    yield "edge", me, f"job:spark/{other}", "depends_on"
            env = _first(j, _ENV)
            own = [*env] if isinstance(env, dict) else [x.get("name") if isinstance(x, dict) else str(x).split("=")[0] for x in _list(env)]
            for v in dict.fromkeys([str(x) for x in own if x] + re.findall(r"\$\{([A-Z][A-Z0-9_]*)", str(j))):
                yield "node", f"env:{v}", v, "env_var"
                yield "edge", me, f"env:{v}", "reads"
            for keys, edge in ((_INPUT, "reads"), (_OUTPUT, "writes")):
                for t in _list(_first(j, keys)):
                    t = _first(t, ("table", "path", "name")) if isinstance(t, dict) else t
                    if t:
                        yield "node", f"data:{str(t).replace('://', ':')}", str(t), "data_asset"
                        yield "edge", me, f"data:{str(t).replace('://', ':')}", edge
            for k in _get(j, "spark_config") or {}:
                yield "node", f"config:spark:{k}", str(k), "config_key"
                yield "edge", me, f"config:spark:{k}", "reads"


def dbt_schema_rows(path: str, text: str) -> Emit:
    """Models with columns and tests, and sources, of a schema file."""
    for d in _loaded(text):
        for m in _list(d.get("models")):
            if not (name := _get(m, "name")):
                continue
            me = f"data:model:{name}"
            yield "node", me, name, "data_asset"
            for c in _list(m.get("columns")):
                if col := _get(c, "name"):
                    yield "node", f"column:{name}/{col}", col, "data_asset"
                    yield "edge", me, f"column:{name}/{col}", "contains"
                    for t in _list(_get(c, "tests")) + _list(_get(c, "data_tests")):
                        test = f"test:{next(iter(t)) if isinstance(t, dict) else t}_{name}_{col}"
                        yield "node", test, test[5:], "job"
                        yield "edge", test, me, "depends_on"
        for s in _list(d.get("sources")):
            for t in _list(_get(s, "tables")):
                if _get(s, "name") and _get(t, "name"):
                    yield "node", f"data:source:{s['name']}.{t['name']}", t["name"], "data_asset"


def yaml_documents(files: DataFrame, rows=None) -> DataFrame:
    """All YAML extractors on each file, each in its turn, so a file may serve several."""
    makers = [rows] if rows else [kubernetes_rows, spark_rows, dbt_schema_rows]

    def run(batches):
        for b in batches:
            out = [(p, *(None if x is None else str(x) for x in r)) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if p is not None and t for f in makers for r in f(p, t)]
            out = list(dict.fromkeys(out))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(5)], ["path", "kind", "a", "b", "c"])

    return files.filter(F.col("path").rlike(LANGUAGES["kubernetes"])).select("path", "text").mapInArrow(run, ROW)


def graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of any of the functions above."""
    nodes = rows.filter("kind = 'node'").select(F.col("a").alias("id"), F.col("b").alias("name"), F.col("c").alias("type"), "path", F.lit(None).cast("string").alias("metadata")).withColumn("tokens", X.tokenize("name"))
    edges = rows.filter("kind = 'edge'").select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("c").alias("type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("metadata"))
    return nodes, edges


def ingested(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every extractor over mixed files; nodes are one of each id, edges one of each key."""
    from . import extract

    on = lambda k: files.filter(F.col("path").rlike(LANGUAGES[k]))
    rows = _union([openlineage(events(on("openlineage").filter(F.contains("text", F.lit("eventType"))))), dbt_manifest(on("dbt_manifest")), terraform_plan(on("terraform_plan")), package_json(on("package_json")), yaml_documents(files)])
    n, e = graph(rows)
    n2, e2 = extract.graph(files)
    n3, e3 = graph(extract.dbt_columns(on("dbt_sql")))
    n, e = n.unionByName(n3), e.unionByName(e3)
    cols = ["id", "name", "type", "path", "metadata", "tokens"]
    nodes = n.select(*cols).unionByName(n2.select(*cols))
    edges = e.unionByName(e2.select(*e.columns))
    return nodes.groupBy("id").agg(*(F.min_by(c, F.struct(F.col("path"), F.col("type"))).alias(c) for c in cols[1:])), edges.dropDuplicates(["source_id", "target_id", "type"])
