"""Findings, explanations, the check gate, reviews, reviewers and diagnostics.

Defined results: a missing or zero confidence counts as one half; null ids, names and paths find nothing and are found by nothing;
equal edges are a finding each; ties go to the smaller id or name; tables may be empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.score import explanation, score
from ..functions.text import checked_env_name, confidence, confidence_level, ignored_path, name_of, normal_path, tokenize
from ..schema import EDGES, NODES
from ..shared import known, spread
from .graph import impact_edges, reach, reached
from .stitch import unsuppressed


def missing_providers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Environment variables without an incoming 'provides' edge."""
    got = edges.filter("type = 'provides'").select(F.col("target_id").alias("id")).distinct()
    return nodes.filter("type = 'env_var'").join(got, "id", "left_anti")


def missing_infra_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Environment variables without an outgoing edge to infrastructure: the findings' notion."""
    got = edges.filter(F.col("target_id").startswith("infra:")).select(F.col("source_id").alias("id")).distinct()
    return nodes.filter("type = 'env_var'").join(got, "id", "left_anti")


def findings(nodes: DataFrame, edges: DataFrame, depth: int = -1, floor: float = 2.0) -> DataFrame:
    """(kind, title, source_id, target_id, confidence, interest, match_count, blast_radius): one for each edge, and one for each
    variable without provider. The radius is computed, for all together, where interest exceeds floor."""
    s = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("s_name"), F.col("type").alias("s_type"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("type").alias("t_type"))
    e = edges.select("source_id", "target_id", confidence().alias("confidence"), F.count("*").over(Window.partitionBy("source_id")).alias("match_count"))
    e = e.join(s, "source_id", "left").join(t, "target_id", "left")
    c, many, cross = F.col("confidence"), F.col("match_count") > 1, F.coalesce(F.col("s_type") != F.col("t_type"), F.lit(False))
    known = F.col("s_name").isNotNull() & F.col("t_name").isNotNull()
    interest = (
        F.when(c >= 0.8, 2.0).when(c >= 0.6, 1.0).otherwise(0.0) + F.when(many, 2.5).otherwise(0.0) + F.when(cross, 1.5).otherwise(0.0)
        + F.when(known & (F.col("t_type") == "infra_resource"), 1.0).otherwise(0.0) + F.when((c < 0.5) & cross, 1.0).otherwise(0.0)
    )
    kind = F.when(many, "ambiguous_match").when(c >= 0.8, "high_confidence_link").when(cross, "cross_domain_chain").when(c < 0.4, "potential_risk").otherwise("high_confidence_link")
    sn, tn = F.coalesce("s_name", F.lit("Unknown")), F.coalesce("t_name", F.lit("Unknown"))
    e = e.withColumns({"interest": interest, "kind": kind})
    title = (
        F.when(F.col("kind") == "ambiguous_match", F.concat(sn, F.lit(": several matches"))).when(F.col("kind") == "high_confidence_link", F.concat(sn, F.lit(" -> "), tn))
        .when(F.col("kind") == "cross_domain_chain", F.concat(F.lit("across domains: "), sn, F.lit(" -> "), tn)).otherwise(sn)
    )
    far = reach(impact_edges(edges, "untyped"), e.filter((F.col("interest") > floor) & known).select(F.col("target_id").alias("seed")), depth).withColumnRenamed("count", "_r")
    e = e.join(far, e.target_id == far.seed, "left").withColumn("blast_radius", F.when(F.col("interest") > floor, F.coalesce("_r", F.lit(0))).otherwise(0)).withColumn("title", title)
    cols = ["kind", "title", "source_id", "target_id", "confidence", "interest", "match_count", "blast_radius"]
    none = missing_infra_targets(nodes, edges).select(
        F.lit("missing_provider").alias("kind"), F.concat("name", F.lit(": no provider")).alias("title"), F.col("id").alias("source_id"), F.lit(None).cast("string").alias("target_id"),
        F.lit(0.0).alias("confidence"), F.lit(1.5).alias("interest"), F.lit(0).cast("long").alias("match_count"), F.lit(0).cast("long").alias("blast_radius"),
    )
    return e.select(*cols).unionByName(none)


def top_findings(found: DataFrame, n: int = 5) -> DataFrame:
    return found.orderBy(F.desc("interest"), "source_id", "target_id").limit(n)


def finding_counts(edges: DataFrame) -> DataFrame:
    """(total, high, medium, low, ambiguous) of all edges by confidence."""
    e = edges.select(confidence().alias("c"), F.count("*").over(Window.partitionBy("source_id")).alias("n"))
    c = F.col("c")
    return e.agg(F.count("*").alias("total"), F.count_if(c >= 0.7).alias("high"), F.count_if((c < 0.7) & (c >= 0.4)).alias("medium"), F.count_if(c < 0.4).alias("low"), F.count_if(F.col("n") > 1).alias("ambiguous"))


def explain(pairs: DataFrame) -> DataFrame:
    """pairs(source_id, target_id) with score, level, matched tokens and explanation, by names only."""
    r = score(name_of("source_id"), name_of("target_id"))
    out = pairs.select("source_id", "target_id", r.alias("_r"))
    return out.select("source_id", "target_id", F.col("_r.score").alias("score"), confidence_level("_r.score").alias("level"), F.col("_r.matched").alias("matched_tokens"), explanation(F.col("_r")).alias("explanation"))


def alternatives(nodes: DataFrame, source_id: str, target_type: str = "infra_resource", n: int = 5) -> DataFrame:
    """The n best-scoring nodes of a type for one id."""
    r = score(F.col("name"), name_of(F.lit(source_id)))
    return spread(nodes.filter((F.col("type") == target_type) & (F.col("id") != source_id)).select("id", "name")).select("id", "name", r["score"].alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(n)


def why_not(source_id: str, target_id: str, spark, threshold: float = 0.5) -> DataFrame:
    """One row: the pair's score and what keeps it under the threshold."""
    row = spark.createDataFrame([(source_id, target_id)], "source_id string, target_id string")
    r = score(name_of("source_id"), name_of("target_id"))
    return row.select("source_id", "target_id", r["score"].alias("score"), (r["score"] >= threshold).alias("matches"), F.transform(r["penalties"], lambda p: p["penalty"]).alias("penalties"))


def check(nodes: DataFrame, edges: DataFrame, files: DataFrame, top: int = 5) -> DataFrame:
    """(severity, rule, subject) for changed files(path): variables read there without provider, the infrastructure most
    impacted by the files' nodes (top each), and changed infrastructure and schema files."""
    nodes, edges = known(nodes, NODES), known(edges, EDGES)
    changed = files.filter(~ignored_path("path")).select(normal_path("path").alias("_p")).distinct()
    touched = nodes.withColumn("_p", normal_path("path")).join(changed, "_p", "left_semi")
    lone = missing_providers(nodes, edges).filter(checked_env_name("name")).select("id")
    reads = edges.filter("type = 'reads'").join(touched.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    missing = lone.join(reads.union(touched.select("id")).distinct(), "id", "left_semi").select(F.lit("critical").alias("severity"), F.lit("missing_provider").alias("rule"), F.col("id").alias("subject"))
    hit = reached(impact_edges(edges, "core"), touched.select(F.col("id").alias("seed"))).select(F.col("node").alias("id"))
    infra = hit.join(nodes.filter("type = 'infra_resource'").select("id"), "id").orderBy("id").limit(top).select(F.lit("high").alias("severity"), F.lit("infra_impact").alias("rule"), F.col("id").alias("subject"))
    kind = F.when(F.col("_p").rlike(r"\.tf(vars)?$"), "infra_change").when(F.col("_p").rlike(r"(?i)(schema|migration|\.sql$)"), "schema_change")
    own = changed.select(F.when(kind == "infra_change", "high").otherwise("medium").alias("severity"), kind.alias("rule"), F.col("_p").alias("subject")).filter("rule is not null")
    return missing.unionByName(infra).unionByName(own)


def review_queue(edges: DataFrame, suppressions: DataFrame, low: float = 0.0, high: float = 0.8) -> DataFrame:
    """Stitched edges in a range of confidence that no rule suppresses."""
    open_ = edges.filter(F.col("match_strategy").isNotNull() & F.col("confidence").between(low, high))
    return unsuppressed(open_, suppressions)


def owner_regex(pattern: str) -> str:
    """A CODEOWNERS pattern as a regular expression on paths."""
    anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")
    body = re.sub(r"\*\*/?|\*|\?|[^*?]+", lambda m: {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0]) or re.escape(m[0]), pattern.strip("/"))
    return ("^" if anchored else "(^|.*/)") + body + "(/.*)?$"


TEAMS = {"dbt": "@data-team", "infra": "@platform-team", "k8s": "@platform-team", "kubernetes": "@platform-team", "pipelines": "@data-team", "src/data": "@data-team", "terraform": "@platform-team"}


def reviewers(files: DataFrame, owners: list[tuple[str, list[str]]], blame: DataFrame | None = None, n: int = 5, teams: dict[str, str] = TEAMS) -> DataFrame:
    """(reviewer, score, reasons): 10 for each file a reviewer owns (the last matching rule decides); where no rule matches,
    the three authors with the most lines of blame(path, author, lines), scored by lines; 5 for each team whose folder a file lies in, if
    neither names anyone. Names without a space get an @. A top-n report."""
    owned = F.lit(None).cast("array<string>")
    for pattern, names in owners:
        owned = F.when(F.col("path").rlike(owner_regex(pattern)), F.array(*map(F.lit, names))).otherwise(owned)
    f = files.select("path").distinct().withColumn("_o", owned)
    rows = f.filter("_o is not null").select(F.explode("_o").alias("reviewer"), F.lit(10).cast("long").alias("points"), F.concat(F.lit("owns "), "path").alias("reason"))
    if blame is not None:
        w = Window.partitionBy("path").orderBy(F.desc("lines"), "author")
        top = blame.filter("author <> ''").withColumn("_n", F.row_number().over(w)).filter("_n <= 3").join(f.filter("_o is null").select("path"), "path", "left_semi")
        rows = rows.unionByName(top.select(F.col("author").alias("reviewer"), F.col("lines").cast("long").alias("points"), F.concat(F.lit("wrote "), "path").alias("reason")))
    if rows.isEmpty():
        team = F.lit(None).cast("string")
        for folder, name in sorted(teams.items(), reverse=True):
            team = F.when(F.col("path").startswith(folder), name).otherwise(team)
        rows = files.select(team.alias("reviewer")).filter("reviewer is not null").distinct().select("reviewer", F.lit(5).cast("long").alias("points"), F.lit("team of the folder").alias("reason"))
    name = F.trim("reviewer")
    rows = rows.withColumn("reviewer", F.when(name.contains(" ") | name.startswith("@"), name).otherwise(F.concat(F.lit("@"), name)))
    return rows.groupBy("reviewer").agg(F.sum("points").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons")).orderBy(F.desc("score"), "reviewer").limit(n)


def source_file(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, path) for asked(id): the node's own file, else the smallest file that contains, reads or provisions it."""
    own = asked.join(nodes.select("id", "path"), "id").filter("path is not null").groupBy("id").agg(F.min("path").alias("path"))
    rest = asked.join(own, "id", "left_anti")
    files = edges.filter(F.col("source_id").startswith("file://") & F.col("type").isin("contains", "provisions", "reads")).select(F.col("target_id").alias("id"), F.substring("source_id", 8, 1 << 30).alias("path"))
    return own.unionByName(rest.join(files, "id").groupBy("id").agg(F.min("path").alias("path")))


def hover(nodes: DataFrame, edges: DataFrame, path: str, line: int) -> DataFrame:
    """The node at a line of a file with its provider, if any."""
    nodes, edges = known(nodes, NODES), known(edges, EDGES)
    at = nodes.filter((F.col("path") == path) & (F.get_json_object("metadata", "$.line").cast("int") == line)).select("id", "name", "type")
    p = edges.filter("type = 'provides'").select(F.col("target_id").alias("id"), "source_id", "confidence")
    return at.join(p, "id", "left").join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("provider"), F.col("path").alias("provider_path")), "source_id", "left").orderBy("id", F.desc_nulls_last("confidence"), "source_id").limit(1)


def providers_for_file(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    nodes, edges = known(nodes, NODES), known(edges, EDGES)
    own = nodes.filter(F.col("path") == path).select(F.col("id").alias("target_id"), "name")
    return own.join(edges.filter("type = 'provides'"), "target_id").join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("provider"), F.col("path").alias("provider_path")), "source_id").select("target_id", "name", "source_id", "provider", "provider_path", "confidence")


def orphan_diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, hint): variables without provider and the output that shares most words with each; among equals the first
    by name; where none shares a word the first output of all."""
    words = lambda c: F.array_sort(F.array_distinct(tokenize(c)))
    lone = missing_providers(nodes, edges).select("id", "name", words("name").alias("_t"))
    outs = nodes.filter(F.col("id").startswith("infra:output:")).select(F.col("name").alias("hint"), words("name").alias("_o"))
    # The most words shared are the most of a set of words that both have, so it is enough to know the first output by name that has each
    # set of words, and no pair of names with a common word is made. Names of too many words for all their sets are paired by words.
    few = lambda c: F.size(c) <= SET_WORDS
    by_set = outs.filter(few("_o")).select("hint", F.explode(word_sets("_o")).alias("_s")).groupBy("_s").agg(F.min("hint").alias("hint"))
    sets = lone.filter(few("_t")).select("id", F.explode(word_sets("_t")).alias("_s")).join(by_set, "_s").select("id", "hint", F.size("_s").cast("long").alias("_n"))
    paired = lambda l, o: l.select("id", "_t").distinct().select("id", F.explode("_t").alias("_w")).join(o.distinct().select("hint", F.explode("_o").alias("_w")), "_w").groupBy("id", "hint").agg(F.count("*").alias("_n"))
    pairs = sets.unionByName(paired(lone.filter(~few("_t")), outs)).unionByName(paired(lone.filter(few("_t")), outs.filter(~few("_o"))))
    best = pairs.groupBy("id").agg(F.min(F.struct((-F.col("_n")).alias("n"), "hint")).alias("_b")).select("id", "_b.hint")
    first = outs.agg(F.min("hint")).first()[0]
    return lone.join(best, "id", "left").select("id", "name", F.coalesce("hint", F.lit(first).cast("string")).alias("hint"))


#: Names of so many words have a row for each set of them, 63 at most.
SET_WORDS = 6


def word_sets(c: str) -> Column:
    """All sets of some of the words of an array without repeats, each in the array's order."""
    none = F.array(F.array().cast("array<string>"))
    grown = F.aggregate(F.col(c), none, lambda got, w: F.concat(got, F.transform(got, lambda s: F.concat(s, F.array(w)))))
    return F.filter(grown, lambda s: F.size(s) > 0)


def accuracy(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(parser, tp, fp, fn, precision, recall, f1) of expected and found(parser, case, item)."""
    keys = ["parser", "case", "item"]
    j = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(found.select(*keys).distinct().withColumn("_f", F.lit(1)), keys, "full_outer")
    c = j.groupBy("parser").agg(F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull()).alias("tp"), F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    c = c.withColumns({"precision": share(F.col("tp"), F.col("fp")), "recall": share(F.col("tp"), F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def envelope(rows: DataFrame, query: str) -> DataFrame:
    """One JSON document of a result's rows, as the programs' interfaces answer."""
    body = F.to_json(F.struct(F.lit(query).alias("query"), F.lit("ok").alias("status"), F.col("n").alias("count"), F.col("data")))
    return rows.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("data")).select(body.alias("response"))
