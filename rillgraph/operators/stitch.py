"""Linking nodes across domains: token-index candidate join, scoring, best match; mappings, packs and suppressions.

Defined results: nodes without id or name match nothing; equal nodes count once as candidates; rules and mappings with a null
pattern apply to nothing; ties have an order that each function states; tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.score import score
from ..functions.text import expand_wildcard, glob_column, glob_regex, hierarchy, jaccard, normalize, tokenize, tokenize_suggest
from ..shared import saved
from .graph import small


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of nodes (id, name) with equal normalised names or a common token of two characters or more.

    Names are made distinct before the join, so repeated names cost one pair; the pairs of a hot token are spread by AQE's
    skew join, and both token tables are hashed by token.
    """

    def keys(df: DataFrame, side: str) -> DataFrame:
        own = F.array_distinct(F.concat(F.filter(tokenize("name"), lambda t: F.length(t) >= 2), F.array(F.concat(F.lit("="), normalize("name")))))
        return df.select(F.col("id").alias(side), F.explode(own).alias("_key"))

    return keys(left, "left_id").join(keys(right, "right_id"), "_key").select("left_id", "right_id").distinct()


def comparable(left: DataFrame, right: DataFrame, gram: int = 4) -> DataFrame:
    """(left_id, right_id) of all pairs whose score can exceed 0: those of ``candidates``, and those where the left name's normal form, of
    ``gram`` characters or more, is a part of the right's. These meet where a run of the right name is the left's beginning, so
    no cross product is made."""
    a = left.select(F.col("id").alias("left_id"), normalize("name").alias("_l")).filter(F.length("_l") >= gram).withColumn("_g", F.substring("_l", 1, gram))
    runs = F.transform(F.sequence(F.lit(1), F.length("_r") - gram + 1), lambda k: F.substr(F.col("_r"), k, F.lit(gram)))
    b = right.select(F.col("id").alias("right_id"), normalize("name").alias("_r")).filter(F.length("_r") >= gram).withColumn("_g", F.explode(F.array_distinct(runs)))
    part = a.join(b, "_g").filter(F.contains("_r", "_l")).select("left_id", "right_id")
    return candidates(left, right).unionByName(part).distinct()


def scored(left: DataFrame, right: DataFrame, count_alternatives: bool = True) -> DataFrame:
    """Candidate pairs of provider nodes (left) and variables (right) with their score and struct ``result``."""
    pairs = candidates(left, right)
    if count_alternatives:  # all candidates count, whatever they score
        pairs = pairs.withColumn("alternatives", (F.count("*").over(Window.partitionBy("right_id")) - 1).cast("int"))
    else:
        pairs = pairs.withColumn("alternatives", F.lit(0))
    a = left.select(F.col("id").alias("left_id"), F.col("name").alias("left_name"), F.col("type").alias("left_type"))
    b = right.select(F.col("id").alias("right_id"), F.col("name").alias("right_name"), F.col("type").alias("right_type"))
    out = pairs.join(a, "left_id").join(b, "right_id")
    out = out.withColumn("result", score("left_name", "right_name", None, None, F.col("alternatives"), F.col("left_type"), F.col("right_type")))
    return out.withColumn("score", F.col("result.score"))


def env_to_infra(nodes: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """A 'provides' edge into each environment variable from its best provider that scores enough.

    Ties: more matched tokens, then the smaller id.
    """
    providers = nodes.filter(F.col("type").isin("config_key", "infra_resource")).select("id", "name", "type")
    variables = nodes.filter("type = 'env_var'").select("id", "name", "type")
    w = Window.partitionBy("right_id").orderBy(F.desc("score"), F.size("result.matched").desc(), "left_id")
    best = scored(providers, variables).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) & (F.col("score") >= min_confidence))
    return _edges(best, "left_id", "right_id", "provides", "semantic")


def _edges(df: DataFrame, source: str | Column, target: str | Column, kind: str, strategy: str) -> DataFrame:
    source, target = (F.col(c) if isinstance(c, str) else c for c in (source, target))
    return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), F.col("score").alias("confidence"), F.lit(strategy).alias("match_strategy"), F.col("result.matched").alias("matched_tokens"))


def infra_to_infra(nodes: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """A 'configures' edge for each pair of infrastructure nodes that share a token and score enough, from the one higher in
    the hierarchy; the smaller id on ties. The score is that of the smaller id against the larger."""
    infra = nodes.filter("type = 'infra_resource'").select("id", "name", "type")
    tokens = infra.select("id", F.explode(F.filter(tokenize("name"), lambda t: F.length(t) >= 2)).alias("_t")).distinct()
    pairs = tokens.alias("a").join(tokens.alias("b"), "_t").filter("a.id < b.id").select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()
    out = pairs.join(infra.select(F.col("id").alias("left_id"), F.col("name").alias("a")), "left_id").join(infra.select(F.col("id").alias("right_id"), F.col("name").alias("b")), "right_id")
    out = out.withColumn("result", score("a", "b")).withColumn("score", F.col("result.score")).filter(F.col("score") >= min_confidence)
    swap = hierarchy("b") > hierarchy("a")
    return _edges(out, F.when(swap, F.col("right_id")).otherwise(F.col("left_id")), F.when(swap, F.col("left_id")).otherwise(F.col("right_id")), "configures", "token_overlap")


def globs_match(pairs: DataFrame, patterns: DataFrame, source: str, target: str) -> Column:
    return F.rlike("source_id", glob_column(source)) & F.rlike("target_id", glob_column(target))


def active(suppressions: DataFrame, now: Column | None = None) -> DataFrame:
    """Enabled rules that haven't expired."""
    now = F.current_timestamp() if now is None else now
    return suppressions.filter(F.col("enabled") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def listed(suppressions: DataFrame, with_expired: bool = False, now: Column | None = None) -> DataFrame:
    """The rules, without expired ones unless they are asked for; disabled ones stay."""
    now = F.current_timestamp() if now is None else now
    return suppressions if with_expired else suppressions.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def without_expired(suppressions: DataFrame, now: Column | None = None) -> DataFrame:
    """What is left when expired rules are cleared."""
    return listed(suppressions, False, now)


def rules_for(suppressions: DataFrame, source_id: str, target_id: str, now: Column | None = None) -> DataFrame:
    """All active rules that match a pair."""
    return active(suppressions, now).filter(F.rlike(F.lit(source_id), glob_column("source_pattern")) & F.rlike(F.lit(target_id), glob_column("target_pattern")))


def suppressed(edges: DataFrame, suppressions: DataFrame, now: Column | None = None) -> DataFrame:
    """Edges that a rule suppresses, with rule and reason of the first by id."""
    rules = active(suppressions, now).select(F.col("id").alias("rule"), "source_pattern", "target_pattern", "reason")
    hit = edges.select("source_id", "target_id").distinct().join(F.broadcast(rules) if rules.count() <= 10_000 else rules, globs_match(edges, rules, "source_pattern", "target_pattern"))
    first = hit.groupBy("source_id", "target_id").agg(F.min(F.struct("rule", "reason")).alias("_r")).select("source_id", "target_id", "_r.rule", "_r.reason")
    return edges.join(first, ["source_id", "target_id"])


def unsuppressed(edges: DataFrame, suppressions: DataFrame, now: Column | None = None) -> DataFrame:
    return edges.join(suppressed(edges, suppressions, now).select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti").select(*edges.columns)


def boosted(edges: DataFrame, boosts: list[tuple[str, float, str]], most: float = 0.3) -> DataFrame:
    """Confidence raised by the packs' boosts whose glob matches either end, at most ``most`` in sum and to 1."""
    total = F.lit(0.0)
    for pattern, boost, _ in boosts:  # a pack's few patterns fold into the projection
        rx = glob_regex(pattern)
        total = total + F.when(F.col("source_id").rlike(rx) | F.col("target_id").rlike(rx), boost).otherwise(0.0)
    return edges.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("confidence") + F.least(F.lit(most), total)), 4))


def auto_suppressed(edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Edges without those that a pack's glob pair suppresses."""
    for source, target, _ in rules:
        edges = edges.filter(~(F.col("source_id").rlike(glob_regex(source)) & F.col("target_id").rlike(glob_regex(target))))
    return edges


def detected_packs(files: DataFrame, indicators: DataFrame, most: int = 10_000) -> DataFrame:
    """(pack, matched) for indicators(pack, mode all|any, path_glob, content) over files(path, text): packs that apply.

    Indicators are written by people; up to ``most`` of them (more raise an error) fold into one aggregation over one scan of the files."""
    asked = indicators.select("pack", "mode", "path_glob", "content").distinct().limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} indicators")
    if not asked:
        return indicators.select("pack", F.lit(False).alias("matched"))

    def hit(r):
        path = F.col("path").rlike(glob_regex(r["path_glob"]))
        return path if r["content"] is None else path & F.contains("text", F.lit(r["content"]))

    one = files.agg(F.array(*(F.coalesce(F.bool_or(hit(r)), F.lit(False)) for r in asked)).alias("_hits"))
    known = F.array(*(F.struct(F.lit(r["pack"]).alias("pack"), F.lit(r["mode"]).alias("mode")) for r in asked))
    each = one.select(F.explode(F.arrays_zip(known.alias("of"), F.col("_hits").alias("hit"))).alias("x")).select("x.of.pack", "x.of.mode", F.col("x.hit").alias("hit"))
    return each.groupBy("pack").agg(F.when(F.max("mode") == "all", F.bool_and("hit")).otherwise(F.bool_or("hit")).alias("matched"))


def expanded(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, mapping_type, reason): mappings applied to the nodes their source glob matches."""
    m = mappings.select("source", "target", "mapping_type", "reason")
    hit = nodes.select("id").join(F.broadcast(m) if m.count() <= 10_000 else m, F.rlike("id", glob_column("source")))
    return hit.select(F.col("id").alias("source_id"), expand_wildcard("id", "source", "target").alias("target_id"), "mapping_type", "reason").distinct()


def explicit_edges(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of confidence 1 for provides and alias mappings whose target exists."""
    known = expanded(mappings.filter("mapping_type <> 'ignore'"), nodes).join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return known.select("source_id", "target_id", F.lit("provides").alias("type"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("match_strategy"), F.array().cast("array<string>").alias("matched_tokens")).distinct()


def stitch(nodes: DataFrame, min_confidence: float = 0.5, suppress: list = (), boosts: list = ()) -> DataFrame:
    """All rules, then the packs' suppressions and boosts."""
    edges = env_to_infra(nodes, min_confidence).unionByName(infra_to_infra(nodes, min_confidence))
    return boosted(auto_suppressed(edges, list(suppress)), list(boosts)) if boosts else auto_suppressed(edges, list(suppress))


def stitch_with_mappings(nodes: DataFrame, mappings: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Explicit edges, and fuzzy ones whose target isn't mapped and whose ends aren't ignored."""
    explicit = saved(explicit_edges(mappings, nodes))
    ignored = saved(nodes.select("id").join(small(mappings.filter("mapping_type = 'ignore'").select("source"), 10_000), F.rlike("id", glob_column("source")), "left_semi"))
    fuzzy = stitch(nodes, min_confidence).join(explicit.select("target_id").distinct(), "target_id", "left_anti")
    for end in ("source_id", "target_id"):
        fuzzy = fuzzy.join(ignored.withColumnRenamed("id", end), end, "left_anti")
    return explicit.unionByName(fuzzy.select(*explicit.columns))


def stitch_counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if(F.col("match_strategy") == "exact").alias("explicit"), F.count_if(F.col("match_strategy") != "exact").alias("fuzzy"), F.count("*").alias("total"))


def mapping_conflicts(mappings: DataFrame) -> DataFrame:
    """Sources with more than one target."""
    return mappings.filter("mapping_type <> 'ignore'").groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("targets")).filter(F.size("targets") > 1)


def mapping_vs_fuzzy(explicit: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Fuzzy edges that lead from a mapped source to another target."""
    return explicit.select("source_id", F.col("target_id").alias("mapped")).join(fuzzy.select("source_id", "target_id", "confidence"), "source_id").filter("mapped <> target_id")


def invalid_mappings(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, problem) of mappings without wildcard whose ends don't exist, and of conflicts."""
    plain = mappings.filter((F.instr("source", "*") == 0) & (F.col("mapping_type") != "ignore"))
    ids = nodes.select("id").distinct()
    no_source = plain.join(ids, plain.source == ids.id, "left_anti").select("source", "target", F.lit("source not found").alias("problem"))
    no_target = plain.join(ids, plain.target == ids.id, "left_anti").select("source", "target", F.lit("target not found").alias("problem"))
    clash = mapping_conflicts(mappings).select("source", F.explode("targets").alias("target"), F.lit("conflict").alias("problem"))
    return no_source.unionByName(no_target).unionByName(clash)


def suggest_mappings(nodes: DataFrame, edges: DataFrame, least: float = 0.3) -> DataFrame:
    """(orphan, suggestion, similarity): for each variable without provider the node with the most similar tokens.

    Only pairs with a common token can have similarity, so a token join stands for the cross product.
    """
    provided = edges.filter("type = 'provides'").select(F.col("target_id").alias("id")).distinct()
    own = lambda df, side: df.select(F.col("id").alias(side), F.array_distinct(tokenize_suggest("name")).alias(f"{side}_t"))
    lone = own(nodes.filter("type = 'env_var'").join(provided, "id", "left_anti"), "orphan")
    others = own(nodes.filter("type in ('config_key', 'infra_resource')"), "suggestion")
    pairs = lone.withColumn("_t", F.explode("orphan_t")).join(others.withColumn("_t", F.explode("suggestion_t")), "_t").drop("_t").dropDuplicates(["orphan", "suggestion"])
    pairs = pairs.withColumn("similarity", F.round(jaccard("orphan_t", "suggestion_t"), 4)).filter(F.col("similarity") >= least)
    w = Window.partitionBy("orphan").orderBy(F.desc("similarity"), "suggestion")
    return pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("orphan", "suggestion", "similarity")
