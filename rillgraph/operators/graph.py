"""Graph operators on edges(source_id, target_id, type) and nodes: closures, paths, cycles, orphans, statistics.

Fix-points iterate over DataFrames: each level joins the frontier with the edges, drops what was seen in the same shuffle that makes
the level's rows distinct, and is written to the shared folder, so the lineage stays short and lost executors cost one level. The
edges are shuffled once, by their first end, made distinct in place and kept with that partitioning while the levels run; a frontier
too large to broadcast is shuffled to them. All seeds of a call run together.

Defined results: edges with a null end and loops lead nowhere, null seeds are left out, equal edges and seeds count once, tables may
be empty; extra columns aren't read, or pass through where whole rows are returned.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blast_bucket, lineage_bucket
from ..schema import EDGE_KEY, EDGES, NODES, POLICIES
from ..shared import fresh, known, parts, saved


SMALL = 100_000


def counted(df: DataFrame, rows: int, most: int = SMALL) -> DataFrame:
    """Hint a broadcast where df has few rows."""
    return F.broadcast(df) if rows <= most else df


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The same for a checkpointed df whose rows aren't known yet."""
    return counted(df, df.count(), most)


def impact_edges(edges: DataFrame, policy: str = "core", upstream: bool = False, distinct: bool = True) -> DataFrame:
    """(u, v): a change of u reaches v, by the policy; turned around for upstream. Closures make them distinct themselves."""
    rules = POLICIES[policy]
    s, t = F.col("source_id"), F.col("target_id")
    if not rules:
        out = edges.select(s.alias("u"), t.alias("v"))
    else:
        known = edges.filter(F.col("type").isin(rules["forward"] + rules["reverse"]))
        back = F.col("type").isin(rules["reverse"])
        out = known.select(F.when(back, t).otherwise(s).alias("u"), F.when(back, s).otherwise(t).alias("v"))
    out = out.filter("u is not null and v is not null and u <> v")
    out = out.distinct() if distinct else out
    return out.select(F.col("v").alias("u"), F.col("u").alias("v")) if upstream else out


def kept(pairs: DataFrame) -> DataFrame:
    """Distinct pairs(u, v), hashed by u in one shuffle and cached that way; a lost part is computed again. Unpersist when done.

    An adaptive plan wouldn't say how the cached rows are partitioned, so this one is made without."""
    conf = pairs.sparkSession.conf
    parts, key = int(conf.get("spark.sql.shuffle.partitions")), "spark.sql.adaptive.enabled"
    before = conf.get(key, None)
    conf.set(key, "false")
    try:
        return pairs.select("u", "v").repartition(parts, "u").distinct().persist()
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def next_level(frontier: DataFrame, pairs: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth) of what the frontier reaches in one step and isn't in seen; one shuffle serves both."""
    step = frontier.join(pairs, F.col("node") == F.col("u")).select("seed", F.col("v").alias("node"), F.lit(depth).alias("depth"))
    both = seen.select("seed", "node", "depth").unionByName(step).groupBy("seed", "node").agg(F.min("depth").alias("depth"))
    return both.filter(F.col("depth") == depth)


#: Seeds of one row of a level: so many words of 64 bits at most.
WORDS = 16


def _words(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("w_")]


def _start(seeds: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(seed, n) of the distinct seeds, their first level, and how many there are.

    One seed keeps its name. More are numbered, in the order of their ids, since neighbours tend to reach the same nodes, and a level
    has (node, block, depth, w_0, w_1, ..): the seeds of a block that reach the node are the bits of its words.
    """
    distinct = saved(seeds.select("seed").filter("seed is not null").distinct())
    rows = distinct.count()
    if rows < 2:
        return distinct, distinct.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")), rows
    ordered = distinct.repartitionByRange(1 + rows // 500_000, F.length("seed"), "seed").sortWithinPartitions(F.length("seed"), "seed")
    numbered = saved(ordered.select("seed", F.monotonically_increasing_id().alias("n")))
    words = min(WORDS, -(-rows // 64))
    word = lambda k: F.when(F.expr(f"n % {64 * words} div 64 = {k}"), F.expr("shiftleft(1L, cast(n % 64 as int))")).otherwise(F.lit(0).cast("long"))
    first = numbered.select(F.col("seed").alias("node"), F.expr(f"n div {64 * words}").alias("block"), F.lit(0).alias("depth"), *(word(k).alias(f"w_{k}") for k in range(words)))
    return numbered, first.groupBy("node", "block", "depth").agg(*(F.bit_or(f"w_{k}").alias(f"w_{k}") for k in range(words))), rows


def next_blocks(frontier: DataFrame, pairs: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """next_level for levels of bits: a row for each node and block of seeds."""
    words = _words(frontier)
    step = frontier.join(pairs, F.col("node") == F.col("u")).select(F.col("v").alias("node"), "block", *words, *(F.lit(0).cast("long").alias(f"had_{c}") for c in words))
    both = seen.select("node", "block", *words, *(F.col(c).alias(f"had_{c}") for c in words)).unionByName(step)
    both = both.groupBy("node", "block").agg(*(F.bit_or(c).alias(c) for c in words), *(F.bit_or(f"had_{c}").alias(f"had_{c}") for c in words))
    new = both.select("node", "block", F.lit(depth).alias("depth"), *(F.col(c).bitwiseAND(F.bitwise_not(f"had_{c}")).alias(c) for c in words))
    return new.filter(functools.reduce(lambda a, b: a | b, (F.col(c) != 0 for c in words)))


def _levels(pairs: DataFrame, seeds: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """(seed, n) and all levels, the seeds themselves at depth 0."""
    pairs = kept(pairs)
    numbered, start, rows = _start(seeds)
    step = next_level if rows < 2 else next_blocks
    frontier = saved(start)
    levels, depth = [frontier], 0
    while max_depth < 0 or depth < max_depth:
        depth += 1
        frontier = saved(step(frontier, pairs, functools.reduce(DataFrame.unionByName, levels), depth))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > 12:  # many short levels: one table instead of a long union
            levels = [saved(functools.reduce(DataFrame.unionByName, levels))]
    pairs.unpersist()
    return numbered, functools.reduce(DataFrame.unionByName, levels)


def _unpacked(levels: DataFrame) -> DataFrame:
    """(n, node, depth): a row for each bit."""
    words = _words(levels)
    at = F.array(*(F.struct(F.lit(64 * k).alias("k"), F.col(c).alias("w")) for k, c in enumerate(words)))
    rows = levels.select("node", "depth", (F.col("block") * (64 * len(words))).alias("b"), F.explode(at).alias("x")).filter("x.w <> 0")
    rows = rows.select("node", "depth", (F.col("b") + F.col("x.k")).alias("b"), F.col("x.w").alias("w"), F.explode(F.array(*map(F.lit, range(64)))).alias("bit"))
    return rows.filter("(shiftrightunsigned(w, bit) & 1L) = 1").select((F.col("b") + F.col("bit")).alias("n"), "node", "depth")


def closure(pairs: DataFrame, seeds: DataFrame, max_depth: int = -1, include_start: bool = False) -> DataFrame:
    """(seed, node, depth) of all that pairs(u, v) reach from seeds(seed), depth the least number of steps.

    max_depth -1 is unbounded, 0 empty. Seeds on a cycle don't return themselves unless include_start, which gives every
    seed at depth 0.
    """
    numbered, out = _levels(pairs, seeds, max_depth)
    out = out if include_start else out.filter("depth > 0")
    if _words(out):
        out = _unpacked(out).join(small(numbered, 1_000_000), "n").select("seed", "node", "depth")
    return out


def reach(pairs: DataFrame, seeds: DataFrame, max_depth: int = -1) -> DataFrame:
    """(seed, count): how many nodes closure has for each seed; seeds without any are left out."""
    numbered, out = _levels(pairs, seeds, max_depth)
    out = out.filter("depth > 0")
    if not _words(out):
        return out.groupBy("seed").agg(F.count("*").alias("count"))
    return _unpacked(out).groupBy("n").agg(F.count("*").alias("count")).join(numbered, "n").select("seed", "count")


def impacted(edges: DataFrame, seeds: DataFrame, policy: str = "core", max_depth: int = -1) -> DataFrame:
    return closure(impact_edges(edges, policy, distinct=False), seeds, max_depth)


def upstream(edges: DataFrame, seeds: DataFrame, policy: str = "lineage", max_depth: int = -1) -> DataFrame:
    return closure(impact_edges(edges, policy, upstream=True, distinct=False), seeds, max_depth)


def descendants(edges: DataFrame, seeds: DataFrame, max_depth: int = -1) -> DataFrame:
    return closure(impact_edges(edges, "untyped", distinct=False), seeds, max_depth)


def ancestors(edges: DataFrame, seeds: DataFrame, max_depth: int = -1) -> DataFrame:
    return closure(impact_edges(edges, "untyped", upstream=True, distinct=False), seeds, max_depth)


def blast_radius(edges: DataFrame, seeds: DataFrame, policy: str = "core", max_depth: int = -1) -> DataFrame:
    """(seed, impacted): how many each seed impacts; seeds without impact have 0. Which they are, a row each, ``impacted`` gives: a
    list of a whole closure might not fit a row."""
    got = reach(impact_edges(edges, policy, distinct=False), seeds, max_depth).withColumnRenamed("count", "impacted")
    return seeds.select("seed").distinct().join(got, "seed", "left").select("seed", F.coalesce("impacted", F.lit(0)).alias("impacted"))


def reached(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) of all that pairs(u, v) reach from a seed other than the node itself: the nodes of closure, without a row for each
    seed.

    A node keeps and hands on the first two seeds that get to it. That is enough: along a path from a seed other than x to x each
    node has a seed other than x, since it was handed one or had two already. Each edge is passed at most twice, however many seeds.
    """
    pairs = kept(pairs)
    numbered = saved(seeds.select("seed").filter("seed is not null").distinct())
    frontier = saved(numbered.select(F.col("seed").alias("node"), F.monotonically_increasing_id().alias("seed")))
    start, levels = frontier, []
    while True:
        seen = functools.reduce(DataFrame.unionByName, levels, start)
        step = frontier.join(pairs, F.col("node") == F.col("u")).select(F.col("v").alias("node"), "seed")
        none = F.lit(None).cast("long")
        both = seen.select("node", F.col("seed").alias("had"), none.alias("got")).unionByName(step.select("node", none.alias("had"), F.col("seed").alias("got")))
        both = both.groupBy("node").agg(F.min("had").alias("h1"), F.max("had").alias("h2"), F.min("got").alias("g1"), F.max("got").alias("g2")).filter("g1 is not null and (h1 is null or h1 = h2)")
        new = F.when(F.col("h1").isNull(), F.array_distinct(F.array("g1", "g2"))).when(F.col("g1") != F.col("h1"), F.array("g1")).when(F.col("g2") != F.col("h1"), F.array("g2")).otherwise(F.array().cast("array<bigint>"))
        frontier = saved(both.select("node", F.explode(new).alias("seed")))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if len(levels) > 12:
            levels = [saved(functools.reduce(DataFrame.unionByName, levels))]
    pairs.unpersist()
    if not levels:
        return frontier.select("node")
    return functools.reduce(DataFrame.unionByName, levels).select("node").distinct()


def blast_artifacts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(bucket, node) of all that is reached from any seed, whatever the edges' types."""
    return reached(impact_edges(edges, "untyped", distinct=False), seeds).select(blast_bucket("node").alias("bucket"), "node")


def blast_breakdown(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(bucket, count) of blast_artifacts."""
    return blast_artifacts(edges, seeds).groupBy("bucket").agg(F.count("*").alias("count"))


def shortest_paths(pairs: DataFrame, seeds: DataFrame, target: str, max_depth: int = 15) -> DataFrame:
    """(seed, path): for each seed that reaches target one shortest path; ties go to the smallest parent at each step.

    The levels go back from target, so a node has one row, however many seeds there are. Of equally short paths the smallest counts,
    read from target: nodes of a level are numbered in the order of theirs (the next node's number, then the id), and a node's next
    is the successor with the smallest number. The seeds' paths are put together from these numbers at the end.
    """
    spark, n = pairs.sparkSession, parts(pairs)
    pairs = pairs.select("u", "v").filter("u is not null").repartition(n, "v").persist()
    levels = [spark.range(1).select(F.lit(target).alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("next"), F.lit(0).cast("long").alias("n"))]
    for depth in range(1, max_depth + 1):
        frontier = levels[-1].select(F.col("node").alias("v"), "n").hint("shuffle_hash")  # so the kept edges needn't be sorted
        step = pairs.join(frontier, "v").select(F.col("u").alias("node"), F.col("n").alias("next"), F.lit(False).alias("had"))
        seen = functools.reduce(DataFrame.unionByName, levels).select("node", F.lit(None).cast("long").alias("next"), F.lit(True).alias("had"))
        new = saved(step.unionByName(seen).groupBy("node").agg(F.min("next").alias("next"), F.max("had").alias("had")).filter("not had").drop("had"))
        rows = new.count()
        if rows == 0:
            break
        ordered = new.repartitionByRange(1 + rows // 500_000, "next", "node").sortWithinPartitions("next", "node")
        levels.append(saved(ordered.select("node", F.lit(depth).alias("depth"), "next", F.monotonically_increasing_id().alias("n"))))
    pairs.unpersist()
    wanted = seeds.select("seed").filter("seed is not null")
    wanted = wanted.repartition(parts(wanted), "seed").distinct()
    found = saved(functools.reduce(DataFrame.unionByName, levels).join(wanted, F.col("node") == F.col("seed")).select("seed", "depth", "next"))
    path: DataFrame | None = None
    for depth in range(len(levels) - 1, -1, -1):
        if path is not None:
            path = path.join(levels[depth].select(F.col("n").alias("next"), "node", F.col("next").alias("_next")), "next").select("seed", F.concat("path", F.array("node")).alias("path"), F.col("_next").alias("next"))
        begun = found.filter(F.col("depth") == depth).select("seed", F.array("seed").alias("path"), "next")
        path = begun if path is None else path.unionByName(begun)
    return path.select("seed", "path")


def simple_paths(pairs: DataFrame, seeds: DataFrame, target: str | None = None, max_nodes: int = 20) -> DataFrame:
    """(seed, path) of all paths without repeated nodes, up to max_nodes long; they end at target if one is given."""
    pairs = saved(pairs.select("u", "v").filter("u <> v").distinct())
    frontier = saved(seeds.select("seed").distinct().select("seed", F.array("seed").alias("path")))
    found = []
    for _ in range(max_nodes - 1):
        step = frontier.join(pairs, F.element_at("path", -1) == F.col("u")).filter(~F.expr("array_contains(path, v)"))
        step = saved(step.select("seed", F.concat("path", F.array("v")).alias("path")))
        if step.isEmpty():
            break
        found.append(step if target is None else step.filter(F.element_at("path", -1) == target))
        frontier = step if target is None else step.filter(F.element_at("path", -1) != target)
    return functools.reduce(DataFrame.unionByName, found) if found else frontier.filter("false")


def cycles(pairs: DataFrame, max_length: int = 5) -> DataFrame:
    """(cycle, length): simple cycles of at most max_length nodes, each once, turned to begin at its smallest id.

    Self-loops are cycles of length 1.
    """
    pairs = saved(pairs.select("u", "v").repartition(parts(pairs), "u", "v").distinct())
    loops = pairs.filter("u = v").select(F.array("u").alias("cycle"))
    pairs = pairs.filter("u <> v")
    n_parts = parts(pairs)
    closing = pairs.repartition(n_parts, "u", "v")
    paths = pairs.filter("u < v").select(F.array("u", "v").alias("path"))
    found = [loops]
    for n in range(2, max_length + 1):
        paths = saved(paths)
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        ends = paths.select("path", last.alias("_last"), first.alias("_first")).repartition(n_parts, "_last", "_first")
        found.append(ends.join(closing, (F.col("_last") == F.col("u")) & (F.col("_first") == F.col("v")), "left_semi").select(F.col("path").alias("cycle")))
        if n < max_length:  # only nodes above the first may follow, so each cycle is found at its smallest node
            paths = paths.join(pairs, last == F.col("u")).filter((F.col("v") > first) & ~F.expr("array_contains(path, v)")).select(F.concat("path", F.array("v")).alias("path"))
    return functools.reduce(DataFrame.unionByName, found).select("cycle", F.size("cycle").alias("length"))


def on_cycle(pairs: DataFrame) -> DataFrame:
    """(node) of all that reach themselves: repeatedly drop nodes without an edge in or out."""
    loops = pairs.filter("u = v").select(F.col("u").alias("node")).distinct()
    now = saved(pairs.select("u", "v").filter("u <> v").distinct())
    while True:
        kept = saved(now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
        if kept.count() == now.count():
            break
        now = kept
    ends = kept.select(F.col("u").alias("seed")).distinct()
    back = closure(kept, ends, include_start=False)
    # a node between two cycles survives the trimming, so each is asked whether a successor reaches it
    hit = back.join(kept.select(F.col("u").alias("node"), F.col("v").alias("seed")), ["seed", "node"], "left_semi").select("node")
    direct = kept.join(kept.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"], "left_semi").select(F.col("u").alias("node"))
    return loops.union(hit).union(direct).distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no edge's end.

    An outer join: the optimiser would repeat an anti-join for each table that nodes is a union of, with all ends each time. Both
    sides are cut by their size, so that a task's share of the ends doesn't grow with them."""
    n, lone = parts(nodes, edges), fresh(nodes)
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).filter("id is not null")
    ends = ends.repartition(n, "id").distinct().withColumn(lone, F.lit(True))
    return nodes.repartition(n, "id").join(ends, "id", "left").filter(F.col(lone).isNull()).select(*nodes.columns)


def hydrate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist, one of each key: the earliest, then the most confident."""
    ids = nodes.select("id").distinct()
    both = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    order = [F.col(c).asc_nulls_last() for c in ("created_at",) if c in edges.columns] + [F.col("confidence").desc_nulls_last()] * ("confidence" in edges.columns)
    w = Window.partitionBy(*EDGE_KEY).orderBy(*(order or [F.lit(1)]))
    nr = fresh(edges)
    return both.withColumn(nr, F.row_number().over(w)).filter(F.col(nr) == 1).select(*edges.columns)


def latest_type(edges: DataFrame) -> DataFrame:
    """One edge of each (source, target), the last written: the light graph of the lineage queries."""
    w = Window.partitionBy("source_id", "target_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("type").desc())
    nr = fresh(edges)
    return edges.withColumn(nr, F.row_number().over(w)).filter(F.col(nr) == 1).drop(nr)


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """(direction, edge_type, id, name, type) of a node's neighbours."""
    out = edges.filter(F.col("source_id") == node_id).select(F.lit("out").alias("direction"), F.col("type").alias("edge_type"), F.col("target_id").alias("id"))
    into = edges.filter(F.col("target_id") == node_id).select(F.lit("in").alias("direction"), F.col("type").alias("edge_type"), F.col("source_id").alias("id"))
    return out.unionByName(into).join(nodes.select("id", "name", "type"), "id").select("direction", "edge_type", "id", "name", "type")


def find_nodes(nodes: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """Nodes whose id (or name, ignoring case) contains pattern."""
    if not ignore_case:
        return nodes.filter(F.col("id").contains(pattern))
    return nodes.filter(F.lower("id").contains(pattern.lower()) | F.lower("name").contains(pattern.lower()))


def find_by_tokens(nodes: DataFrame, tokens: list[str]) -> DataFrame:
    return nodes.filter(F.arrays_overlap("tokens", F.array(*map(F.lit, tokens))))


def token_index(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("tokens").alias("token"), F.col("id").alias("node_id")).distinct()


def resolve(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, id) for asked(query): the exact id, else with colons for dots, with a known prefix, else the smallest id that
    ends with it, else the smallest that contains it."""
    prefixes = ["infra:output:", "infra:", "env:", "file://", "data:", "k8s:", "job:"]
    q = F.col("query")
    exact = F.array(q, F.regexp_replace(q, r"\.", ":"), *(F.concat(F.lit(p), q) for p in prefixes), *(F.concat(F.lit(p), F.regexp_replace(q, r"\.", ":")) for p in prefixes))
    tries = asked.select("query", F.posexplode(exact).alias("rank", "id"))
    direct = tries.join(nodes.select("id"), "id").groupBy("query").agg(F.min_by("id", "rank").alias("id"))
    rest = asked.join(direct, "query", "left_anti")
    # the patterns asked for come from a user; they are few, so the scan of nodes is joined with a broadcast of them
    like = nodes.select("id").join(small(saved(rest), 10_000), F.contains("id", "query")).groupBy("query").agg(F.min(F.struct((~F.endswith("id", "query")).alias("r"), "id")).alias("m")).select("query", "m.id")
    return direct.unionByName(like)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without ids(id) and the edges that touch them."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, key, value): totals, counts by type, orphans."""
    by_type = nodes.groupBy(F.lit("nodes_by_type").alias("metric"), F.col("type").alias("key")).agg(F.count("*").alias("value"))
    by_edge = edges.groupBy(F.lit("edges_by_type").alias("metric"), F.col("type").alias("key")).agg(F.count("*").alias("value"))
    none = F.lit(None).cast("string").alias("key")
    total = nodes.agg(F.count("*").alias("value")).select(F.lit("nodes").alias("metric"), none, "value")
    total_edges = by_edge.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(F.lit("edges").alias("metric"), none, "value")
    lone = orphans(nodes, edges).agg(F.count("*").alias("value")).select(F.lit("orphans").alias("metric"), none, "value")
    return by_type.unionByName(by_edge).unionByName(total).unionByName(total_edges).unionByName(lone)


def lineage_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(lineage_bucket("id").alias("bucket")).agg(F.count("*").alias("nodes"))


def stats_cube(nodes: DataFrame) -> DataFrame:
    """An extension: counts by type and repository with all subtotals."""
    return nodes.cube("type", "source_repo").agg(F.count("*").alias("nodes"), F.grouping_id().alias("level"))


def file_dependencies(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """(bucket, ids) of what the file's nodes depend on: consumes, provides or internal."""
    nodes, edges = known(nodes, NODES), known(edges, EDGES)
    own = nodes.filter((F.col("path") == path) | F.col("path").endswith("/" + path)).select(F.col("id").alias("source_id"))
    out = edges.join(own, "source_id").join(nodes.select(F.col("id").alias("target_id"), F.col("type").alias("kind")), "target_id")
    bucket = F.when(F.col("type").isin("provides", "provisions", "writes"), "provides").when(F.col("kind").isin("config_key", "data_asset", "env_var", "infra_resource", "secret"), "consumes").otherwise("internal")
    return out.groupBy(bucket.alias("bucket")).agg(F.array_sort(F.collect_set("target_id")).alias("ids"))


def search_artifacts(nodes: DataFrame, pattern: str, kind: str | None = None, n: int = 20) -> DataFrame:
    """The first n nodes by id whose id or name contains pattern, ignoring case, of one type if given: a top-n report."""
    got = find_nodes(nodes, pattern)
    return (got.filter(F.col("type") == kind) if kind else got).orderBy("id").limit(n)


def files_of(nodes: DataFrame) -> DataFrame:
    """(path) of all files that nodes come from."""
    return nodes.select("path").filter("path is not null").distinct()


def lint(nodes: DataFrame, edges: DataFrame, max_length: int = 5) -> DataFrame:
    """(issue, subject) of orphans and short cycles."""
    lone = orphans(nodes, edges).select(F.lit("orphan").alias("issue"), F.col("id").alias("subject"))
    loops = cycles(impact_edges(edges, "untyped", distinct=False), max_length).select(F.lit("cycle").alias("issue"), F.array_join("cycle", " > ").alias("subject"))
    return lone.unionByName(loops)


def impact_summary(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, upstream, downstream, total) counts by the lineage policy."""
    down = reach(impact_edges(edges, "lineage", distinct=False), seeds).withColumnRenamed("count", "downstream")
    up = reach(impact_edges(edges, "lineage", upstream=True, distinct=False), seeds).withColumnRenamed("count", "upstream")
    out = seeds.select("seed").distinct().join(up, "seed", "left").join(down, "seed", "left").fillna(0)
    return out.select("seed", "upstream", "downstream", (F.col("upstream") + F.col("downstream")).alias("total"))
