import itertools
import random

from pyspark.sql import functions as F

from rillgraph.operators import graph as G

E = "source_id string, target_id string, type string"


def edges(spark, rows):
    return spark.createDataFrame(rows, E)


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed string")


def test_mixed_directions(spark):
    """infra provides a variable that a file reads: both are impacted, and the file's upstream is both."""
    e = edges(spark, [("infra:output:db_host", "env:DB_HOST", "provides"), ("file://src/app.py", "env:DB_HOST", "reads")])
    assert {x.node for x in G.impacted(e, seeds(spark, "infra:output:db_host")).collect()} == {"env:DB_HOST", "file://src/app.py"}
    assert {x.node for x in G.upstream(e, seeds(spark, "file://src/app.py")).collect()} == {"env:DB_HOST", "infra:output:db_host"}


def test_depths_and_cycles(spark):
    e = edges(spark, [(a, b, "provides") for a, b in ("ab", "bc", "ca", "cd", "ad")])
    got = {(x.node, x.depth) for x in G.descendants(e, seeds(spark, "a")).collect()}
    assert got == {("b", 1), ("d", 1), ("c", 2)}
    assert G.descendants(e, seeds(spark, "a"), max_depth=0).count() == 0
    assert {x.node for x in G.descendants(e, seeds(spark, "a"), max_depth=1).collect()} == {"b", "d"}


def test_upstream_is_the_inverse(spark):
    e = edges(spark, [(f"n{i}", f"n{i * 7 % 40}", ["provides", "reads", "calls", "imports"][i % 4]) for i in range(40)])
    every = seeds(spark, *(f"n{i}" for i in range(40)))
    down = {(x.seed, x.node) for x in G.impacted(e, every, "lineage").collect()}
    up = {(x.node, x.seed) for x in G.upstream(e, every).collect()}
    assert down == up and down


def test_paths(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "a"), ("b", "c")], "u string, v string")
    assert {"".join(x.path) for x in G.simple_paths(p, seeds(spark, "a"), "d").collect()} == {"abd", "acd", "abcd"}
    assert ["".join(x.path) for x in G.shortest_paths(p, seeds(spark, "a"), "d").collect()] == ["abd"]
    assert {("".join(x.cycle), x.length) for x in G.cycles(p).collect()} == {("abd", 3), ("acd", 3), ("abcd", 4)}
    assert {x.node for x in G.on_cycle(p).collect()} == set("abcd")


def test_node_between_cycles_is_on_none(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c"), ("s", "s")], "u string, v string")
    assert {x.node for x in G.on_cycle(p).collect()} == set("abcds")


def test_hydrate_first_wins_and_drops_danglers(spark):
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b", "reads", 0.5), ("a", "b", "reads", 0.9), ("a", "x", "reads", 1.0), ("b", "a", "calls", None)], E + ", confidence double")
    assert {(x.source_id, x.type, x.confidence) for x in G.hydrate(n, e).collect()} == {("a", "reads", 0.9), ("b", "calls", None)}


def test_resolve(spark):
    n = spark.createDataFrame([("env:A", ), ("infra:output:db", ), ("file://x/app.py", ), ("file://y/app.pyc", )], "id string")
    asked = spark.createDataFrame([("env:A",), ("A",), ("db",), ("app.py",), ("none",)], "query string")
    assert {x.query: x.id for x in G.resolve(n, asked).collect()} == {"env:A": "env:A", "A": "env:A", "db": "infra:output:db", "app.py": "file://x/app.py"}


def test_nulls_and_no_rows(spark):
    e = edges(spark, [(None, "a", "reads"), ("a", None, "reads"), ("a", "b", None)])
    assert G.impacted(e, seeds(spark, "a", None)).count() == 0
    assert {x.node for x in G.descendants(e, seeds(spark, "a", None)).collect()} == {"b"}
    assert G.descendants(edges(spark, []), seeds(spark)).count() == 0


def test_edges_are_shuffled_once(spark):
    """A level's plan reads the kept edges as they lie, also where the frontier is shuffled to them."""
    pairs = G.kept(spark.range(1000).selectExpr("cast(id % 100 as string) u", "cast(id as string) v"))
    frontier = spark.range(500).selectExpr("cast(id as string) seed", "cast(id as string) node", "0 depth")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = G.next_level(frontier, pairs, frontier, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
        pairs.unpersist()
    above = plan.split("InMemoryTableScan")[0].splitlines()
    side = next(k for k in range(len(above) - 1, -1, -1) if "Join" in above[k])
    assert not any("Exchange" in x for x in above[side + 1 :] if "u#" in x), plan
    inner = plan.split("InMemoryRelation")[1]
    assert inner.count("Exchange hashpartitioning(u") == 1 and inner.count("Exchange") == 1, plan


def test_closure_of_a_long_chain_and_many_seeds(spark):
    n = 30
    e = edges(spark, [(f"n{i}", f"n{i + 1}", "provides") for i in range(n)] + [("n0", "n1", "provides"), (f"n{n}", "n5", "provides")])
    got = {(x.seed, x.node): x.depth for x in G.descendants(e, seeds(spark, "n0", "n5", "n0")).collect()}
    assert got == {("n0", f"n{i}"): i for i in range(1, n + 1)} | {("n5", f"n{i}"): i - 5 for i in range(6, n + 1)}


def test_shortest_paths_end_at_the_target(spark):
    p = spark.createDataFrame([("t", "a"), ("a", "t"), ("b", "a"), ("c", "b"), ("c", "a2"), ("a2", "t"), ("x", "y")], "u string, v string")
    got = {x.seed: ">".join(x.path) for x in G.shortest_paths(p, seeds(spark, "t", "a", "b", "c", "x", None), "t").collect()}
    assert got == {"t": "t", "a": "a>t", "b": "b>a>t", "c": "c>a2>t"}


def test_saved_tables_can_be_swept(spark):
    from rillgraph import shared

    folder = shared.fresh_folder(spark, "x")
    shared.saved(spark.range(3))
    n = len(shared._MADE)
    kept, shared._MADE[:] = shared._MADE[:-2], shared._MADE[-2:]
    assert shared.sweep(spark) == 2 and n >= 2 and folder not in shared._MADE
    shared._MADE[:] = kept


def test_reach_of_many_seeds_has_no_row_for_each_seed(spark, monkeypatch):
    """As many rows as nodes, twice at most, where 60 seeds reach 60 nodes each; seeds that only reach themselves aren't reached."""
    rows, write = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df: (out := write(df), rows.append(out.count()))[0])
    e = edges(spark, [(f"s{i}", "hub", "reads") for i in range(60)] + [("hub", f"n{i}", "reads") for i in range(60)] + [("n0", "s0", "reads"), ("x", "y", "reads"), ("y", "x", "reads")])
    got = {x.node for x in G.blast_artifacts(e, seeds(spark, "x", None, *(f"s{i}" for i in range(60)))).collect()}
    assert got == {"hub", "s0", "y", *(f"n{i}" for i in range(60))}
    assert sum(rows) < 4 * 130


def test_reached_is_the_closures_nodes(spark):
    for case in (1, 2):
        e = edges(spark, [(f"n{i * (case + 3) % 17}", f"n{(i * i + case) % 17}", "reads") for i in range(12)])
        some = seeds(spark, *(f"n{i}" for i in range(case % 3 + 1)))
        pairs = G.impact_edges(e, "untyped")
        assert {x.node for x in G.reached(pairs, some).collect()} == {x.node for x in G.closure(pairs, some).collect()}


def test_levels_have_a_row_for_a_block_of_seeds(spark, monkeypatch):
    """70 seeds that reach a hub and 40 nodes behind it: two words of bits for each node, not 70 rows."""
    rows, write = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df: (out := write(df), rows.append(out.count()))[0])
    e = edges(spark, [(f"s{i}", "hub", "reads") for i in range(70)] + [("hub", f"n{i}", "reads") for i in range(40)] + [("n0", "s63", "reads")])
    every = seeds(spark, *(f"s{i}" for i in range(70)))
    depths = {"hub": 1, "s63": 3} | {f"n{i}": 2 for i in range(40)}
    got = {(x.seed, x.node, x.depth) for x in G.descendants(e, every).collect()}
    assert got == {(f"s{i}", n, d) for i in range(70) for n, d in depths.items() if n != f"s{i}"}
    assert sum(rows) < 400
    assert {x.seed: x["count"] for x in G.reach(G.impact_edges(e, "untyped"), every).collect()} == {f"s{i}": 42 - (i == 63) for i in range(70)}


def test_orphans_of_a_union_read_the_edges_once(spark):
    """An anti-join would be repeated for each table of the union, all ends each time."""
    some = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id string, type string")
    n = some("a", "b").unionByName(some("c", "c")).unionByName(some("d", None))
    e = edges(spark, [("a", "b", "reads"), (None, "d", "reads"), ("d", "d", "calls")])
    lone = G.orphans(n, e)
    assert lone._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted(str(x.id) for x in lone.collect()) == ["None", "c", "c"] and lone.columns == ["id", "type"]
    got = {(x.metric, x.key): x.value for x in G.stats(n, e).collect()}
    assert got == {("nodes_by_type", "x"): 6, ("edges_by_type", "reads"): 2, ("edges_by_type", "calls"): 1, ("nodes", None): 6, ("edges", None): 3, ("orphans", None): 3}


def test_large_tables_have_more_partitions(spark):
    """A task's share of the ends of edges doesn't grow with the tables."""
    big = spark.range(10**7)
    n = big.select(F.col("id").cast("string").alias("id"))
    e = big.select(F.col("id").cast("string").alias("source_id"), F.col("id").cast("string").alias("target_id"), F.lit("reads").alias("type"))
    from rillgraph.shared import parts

    assert parts(edges(spark, [("a", "b", "reads")])) == 4 < parts(n) < parts(n, e) <= 400
    plan = G.orphans(n, e)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {parts(n, e)}") == 2, plan


def test_lint_makes_edges_distinct_once(spark, monkeypatch):
    """The edges are shuffled once to make them distinct, and cut by their size where cycles are closed."""
    plans, write = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df))[1])
    e = edges(spark, [("a", "b", "reads"), ("a", "b", "calls"), ("b", "c", "reads"), ("c", "a", "reads"), ("c", "b", "reads"), (None, "a", "reads")])
    n = spark.createDataFrame([("a",), ("z",)], "id string")
    assert sorted((x.issue, x.subject) for x in G.lint(n, e).collect()) == [("cycle", "a > b > c"), ("cycle", "b > c"), ("orphan", "z")]
    assert plans[0].count("Aggregate [") == 1 and "RepartitionByExpression" in plans[0], plans[0]


def test_shortest_paths_have_a_row_for_a_node(spark, monkeypatch):
    """40 seeds that share a chain of 10 nodes: a row for each node, not one for each seed and node."""
    rows, write = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df: (out := write(df), rows.append(out.count()))[0])
    p = spark.createDataFrame([(f"s{i}", "c0") for i in range(40)] + [(f"c{i}", f"c{i + 1}") for i in range(9)], "u string, v string")
    got = {x.seed: x.path for x in G.shortest_paths(p, seeds(spark, *(f"s{i}" for i in range(40))), "c9").collect()}
    assert got == {f"s{i}": [f"s{i}", *(f"c{k}" for k in range(10))] for i in range(40)}
    assert sum(rows) < 3 * 50


def test_ties_of_shortest_paths_go_to_the_smallest_parent(spark):
    """Against all shortest paths: of those the least, read from the target."""
    names = [f"n{i}" for i in range(14)]
    draw = random.Random(4)
    pairs = sorted({(draw.choice(names), draw.choice(names)) for _ in range(40)})
    after = {u: [v for _, v in g] for u, g in itertools.groupby(pairs, lambda x: x[0])}
    tied = 0
    for most in (15, 2):
        want = {}
        for s in names:
            paths = [[s]]
            while paths and s not in want and len(paths[0]) <= most + 1:
                if done := [x[::-1] for x in paths if x[-1] == "n3"]:
                    want[s], tied = min(done)[::-1], tied + (len(done) > 1)
                paths = [[*x, v] for x in paths for v in after.get(x[-1], []) if v not in x]
        got = {x.seed: x.path for x in G.shortest_paths(spark.createDataFrame(pairs, "u string, v string"), seeds(spark, *names, None, "n1"), "n3", most).collect()}
        assert got == want and len(want) > 3 and tied
