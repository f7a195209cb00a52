"""Lineage graphs against plain walks, and the number of passes on long chains."""

import random

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import lineage as L


@pytest.fixture
def passes(monkeypatch):
    """Counts the tables written: every pass writes one."""
    seen = []
    for name in ("cut", "cut_counted", "written"):
        real = getattr(L, name)
        monkeypatch.setattr(L, name, lambda *a, real=real: (seen.append(1), real(*a))[1])
    return seen


def ways(edges, goals):
    """Node to (steps, path, goal): shortest way to a goal, smallest edge ids first."""
    out = {g: (0, [], g) for g in goals}
    own = {}
    for a, b, e in edges:
        if a != b and e < own.get((a, b), "~"):
            own[a, b] = e
    for steps in range(1, len(own) + 2):
        new = {}
        for (a, b), e in own.items():
            if a not in out and b in out and out[b][0] == steps - 1:
                way = (steps, [e, *out[b][1]], out[b][2])
                new[a] = min(new.get(a, way), way)
        if not new:
            return out
        out.update(new)
    return out


def graphs():
    for seed in (3,):
        rng = random.Random(seed)
        nodes = [f"n{k:02d}" for k in range(60)]
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(25 * (seed + 1))]
        edges += [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(20)] + [("c20", "n00"), ("n05", "c07"), ("n05", "c07")]  # a chain into the graph
        edges += [(f"r{k}", f"r{(k + 1) % 5}") for k in range(5)] + [("s0", "s1"), ("s1", "s0"), ("n03", "s0"), ("t", "t")]  # rounds without a way out
        goals = [*rng.sample(nodes, 3), "c10", "alone"]
        yield [(a, b, f"e{rng.randrange(900):03d}-{k}") for k, (a, b) in enumerate(edges)], goals


def test_nearest_against_plain_search(spark):
    for edges, goals in graphs():
        got = L.nearest(spark.createDataFrame([("x", g) for g in goals] + [("x", goals[0]), ("y", "n00")], "scope string, node string"),
                        spark.createDataFrame(edges, "src string, dst string, edge_id string")).collect()
        for scope, own in (("x", goals), ("y", ["n00"])):
            assert {r["node"]: (r["steps"], r["path"], r["goal"]) for r in got if r["scope"] == scope} == ways(edges, own)
        assert len(got) == len({(r["scope"], r["node"]) for r in got})


def test_origins_on_chains_and_rounds(spark):
    for edges, goals in graphs():
        df = spark.createDataFrame([(e, a, b, "cites", "direct", b, True, True) for a, b, e in edges],
                                   "relation_id string, from_version string, to_version string, kind string, status string, to_url_key string, quotes_from boolean, quotes_to boolean")
        nodes = sorted({n for e in edges for n in e[:2]} | {"lost"})
        targets = spark.createDataFrame([(n,) for n in nodes], "source_version_id string")
        origins = spark.createDataFrame([(g, "original_record") for g in goals], "version_id string, material_kind string")
        got = {r["source_version_id"]: r["has_origin"] for r in L.origin_reached(targets, df, origins).collect()}
        assert got == {n: n in ways(edges, goals) for n in nodes}
        cited = df.select("from_version", "to_version")
        found = L.located_origins(targets, df, origins, spark.createDataFrame([], "version_id string, link_key string"), cited)
        want = {(n, g, "original_record") for g in goals for n in nodes if n in ways(edges, [g])}
        rows = sorted(map(tuple, found.select("source_version_id", "version_id", "material_kind").collect()))
        assert rows == sorted(want)


def test_cascade_against_plain_search(spark):
    for edges, goals in graphs():
        starts = [("x", goals[0]), ("y", "c00"), ("y", "n05")]
        visited, log = L.revisit_cascade(spark.createDataFrame([e[:2] for e in edges], "from_version string, to_version string"),
                                         spark.createDataFrame(starts, "scope string, version_id string"))
        want, repeats = set(), {}
        for scope in ("x", "y"):
            level, depth, seen = [n for s, n in starts if s == scope], 0, set()
            seen |= set(level)
            want |= {(scope, n, 0) for n in level}
            while level:
                depth += 1
                asked = [b for n in level for a, b, _ in edges if a == n]
                level = sorted(set(asked) - seen)
                for n in set(asked):
                    again = asked.count(n) - (n in level)
                    if again:
                        repeats[scope, n, depth] = again
                seen |= set(level)
                want |= {(scope, n, depth) for n in level}
        assert set(map(tuple, visited.collect())) == want
        assert {(r["scope"], r["node"], r["depth"]): r["repeats"] for r in log.collect()} == repeats


def test_tree_with_rounds_and_gaps(spark):
    rows = [("s", "a", None), ("s", "b", "a"), ("s", "c", "b"), ("s", "d", "c"), ("s", "e", "gone"), ("s", "f", "e"), ("s", "x", "y"), ("s", "y", "x"), ("t", "b", None),
            ("t", "a", "b")]
    got = {(r["scope"], r["id"]): (r["depth"], r["path"]) for r in L.flatten_tree(spark.createDataFrame(rows, "scope string, id string, parent_id string")).collect()}
    assert got == {("s", "a"): (0, "a"), ("s", "b"): (1, "a/b"), ("s", "c"): (2, "a/b/c"), ("s", "d"): (3, "a/b/c/d"), ("t", "b"): (0, "b"), ("t", "a"): (1, "b/a")}


def test_long_chains_take_few_passes(spark, passes):
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    goals = spark.createDataFrame([(0, n)], "scope int, node long")
    # ids would make every way a list of up to 100,000 edges: without them only steps are kept
    found = L.nearest(goals, edges).select("node", "steps").agg(F.count("*"), F.max("steps"), F.sum("steps")).first()
    assert tuple(found) == (n + 1, n, n * (n + 1) // 2) and len(passes) <= 40
    del passes[:]
    visited, log = L.revisit_cascade(edges.toDF("from_version", "to_version"), spark.createDataFrame([("x", 0)], "scope string, version_id long"))
    assert visited.agg(F.max("depth")).first()[0] == n and log.isEmpty() and len(passes) <= 40
    del passes[:]
    deep = spark.range(2_000).select(F.lit(0).alias("scope"), F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    assert L.flatten_tree(deep).agg(F.max("depth")).first()[0] == 1_999 and len(passes) <= 14


def test_hub_of_a_star(spark, passes):
    """A goal that all others point at, and a chain node that all others point at."""
    edges = spark.range(50_000).select(F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst")).unionByName(
        spark.createDataFrame([(-1, -2), (-2, -3), (-2, -4)], "src long, dst long"))
    got = L.nearest(spark.createDataFrame([(0, -3)], "scope int, node long"), edges)
    assert got.groupBy("steps").count().orderBy("steps").collect()[-1]["count"] == 50_000 and len(passes) < 15


def test_closed_rounds_carry_no_growing_paths(spark, monkeypatch):
    """Pointers on closed rounds, and those that lead into one, stop joining edge ids; chains beside them still arrive."""
    longest, real = [0], L.written
    def watched(df):
        out = real(df)
        if "path" in out.columns:
            longest[0] = max(longest[0], out.agg(F.max(F.size("path"))).first()[0] or 0)
        return out
    monkeypatch.setattr(L, "written", watched)
    pairs = [(f"a{k}", f"b{k}") for k in range(500)] + [(f"b{k}", f"a{k}") for k in range(500)] + [("in", "a7"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0")]
    chain = [(f"c{k}", f"c{k + 1}") for k in range(40)]
    edges = spark.createDataFrame([(a, b, f"{a}>{b}") for a, b in pairs + chain], "src string, dst string, edge_id string")
    out = L.chains(edges, spark.createDataFrame([("c40",)], "node string"))
    rows = {r["node"]: r for r in out.collect()}
    assert len(rows) == len(pairs) + 40 and longest[0] <= 64
    assert all(rows[a]["end"] is None and rows[a]["path"] is None for a, _ in pairs)
    assert all(rows[f"c{k}"]["end"] == "c40" and rows[f"c{k}"]["path"] == [f"c{j}>c{j + 1}" for j in range(k, 40)] for k in range(40))
