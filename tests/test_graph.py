"""Components, subtrees, paths and bindings against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stratalens.operators import components, graph, units

EVENTS = "id string, parent string"


def test_a_long_chain_is_whole_and_rounds_are_few(spark, monkeypatch):
    rows = [(f"e{k}", f"e{k - 1}" if k else None) for k in range(1000)] + [("x", "nowhere"), ("y", "x")]
    made = []
    written = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="table": made.append(name) or written(df, name))
    got = graph.subtree(spark.createDataFrame(rows, EVENTS), spark.createDataFrame([("e0",), ("e990",), ("y",), ("lone",)], "id string"))
    want = {("e0", f"e{k}", k) for k in range(1000)} | {("e990", f"e{k}", k - 990) for k in range(990, 1000)} | {("y", "y", 0), ("lone", "lone", 0)}
    assert {(r.root, r.id, r.depth) for r in got.collect()} == want
    assert made.count("pointers") <= 12


def test_circles_fail_loudly(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "r"), ("r", None)]
    with pytest.raises(ValueError, match="circles"):
        graph.subtree(spark.createDataFrame(rows, EVENTS), spark.createDataFrame([("r",)], "id string"))
    got = graph.subtree(spark.createDataFrame(rows, EVENTS), spark.createDataFrame([("r",), ("a",)], "id string"))  # a circle below a root has an end
    assert {(r.root, r.id, r.depth) for r in got.collect()} == {("r", "r", 0), ("r", "d", 1), ("a", "a", 0), ("a", "c", 1), ("a", "b", 2)}


def test_paths_from_both_ends(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(34)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def shortest(a, z, most=6):
        level = [(a,)]
        for _ in range(most + 1):
            done = sorted(p for p in level if p[-1] == z)
            if done:
                return list(done[0])
            level = [(*p, x) for p in level for x in near.get(p[-1], ()) if x not in p]
        return None

    nodes = sorted(near) + ["away"]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(40)]
    got = graph.shortest_paths(spark.createDataFrame([(*e, "T") for e in edges], "src string, dst string, type string"), spark.createDataFrame(pairs, "start string, end string"))
    want = {p: shortest(*p) for p in set(pairs)}
    assert {(r.start, r.end): r.path for r in got.collect()} == {p: x for p, x in want.items() if x}
    assert any(len(x or ()) > 4 for x in want.values())


def test_a_hub_and_shrinking_edges(spark, monkeypatch):
    sizes = []
    written = components.written
    monkeypatch.setattr(components, "written", lambda df, name="table": (lambda t: sizes.append(t.count()) or t)(written(df, name)))
    hub = spark.range(1, 200_000).select(F.lit(7).cast("bigint").alias("src"), F.col("id").alias("dst"))
    path = spark.range(300_000, 300_200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    twice = path.select("dst", "src")
    got = components.connected_components(hub.union(path).union(twice)).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert {(r.component, r.n) for r in got} == {(1, 199_999), (300_000, 201)}
    assert sizes == sorted(sizes, reverse=True) and len(sizes) <= 24


def test_bound_through_the_first_hunk(spark):
    rng = random.Random(8)
    rows = [("c", f"f{rng.randrange(6)}", k, [f"s{rng.randrange(9)}" for _ in range(rng.randint(0, 2))], {f"d{rng.randrange(4)}": 1} if rng.random() < 0.4 else {}) for k in range(40)]
    calls = [("f0", "f1"), ("f2", "f2"), ("f5", "f3")]
    features = spark.createDataFrame(rows, "sha string, file string, idx int, symbols array<string>, bind map<string,int>")
    links = units.bind_edges(features, spark.createDataFrame(calls, "caller_file string, callee_file string")).collect()
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    parents = [list(range(41)), list(range(41))]

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(40):
        for b in range(a + 1, 40):
            x, y = order[a], order[b]
            called = x[1] != y[1] and ((x[1], y[1]) in calls or (y[1], x[1]) in calls)
            if set(x[3]) & set(y[3]) or set(x[4]) & set(y[4]) or called:
                parents[0][find(parents[0], b + 1)] = find(parents[0], a + 1)
    for r in links:
        assert r.a < r.b
        parents[1][find(parents[1], r.b)] = find(parents[1], r.a)
    together = lambda p: {(a, b) for a in range(1, 41) for b in range(1, 41) if find(p, a) == find(p, b)}
    assert together(parents[0]) == together(parents[1]) and len(links) < 40 * 39 // 4
