"""The layered search against hand-made graphs, fixed counts and definitional brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from girthline.operators import accept, expand
from girthline.operators.cycles import Cycles
from girthline.plans.bounds import Search, bounds_by_size
from girthline.plans.enumerate import Enumeration, enumerate_sets
from girthline.sources import codes, scratch
from girthline.sources.graph import Tanner, from_edges

TOYS = {
    "pair": ([(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (3, 1)], 4, {(2, 2): 1}, 2, 1),
    "full_pair": ([(c, v) for c in range(3) for v in range(2)], 4, {(2, 0): 1}, 6, 5),
    "dot": ([(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 2), (3, 1), (3, 2)], 4, {(2, 2): 1, (3, 0): 1}, 5, 3),
    "path": ([(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 2), (3, 2), (3, 3), (4, 1), (4, 3)], 4, {(2, 2): 1, (4, 0): 1}, 6, 4),
    "lollipop1": ([(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 2), (3, 2), (3, 3), (4, 2), (4, 3)], 4, {(2, 1): 2, (4, 0): 1}, 6, 3),
    "lollipop2": ([(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 4), (5, 2), (5, 4), (3, 2), (3, 3), (4, 2), (4, 3)], 5, {(2, 1): 2, (5, 0): 1}, 6, 3),
}


def graph(spark, edges):
    return from_edges(spark.createDataFrame(edges, "c int, v int").coalesce(1))


def classes(result):
    return {(r["a"], r["b"]): r["n"] for r in result.counts.collect()}


def identity(stats):
    return stats["generated_candidates"] == sum(stats[k] for k in ("duplicate_candidates", "rejected_non_elementary", "rejected_by_b", "accepted_intermediate"))


@pytest.mark.parametrize("name", TOYS)
def test_toys(spark, name):
    edges, amax, want, generated, duplicates = TOYS[name]
    r = enumerate_sets(graph(spark, edges), 4, amax, [2] * (amax + 1))
    assert classes(r) == want
    assert (r.stats["generated_candidates"], r.stats["duplicate_candidates"]) == (generated, duplicates)
    assert identity(r.stats) and r.written_supports == sum(want.values())
    assert r.dense_counts().sum() == sum(want.values()) and r.dense_counts().shape == (3, amax + 1)


def test_triangle_and_leaf(spark):
    r = enumerate_sets(graph(spark, [(0, 0), (0, 1), (1, 1), (1, 2), (2, 0), (2, 2)]), 6, 3, [2] * 4)
    assert classes(r) == {(3, 0): 1} and r.stats["generated_candidates"] == 1
    leaf = graph(spark, [*TOYS["pair"][0], (2, 4), (4, 4)])
    assert classes(enumerate_sets(leaf, 4, 3, [2] * 4)) == {(2, 2): 1}
    got = enumerate_sets(leaf, 4, 3, [2] * 4, leaves=True).supports.where("kind = 'leafy'").collect()
    assert [(r["a"], r["b"], r["vs"]) for r in got] == [(3, 2, [0, 1, 4])]


def brute(edges, amax, bound):
    """Connected elementary sets whose every variable has two even checks."""
    near = {}
    for c, v in edges:
        near.setdefault(v, set()).add(c)
    out = {}
    for a in range(2, amax + 1):
        for s in itertools.combinations(sorted(near), a):
            degree = {}
            for v in s:
                for c in near[v]:
                    degree[c] = degree.get(c, 0) + 1
            if max(degree.values()) > 2 or any(sum(degree[c] == 2 for c in near[v]) < 2 for v in s):
                continue
            seen, todo = {s[0]}, [s[0]]
            while todo:
                v = todo.pop()
                new = {w for w in s if w not in seen and near[v] & near[w]}
                seen |= new
                todo += new
            b = sum(d == 1 for d in degree.values())
            if len(seen) == a and b <= bound:
                out[s] = (a, b)
    return out


def test_random_graph_is_complete(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(10), v) for v in range(12) for _ in range(rng.randint(1, 4))})
    degrees = sorted({sum(v == w for _, w in edges) for v in range(12)})
    r = enumerate_sets(graph(spark, edges), 4, 4, bounds_by_size(4, 4, degrees, 4), degrees)
    got = {tuple(x["vs"]): (x["a"], x["b"]) for x in r.supports.collect()}
    assert got == {s: k for s, k in brute(edges, 4, 4).items()}
    assert identity(r.stats)
    both = enumerate_sets(graph(spark, edges), 4, 3, bounds_by_size(3, 3, degrees, 4), degrees, leaves=True, singletons=True)
    assert identity(both.stats)
    assert {k: v for k, v in got.items() if v[0] <= 3 and v[1] <= 3} == {tuple(x["vs"]): (x["a"], x["b"]) for x in both.supports.where("kind = 'leafless'").collect()}


def test_bicycle_code_with_leaves(spark):
    r = enumerate_sets(codes.preset(spark, "72")[0].hz, 6, 4, [0, 0, 0, 3, 4], [3], leaves=True, singletons=True)
    assert classes(r) == {(1, 3): 72, (2, 4): 540, (3, 3): 72, (4, 4): 3024}
    s = r.stats
    assert (s["generated_candidates"], s["duplicate_candidates"], s["rejected_non_elementary"], s["accepted_intermediate"]) == (4176, 540, 0, 3636)
    assert r.layer_stats(spark).where("stage = 'leafless'").count() == 2


def test_relabelling(spark):
    edges = TOYS["path"][0]
    new = graph(spark, [(4 - c, 10 + 3 * v) for c, v in edges])
    want = {tuple(10 + 3 * v for v in x["vs"]) for x in enumerate_sets(graph(spark, edges), 4, 4, [2] * 5).supports.collect()}
    assert {tuple(x["vs"]) for x in enumerate_sets(new, 4, 4, [2] * 5).supports.collect()} == want


def test_repeated_edges_count(spark):
    g = Tanner(spark.createDataFrame([(0, 0), (0, 0)], "c int, v int"), 1, 1)
    sets = spark.createDataFrame([([0],)], "vs array<int>")
    assert accept.induced_stats(sets, g.edges).first()["b"] == 0
    x = accept.measured(sets.crossJoin(g.neighbours().select(F.col("cs").alias("checks")))).first()
    assert (x["b"], x["elementary"], x["even"]) == (0, True, [0]) and g.repeated_edges().count() == 1


def test_pairs_with_repeated_edges(spark):
    """Raw pair cycles by walking edges: s to a check, to v, by another edge to another check that s touches."""
    edges = [(0, 0), (0, 0), (0, 1), (1, 0), (1, 1), (1, 1), (2, 1), (2, 0), (2, 2), (0, 2)]
    g = Tanner(spark.createDataFrame(edges, "c int, v int"), 3, 3)
    want = {}
    for s in range(3):
        for v in range(s + 1, 3):
            raw = sum(c2 != c1 and (c2, s) in edges for c1, a in edges if a == s for c, b in edges if c == c1 and b == v for c2, d in edges if d == v)
            if raw:
                want[s, v] = raw
    got = {tuple(r["vs"]): r["raw"] for r in accept.merged(expand.cycles(Cycles(g.neighbours()), 2)).collect()}
    assert got == want


def test_bounds():
    assert bounds_by_size(4, 4, [3], 6) == [0, 0, 0, 3, 4]
    assert bounds_by_size(3, 3, [2, 3], 4) == [0, 0, 2, 3]
    assert bounds_by_size(5, 5, range(1, 8), 4) == [0, 0, 10, 12, 9, 5]
    for bad in ((4, 4, [3], 4), (2, 2, [9], 4)):
        with pytest.raises(ValueError):
            bounds_by_size(*bad)


@pytest.mark.parametrize("bad", [(3, 3, (0,) * 4), (0, 3, (0,) * 4), (4, 33, (0,) * 34), (8, 3, (0,) * 4), (4, 3, (0,) * 3), (4, 3, (0, 0, 70000, 0)), (4, 3, (0,) * 4, (0,)), (4, 3, (0,) * 4, (256,))])
def test_validation(bad):
    with pytest.raises(ValueError):
        Search(*bad)


def test_empty_cycles(spark):
    g = graph(spark, [(0, 0), (1, 1)])
    assert expand.cycles(Cycles(g.neighbours()), 2).isEmpty()
    assert classes(enumerate_sets(g, 4, 2, [2, 2, 2])) == {}


def test_adjacency_is_not_shuffled_again(spark, monkeypatch):
    """The plans of a layer read the adjacency in buckets of the check that they join on."""
    monkeypatch.setattr(scratch, "BUCKET_ROWS", 20)
    rng = random.Random(7)
    g = graph(spark, sorted({(rng.randrange(30), v) for v in range(60) for _ in range(4)}))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = Enumeration(g, Search(4, 4, (0, 0, 6, 6, 6)))
        parents = e.layer(2).where("b >= 2")
        for op in (expand.dot(parents, e.adjacency), expand.path(parents, e.adjacency, 2), expand.stems(expand.numbered(parents), e.adjacency, 1)):
            op.collect()
            plan = op._jdf.queryExecution().executedPlan().toString()
            # On the way from a scan of the buckets up to the join on the check there is no exchange.
            lines, found = plan.split("\n"), []
            depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
            for i, line in enumerate(lines):
                if "Bucketed: true" in line:
                    at, way = depth(line), []
                    for x in reversed(lines[:i]):
                        if depth(x) < at:
                            at = depth(x)
                            way.append(x)
                    join = next((k for k, x in enumerate(way) if "Join" in x), None)
                    if join is not None:
                        found.append(("pair#" in way[join], any("Exchange" in x for x in way[:join])))
            assert (False, False) in found and (False, True) not in found, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_layers_in_parts(spark, monkeypatch):
    """Sets and leaves that are dealt out give the same sets and counts, and only accepted sets are kept."""
    from girthline.plans import enumerate as module

    rng = random.Random(5)
    g = graph(spark, sorted({(rng.randrange(30), v) for v in range(60) for _ in range(rng.randint(1, 4))}))
    run = lambda: enumerate_sets(g, 4, 4, [0, 0, 5, 3, 3], leaves=True, singletons=True)
    sets = lambda r: sorted((x["a"], x["b"], x["kind"], tuple(x["vs"])) for x in r.supports.collect())
    kept, in_rounds = {}, module.in_rounds
    with monkeypatch.context() as m:
        m.setattr(module, "in_rounds", lambda parts, label: kept.setdefault(label, in_rounds(parts, label)))
        whole = run()
    row = {(r["stage"], r["a"]): r for r in whole.layers}
    assert kept["leafless3"].count() == row["leafless", 3]["accepted"] < row["leafless", 3]["unique"]
    monkeypatch.setattr(module, "SETS_AT_ONCE", 7)
    monkeypatch.setattr(module, "LEAVES_AT_ONCE", 50)
    parts = run()
    assert parts.stats == whole.stats and parts.layers == whole.layers and sets(parts) == sets(whole) and identity(whole.stats)
