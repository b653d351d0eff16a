"""Cycles by half paths against plain walks, and on graphs with a node that very many others share."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from girthline.operators import accept
from girthline.operators import cycles as module
from girthline.operators.cycles import Cycles
from girthline.sources import codes
from girthline.sources.graph import Tanner, from_edges


def walked(edges, k):
    """Cycles by walking edges from the smallest variable; the step back to it counts once, whatever its copies."""
    at_v, at_c = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in edges:
        at_v[v].append(c)
        at_c[c].append(v)
    found = collections.Counter()

    def walk(vs, cs):
        for c in at_v[vs[-1]]:
            if c in cs:
                continue
            if len(vs) == k:
                if vs[0] in at_c[c] and (k < 3 or vs[1] < vs[-1]):
                    found[tuple(sorted(vs))] += 1
                continue
            for v in at_c[c]:
                if v > vs[0] and v not in vs:
                    walk([*vs, v], [*cs, c])

    for v in list(at_v):
        walk([v], [])
    return dict(found)


def counted(spark, edges, k):
    g = Tanner(spark.createDataFrame(edges, "c int, v int"), 100, 100)
    return {tuple(r["vs"]): r["n"] for r in Cycles(g.neighbours()).counted(k).collect()}


@pytest.mark.parametrize("copies", [0, 8])
def test_cycles(spark, copies):
    rng = random.Random(copies)
    edges = sorted({(rng.randrange(9), rng.randrange(11)) for _ in range(38)})
    edges += rng.choices(edges, k=copies)
    for k in (2, 3, 4, 5):
        want = walked(edges, k)
        assert want and counted(spark, edges, k) == want


def test_no_cycles(spark):
    assert counted(spark, [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)], 2) == {} == counted(spark, [(0, 0), (0, 0)], 2)
    assert counted(spark, [(0, 5), (0, 6), (1, 6), (1, 7), (2, 7), (2, 5)], 2) == {}


@pytest.mark.parametrize("hub", ["check", "variable"])
def test_a_node_shared_by_20000(spark, hub, monkeypatch):
    """Wedges grow with the edges, not with the square of a degree, and no task has many more of them than others."""
    monkeypatch.setattr(module, "HEAVY", 200)
    rng, n = random.Random(1), 20_000
    pairs = [(0, i) for i in range(n)] + [(1 + rng.randrange(6000), i) for i in range(n)]
    df = spark.createDataFrame(pairs if hub == "check" else [(v, c) for c, v in pairs], "c int, v int")
    found = Cycles(Tanner(df, n, n).neighbours())
    assert found.half(2).count() <= 2 * len(pairs)
    size = collections.Counter(c for c, _ in pairs[n:])
    want = sum(k * (k - 1) // 2 for k in size.values())
    assert found.closed(2).count() == want and found.counted(2).agg(F.sum("n")).first()[0] == 2 * want
    tasks = [r["count"] for r in found.half(2).repartition(16, "u", "p2").groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) <= 4 * sorted(tasks)[len(tasks) // 2]


def test_parts_of_a_heavy_middle(spark, monkeypatch):
    """A node in the middle with many ends above it is joined in parts: the same paths, spread over the parts."""
    rng = random.Random(2)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(600)})
    g = Tanner(spark.createDataFrame(edges, "c int, v int"), 40, 40)
    paths = lambda: sorted(map(tuple, Cycles(g.neighbours()).half(3).select("u", "p1", "p2", "p3").collect()))
    whole = paths()
    monkeypatch.setattr(module, "HEAVY", 2)
    assert paths() == whole and len(whole) > 1000


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_girth_of_a_ring(spark, k):
    ring = [(i, i) for i in range(k)] + [(i, (i + 1) % k) for i in range(k)] + [(k + i, i) for i in range(k)]
    assert codes.girth(from_edges(spark.createDataFrame(ring, "c int, v int"))) == 2 * k


@pytest.mark.parametrize("copies", [0, 8])
def test_only_half_paths_that_meet_become_rows(spark, copies, monkeypatch):
    """Sparse graphs have far more half paths than meet; starts and lists beyond a block are dealt out, with the same cycles."""
    rng = random.Random(3)
    edges = sorted({(rng.randrange(300), rng.randrange(400)) for _ in range(1100)})
    edges += rng.choices(edges, k=copies)
    found = Cycles(Tanner(spark.createDataFrame(edges, "c int, v int"), 300, 400).edges)
    met, every = found.meeting(3).select("u", "p1", "p2").count(), found.half(3).count()
    assert met < every / 2
    assert found.counted(3).count() == len(walked(edges, 3))
    monkeypatch.setattr(module, "BLOCK", 50)
    monkeypatch.setattr(module, "LONG", 3)
    assert counted(spark, edges, 3) == walked(edges, 3)


def test_pairs_where_variables_have_few_checks(spark, monkeypatch):
    # Pairs of checks that two, three and four variables join, and one joined by most of them.
    rng = random.Random(5)
    edges = sorted({(rng.randrange(7), rng.randrange(24)) for _ in range(80)} | {(c, v) for c in (0, 1) for v in range(12)})
    found = Cycles(Tanner(spark.createDataFrame(edges, "c int, v int"), 100, 100).edges)
    with monkeypatch.context() as m:
        # Neither degrees of both sides nor half paths are needed.
        m.setattr(module, "ranked", lambda edges: pytest.fail("degrees were looked up"))
        sets = {tuple(r["vs"]): (r["checks"], r["n"]) for r in found.sets(2).collect()}
    assert {k: n for k, (_, n) in sets.items()} == walked(edges, 2)
    assert all(sorted(cs) == sorted(c for c, v in edges if v in vs) for vs, (cs, _) in sets.items())
    monkeypatch.setattr(module, "PAIRS", 0)
    found = Cycles(Tanner(spark.createDataFrame(edges, "c int, v int"), 100, 100).edges)
    assert {tuple(r["vs"]): (r["checks"], r["n"]) for r in found.sets(2).collect()} == sets


def test_induced_degrees_from_lists(spark):
    edges = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 1), (0, 2), (3, 2)]
    found = Cycles(Tanner(spark.createDataFrame(edges, "c int, v int"), 4, 3).edges)
    sets = spark.createDataFrame([([0, 1],), ([0, 1, 2],)], "vs array<int>")
    want = [([0, 1], True, 1), ([0, 1, 2], False, 3)]
    for graph in (found.near, spark.createDataFrame(edges, "c int, v int")):
        assert sorted((r["vs"], r["elementary"], r["b"]) for r in accept.induced_stats(sets, graph).collect()) == want


@pytest.mark.parametrize("copies", [0, 8])
def test_rounds_give_the_same_and_leave_nothing(spark, copies, monkeypatch):
    """Starts in several rounds; the tables of a round are gone after it, and those of the last size with its count."""
    from girthline.sources import scratch

    rng = random.Random(3)
    edges = sorted({(rng.randrange(60), rng.randrange(80)) for _ in range(330)})
    edges += rng.choices(edges, k=copies)
    labels, path = [], scratch.fresh_path
    monkeypatch.setattr(scratch, "fresh_path", lambda s, label: labels.append((label, path(s, label))) or labels[-1][1])
    monkeypatch.setattr(module, "ROUND", 500)
    found = Cycles(Tanner(spark.createDataFrame(edges, "c int, v int"), 300, 400).edges, 3)
    assert {tuple(r["vs"]): r["n"] for r in found.counted(3).collect()} == walked(edges, 3)
    assert sum(label == "meeting3" for label, _ in labels) > 2
    assert {label for label, p in labels if scratch.finished(spark, p)} == {"near", "cycles3"}


def test_triples_judged_by_degrees(spark):
    """Triples of which no two share two checks are elementary with b = d - 6; the others are found."""
    rng = random.Random(9)
    edges = sorted({(rng.randrange(14), rng.randrange(20)) for _ in range(70)})
    near = collections.defaultdict(set)
    for c, v in edges:
        near[v].add(c)
    found = Cycles(Tanner(spark.createDataFrame(edges, "c int, v int"), 100, 100).edges)
    sets = found.counted(3)
    twice = {tuple(r["vs"]) for r in found.joined_twice(sets, found.counted(2)).collect()}
    every = {tuple(r["vs"]): r["d"] for r in sets.collect()}
    assert twice == {t for t in every if any(len(near[t[i]] & near[t[j]]) > 1 for i, j in ((0, 1), (0, 2), (1, 2)))} and 0 < len(twice) < len(every)
    for t in set(every) - twice:
        degree = collections.Counter(c for v in t for c in near[v])
        assert max(degree.values()) == 2 and sum(n == 1 for n in degree.values()) == every[t] - 6


def test_negative_names(spark):
    """A search names checks of many edges negatively; cycles by half paths keep these ids."""
    edges = [(c, v) for c in (-1, -7) for v in (1, 2, 3)] + [(5, 3), (5, 4), (-1, 4), (-1, 1)]
    assert counted(spark, edges, 2) == walked(edges, 2) and counted(spark, edges, 3) == walked(edges, 3)
