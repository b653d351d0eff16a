"""Expansions of every length against plain walks over graphs with parallel edges, with and without checks of many edges."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from girthline.functions import arrays
from girthline.operators import accept, expand
from girthline.operators.cycles import Cycles
from girthline.sources.graph import Tanner
from girthline.sources.scratch import written


class Plain:
    def __init__(self, edges):
        self.m = collections.Counter(edges)
        self.cs, self.vs = collections.defaultdict(list), collections.defaultdict(list)
        for c, v in edges:
            self.cs[v].append(c)
            self.vs[c].append(v)

    def sets(self, parent):
        degree = collections.Counter(c for v in parent for c in self.cs[v])
        return {c for c in degree if degree[c] % 2}, {c for c in degree if degree[c] % 2 == 0}

    def dot(self, parent, one):
        odd, even = self.sets(parent)
        for v in self.cs:
            n = sum(c in odd for c in self.cs[v])
            if v not in parent and not set(self.cs[v]) & even and (n == 1 if one else n >= 2):
                yield tuple(sorted((*parent, v)))

    def walks(self, parent, m, ring=None):
        """Ways of m new variables from an odd check, to another (or to the ring); each step by each copy of an edge."""
        odd, even = self.sets(parent)
        own = odd | even
        rset = {c for v in ring for c in self.cs[v]} if ring else set()
        if ring and (own & rset or set(ring) & set(parent)):
            return

        def go(c, pv, pc):
            last = len(pv) == m - 1
            for v in self.vs[c]:
                if v in parent or v in pv or (ring and v in ring):
                    continue
                for n in self.cs[v]:
                    if n in pc:
                        continue
                    if last and not ring:
                        if n in odd and not set(self.cs[v]) & own - {c, n}:
                            yield (*pv, v)
                        continue
                    if n in own or set(self.cs[v]) & own - {c}:
                        continue
                    if last and n in rset:
                        yield (*pv, v)
                    elif not last and n not in rset:
                        yield from go(n, (*pv, v), (*pc, n))

        for c in odd:
            yield from go(c, (), (c,))


def graph(seed, checks, variables, n, copies=0):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(checks), rng.randrange(variables)) for _ in range(n)})
    return edges + rng.choices(edges, k=copies)


def found(df):
    return {tuple(r["vs"]): r["raw"] for r in accept.merged(df).collect()}


def setup(spark, edges, heavy=None):
    g = Tanner(spark.createDataFrame(edges, "c int, v int"), 100, 100)
    g = g.marked(heavy) if heavy is not None else g
    pairs = accept.measured(accept.merged(expand.cycles(Cycles(g.neighbours()), 2))).where("elementary")
    return g, pairs, [tuple(r["vs"]) for r in pairs.collect()], Plain(edges)


@pytest.mark.parametrize("copies", [0, 6])
@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_paths(spark, m, copies):
    g, parents, sets, plain = setup(spark, graph(48, 30, 34, 84, copies))
    want = collections.Counter(tuple(sorted((*p, *w))) for p in sets for w in plain.walks(p, m))
    assert sets and want and found(expand.path(parents, g.adjacency(), m)) == want


@pytest.mark.parametrize("copies", [0, 6])
@pytest.mark.parametrize("m", [3, 4, 5, 6])
def test_lollipops(spark, m, copies):
    g, parents, sets, plain = setup(spark, graph(48, 30, 34, 84, copies))
    want = collections.Counter(tuple(sorted((*p, *w, *r))) for p in sets for r in sets for w in plain.walks(p, m - 2, r))
    assert want and found(expand.lollipop(parents, parents, g.adjacency(), m, 2)) == want


@pytest.mark.parametrize("heavy", [None, 6, 3, 0])
def test_dots_at_checks_of_many_edges(spark, heavy):
    """The same children whichever checks are kept apart."""
    rng = random.Random(4)
    edges = graph(3, 14, 30, 70, 8) + [(c, v) for c in (90, 91) for v in rng.sample(range(30), 14)] + [(90, 1), (91, 2)]
    g, parents, sets, plain = setup(spark, edges, heavy)
    assert (g.edges.where("c < 0").count() > 0) == (heavy is not None)
    for one, op in ((False, expand.dot(parents, g.adjacency())), (True, expand.dot1(parents, g.adjacency(), 99))):
        want = collections.Counter(x for p in sets for x in plain.dot(p, one))
        assert want and found(op) == want


def test_a_check_of_20000_variables(spark):
    """A dot at a check that everything shares meets the variables of the parent's other checks only."""
    rng, n = random.Random(6), 20_000
    edges = [(0, v) for v in range(n)] + [(1 + rng.randrange(9000), v) for v in range(n)] + [(1 + rng.randrange(9000), v) for v in range(n)]
    g = Tanner(spark.createDataFrame(sorted(set(edges)), "c int, v int"), n, n).marked(1000)
    adjacency = g.adjacency().persist()
    parents = accept.measured(expand.singletons(g.neighbours(), 3)).where("vs[0] < 50")
    x = expand.touching(parents, adjacency, 2)
    got = {(r["vs"][0], r["v"]) for r in x.collect()}
    near = collections.defaultdict(set)
    for c, v in edges:
        near[v].add(c)
    by_check = collections.defaultdict(set)
    for c, v in edges:
        if c:
            by_check[c].add(v)
    want = {(s, v) for s in range(50) for c in near[s] - {0} for v in by_check[c] if v != s and len(near[s] & near[v]) >= 2}
    assert got == want and rows_of_joins(x) < 20 * len(want) + 5000


def rows_of_joins(df):
    """The most rows that a join of the executed plan gives."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    todo = [plan]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName():
            rows = p.metrics().get("numOutputRows")
            most = max(most, rows.get().value() if rows.isDefined() else 0)
        name = p.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


def test_signatures_spare_lists(spark, monkeypatch):
    """The same children with and without, and most pairs of lists are never looked at."""
    g, parents, _, _ = setup(spark, graph(8, 60, 60, 210))
    with_them = found(expand.path(parents, g.adjacency(), 3))
    x = parents.select(F.concat("odd", "even").alias("own")).crossJoin(g.neighbours())
    meet = arrays.signature(F.col("own")).bitwiseAND(F.col("sig")) != 0
    r = x.agg(F.count("*").alias("n"), F.count_if(meet).alias("looked"), F.count_if(F.arrays_overlap("own", "cs")).alias("overlap"), F.count_if(F.arrays_overlap("own", "cs") & ~meet).alias("missed")).first()
    assert r["missed"] == 0 and r["overlap"] <= r["looked"] < 0.75 * r["n"]
    monkeypatch.setattr(expand, "apart", lambda a, sig_a, b, sig_b: arrays.disjoint(a, b))
    assert with_them and found(expand.path(parents, g.adjacency(), 3)) == with_them


def test_only_stems_that_meet_are_kept(spark, monkeypatch):
    """A sparse graph has far more stems than meet another of their parent: no others are written or joined."""
    kept = []

    def seen(df, label="table"):
        out = written(df, label)
        kept.append((label, out.count()))
        return out

    g, parents, sets, plain = setup(spark, graph(7, 60, 90, 210))
    monkeypatch.setattr(expand, "written", seen)
    want = collections.Counter(tuple(sorted((*p, *w))) for p in sets for w in plain.walks(p, 2))
    assert want and found(expand.path(parents, g.adjacency(), 2)) == want
    (n,) = [n for label, n in kept if label == "meeting"]
    every = expand.stems(parents.withColumn("pid", F.monotonically_increasing_id()), g.adjacency(), 1).count()
    assert 0 < n < every / 2


def test_lists_are_fetched_only_for_variables_met_twice(spark):
    """Of many variables at an odd check only those with a second edge to odd checks of the same parent get their lists."""
    from girthline.operators import expand

    parents = spark.createDataFrame([([1, 2], [10, 11]), ([3, 4], [12])], "vs array<int>, odd array<int>")
    near = [(v, [10, 100 + v]) for v in range(20, 60)] + [(5, [10, 11, 12]), (6, [11, 11]), (7, [10, 12]), (8, [])]
    got = expand.twice_met(parents, spark.createDataFrame(near, "v int, cs array<int>"))
    assert sorted((r["v"], r["dv"], r["cs"]) for r in got.collect()) == [(5, 3, [10, 11, 12]), (6, 2, [11, 11])]


@pytest.mark.parametrize("copies", [0, 12])
def test_leaves_without_lists(spark, copies):
    """The last leaves carry b and elementary instead of checks; in parts, each child is in one; places are enough."""
    edges = graph(3, 30, 40, 90, copies)
    g, pairs, _, _ = setup(spark, edges)
    parents = pairs.select("vs", "checks", "odd", "even", "b").unionByName(accept.measured(expand.singletons(g.neighbours(), 4)).where("elementary").select("vs", "checks", "odd", "even", "b"))
    full = accept.measured(accept.merged(expand.dot1(parents, g.adjacency(), 4)))
    want = {tuple(r["vs"]): (r["b"], r["elementary"], r["raw"]) for r in full.collect()}
    got = [{tuple(r["vs"]): (r["b"], r["elementary"], r["raw"]) for r in accept.merged(expand.bare_dot1(parents, g.adjacency(), 4, i, 3)).collect()} for i in range(3)]
    assert want and sum(map(len, got)) == len(want) and got[0] | got[1] | got[2] == want
    assert expand.leaf_places(parents, g.neighbours(), 4) >= sum(raw for _, _, raw in want.values())
