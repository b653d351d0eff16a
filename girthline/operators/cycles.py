"""Cycles of a Tanner graph: half paths from a cycle's heaviest node, which meet at the node opposite.

Every node, check or variable, is one long that orders nodes by degree: degree, side and id, from the high bits down. A
cycle of 2k nodes is found once, from its largest node u, as two half paths of k edges from u to the same end that have
nothing else in common and stay below u. A wedge around a node of degree d with m edges in the graph has an end above it,
of which there are at most m / d, so a node shared by any number of others makes no square of that number.

Where variables have few checks, cycles of two are found by the pairs of checks that each variable joins: no degrees are
looked up, and a pair of checks that only one variable joins ends in a hash aggregation.

Few half paths meet another, so the last edge is not taken as a row: a path of k - 1 edges goes to the block of its start
with the ids of all its next nodes, four bytes each, and only what meets in the block leaves it as rows, to be joined.
Starts are taken in rounds of about ROUND such ids, whose shuffles are gone before the next, and what one size alone needs
is deleted with it: the disk holds a round and the tables of the graph, however many half paths there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, in_rounds, written

#: Fixed layout of a node: the id in the low 32 bits, then one bit for variables, then the degree.
SIDE, DEGREE = 32, 33

#: Ends above a node that one task joins; a node with more is dealt out in so many parts.
HEAVY = 2000

#: Ids of one row of next nodes, and next nodes of a block, about; a start with more is dealt out by ends.
LONG, BLOCK = 4096, 1_000_000

#: Ids of next nodes of a round, about.
ROUND = 500_000_000

#: Pairs of checks for each edge, and checks of a variable, up to which cycles of two are found by pairs of checks.
PAIRS, MOST = 32, 4096


def node_id(node: Column) -> Column:
    # Ids may be negative: the sign is that of the low half.
    return F.shiftright(F.shiftleft(node, 64 - SIDE), 64 - SIDE).cast("int")


def is_variable(node: Column) -> Column:
    return F.shiftright(node, SIDE).bitwiseAND(F.lit(1)) == 1


def degree(node: Column) -> Column:
    return F.shiftright(node, DEGREE)


def ranked(edges: DataFrame) -> DataFrame:
    """c, v, m as nodes: the edges (c, v, m) between those that can lie on a cycle."""
    # Nodes with one neighbour are on no cycle.
    checks = edges.groupBy("c").agg(F.count("*").alias("dc")).where("dc > 1")
    variables = edges.groupBy("v").agg(F.count("*").alias("dv")).where("dv > 1")
    e = edges.join(checks, "c").join(variables, "v")
    node = lambda degree, side, i: F.shiftleft(F.col(degree), DEGREE).bitwiseOR(F.lit(side << SIDE)).bitwiseOR(F.col(i).cast("long").bitwiseAND(F.lit(2**SIDE - 1)))
    return e.select(node("dc", 0, "c").alias("c"), node("dv", 1, "v").alias("v"), "m")


def meets(table: pa.Table, k: int) -> pa.Table:
    """Rows of paths u, p1, ... with ids `ys` of their next nodes, as a row for each of these that two or more rows of the
    same u have. A node that is on the path already is none."""
    ys = table.column("ys").combine_chunks()
    row = np.repeat(np.arange(len(ys)), pc.list_value_length(ys).to_numpy(zero_copy_only=False))
    y = ys.flatten().to_numpy(zero_copy_only=False)
    for i in range(k - 2, 0, -2):
        ok = y != table.column(f"p{i}").to_numpy().astype(np.int32)[row]
        row, y = row[ok], y[ok]
    start = np.unique(table.column("u").to_numpy(), return_inverse=True)[1].astype(np.int64)
    key = (start[row] << 32) | y.view(np.uint32)
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    met = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key if len(again) else np.zeros(len(key), bool)
    return table.drop_columns(["block", "ys"]).take(pa.array(row[met])).append_column("y", pa.array(y[met], pa.int32()))


class Cycles:
    """The cycles of one graph by size; what sizes share is made once."""

    def __init__(self, graph: DataFrame, last: int | None = None):
        """`graph`: edges (c, v), or neighbours (v, cs). `last`: the largest size that will be asked for; what it needs
        is deleted once its cycles are counted."""
        near = graph.select("v", "cs") if "cs" in graph.columns else graph.groupBy("v").agg(F.sort_array(F.collect_list("c")).alias("cs"))
        #: v, cs: the checks of each variable in order, with multiplicity.
        self.near = written(near.withColumn("cs", F.sort_array("cs")), "near")
        d = F.size("cs").cast("long")
        found = self.near.agg(F.sum(d * (d - 1) / 2).alias("pairs"), F.sum(d).alias("n"), F.max(d).alias("most"), F.bool_and(F.size(F.array_distinct("cs")) == d).alias("simple")).first()
        self.simple = found["simple"] is not False
        self.few = self.simple and (found["pairs"] or 0) <= PAIRS * (found["n"] or 0) and (found["most"] or 0) <= MOST
        self.halves: dict[int, DataFrame] = {}
        self.last, self.made = last, []

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        """A table that goes with over()."""
        self.made.append(written(df, label))
        return self.made[-1]

    def over(self) -> None:
        """Deletes what the search for half paths has written."""
        for df in self.made:
            forget(df)
        self.made, self.halves = [], {}
        for name in ("edges", "count"):
            self.__dict__.pop(name, None)

    @cached_property
    def edges(self) -> DataFrame:
        """x, y, m: both directions of the edges that can lie on a cycle, with their multiplicity."""
        every = written(self.near.select("v", F.explode("cs").alias("c")).groupBy("c", "v").agg(F.count("*").cast("int").alias("m")), "edges")
        e = self.kept(ranked(every), "ranked")
        forget(every)
        return e.select(F.col("c").alias("x"), F.col("v").alias("y"), "m").unionByName(e.select(F.col("v").alias("x"), F.col("c").alias("y"), "m"))

    @cached_property
    def count(self) -> int:
        return self.edges.count() // 2

    def parts(self, node: Column) -> Column:
        """In how many parts the paths to a node are dealt out, by the number of ends above it."""
        return F.ceil(F.least(degree(node), F.lit(self.count) / degree(node)) / HEAVY).cast("int")

    def dealt(self, x: DataFrame, at: str) -> DataFrame:
        return x.withColumn("part", F.pmod(F.xxhash64("u", at), self.parts(F.col(at)).cast("long")).cast("int"))

    def to_every_part(self, y: DataFrame, at: str) -> DataFrame:
        return y.withColumn("part", F.explode(F.sequence(F.lit(0), self.parts(F.col(at)) - 1)))

    def step(self, x: DataFrame, at: str, k: int) -> DataFrame:
        """Half paths with one edge more, to p{k}, below the start u and not on the path. Around a node whose ends above
        it are many the paths are dealt out, and its edges go to every part."""
        y = self.edges.select(F.col("x").alias(at), F.col("y").alias(f"p{k}"), *([] if self.simple else [F.col("m").alias(f"m{k}")]))
        apart = [F.col(f"p{k}") != F.col(f"p{i}") for i in range(k - 2, 0, -2)]
        return self.dealt(x, at).join(self.to_every_part(y, at), [at, "part"]).where(reduce(Column.__and__, apart, F.col(f"p{k}") < F.col("u"))).drop("part")

    def lists(self, ends: DataFrame) -> DataFrame:
        """x, ys, ids, top: neighbours of the nodes in `ends` (x), their ids, and the largest; more than LONG of them in
        rows of about so many."""
        rows = self.edges.join(ends.distinct(), "x", "left_semi").withColumn("row", F.pmod(F.xxhash64("y"), F.ceil(degree(F.col("x")) / LONG)))
        found = rows.groupBy("x", "row").agg(F.collect_list("y").alias("ys"), F.max("y").alias("top"))
        return written(found.select("x", "ys", F.transform("ys", node_id).alias("ids"), "top"), "lists")

    def half(self, k: int) -> DataFrame:
        """u, p1, ..., pk (and m1, ..., mk of the edges, where some stand more than once)."""
        if k == 1:
            x = self.edges.where("y < x").select(F.col("x").alias("u"), F.col("y").alias("p1"), *([] if self.simple else [F.col("m").alias("m1")]))
            return x
        return self.step(self.shorter(k), f"p{k - 1}", k)

    def shorter(self, k: int) -> DataFrame:
        """The half paths of k - 1 edges, kept."""
        if k - 1 not in self.halves:
            self.halves[k - 1] = self.half(1) if k == 2 else self.kept(self.half(k - 1), f"half{k - 1}")
        return self.halves[k - 1]

    def meetings(self, k: int) -> Iterator[DataFrame]:
        """The half paths of k edges whose end another one from the same start has, in rounds of starts; each is deleted
        when the next is asked for. p{k} is given by its id and side."""
        x, at = self.shorter(k), f"p{k - 1}"
        size = x.groupBy("u").agg(F.sum(degree(F.col(at))).alias("n"))
        most = size.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        rounds, lists = 1 + (most["n"] or 0) // ROUND, self.lists(x.select(F.col(at).alias("x")))
        for i in range(rounds):
            own = (lambda df: df.where(F.pmod(F.hash("u"), F.lit(rounds)) == i)) if rounds > 1 else (lambda df: df)
            found = written(self.met(k, own(x), own(size), lists, most["most"] or 0, 1 + (most["n"] or 0) // (BLOCK * rounds)), f"meeting{k}")
            if i == rounds - 1:
                forget(lists)
            yield found
            forget(found)

    def met(self, k: int, x: DataFrame, size: DataFrame, lists: DataFrame, most: int, blocks: int) -> DataFrame:
        """The paths that meet, of the half paths `x` of k - 1 edges with their next nodes in `lists`. size: the number
        of these by start, `most` at most."""
        at, u = f"p{k - 1}", F.col("u")
        y = self.dealt(x, at).join(self.to_every_part(lists.withColumnRenamed("x", at), at), [at, "part"]).drop("part")
        below = F.when(F.col("top") < u, F.col("ids")).otherwise(F.transform(F.filter("ys", lambda p: p < u), node_id))
        y = y.withColumn("ys", below).drop("ids", "top").where(F.size("ys") > 0).withColumn("deal", F.lit(0))
        if most > BLOCK:
            deals = size.where(F.col("n") > BLOCK).select("u", F.ceil(F.col("n") / BLOCK).cast("int").alias("deals"))
            y = y.join(deals, "u", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)))
            own = F.filter("ys", lambda p: F.pmod(F.hash(p), F.col("deals")) == F.col("deal"))
            y = y.withColumn("ys", F.when(F.col("deals").isNull(), F.col("ys")).otherwise(own)).drop("deals").where(F.size("ys") > 0)
        y = y.withColumn("block", F.pmod(F.xxhash64("u", "deal"), F.lit(blocks)).cast("int")).drop("deal")
        kept = [f for f in y.schema if f.name not in ("block", "ys")]
        y = y.select(*(f.name for f in kept), "ys", "block")
        found = y.groupBy("block").applyInArrow(lambda t: meets(t, k), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", y int")
        end = F.when(is_variable(F.col(at)), F.lit(0)).otherwise(F.lit(1 << SIDE)).cast("long").bitwiseOR(F.col("y").cast("long").bitwiseAND(F.lit(2**SIDE - 1)))
        found = found.withColumn(f"p{k}", end)
        if not self.simple:
            m = self.edges.select(F.col("x").alias(at), node_id(F.col("y")).alias("y"), F.col("m").alias(f"m{k}"))
            found = found.join(m, [at, "y"])
        return found.drop("y")

    def meeting(self, k: int) -> DataFrame:
        """All of meetings(), as one table."""
        return self.each(k, lambda x: x, f"meeting{k}")

    def each(self, k: int, make, label: str) -> DataFrame:
        """What `make` gives of each round of meetings(), as one table."""
        return in_rounds(map(make, self.meetings(k)), label)

    def closed(self, k: int) -> DataFrame:
        """Each cycle of 2k nodes once: nodes in order from its largest, and the multiplicities of the edges between."""
        return self.each(k, lambda x: self.closing(x, k), f"closed{k}")

    def closing(self, x: DataFrame, k: int) -> DataFrame:
        """The cycles of half paths that meet."""
        names = [f"{c}{i}" for i in range(1, k + 1) for c in ("p", "m") if f"{c}{i}" in x.columns]
        y = x.select("u", F.col(f"p{k}"), *(F.col(c).alias(f"o{c}") for c in names if c != f"p{k}"))
        apart = [F.col(f"p{i}") != F.col(f"op{j}") for i in range(1, k) for j in range(1, k) if (i - j) % 2 == 0 and (i, j) != (1, 1)]
        z = x.join(y, ["u", f"p{k}"]).where(reduce(Column.__and__, apart, F.col("p1") < F.col("op1")))
        nodes = F.array("u", *(f"p{i}" for i in range(1, k + 1)), *(f"op{i}" for i in range(k - 1, 0, -1)))
        ms = [] if self.simple else [F.array(*(f"m{i}" for i in range(1, k + 1)), *(f"om{i}" for i in range(k, 0, -1))).alias("ms")]
        return z.select(nodes.alias("nodes"), *ms)

    def counted(self, k: int) -> DataFrame:
        """vs, n: the sorted variables of cycles with k of them, and how many there are on them: for k = 2 either order
        of the checks, else a cycle once. Without repeated edges and for k = 3, d: the sum of their degrees. A repeated edge counts by its copies, but for the one by which a walk from
        the smallest variable to the smaller of its two neighbours comes back."""
        if k == 2 and self.few:
            return self.pairs()
        every = self.each(k, lambda x: self.weighed(self.closing(x, k), k), f"closed{k}")
        out = written(every.groupBy("vs", *(["d"] if "d" in every.columns else [])).agg(F.sum("w").alias("n")), f"cycles{k}")
        forget(every)
        if k == self.last:
            self.over()
        return out

    def weighed(self, x: DataFrame, k: int) -> DataFrame:
        """vs, w, d of cycles: how often each counts for its variables, and the sum of their degrees, as in counted()."""
        odd = is_variable(F.get("nodes", F.lit(1)))
        places = lambda start: [F.get("nodes", F.lit(i)) for i in range(start, 2 * k, 2)]
        listed = F.when(odd, F.array(*places(1))).otherwise(F.array(*places(0)))
        ids = F.transform(listed, node_id)
        if self.simple:
            end = F.get("nodes", F.lit(k))
            d = reduce(Column.__add__, (degree(F.get(listed, F.lit(i))) for i in range(k))).cast("int")
            x = x.select(F.sort_array(ids).alias("vs"), F.lit(2 if k == 2 else 1).cast("long").alias("w"), *([d.alias("d"), F.when(is_variable(end), node_id(end)).alias("v")] if k == 3 else []))
            if k == 3:
                # The node opposite has come without its degree.
                far = x.where("v IS NOT NULL").join(self.near.select("v", F.size("cs").alias("dv")), "v").withColumn("d", F.col("d") + F.col("dv")).select("vs", "w", "d")
                x = x.where("v IS NULL").select("vs", "w", "d").unionByName(far)
        else:
            x = x.select(ids.alias("ids"), "ms", odd.cast("int").alias("odd"))
            x = x.withColumn("s", F.array_position("ids", F.array_min("ids")).cast("int") - 1)
            other = lambda step: F.get("ids", F.pmod(F.col("s") + step, F.lit(k)))
            at = 2 * F.col("s") + F.col("odd")
            # The edge after the variable, and the one before it.
            after, before = (F.get("ms", F.pmod(at + d, F.lit(2 * k))).cast("long") for d in (0, -1))
            every = F.aggregate("ms", F.lit(1).cast("long"), lambda a, m: a * m)
            w = F.expr("0L") + every / after + every / before if k == 2 else every / F.when(other(1) < other(-1), before).otherwise(after)
            x = x.select(F.sort_array("ids").alias("vs"), w.cast("long").alias("w"))
        return x

    def pairs(self) -> DataFrame:
        """counted(2) of a graph without repeated edges, by the pairs of checks that each variable joins. Of a pair that
        two variables join these are the smallest and the largest; only for pairs of more are the others fetched."""
        one = self.near.where("size(cs) > 1").select("v", "cs", F.posexplode("cs").alias("i", "c"))
        two = one.select("v", "c", F.explode(F.slice("cs", F.col("i") + 2, F.size("cs"))).alias("d"))
        key = F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("d").cast("long").bitwiseAND(F.lit(2**32 - 1)))
        joined = two.select(key.alias("key"), "v")
        met = joined.groupBy("key").agg(F.min("v").alias("v1"), F.max("v").alias("v2"), F.count("*").alias("n")).where("n > 1")
        met = written(met, "met")
        found, more = met.where("n = 2").select("v1", "v2"), met.where("n > 2").select("key")
        if not more.isEmpty():
            x = written(joined.join(more, "key", "left_semi"), "more")
            y = x.withColumnRenamed("v", "v2")
            found = found.unionByName(x.withColumnRenamed("v", "v1").join(y, "key").where("v1 < v2").select("v1", "v2"))
        return found.groupBy("v1", "v2").agg((2 * F.count("*")).alias("n")).select(F.array("v1", "v2").alias("vs"), "n")

    def sets(self, k: int) -> DataFrame:
        """vs, checks, n: as counted(), with the checks of all the variables."""
        x = self.counted(k)
        return self.with_checks(written(x, f"cycles{k}") if k == 2 and self.few else x, k)

    def with_checks(self, x: DataFrame, k: int) -> DataFrame:
        """vs, checks, n of variables vs, n of a written table."""
        lists = self.near
        if 2 * k * x.count() < lists.count():
            lists = written(lists.join(x.select(F.explode("vs").alias("v")).distinct(), "v", "left_semi"), "checks")
        for i in range(k):
            x = x.withColumn("v", F.get("vs", F.lit(i))).join(lists.withColumnRenamed("cs", f"cs{i}"), "v")
        return x.select("vs", F.sort_array(F.concat(*(f"cs{i}" for i in range(k)))).alias("checks"), "n")

    def joined_twice(self, triples: DataFrame, pairs: DataFrame) -> DataFrame:
        """Of cycles of three variables (rows with vs), those of which two share more than one check; `pairs`: counted(2).

        The others, where no edge is repeated, are elementary with b = d - 6: each two share one check, and no check is
        shared by all, for two of them would share another one on the cycle. So their lists need not be fetched."""
        key = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long").bitwiseAND(F.lit(2**32 - 1)))
        v = lambda i: F.get("vs", F.lit(i))
        x = triples.withColumn("key", F.explode(F.array(*(key(v(i), v(j)) for i, j in ((0, 1), (0, 2), (1, 2))))))
        return x.join(pairs.select(key(v(0), v(1)).alias("key")), "key", "left_semi").drop("key").distinct()

    def any(self, k: int) -> bool:
        return any(not self.closing(x, k).isEmpty() for x in self.meetings(k))
