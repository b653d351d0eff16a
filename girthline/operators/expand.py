"""The operators that make candidate supports, as joins.

A set is a row (a, vs, checks): its sorted variables and the multiset of their checks. Candidates are rows
(vs, checks, flags), repeated as often as the operator makes them; accept.py merges and judges them. Parents also carry
`odd` and `even`, the checks of odd and of even induced degree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import apart, disjoint, is_elementary, odd_checks, signature, times
from ..sources.scratch import written
from .cycles import Cycles

#: Provenance flags.
SEED_CYCLE, ETSL_LEAFLESS_SEED, ETSL_DOT1, ETSL_SINGLETON = 1, 2, 4, 8

no_ids = lambda: F.array().cast("array<int>")
candidate = "array_sort(vs) AS vs", "array_sort(checks) AS checks"


def within(checks: Column, group: Column) -> Column:
    """How many entries of a check multiset lie in a set of checks."""
    return F.size(F.filter(checks, lambda c: F.array_contains(group, c)))


def cycles(found: Cycles, k: int) -> DataFrame:
    """Simple cycles of k variables and k different checks. copies: their choices of checks (for k = 2, each order) and of
    parallel edges."""
    return of_cycles(found.sets(k))


def of_cycles(sets: DataFrame) -> DataFrame:
    return sets.select("vs", "checks", F.lit(SEED_CYCLE).alias("flags"), F.col("n").alias("copies"))


def bare_cycles(found: Cycles, k: int) -> DataFrame:
    """The same without checks, whose lists need not be fetched."""
    return found.counted(k).select("vs", F.lit(SEED_CYCLE).alias("flags"), F.col("n").alias("copies"))


def once(candidates: DataFrame) -> DataFrame:
    """Candidates that stand for themselves, beside those of cycles."""
    return candidates.withColumn("copies", F.lit(1).cast("long"))


def touching(parents: DataFrame, adjacency: DataFrame, least: int, room: Column | None = None) -> DataFrame:
    """Each parent with each allowed variable outside it that has `least` or more edges to odd checks and none to even
    ones, once. n: its edges to odd checks. `room`: a condition on parents and variables that costs little, looked at
    before their lists.

    A variable is met at every odd check that it touches; only the meeting at the smallest counts, so no shuffle is
    needed to make the rows distinct. Checks with negative names are those of very many edges (Tanner.marked): a variable
    that needs two edges is met at another check, or at two of them at once, so none brings all its variables.
    """
    x = parents.withColumn("even_sig", signature(F.col("even")))
    fits = (F.lit(True) if room is None else room) & ~F.array_contains("vs", F.col("v")) & apart(F.col("even"), F.col("even_sig"), F.col("cs"), F.col("sig"))
    met = F.array_intersect("odd", "cs")
    if least < 2:
        x = x.withColumn("c", F.explode("odd")).join(adjacency, "c").where(fits & (F.col("c") == F.array_min(met)))
    else:
        light, heavy = (lambda ids: F.filter(ids, lambda c: c >= 0)), (lambda ids: F.filter(ids, lambda c: c < 0))
        one = x.withColumn("c", F.explode(light(F.col("odd")))).join(adjacency.where("c >= 0"), "c").where(fits & (F.col("c") == F.array_min(light(met))))
        two = in_pairs(adjacency.select("c", "v", "dv", "cs", "sig").where(F.col("c") == F.array_min(heavy(F.col("cs")))), "cs", heavy)
        own = x.withColumn("c", F.get(heavy(F.col("odd")), F.lit(0))).where("c IS NOT NULL").drop("c")
        # Twice: a pair of edges may go to one check.
        own = in_pairs(own.withColumn("twice", F.array_sort(F.concat("odd", "odd"))), "twice", heavy).drop("twice")
        first = F.slice(F.filter("cs", lambda c: (c < 0) & F.array_contains("odd", c)), 1, 2)
        two = own.join(two.drop("c"), "pair").where(fits & (F.size(light(met)) == 0) & (F.col("pair") == first)).drop("pair")
        x = one.drop("c").unionByName(two)
    return x.withColumn("n", within(F.col("cs"), F.col("odd"))).where(F.col("n") >= least).drop("even_sig")


def twice_met(parents: DataFrame, near: DataFrame) -> DataFrame:
    """v, dv, cs, sig of the variables (v, cs) that have two or more edges to odd checks of some parent, for touching().

    Only ids are joined at the checks, and lists fetched for what remains, so no list of checks is shuffled once for each
    of its checks. Parents are told apart by a hash; two with the same one could only let more variables pass.
    """
    ends = parents.select(F.xxhash64("vs").alias("parent"), F.explode("odd").alias("c"))
    met = ends.join(near.select("v", F.explode("cs").alias("c")), "c").groupBy("parent", "v").agg(F.count("*").alias("n"))
    kept = written(met.where("n > 1").select("v").distinct(), "met")
    return near.join(kept, "v", "left_semi").select("v", F.size("cs").alias("dv"), "cs", signature(F.col("cs")).alias("sig"))


def in_pairs(rows: DataFrame, column: str, kind) -> DataFrame:
    """Rows with `pair`, each two entries of a sorted list of one kind, equal pairs once."""
    ids = kind(F.col(column))
    pairs = F.flatten(F.transform(ids, lambda a, i: F.transform(F.filter(ids, lambda b, j: j > i), lambda b: F.array(a, b))))
    return rows.withColumn("pair", F.explode(F.array_distinct(pairs)))


def grown(x: DataFrame, flags: int) -> DataFrame:
    return x.select(F.array_append("vs", F.col("v")).alias("vs"), F.concat("checks", "cs").alias("checks")).selectExpr(*candidate).withColumn("flags", F.lit(flags))


def dot(parents: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Add one variable with two or more edges to odd checks and none to even ones."""
    return grown(touching(parents, adjacency, 2), 0)


def leaves(parents: DataFrame, adjacency: DataFrame, b_target: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Each parent with each variable that may be its leaf: one with exactly one edge to an odd check and none to even
    ones, if the child's b allows. Of `parts` parts that a hash of the child's variables makes, one."""
    room = F.col("b") + F.col("dv") - 2 <= b_target
    if parts > 1:
        parents = parents.withColumn("mix", F.aggregate("vs", F.lit(0), lambda x, v: x.bitwiseXOR(v)))
        room &= F.pmod(F.hash(F.col("mix").bitwiseXOR(F.col("v"))), F.lit(parts)) == part
    # No parent has fewer than one odd check.
    return touching(parents.where("b >= 1"), adjacency.where(F.col("dv") <= b_target + 1), 1, room).where("n = 1")


def dot1(parents: DataFrame, adjacency: DataFrame, b_target: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Add a leaf."""
    return grown(leaves(parents, adjacency, b_target, part, parts), ETSL_DOT1)


def bare_dot1(parents: DataFrame, adjacency: DataFrame, b_target: int, part: int = 0, parts: int = 1) -> DataFrame:
    """The same with b and elementary in place of checks, for children that are no parents: where the parent is elementary,
    both follow from the leaf."""
    x = leaves(parents, adjacency, b_target, part, parts)
    own, plain = F.col("cs"), F.size(F.array_distinct("cs")) == F.col("dv")
    b = F.col("b") - 2 + F.when(plain, F.col("dv")).otherwise(F.size(odd_checks(own)))
    return x.select(F.array_sort(F.array_append("vs", F.col("v"))).alias("vs"), b.cast("int").alias("b"), (plain | is_elementary(own)).alias("elementary"), F.lit(ETSL_DOT1).alias("flags"))


def leaf_places(parents: DataFrame, neighbours: DataFrame, b_target: int) -> int:
    """How many pairs of a parent's odd check and a variable there fit by their degrees: children of dot1(), at most."""
    ends = parents.where("b >= 1").select(F.explode("odd").alias("c"), "b").groupBy("c", "b").agg(F.count("*").alias("n"))
    at = neighbours.where(F.col("dv") <= b_target + 1).select(F.explode(F.array_distinct("cs")).alias("c"), "dv").groupBy("c", "dv").agg(F.count("*").alias("m"))
    return ends.join(at, "c").where(F.col("b") + F.col("dv") - 2 <= b_target).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def singletons(neighbours: DataFrame, b_target: int) -> DataFrame:
    return neighbours.where(F.col("dv") <= b_target).select(F.array("v").alias("vs"), F.col("cs").alias("checks"), F.lit(ETSL_SINGLETON).alias("flags"))


def ways(rows: DataFrame, adjacency: DataFrame, steps: int, first: Column, later: Column, onward) -> DataFrame:
    """Paths of `steps` new variables from the check `cur` on. pv, pc, pcs: their variables, their checks, and all checks
    of the variables; w: how often parallel edges make a path. `first` and `later` say which variables may come first
    and after that, onward(c) to which checks a path may go on."""
    x = rows.withColumn("pv", no_ids()).withColumn("pc", F.array("cur")).withColumn("pcs", no_ids()).withColumn("w", F.lit(1).cast("long"))
    for k in range(steps):
        y = met(x, adjacency).where(later if k else first)
        y = y.withColumn("next", F.explode(F.filter(F.array_distinct("cs"), lambda c: onward(c) & ~F.array_contains("pc", c))))
        x = y.select(*rows.drop("cur").columns, F.col("next").alias("cur"), F.array_append("pv", F.col("v")).alias("pv"), F.array_append("pc", F.col("next")).alias("pc"), F.concat("pcs", "cs").alias("pcs"), (F.col("w") * times(F.col("cs"), F.col("next"))).alias("w"))
    return x


def met(x: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Paths with each variable of the check that they have reached, if it is not on them."""
    y = x.join(adjacency.select(F.col("c").alias("cur"), "v", "cs", "sig"), "cur").where(~F.array_contains("pv", F.col("v")))
    return y.withColumn("w", F.col("w") * times(F.col("cs"), F.col("cur")))


def numbered(parents: DataFrame) -> DataFrame:
    """Parents with pid, as a written table, so that both halves of a path know their parent by the same number."""
    return written(parents.withColumn("pid", F.monotonically_increasing_id()), "parents")


def stems(parents: DataFrame, adjacency: DataFrame, steps: int) -> DataFrame:
    """Paths that leave a numbered parent by an odd check, of variables outside it: the first touches no other check of
    the parent, the others none; checks on the way are no checks of the parent. Rows carry the parent's number and checks."""
    x = parents.select("pid", "vs", F.concat("odd", "even").alias("own"), F.explode("odd").alias("cur"))
    x = x.withColumn("own_sig", signature(F.col("own")))
    first = ~F.array_contains("vs", F.col("v")) & (F.size(F.array_remove(F.array_intersect("cs", "own"), F.col("cur"))) == 0)
    return ways(x, adjacency, steps, first, off(), lambda c: ~F.array_contains("own", c))


def off() -> Column:
    """Whether a variable touches no check of the parent."""
    return apart(F.col("own"), F.col("own_sig"), F.col("cs"), F.col("sig"))


def children(found: DataFrame, parents: DataFrame, variables: Column, checks: Column, copies: Column) -> DataFrame:
    """Candidates from rows that know their parent by its number: it gets the variables and checks, so many times."""
    x = found.select("pid", variables.alias("new"), checks.alias("new_checks"), F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    x = x.join(parents.select("pid", "vs", "checks"), "pid")
    return x.select(F.concat("vs", "new").alias("vs"), F.concat("checks", "new_checks").alias("checks")).selectExpr(*candidate).withColumn("flags", F.lit(0))


def path(parents: DataFrame, adjacency: DataFrame, m: int) -> DataFrame:
    """Join two odd checks of a parent by a path of m new variables; each path is made in both directions.

    Two stems of equal length from different odd checks meet at the middle, a check for even m and a variable for odd m,
    so paths grow to half their length only."""
    parents = numbered(parents)
    x = stems(parents, adjacency, m // 2).withColumn("c0", F.get("pc", F.lit(0))).withColumn("mid", F.col("cur"))
    if m % 2:
        x = met(x.drop("mid"), adjacency).where(off()).withColumnRenamed("v", "mid").drop("sig")
    mine, other = ("pv", "pc", "pcs", "w", "c0", "cur"), lambda c: F.col(f"o_{c}")
    # Few stems meet another of their parent: the others end in the one shuffle, and only what meets is kept and joined.
    ends = Window.partitionBy("pid", "mid")
    x = x.select("pid", "mid", *mine, *(["cs"] if m % 2 else [])).withColumn("lo", F.min("c0").over(ends)).withColumn("hi", F.max("c0").over(ends))
    x = written(x.where("lo < hi").drop("lo", "hi"), "meeting")
    y = x.select("pid", "mid", *(F.col(c).alias(f"o_{c}") for c in mine))
    # For even m the last check of both is the middle, for odd m they come to it by different ones.
    between = lambda pc: pc if m % 2 else F.slice(pc, F.lit(1), F.size(pc) - 1)
    z = x.join(y, ["pid", "mid"]).where((F.col("c0") < other("c0")) & disjoint(F.col("pv"), other("pv")) & disjoint(between(F.col("pc")), between(other("pc"))))
    middle = (F.array("mid"), F.col("cs")) if m % 2 else (no_ids(), no_ids())
    return children(z, parents, F.concat("pv", other("pv"), middle[0]), F.concat("pcs", other("pcs"), middle[1]), 2 * F.col("w") * other("w"))


def lollipop(parents: DataFrame, cycle_sets: DataFrame, adjacency: DataFrame, m: int, size: int) -> DataFrame:
    """Attach an accepted cycle of `size` variables to an odd check, directly or by a stem of m - size new variables.

    A stem grows from both ends, from the parent's odd checks and from the cycle's checks, to the check in its middle."""
    rings = cycle_sets.select(F.col("vs").alias("ring"), F.col("checks").alias("rcs"), F.array_distinct("checks").alias("rset")).withColumn("rset_sig", signature(F.col("rset")))
    if m == size:
        at = rings.withColumn("c", F.explode("rset"))
        x = parents.withColumn("own", F.concat("odd", "even")).withColumn("c", F.explode("odd")).join(at, "c")
        # The one check in common is the odd one that the join met.
        x = x.where((F.size(F.array_intersect("own", "rset")) == 1) & disjoint(F.col("vs"), F.col("ring")))
        x = x.select(F.concat("vs", "ring").alias("vs"), F.concat("checks", "rcs").alias("checks"))
        return x.selectExpr(*candidate).withColumn("flags", F.lit(0))
    parents, far = numbered(parents), (m - size) // 2
    outside = ~F.array_contains("ring", F.col("v"))
    at = ways(rings.withColumn("cur", F.explode("rset")), adjacency, far, outside, outside, lambda c: ~F.array_contains("rset", c))
    at = at.select("cur", "ring", "rcs", "rset", "rset_sig", *(F.col(c).alias(f"o_{c}") for c in ("pv", "pc", "pcs", "w")))
    x = stems(parents, adjacency, m - size - far).join(at, "cur")
    before = F.slice("pc", F.lit(1), F.size("pc") - 1)
    x = x.where(apart(F.col("own"), F.col("own_sig"), F.col("rset"), F.col("rset_sig")) & disjoint(F.col("pv"), F.col("ring")) & disjoint(before, F.col("rset")))
    x = x.where(disjoint(F.col("vs"), F.col("ring")) & disjoint(F.col("pv"), F.col("o_pv")) & disjoint(before, F.col("o_pc")) & disjoint(F.col("own"), F.col("o_pcs")))
    return children(x, parents, F.concat("pv", "o_pv", "ring"), F.concat("pcs", "o_pcs", "rcs"), F.col("w") * F.col("o_w"))
