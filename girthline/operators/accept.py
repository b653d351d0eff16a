"""Merge candidates, measure them, and decide what happens to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import even_checks, is_elementary, odd_checks


def merged(candidates: DataFrame) -> DataFrame:
    """One row a support: flags or-ed, raw counts the rows merged, each by its `copies` if it has them. What follows from
    the support, such as its checks, is grouped with it, so the aggregation stays a hash aggregation with a map-side part."""
    follows = [c for c in candidates.columns if c not in ("vs", "flags", "copies")]
    return candidates.groupBy("vs", *follows).agg(F.bit_or("flags").alias("flags"), (F.sum("copies") if "copies" in candidates.columns else F.count("*")).alias("raw"))


def measured(sets: DataFrame) -> DataFrame:
    """Adds a, odd, even, b and elementary."""
    x = sets.withColumn("a", F.size("vs")).withColumn("odd", odd_checks(F.col("checks"))).withColumn("even", even_checks(F.col("checks")))
    return x.withColumn("b", F.size("odd")).withColumn("elementary", is_elementary(F.col("checks")))


def judged(sets: DataFrame, bound: int) -> DataFrame:
    """Adds reject_reason: the elementary test comes first, then the bound on b; null is accepted."""
    reason = F.when(~F.col("elementary"), "non_elementary").when(F.col("b") > bound, "b")
    return sets.withColumn("reject_reason", reason)


def induced_stats(supports: DataFrame, graph: DataFrame) -> DataFrame:
    """vs with b and elementary, by joining the graph's edges (c, v), or neighbours (v, cs), which are rows of a variable
    and so fewer to move: for supports whose checks aren't at hand."""
    x = supports.select("vs").distinct().withColumn("v", F.explode("vs")).join(graph, "v")
    x = x.select("vs", F.explode("cs").alias("c")) if "cs" in graph.columns else x
    degree = x.groupBy("vs", "c").agg(F.count("*").alias("d"))
    return degree.groupBy("vs").agg((F.max("d") <= 2).alias("elementary"), F.count_if(F.col("d") % 2 == 1).alias("b"))


def class_counts(sets: DataFrame) -> DataFrame:
    return sets.groupBy("a", "b").agg(F.count("*").alias("n"))


def bound_of(bounds: list[int], a: int) -> int:
    return bounds[a] if a < len(bounds) else 0


def dot_allowed(a: int, b, amax: int, bounds: list[int]):
    """Whether parents of size a (b a column) may take a dot; paths and lollipops likewise below."""
    return (b >= 2) & (b <= bound_of(bounds, a)) if a + 1 <= amax else F.lit(False)


def path_allowed(a: int, b, m: int, amax: int, bounds: list[int]):
    return (b >= 2) & (b - 2 <= bound_of(bounds, a + m)) if m >= 2 and a + m <= amax else F.lit(False)


def lollipop_allowed(a: int, b, m: int, girth: int, amax: int, bounds: list[int]):
    return (b >= 1) & (b - 1 <= bound_of(bounds, a + m)) if m >= girth // 2 and a + m <= amax else F.lit(False)
