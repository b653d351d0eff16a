"""Array expressions over sorted id lists and check multisets; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_set(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def inserted(ids: Column, new: Column) -> Column:
    """A sorted list with one id more; an id that is there already is an error, as is any cap (see validate_support)."""
    taken = F.array_contains(ids, new)
    return F.when(taken, F.raise_error(F.lit("duplicate variable in support"))).otherwise(F.array_sort(F.array_append(ids, new)))


def disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(a, b)


def signature(ids: Column) -> Column:
    """64 bits of a set of ids: one of them for each id. Sets whose signatures have no bit in common are disjoint."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x), F.lit(64)))
    return F.aggregate(ids, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(bit(x)))


def apart(a: Column, sig_a: Column, b: Column, sig_b: Column) -> Column:
    """disjoint(a, b), which looks into the lists only where their signatures meet."""
    return (sig_a.bitwiseAND(sig_b) == 0) | disjoint(a, b)


def validated_support(ids: Column, amax: int = 32) -> Column:
    s = sorted_set(ids)
    return F.when(F.size(s) > amax, F.raise_error(F.lit(f"support exceeds {amax} variables"))).otherwise(s)


def times(checks: Column, c: Column) -> Column:
    """How often a check stands in a multiset: its induced degree."""
    return F.size(F.filter(checks, lambda x: x == c))


def odd_checks(checks: Column) -> Column:
    return F.array_sort(F.filter(F.array_distinct(checks), lambda c: times(checks, c) % 2 == 1))


def even_checks(checks: Column) -> Column:
    return F.array_sort(F.filter(F.array_distinct(checks), lambda c: times(checks, c) % 2 == 0))


def is_elementary(checks: Column) -> Column:
    return ~F.exists(F.array_distinct(checks), lambda c: times(checks, c) > 2)


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def bin2int(bits: Column) -> Column:
    """Most significant bit first; the empty list gives null."""
    return F.when(F.size(bits) > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc * 2 + b.cast("long")))


def int2bin(number: Column, length: int) -> Column:
    """The lowest `length` bits, most significant first; negative numbers are an error."""
    bits = F.transform(F.sequence(F.lit(length - 1), F.lit(0), F.lit(-1)), lambda k: F.getbit(number.cast("long"), k).cast("int")) if length else F.array().cast("array<int>")
    return F.when(number < 0, F.raise_error(F.lit("negative number")).cast("array<int>")).otherwise(bits)


def as_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
