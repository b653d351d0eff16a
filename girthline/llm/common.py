"""Small pieces that several operators share: tables, words, folds and scratch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import forget, scratch_dir, written

__all__ = ["LOWER", "SPACES", "UPPER", "WORD", "crc_fold", "cuts", "forget", "let", "part_of", "scratch_dir", "table", "unused", "word_count", "written"]

#: White space of the word rule: the space and the control characters 09 to 0D.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; Spark would compute it again at each mention inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns to add: those given, with as many underscores in front as no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    lead = "_"
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def cuts(df: DataFrame, column: str, most: int) -> list:
    """At most `most` - 1 ascending values that cut a numeric column into parts of about equal numbers of rows."""
    shares = [k / most for k in range(1, most)]
    found = df.agg(F.percentile_approx(column, shares, 20 * most).alias("q")).first()["q"] if shares else []
    return sorted(set(found or []))


def part_of(value: Column, edges: list) -> Column:
    """The number of edges up to a value: of a coarse step and a fine one, so that few are looked at."""
    if not edges:
        return F.when(value.isNotNull(), F.lit(0))
    step = max(1, int(len(edges) ** 0.5))
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    listed = lambda xs: F.array(*map(F.lit, xs))
    count = lambda xs: F.size(F.filter(xs, lambda e: e <= value))
    coarse = F.greatest(count(listed([g[0] for g in groups])) - 1, F.lit(0))
    fine = F.element_at(F.array(*map(listed, groups)), coarse + 1)
    return F.when(value.isNotNull(), coarse * step + count(fine))
