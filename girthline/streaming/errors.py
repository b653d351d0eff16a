"""Error rows as a stream: lines of flat error models, merged into symptom columns as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(lines: DataFrame) -> DataFrame:
    """p, dets, obs of `error(p) D.. L..` lines (column value), tagged or not; other lines take no part.

    Repeat blocks and detector shifts need the lines in order, which a stream doesn't keep: they are an error.
    """
    ordered = F.col("value").rlike(r"^\s*(repeat|shift_detectors)\b")
    line = F.when(ordered, F.raise_error(F.lit("a stream can't unroll repeat blocks or detector shifts; read the file with sources.dem"))).otherwise(F.regexp_replace("value", "#.*$", ""))
    ids = lambda c: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(rf"\b{c}(\d+)"), 1), lambda x: x.cast("int"))))
    rows = lines.select(line.alias("line")).where(F.col("line").rlike(r"^\s*error\s*(\[[^\]]*\])?\s*\("))
    return rows.select(F.regexp_extract("line", r"\(([^)]*)\)", 1).cast("double").alias("p"), ids("D").alias("dets"), ids("L").alias("obs"))


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.readStream.text(folder))


def symptoms(errors: DataFrame) -> DataFrame:
    """Running sum of probabilities and number of errors of each symptom; state is one row a different symptom."""
    return errors.groupBy("dets", "obs").agg(F.sum("p").alias("p"), F.count("*").alias("n"))
