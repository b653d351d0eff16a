"""Class files: one text file for each class (a, b), a line a support, ascending ids joined by commas, no header."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import as_text


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def prepare_output(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """An existing, non-empty folder is an error, or is deleted with `overwrite`. Call it when the results are there."""
    if not path:
        raise ValueError("an output folder is needed")
    fs, p = file_system(spark, path)
    if fs.exists(p) and len(fs.listStatus(p)):
        if not overwrite:
            raise FileExistsError(f"{path} is not empty")
        fs.delete(p, True)
    fs.mkdirs(p)


def write_classes(supports: DataFrame, path: str, overwrite: bool = False, rows: int = 1_000_000) -> list[str]:
    """Writes a_<a>_b_<b>.csv for each class, and gives the names.

    All are written under a hidden folder first and then renamed, so a failed run leaves none of them. Tasks take ranges
    of about `rows` supports in order of class and ids. A class inside one range is one file, by format; a larger one is
    a folder of that name, whose files follow one another in ascending order of ids.
    """
    spark = supports.sparkSession
    prepare_output(spark, path, overwrite)
    stage = f"{path.rstrip('/')}/.stage-{uuid.uuid4().hex}"
    lines = supports.select("a", "b", "vs").withColumn("line", as_text(F.col("vs")))
    counts = supports.groupBy("a", "b").count()
    small = counts.where(F.col("count") <= rows).select("a", "b")
    ranges = max(1, -(-supports.count() // rows))
    # Classes that fit into one task go there whole; the others are cut by ids.
    whole = lines.join(F.broadcast(small), ["a", "b"], "left_semi").repartition(ranges, "a", "b")
    cut = lines.join(F.broadcast(small), ["a", "b"], "left_anti").repartitionByRange(ranges, "a", "b", "vs")
    for part in (whole, cut):
        part.sortWithinPartitions("a", "b", "vs").select("a", "b", "line").write.mode("append").partitionBy("a", "b").text(stage)
    fs, p = file_system(spark, stage)
    Path, names = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    for fa in fs.listStatus(p):
        if not fa.isDirectory():
            continue
        for fb in fs.listStatus(fa.getPath()):
            parts = [f.getPath() for f in fs.listStatus(fb.getPath()) if f.getPath().getName().startswith("part-")]
            a, b = (x.getPath().getName().split("=")[1] for x in (fa, fb))
            names.append(f"a_{a}_b_{b}.csv")
            fs.rename(parts[0] if len(parts) == 1 else fb.getPath(), Path(f"{path.rstrip('/')}/{names[-1]}"))
    fs.delete(p, True)
    return sorted(names)


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """a, b, vs from a folder of class files; sizes and b come from the names. Files are split among tasks."""
    rows = spark.read.text(f"{path.rstrip('/')}/a_*_b_*.csv").withColumn("file", F.input_file_name())
    part = lambda k: F.regexp_extract("file", r"a_(\d+)_b_(\d+)\.csv(?:/[^/]*)?$", k).cast("int")
    return rows.where("value <> ''").select(part(1).alias("a"), part(2).alias("b"), F.split("value", ",").cast("array<int>").alias("vs"))


def write_counts(counts: DataFrame, path: str) -> None:
    counts.coalesce(1).write.mode("errorifexists").parquet(path)
