"""Scratch tables in the folder that spark.checkpoint.dir names.

Each is a Parquet table under <folder>/girthline/<application id>, so that lineage is cut, every row is computed once and
the loss of any executor does no harm. A table is needed as long as what was made of it is read: forget() deletes one,
clear() all of an application's, once its results are written elsewhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; only on one machine, and where the setting is absent, a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="girthline-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/girthline/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that no other call has."""
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Spark's setting by which a query deletes its shuffles when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the queries inside are deleted with each query, not when the driver happens to collect its garbage:
    what they made is in a table then. The session's setting is left as it was."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def saved(parts: Iterable[DataFrame], path: str) -> DataFrame:
    """The rows of all the parts as one table at a path, in place of what is there. Each part is a query of its own, whose
    shuffles are gone before the next is asked for; the table has its marker only when all are there."""
    parts = iter(parts)
    part, first = next(parts), True
    spark, schema = part.sparkSession, part.schema
    while part is not None:
        with shuffles_end(spark):
            # A marker can't be taken back, so it is written last.
            part.write.mode("overwrite" if first else "append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        part, first = next(parts, None), False
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()
    back = spark.read.schema(schema).parquet(path)
    back.girthline_path = path
    return back


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """`df` as a Parquet table in the shared folder."""
    return saved([df], fresh_path(df.sparkSession, label))


def in_rounds(parts: Iterable[DataFrame], label: str = "table") -> DataFrame:
    """As written(), of parts that are made one after the other."""
    parts = iter(parts)
    first = next(parts)
    return saved(chain([first], parts), fresh_path(first.sparkSession, label))


#: Rows of a bucket, about, until there are as many buckets as shuffles have partitions.
BUCKET_ROWS = 50_000


def bucketed(df: DataFrame, path: str, column: str) -> DataFrame:
    """`df` as a table of buckets of `column` at a path, written unless it is there to its end, so that joins on the
    column need not shuffle it again. The session knows it by a name of its own."""
    spark, name = df.sparkSession, f"girthline_{uuid.uuid4().hex}"
    if finished(spark, path):
        # Written under another setting, perhaps: the number of buckets is kept beside the table.
        n = spark.read.parquet(f"{path}-buckets").first()["n"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({column}) SORTED BY ({column}) INTO {n} BUCKETS")
    else:
        n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + df.count() // BUCKET_ROWS)
        spark.range(1).selectExpr(f"{n} AS n").write.mode("overwrite").parquet(f"{path}-buckets")
        with shuffles_end(spark):
            df.repartition(n, column).write.mode("overwrite").format("parquet").bucketBy(n, column).sortBy(column).option("path", path).saveAsTable(name)
    return spark.table(name)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end: Spark's writers leave a marker."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def forget(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing reads it any more."""
    path = getattr(df, "girthline_path", None)
    if path:
        remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Results that were not written elsewhere can't be read any more."""
    remove(spark, own_dir(spark))
