"""Detection events as a stream, in sliding windows of two consecutive layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path

#: A window's row: when its first layer began, its events, and its detectors that fired an odd number of times.
WINDOWS = "start timestamp, events long, dets array<long>"


def layer_windows(events: DataFrame, layer: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """start, events, dets of each two consecutive layers, from events (ts, det); each layer is in two windows.

    An event that comes after others counts as long as it is at most `delay` older than the newest of the batches before;
    beyond that it is dropped, as its windows may be closed. As a stream, a window is given once, when it is closed. State
    is one row for each detector of an open window. Events without time or detector take no part.
    """
    x = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("det").cast("long").alias("det")).dropna().withWatermark("ts", delay)
    double = f"{2 * int(layer.split()[0])} {layer.split()[1]}"
    fired = x.groupBy(F.window("ts", double, layer), "det").agg(F.count("*").alias("n"))
    y = fired.groupBy("window").agg(F.sum("n").alias("events"), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("n") % 2 == 1, F.col("det"))))).alias("dets"))
    return y.select(F.col("window.start").alias("start"), "events", "dets")


def read_events(spark: SparkSession, path: str, ts: str, det: str, files: int | None = None) -> DataFrame:
    """A stream of (ts, det) from the files of a table, `files` at most in a batch."""
    pattern = path if set(path) & set("*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = stream.option("maxFilesPerTrigger", files) if files else stream
    return stream.parquet(pattern).select(F.expr(ts).alias("ts"), F.expr(det).alias("det"))


def written_windows(windows: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of windows over what is there, and gives all windows closed so far. <folder>/checkpoint holds what
    was read and the open windows, so a later run goes on from there; <folder>/windows the closed ones, each once."""
    folder = folder.rstrip("/")
    windows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return windows.sparkSession.read.schema(WINDOWS).parquet(f"{folder}/windows")


def windows_of(spark: SparkSession, path: str, ts: str, det: str, **how: str) -> DataFrame:
    """The closed windows of a table of events, by a stream into a new folder."""
    return written_windows(layer_windows(read_events(spark, path, ts, det), **how), fresh_path(spark, "windows"))
