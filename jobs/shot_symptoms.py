"""Incremental: logs of shots to the columns of an error model.

Each text is the log of one shot, a line for each thing that fired; a line that stands an even number of times cancels
itself. Shots with equal sets of lines have one symptom, which becomes one column with its number of shots and its
share of all shots, the estimate of its probability. Lines are the checks of the matrix, known by their MD5.

The table is read as a stream of files, so a run takes only files that no run before it has taken. Each batch leaves one
row a different symptom in its own partition of `shots`, overwritten if the batch runs again; texts are never read twice.
The columns are then made anew from these rows:

    <checkpoint>/files              the stream's own record of what it has taken
    <checkpoint>/shots/batch=..     symptom, weight, checks, shots, first_id        (a row a symptom and batch)
    <output>/width=..               symptom, weight, checks, shots, first_id, p     (a row a symptom; wide ones together)

    python -m jobs.shot_symptoms --input documents.parquet --output out --checkpoint ck [--config jobs/shot_symptoms.json]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girthline.sources.graph import mod2

from .common import log, main

#: id, text: columns of the table. files: most files of a batch. widest: columns of this weight and more share a
#: partition. spread: files of a partition.
DEFAULTS = {"id": "doc_id", "text": "text", "files": 100, "widest": 50, "spread": 16}

SHOTS = "symptom string, weight int, checks array<string>, shots long, first_id long, batch int"
COLUMNS = "symptom string, weight int, checks array<string>, shots long, first_id long, p double, width int"


def symptoms(shots: DataFrame, settings: dict) -> DataFrame:
    """symptom, weight, checks, shots, first_id of a table of shots.

    Lines without a word do not count; null and empty texts are shots in which nothing fired, of weight 0; a null id
    is a shot as others, and is no first_id; repeated rows are shots of their own.
    """
    x = shots.select(F.col(settings["id"]).cast("long").alias("id"), F.col(settings["text"]).alias("text"), F.monotonically_increasing_id().alias("v"))
    lines = x.select("v", F.explode(F.split("text", "\n")).alias("line")).where(r"line RLIKE '[^\\x20\\x09-\\x0D]'")
    fired = mod2(lines.select(F.md5("line").alias("c"), "v")).groupBy("v").agg(F.array_sort(F.collect_list("c")).alias("checks"))
    x = x.select("id", "v").join(fired, "v", "left").withColumn("checks", F.coalesce("checks", F.array().cast("array<string>")))
    x = x.withColumn("symptom", F.md5(F.array_join("checks", ",")))
    return x.groupBy("symptom").agg(F.size(F.any_value("checks")).alias("weight"), F.any_value("checks").alias("checks"), F.count("*").alias("shots"), F.min("id").alias("first_id"))


def run(spark: SparkSession, input: str, output: str, checkpoint: str, settings: dict) -> DataFrame:
    """Takes what is new in `input`, and returns the columns as written: symptom, shots, first_id, p, weight."""
    settings = {**DEFAULTS, **settings}
    checkpoint, taken = checkpoint.rstrip("/"), []

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        rows = symptoms(batch, settings).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{checkpoint}/shots")
        taken.append(number)
        log.info("batch %d: %d shots read from %s", number, batch.count(), input)
        batch.unpersist()

    # A stream of a path wants a folder; as a pattern the path may be a single file too.
    pattern = input if set(input) & set("*?[{") else f"{input.rstrip('/')[:-1]}[{input.rstrip('/')[-1]}]"
    table = spark.readStream.schema(spark.read.parquet(input).schema).option("maxFilesPerTrigger", settings["files"]).parquet(pattern)
    table.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/files").trigger(availableNow=True).start().awaitTermination()
    if not taken:
        log.info("nothing new in %s", input)
    merged(spark.read.schema(SHOTS).parquet(f"{checkpoint}/shots"), settings).write.mode("overwrite").partitionBy("width").parquet(output)
    columns = spark.read.schema(COLUMNS).parquet(output)
    log.info("%d columns written to %s", columns.count(), output)
    return columns


def merged(shots: DataFrame, settings: dict) -> DataFrame:
    """Columns from the batches' rows. They follow from these alone, so a run that stopped while writing does no harm."""
    every = shots.agg(F.sum("shots").alias("n")).first()["n"] or 1
    x = shots.groupBy("symptom", "weight").agg(F.any_value("checks").alias("checks"), F.sum("shots").alias("shots"), F.min("first_id").alias("first_id"))
    x = x.withColumn("p", F.col("shots") / F.lit(float(every))).withColumn("width", F.least("weight", F.lit(settings["widest"])))
    # A width's rows are spread over tasks, since most symptoms may have the same.
    return x.repartition("width", F.pmod(F.xxhash64("symptom"), F.lit(settings["spread"])))


if __name__ == "__main__":
    main(run, DEFAULTS, __doc__.splitlines()[0], __file__)
