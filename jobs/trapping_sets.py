"""Batch: an edge table to its elementary trapping sets by class.

Reads two columns of a table as the edges of a Tanner graph, searches all sets up to a size, and writes them with their
class counts. The search keeps finished layers in the checkpoint folder, so a run that was stopped goes on where it was;
they are deleted once the results are written. A run over the same edges with the same settings finds its search named
beside the results: it counts the sets again, and leaves them if the classes are as they were, else it makes all anew.

    <output>/sets/a=../b=..     vs, kind       (a row a set)
    <output>/counts             a, b, kind, n  (a row a class)
    <output>/search             key            (one row, of a finished run)

    python -m jobs.trapping_sets --input edges.parquet --output out --checkpoint ck [--config jobs/trapping_sets.json]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girthline.plans.bounds import Search, bounds_by_size
from girthline.plans.enumerate import enumerate_sets, graph_key
from girthline.sources.graph import degree_set, from_edges
from girthline.sources.scratch import finished, remove, saved, shuffles_end

from .common import log, main

#: check, variable: columns of the table; distinct: count repeated rows as one edge. bounds: the bound on b by size, or
#: null to take it from the degrees and bmax. spread: files of a class.
DEFAULTS = {"check": "c", "variable": "v", "distinct": True, "girth": 4, "amax": 3, "bmax": 3, "bounds": None, "leaves": False, "singletons": False, "spread": 8}

SETS = "vs array<int>, kind string, a int, b int"


def by_class(sets: DataFrame) -> DataFrame:
    return sets.groupBy("a", "b", "kind").agg(F.count("*").alias("n"))


def still_there(spark: SparkSession, output: str, key: str) -> bool:
    """Whether a run of this search has finished and its sets are there by their classes."""
    if not finished(spark, f"{output}/search") or spark.read.parquet(f"{output}/search").first()["key"] != key:
        return False
    rows = lambda df: sorted(map(tuple, df.select("a", "b", "kind", "n").collect()))
    return all(finished(spark, f"{output}/{t}") for t in ("sets", "counts")) and rows(by_class(spark.read.schema(SETS).parquet(f"{output}/sets"))) == rows(spark.read.parquet(f"{output}/counts"))


def run(spark: SparkSession, input: str, output: str, checkpoint: str, settings: dict) -> DataFrame:
    """Writes the sets, and returns them as written: vs, kind, a, b."""
    s = {**DEFAULTS, **settings}
    output = output.rstrip("/")
    edges = spark.read.parquet(input).select(F.col(s["check"]).cast("int").alias("c"), F.col(s["variable"]).cast("int").alias("v")).dropna()
    # Written once: the search and its name read the edges several times.
    saved([edges.distinct() if s["distinct"] else edges], f"{checkpoint.rstrip('/')}/edges")
    graph = from_edges(spark.read.schema("c int, v int").parquet(f"{checkpoint.rstrip('/')}/edges"))
    log.info("%d checks and %d variables at most in %s", graph.checks, graph.variables, input)
    degrees = [] if s["bounds"] else degree_set(graph.edges)
    bounds = s["bounds"] or bounds_by_size(s["amax"], s["bmax"], degrees, s["girth"])
    key = graph_key(graph.edges, Search(s["girth"], s["amax"], tuple(bounds), (), s["leaves"], s["singletons"]))
    if still_there(spark, output, key):
        log.info("the sets of this search are in %s/sets", output)
        return spark.read.schema(SETS).parquet(f"{output}/sets")
    remove(spark, f"{output}/search")
    found = enumerate_sets(graph, s["girth"], s["amax"], bounds, leaves=s["leaves"], singletons=s["singletons"], folder=f"{checkpoint.rstrip('/')}/layers")
    for row in found.layers:
        log.info("size %(a)d, %(stage)s: %(raw)d made, %(unique)d different, %(accepted)d accepted", row)
    # A class may hold most of the sets: its rows are spread over tasks.
    spread = F.pmod(F.xxhash64("vs"), F.lit(s["spread"]))
    with shuffles_end(spark):
        found.supports.select("vs", "kind", "a", "b").repartition("a", "b", spread).write.mode("overwrite").partitionBy("a", "b").parquet(f"{output}/sets")
    sets = spark.read.schema(SETS).parquet(f"{output}/sets")
    saved([by_class(sets)], f"{output}/counts")
    saved([spark.range(1).select(F.lit(key).alias("key"))], f"{output}/search")
    log.info("%d sets written to %s/sets", found.written_supports, output)
    remove(spark, found.folder)
    return sets


if __name__ == "__main__":
    main(run, DEFAULTS, __doc__.splitlines()[0], __file__)
