"""Check matrices in alist text: dimensions, largest degrees, degrees, then the neighbours of each node, 1-based."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Tanner
from .scratch import written

#: Lines of a file, degrees of a piece of a degree line, and numbers of a batch, about.
LINES, PIECE, NUMBERS = 1_000_000, 100_000, 1_000_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """no, line: the lines that aren't blank, counted from 0, with one space between numbers. Any white space separates.
    A file is read in splits; those of a folder follow one another by name."""
    text = F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), text).where("line <> ''")
    x = written(x.withColumn("id", F.monotonically_increasing_id()), "alist")
    # Ids are consecutive inside a split.
    splits = x.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = splits.withColumn("before", F.sum("n").over(Window.orderBy("file", "split")) - F.col("n"))
    return x.join(F.broadcast(before.drop("n")), ["file", "split"]).select((F.col("id") - F.col("first") + F.col("before")).alias("no"), "line")


def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """no, at, x: the numbers of lines with their places; a line may have any length."""
    for b in batches:
        n = pc.add(pc.count_substring(b.column("line"), " "), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        xs = np.fromstring(" ".join(b.column("line").to_pylist()), np.int32, sep=" ")
        if len(xs) != n.sum():
            raise ValueError("an alist holds numbers only")
        row = np.repeat(np.arange(len(n)), n)
        no, place = b.column("no").to_numpy()[row], np.arange(len(xs)) - (np.cumsum(n) - n)[row]
        for k in range(0, len(xs), NUMBERS):
            s = slice(k, k + NUMBERS)
            yield pa.RecordBatch.from_pydict({"no": pa.array(no[s]), "at": pa.array(place[s].astype(np.int32)), "x": pa.array(xs[s])})


def read(spark: SparkSession, path: str, columns_first: bool = True, checked: bool = True) -> Tanner:
    """The graph of an alist file, or of a folder of ordered files. `columns_first`: the header gives columns before
    rows, and their lists come first.

    The degree lines may be missing. With `checked`, degrees, their largest values and both sides' lists must agree.
    """
    text = lines(spark, path)
    head = {r["no"]: [int(x) for x in r["line"].split(" ")] for r in text.where("no < 2").collect()}
    first, second = head[0]
    size = {r["no"]: r["n"] for r in text.where("no BETWEEN 2 AND 3").selectExpr("no", "length(line) - length(replace(line, ' ', '')) + 1 AS n").collect()}
    degrees = size.get(2, 0) == first and size.get(3, 0) == second
    x = written(text.mapInArrow(numbers, "no long, at int, x int"), "numbers")
    start = 4 if degrees else 2
    node = (F.col("no") - start).cast("int")
    near = x.where(F.col("no").between(start, start + first - 1) & (F.col("x") != 0)).select((F.col("x") - 1).alias("c"), node.alias("v"))
    far = x.where(F.col("no").between(start + first, start + first + second - 1) & (F.col("x") != 0)).select((node - first).alias("c"), (F.col("x") - 1).alias("v"))
    if checked:
        both = near.withColumn("n", F.lit(1)).unionByName(far.withColumn("n", F.lit(-1)))
        if not both.groupBy("c", "v").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty():
            raise ValueError("the two sides of the alist disagree")
        if degrees:
            for k, side in ((2, "v"), (3, "c")):
                given = x.where(F.col("no") == k).select("at", "x")
                found = given.join(near.groupBy(F.col(side).alias("at")).count(), "at", "left")
                if not found.where(F.col("x") != F.coalesce("count", F.lit(0))).isEmpty() or (given.agg(F.max("x")).first()[0] or 0) != head[1][k - 2]:
                    raise ValueError("the degrees of the alist disagree with its lists")
    edges = near if columns_first else near.select(F.col("v").alias("c"), F.col("c").alias("v"))
    dimensions = (second, first) if columns_first else (first, second)
    return Tanner(edges, *dimensions)


def parameters(graph: Tanner) -> dict[str, float]:
    """n, k = n - m and the rate k / n of the code that a check matrix defines when its rows are independent."""
    n, k = graph.variables, graph.variables - graph.checks
    return {"n": n, "k": k, "rate": k / n}


def as_lines(graph: Tanner) -> DataFrame:
    """no, line: the alist text of a graph, padded with zeros."""
    spark = graph.edges.sparkSession

    def side(key: str, other: str, size: int) -> DataFrame:
        lists = graph.edges.groupBy(key).agg(F.sort_array(F.collect_list(F.col(other) + 1)).alias("xs"))
        return written(spark.range(size).join(lists, F.col("id") == F.col(key), "left").select("id", F.coalesce("xs", F.array().cast("array<int>")).alias("xs")), "side")

    text = lambda xs: F.array_join(xs.cast("array<string>"), " ")

    def degrees(x: DataFrame, no: int) -> DataFrame:
        """One line: the texts of pieces, joined."""
        piece = x.groupBy(F.floor(F.col("id") / PIECE).alias("k")).agg(F.sort_array(F.collect_list(F.struct("id", F.size("xs").alias("d")))).alias("ds"))
        line = F.sort_array(F.collect_list(F.struct("k", text(F.col("ds.d")).alias("text"))))
        return piece.agg(line.alias("ts")).select(F.lit(no).cast("long").alias("no"), F.array_join("ts.text", " ").alias("line"))

    v, c = side("v", "c", graph.variables), side("c", "v", graph.checks)
    most = [x.agg(F.coalesce(F.max(F.size("xs")), F.lit(0))).first()[0] for x in (v, c)]
    padded = lambda m: F.concat("xs", F.array_repeat(F.lit(0), F.lit(m) - F.size("xs")))
    out = spark.createDataFrame([(0, f"{graph.variables} {graph.checks}"), (1, f"{most[0]} {most[1]}")], "no long, line string")
    out = out.unionByName(degrees(v, 2)).unionByName(degrees(c, 3)).unionByName(v.select((F.col("id") + 4).alias("no"), text(padded(most[0])).alias("line")))
    return out.unionByName(c.select((F.col("id") + 4 + graph.variables).alias("no"), text(padded(most[1])).alias("line")))


def write(graph: Tanner, path: str, rows: int = LINES) -> None:
    """The lines of a graph as a folder of text files of about `rows` lines, which follow one another by name."""
    parts = -(-(4 + graph.variables + graph.checks) // rows)
    as_lines(graph).repartitionByRange(parts, "no").sortWithinPartitions("no").select("line").write.text(path)
