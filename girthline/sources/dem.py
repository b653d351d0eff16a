"""Detector error models: their text form, and the matrices that they define."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Tanner, with_sum_before
from .scratch import written

ERRORS = "idx long, p double, dets array<int>, obs array<int>"
#: Line ends that only Python knows, lines on which others depend, and errors.
ENDS, SPACE = r"[\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]", r"(?iU)^[\s\x1f]*"
SEQUENTIAL, ERROR = SPACE + r"(\}|repeat(?!\w)|shift_detectors(?!\w))", SPACE + r"error(?!\w)"
LINE = re.compile(r"^\s*(\w+)(?:\[[^\]]*\])?(?:\(([^)]*)\))?\s*([^#{]*)")


def flattened(text: str) -> Iterator[tuple[str, list[float], list[str]]]:
    """Instructions with repeat blocks unrolled and detector shifts applied, in order."""
    lines = text.splitlines()

    def block(i: int, shift: int) -> Iterator:
        """Yields instructions; returns the line after the block and the shift at its end."""
        while i < len(lines):
            line = lines[i].split("#")[0].strip()
            i += 1
            if line == "}":
                return i, shift
            m = LINE.match(line)
            if not line or not m:
                continue
            name, args, targets = m[1].lower(), [float(x) for x in (m[2] or "").split(",") if x.strip()], m[3].split()
            if name == "repeat":
                end = i
                for _ in range(int(targets[0])):
                    end, shift = yield from block(i, shift)
                if int(targets[0]) == 0:
                    depth = 1
                    while depth:
                        depth += lines[end].count("{") - lines[end].count("}")
                        end += 1
                i = end
            elif name == "shift_detectors":
                shift += int(targets[0]) if targets else 0
            else:
                yield name, args, [f"D{int(t[1:]) + shift}" if t[0] == "D" else t for t in targets]
        return i, shift

    yield from block(0, 0)


def parse(text: str) -> Iterator[tuple[int, float, list[int], list[int]]]:
    """idx, p, detectors and observables of each error; a target that repeats in one error counts once."""
    k = 0
    for name, args, targets in flattened(text):
        if name == "error":
            pick = lambda c: sorted({int(t[1:]) for t in targets if t[0] == c})
            yield k, args[0], pick("D"), pick("L")
            k += 1


def texts(spark: SparkSession, path: str) -> tuple[bool, DataFrame]:
    """Whether a model, a file or a folder of ordered files, has no blocks and shifts, and its value: then its lines,
    of which none depends on another, with file and split; else the whole file, as repeat blocks are sequential."""
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.explode(F.split("value", ENDS)).alias("value"))
    if x.where(F.col("value").rlike(SEQUENTIAL)).isEmpty():
        return True, x
    whole = spark.read.text(path, wholetext=True)
    if len(whole.inputFiles()) > 1:
        raise ValueError("a model with blocks or shifts must be one file")
    return False, whole


def read(spark: SparkSession, path: str) -> DataFrame:
    """Errors of a model file, or of a folder of files that follow one another by name: idx, p, dets, obs. It is read in
    splits; only a file with blocks or shifts is parsed by one task."""
    apart, x = texts(spark, path)

    def one_by_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *row[1:]) for k, row in zip(b["idx"], parse("\n".join(b["value"])), strict=True)]
            yield pd.DataFrame(rows, columns=["idx", "p", "dets", "obs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                rows = []
                for row in parse(text):
                    rows.append(row)
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=["idx", "p", "dets", "obs"])
                        rows = []
                yield pd.DataFrame(rows, columns=["idx", "p", "dets", "obs"])

    if not apart:
        return x.mapInPandas(run, ERRORS)
    x = written(x.where(F.col("value").rlike(ERROR)).withColumn("id", F.monotonically_increasing_id()), "model")
    # Ids are consecutive inside a split.
    splits = x.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = splits.withColumn("before", F.sum("n").over(Window.orderBy("file", "split")) - F.col("n")).drop("n")
    x = x.join(F.broadcast(before), ["file", "split"]).select((F.col("id") - F.col("first") + F.col("before")).alias("idx"), "value")
    return x.mapInPandas(one_by_one, ERRORS)


def declared_in(spark: SparkSession, path: str) -> tuple[int, int]:
    """declared() of a model."""
    apart, x = texts(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([declared(t) for t in (["\n".join(b["value"])] if apart else b["value"])], columns=["d", "o"])

    found = x.select("value").mapInPandas(run, "d int, o int").agg(F.max("d"), F.max("o")).first()
    return found[0] or 0, found[1] or 0


def declared(text: str) -> tuple[int, int]:
    """Numbers of detectors and observables: one more than the largest named anywhere."""
    d = o = 0
    for _, _, targets in flattened(text):
        for t in targets:
            if t[0] == "D":
                d = max(d, int(t[1:]) + 1)
            elif t[0] == "L":
                o = max(o, int(t[1:]) + 1)
    return d, o


def numbered(df: DataFrame, key: str, name: str, parts: int = 256) -> DataFrame:
    """`df` with numbers from 0 in ascending order of a numeric column without ties, as ints."""
    return with_sum_before(df, key, F.lit(1), name, parts).withColumn(name, F.col(name).cast("int"))


def merged(errors: DataFrame, combine: str = "sum") -> DataFrame:
    """v, p, dets, obs: one column for each different symptom, in order of first appearance.

    combine: `sum` adds probabilities (as the matrices here are defined), `xor` gives that of an odd number of errors.
    """
    p = F.sum("p") if combine == "sum" else (1 - F.product(1 - 2 * F.col("p"))) / 2
    x = errors.select("idx", "p", F.array_sort(F.array_distinct("dets")).alias("dets"), F.array_sort(F.array_distinct("obs")).alias("obs"))
    x = x.groupBy("dets", "obs").agg(p.alias("p"), F.min("idx").alias("first"))
    # Numbering reads them more than once.
    return numbered(written(x, "merged"), "first", "v").select("v", "p", "dets", "obs")


def matrices(columns: DataFrame, detectors: int | None = None, observables: int | None = None) -> tuple[Tanner, Tanner, DataFrame]:
    """Check matrix, observable matrix and priors (v, p) of merged columns."""
    most = columns.agg(F.max(F.array_max("dets")).alias("d"), F.max(F.array_max("obs")).alias("o"), F.count("*").alias("n")).first()
    side = lambda c: columns.select(F.explode(c).alias("c"), F.col("v").cast("int").alias("v"))
    size = lambda given, found: given if given is not None else (found if found is not None else -1) + 1
    return Tanner(side("dets"), size(detectors, most["d"]), most["n"]), Tanner(side("obs"), size(observables, most["o"]), most["n"]), columns.select("v", "p")
