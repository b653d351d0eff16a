"""Linear algebra over GF(2) on edge tables. Elimination is sequential, so a matrix is one task's work; it runs on an
executor, with rows as bit masks, and the driver sees results only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gf2
from ..sources.codes import Css, transposed
from ..sources.graph import Tanner

ENTRIES = "part string, c int, v int"


def masks(pdf: pd.DataFrame, rows: int) -> list[int]:
    out = [0] * rows
    for c, v in zip(pdf["c"], pdf["v"]):
        out[int(c)] ^= 1 << int(v)
    return out


def entries(part: str, rows: list[int]) -> list[tuple[str, int, int]]:
    return [(part, i, j) for i, r in enumerate(rows) for j in range(r.bit_length()) if r >> j & 1]


def apply(graph: Tanner, work) -> DataFrame:
    """work(rows, columns) -> list of (part, c, v), run once for the whole matrix, also for one without ones."""
    size, n = graph.checks, graph.variables
    spark = graph.edges.sparkSession
    one = spark.range(1).select(F.lit(-1).alias("c"), F.lit(-1).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(work(masks(pdf[pdf["c"] >= 0], size), n), columns=["part", "c", "v"])

    return graph.edges.select("c", "v").unionByName(one).groupBy(F.lit(0).alias("g")).applyInPandas(run, ENTRIES)


def row_echelon(graph: Tanner, reduced: bool = False) -> DataFrame:
    """part (form, transform, pivot), c, v: entries of the echelon form and its transform, and pivots (c-th is column v)."""

    def work(rows: list[int], n: int) -> list:
        a, t, pivots = gf2.eliminate(rows, n, reduced)
        return entries("form", a) + entries("transform", t) + [("pivot", i, p) for i, p in enumerate(pivots)]

    return apply(graph, work)


def rank(graph: Tanner) -> int:
    return row_echelon(graph).where("part = 'pivot'").count()


def kernel(graph: Tanner) -> DataFrame:
    """c, v: a basis (c numbers its vectors) of what the matrix takes to zero."""

    def work(rows: list[int], n: int) -> list:
        _, t, pivots = gf2.eliminate(gf2.transposed(rows, n), len(rows))
        return entries("kernel", t[len(pivots) :])

    return apply(graph, work).select("c", "v")


def row_basis(graph: Tanner) -> DataFrame:
    """c, v: the first independent rows, numbered anew."""

    def work(rows: list[int], n: int) -> list:
        return entries("basis", [rows[i] for i in gf2.eliminate(gf2.transposed(rows, n), len(rows))[2]])

    return apply(graph, work).select("c", "v")


def parameters(code: Css) -> dict[str, int]:
    """n, k, and the least weight of a basis of logical operators (a bound on the distance, not the distance)."""
    k = code.hx.variables - rank(code.hx) - rank(code.hz)
    lx, lz = logicals(code)
    least = min((x.groupBy("c").count().agg(F.min("count")).first()[0] or 0 for x in (lx, lz)), default=0)
    return {"n": code.hx.variables, "k": k, "min_basis_weight": least}


def logicals(code: Css) -> tuple[DataFrame, DataFrame]:
    """lx and lz as edge tables."""
    both = code.hx.edges.select(F.lit("x").alias("m"), "c", "v").unionByName(code.hz.edges.select(F.lit("z").alias("m"), "c", "v"))
    n, mx, mz = code.hx.variables, code.hx.checks, code.hz.checks

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, z = (gf2.matrix_of(masks(pdf[pdf["m"] == k], size), n) for k, size in (("x", mx), ("z", mz)))
        lx, lz = gf2.logical_operators(x, z)
        rows = [(k, int(c), int(v)) for k, a in (("x", lx), ("z", lz)) for c, v in np.argwhere(a)]
        return pd.DataFrame(rows, columns=["part", "c", "v"])

    found = both.groupBy(F.lit(0).alias("g")).applyInPandas(run, ENTRIES)
    return tuple(found.where(F.col("part") == k).select("c", "v") for k in "xz")


__all__ = ["kernel", "logicals", "parameters", "rank", "row_basis", "row_echelon", "transposed"]
