"""From a code's name to its trapping sets, as a function and as a command."""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import linear
from ..sources import circuit, codes, dem, supports
from ..sources.graph import Tanner, degree_set
from ..sources.scratch import clear, written
from .bounds import bounds_by_size
from .enumerate import Result, enumerate_sets

#: Physical error rate and girth of the detector graphs.
ERROR_RATE, GIRTH = 1e-3, 4


def rows_of(edges: DataFrame, height: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(height)]
    for r in edges.orderBy("c", "v").collect():
        out[r["c"]].append(r["v"])
    return out


def gates_of(spark: SparkSession, name: str, rounds: int | None, p: float) -> tuple[codes.Css, list[circuit.Gate], int]:
    """A preset's code, the gates of its memory experiment, and the rounds."""
    code, a, b, usual = codes.preset(spark, name)
    rounds = usual if rounds is None else rounds
    if rounds <= 0:
        raise ValueError("rounds must be positive")
    logical = linear.logicals(code)[1]
    size = logical.agg({"c": "max"}).first()[0]
    terms = [[circuit.permutation(t) for t in side] for side in (a, b)]
    gates = circuit.memory_circuit(code.hx.variables // 2, *terms, rows_of(code.hz.edges, code.hz.checks), rows_of(logical, (size if size is not None else -1) + 1), p, rounds)
    return code, gates, rounds


def detector_columns(spark: SparkSession, name: str, rounds: int | None = None, p: float = ERROR_RATE) -> tuple[codes.Css, DataFrame, Tanner, int]:
    """A preset's code, merged error columns, detector matrix and rounds."""
    code, gates, rounds = gates_of(spark, name, rounds, p)
    columns = written(dem.merged(circuit.error_table(spark, gates)), "columns")
    return code, columns, dem.matrices(columns, (rounds + 1) * code.hz.checks)[0], rounds


def enumerate_graph(graph: Tanner, amax: int, bmax: int, girth: int = GIRTH, leaves: bool = False, singletons: bool = False, verbose: bool = False) -> Result:
    """Enumerate with the bounds that a class (amax, up to bmax) needs, and all degrees of the graph allowed."""
    degrees = degree_set(graph.edges, graph.variables)
    if 0 in degrees:
        raise ValueError("a column of the matrix has no entry: its variable has degree 0")
    return enumerate_sets(graph, girth, amax, bounds_by_size(amax, bmax, degrees, girth), degrees, leaves, singletons, verbose)


def enumerate_preset(spark: SparkSession, name: str, amax: int = 5, bmax: int = 5, rounds: int | None = None, leaves: bool = False, singletons: bool = False, verbose: bool = False) -> Result:
    return enumerate_graph(detector_columns(spark, name, rounds)[2], amax, bmax, GIRTH, leaves, singletons, verbose)


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Enumerate elementary trapping sets of a code's detector error model.")
    p.add_argument("--code", default="144")
    p.add_argument("--dem", help="a detector error model file instead of a code")
    p.add_argument("--rounds", type=int)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--amax", type=int, default=5)
    p.add_argument("--bmax", type=int, default=5)
    p.add_argument("--etsl", action="store_true", help="also sets with leaves")
    p.add_argument("--singleton-etsl-seeds", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(argv)
    if a.amax <= 0 or a.bmax < 0 or a.rounds is not None and a.rounds <= 0:
        p.error("--amax and --rounds must be positive, --bmax not negative")
    if a.singleton_etsl_seeds and not a.etsl:
        p.error("--singleton-etsl-seeds needs --etsl")
    if not a.dem:
        codes.preset_name(a.code)
    return a


def main(argv: Sequence[str] | None = None) -> None:
    """Search first, then clear and fill the output folder, so that a failed search deletes nothing."""
    a, start = arguments(argv), time.time()
    spark = SparkSession.builder.appName("girthline").getOrCreate()
    if not a.overwrite:
        supports.prepare_output(spark, a.output_dir)
    graph = dem.matrices(written(dem.merged(dem.read(spark, a.dem)), "columns"), *dem.declared_in(spark, a.dem))[0] if a.dem else detector_columns(spark, a.code, a.rounds)[2]
    result = enumerate_graph(graph, a.amax, a.bmax, GIRTH, a.etsl, a.singleton_etsl_seeds, not a.quiet)
    supports.write_classes(result.supports, a.output_dir, a.overwrite)
    for r in result.counts.orderBy("a", "b").collect():
        print(f"({r['a']}, {r['b']}): {r['n']}")
    print(f"{result.written_supports} supports in {time.time() - start:.1f} s")
    clear(spark)


if __name__ == "__main__":
    main()
