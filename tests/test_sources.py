"""Graphs, codes, files, error models and linear algebra."""

import functools
import itertools
import operator
import random

import numpy as np
import pytest

from girthline.functions import fields, gf2
from girthline.functions.arrays import bin2int, inserted, int2bin, validated_support
from girthline.operators import hooks, linear
from girthline.plans import pipeline
from girthline.sources import alist, circuit, codes, dem, graph, supports
from girthline.streaming import errors as stream
from pyspark.sql import functions as F


def edge_set(df):
    return {(r["c"], r["v"]) for r in df.collect()}


def test_csr_validation(spark):
    g = graph.from_csr(spark, 2, 3, [0, 2, 3], [0, 2, 1])
    assert edge_set(g.edges) == {(0, 0), (0, 2), (1, 1)}
    assert [x.tolist() for x in graph.to_csr(g)] == [[0, 2, 3], [0, 2, 1]]
    for bad in ((-1, 3, [0], []), (2, 3, [0, 1], [0]), (1, 3, [1, 1], []), (2, 3, [0, 2, 1], [0]), (1, 3, [0, 2], [0]), (1, 3, [0, 1], [3])):
        with pytest.raises(ValueError):
            graph.from_csr(spark, *bad)


def test_csr_tables(spark, monkeypatch):
    """The same compressed rows as tables and as arrays, isolated checks and parallel edges included."""
    rows = [(5, 1), (0, 3), (0, 0), (5, 0), (2, 2), (2, 2), (0, 9)]
    g = graph.Tanner(spark.createDataFrame(rows, "c int, v int").repartition(3), 8, 10)
    indptr, indices = graph.csr_tables(g)
    ptr, ind = graph.to_csr(g)
    assert [r["ptr"] for r in indptr.orderBy("k").collect()] == ptr.tolist() == [0, 3, 3, 5, 5, 5, 7, 7, 7]
    assert [r["v"] for r in indices.orderBy("pos").collect()] == ind.tolist()
    back = graph.from_csr_tables(indptr, indices, 8, 10)
    assert sorted(map(tuple, back.edges.collect())) == sorted(rows) and (back.checks, back.variables) == (8, 10)
    bad = [(indptr, 9, 10), (indptr, 7, 10), (indptr, 8, 9), (indptr.where("k <> 3"), 8, 10), (indptr.selectExpr("k", "IF(k = 4, 1L, ptr) AS ptr"), 8, 10), (indptr.selectExpr("k", "ptr + 1 AS ptr"), 8, 10)]
    for table, checks, variables in bad:
        with pytest.raises(ValueError):
            graph.from_csr_tables(table, indices, checks, variables)
    empty = graph.Tanner(g.edges.where("c < 0"), 0, 0)
    assert graph.from_csr_tables(*graph.csr_tables(empty), 0, 0).edges.isEmpty()
    monkeypatch.setattr(graph, "MOST_EDGES", 3)
    with pytest.raises(ValueError):
        graph.to_csr(g)


@pytest.mark.parametrize(
    "make,size",
    [
        (lambda s: codes.surface(s, 3), (6, 13, 6)), (lambda s: codes.rotated_surface(s, 3), (4, 9, 4)), (lambda s: codes.checkerboard_toric(s, 4), (8, 16, 7)),
        (lambda s: codes.generalized_bicycle(s, 7, [0, 1], [0, 3]), (7, 14, 6)), (lambda s: codes.two_block_group(s, 3, 2, 2, [(0, 0), (1, 0), (0, 1)], [(0, 0), (1, 1)], True), None),
        (lambda s: codes.cycle_assemble(s, 7, 3), (21, 50, 19)), (lambda s: codes.euclidean_geometry(s, 2), (16, 21, 9)), (lambda s: codes.quasi_cyclic(s, 7, codes.cyclic_permuting(3, [0, 1]), [0, 1, 3]), None),
    ],
)
def test_codes_are_css(spark, make, size):
    c = codes.checked(make(spark))
    if size:
        assert (c.hx.checks, c.hx.variables, linear.rank(c.hx)) == size


def test_preset_dimensions(spark):
    for name, k, rank in (("72", 12, 30), (" BB90 ", 8, 41)):
        c = codes.checked(codes.preset(spark, name)[0])
        p = linear.parameters(c)
        assert (linear.rank(c.hx), p["k"]) == (rank, k)
    with pytest.raises(ValueError):
        codes.preset_name("73")
    assert codes.weights(codes.preset(spark, "72")[0]) == (3, 6)


def test_girth(spark):
    assert codes.girth(codes.repetition(spark, 5)) == -1
    assert codes.girth(codes.hamming(spark, 3)) == 4
    assert codes.girth(codes.preset(spark, "72")[0].hz) == 6


def test_gf2():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.integers(0, 2, (rng.integers(1, 7), rng.integers(1, 7)))
        form, rank, transform, pivots = gf2.row_echelon(m, True)
        assert (transform @ m % 2 == form).all() and rank == len(pivots)
        ker, r, _ = gf2.kernel(m)
        assert r == rank and len(ker) == m.shape[1] - rank and not (m @ ker.T % 2).any()
        assert gf2.rank(gf2.row_basis(m)) == rank if rank else len(gf2.row_basis(m)) == 0
    tall = np.array([[1, 1, 0], [0, 1, 1], [0, 0, 1], [1, 0, 0]])
    assert (gf2.inverse(tall) @ tall % 2 == np.eye(3)).all()
    with pytest.raises(ValueError):
        gf2.inverse([[1, 1], [1, 1]])
    h = np.array([[1, 1, 0, 1], [0, 1, 1, 1]])
    assert (gf2.make_systematic(h)[0][:, :2] == np.eye(2)).all() and (gf2.make_systematic(h, True)[0][:, 2:] == np.eye(2)).all()
    assert gf2.min_basis_weight([[1, 1, 0], [1, 1, 1]], False) == 2
    lx, lz = np.array([[1, 1, 0, 0], [0, 1, 1, 0]]), np.array([[1, 0, 0, 0], [1, 1, 0, 1]])
    assert (gf2.canonical_logicals(lx, lz) @ lz.T % 2 == np.eye(2)).all()


def test_systematic_form():
    """Pivots and swaps by the rule, column zero warned of, and the same code up to the swaps."""
    h = np.array([[0, 1, 1, 0, 1], [0, 1, 0, 1, 1]])
    form, swaps = gf2.make_systematic(h)
    assert swaps == [(0, 2)] and (form[:, :2] == np.eye(2)).all()
    back = form.copy()
    for i, j in reversed(swaps):
        back[:, [i, j]] = back[:, [j, i]]
    assert gf2.rank(np.vstack([back, h])) == 2
    with pytest.warns(UserWarning, match="zeros"):
        form, swaps = gf2.make_systematic(h, True)
    assert swaps == [(0, 2), (0, 3), (1, 4)] and (form[:, 3:] == np.eye(2)).all()
    with pytest.raises(ValueError):
        gf2.make_systematic(np.array([[1, 1, 0], [1, 1, 0]]))


def test_cyclic_permuting():
    assert codes.cyclic_permuting(3, [0, 1]) == [[0, -1, 1], [1, 0, -1], [-1, 1, 0]] and codes.cyclic_permuting(2, [5, 7]) == [[5, 7], [7, 5]]


def test_fields():
    log, antilog = fields.tables(4, fields.primitive_polynomial(4))
    assert sorted(antilog[:-1]) == list(range(1, 16)) and log[0] == -1
    zech = fields.zech(log, antilog)
    assert sorted(zech) == list(range(1, 15)) and all(antilog[j] == 1 ^ antilog[i] for i, j in zech.items())
    divisor = fields.common_divisor(fields.mask_of([0, 1, 3]), fields.mask_of([0, 7]))
    assert fields.powers_of(divisor) == [0, 1, 3] and fields.mask_of([2, 2, 5]) == 32 and fields.inverse_modulo(3, 7) == 5
    assert fields.common_divisor(0, 6) == 6 and fields.remainder(0b1011, 0b11) == 1
    with pytest.raises(ValueError):
        fields.primitive_polynomial(5)


def test_array_functions(spark):
    one = spark.range(1)
    row = one.select(bin2int(F.array(*map(F.lit, (1, 0, 1)))).alias("x"), bin2int(F.array().cast("array<int>")).alias("none"), int2bin(F.lit(13), 3).alias("low"), inserted(F.array(F.lit(1), F.lit(5)), F.lit(3)).alias("ins")).first()
    assert (row["x"], row["none"], row["low"], row["ins"]) == (5, None, [1, 0, 1], [1, 3, 5])
    for bad in (int2bin(F.lit(-1), 3), inserted(F.array(F.lit(1)), F.lit(1)), validated_support(F.sequence(F.lit(1), F.lit(40)))):
        with pytest.raises(Exception):
            one.select(bad).collect()


def test_alist(spark, tmp_path):
    g = codes.hamming(spark, 3)
    lines = [r["line"] for r in alist.as_lines(g).orderBy("no").collect()]
    path = tmp_path / "h.alist"
    path.write_text("\n".join(x.replace(" ", "  ") for x in lines))
    back = alist.read(spark, str(path))
    assert edge_set(back.edges) == edge_set(g.edges) and (back.checks, back.variables) == (3, 7)
    assert alist.parameters(back) == {"n": 7, "k": 4, "rate": 4 / 7}
    path.write_text("\n".join([*lines[:4], "2 0 0", *lines[5:]]))
    with pytest.raises(ValueError):
        alist.read(spark, str(path))


def test_alist_of_many_files_and_splits(spark, tmp_path, monkeypatch):
    """Files follow one another by name and are read in splits; long degree lines are made in pieces and read as numbers."""
    monkeypatch.setattr(alist, "PIECE", 30)
    monkeypatch.setattr(alist, "NUMBERS", 7)
    rng = random.Random(4)
    edges = sorted({(rng.randrange(150), rng.randrange(400)) for _ in range(1200)})
    g = graph.from_edges(spark.createDataFrame(edges, "c int, v int"), 151, 401)
    alist.write(g, str(tmp_path / "many"), rows=50)
    parts = sorted((tmp_path / "many").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert len(parts) > 5 and text.splitlines() == [r["line"] for r in alist.as_lines(g).orderBy("no").collect()]
    (tmp_path / "one.alist").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for name in ("many", "one.alist"):
            back = alist.read(spark, str(tmp_path / name))
            assert edge_set(back.edges) == set(edges) and (back.checks, back.variables) == (151, 401)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wrong = text.splitlines()
    degrees = wrong[2].split(" ")
    wrong[2] = " ".join([str(int(degrees[0]) + 1), *degrees[1:]])
    (tmp_path / "one.alist").write_text("\n".join(wrong))
    with pytest.raises(ValueError):
        alist.read(spark, str(tmp_path / "one.alist"))


def test_class_files(spark, tmp_path):
    rows = [(2, 1, [3, 4], "leafless"), (2, 1, [0, 9], "leafy"), (3, 0, [1, 2, 10], "leafless")]
    sets = spark.createDataFrame(rows, "a int, b int, vs array<int>, kind string")
    out = str(tmp_path / "out")
    assert supports.write_classes(sets, out) == ["a_2_b_1.csv", "a_3_b_0.csv"]
    assert (tmp_path / "out" / "a_2_b_1.csv").read_text() == "0,9\n3,4\n"
    got = {(r["a"], r["b"], tuple(r["vs"])) for r in supports.read_classes(spark, out).collect()}
    assert got == {(a, b, tuple(v)) for a, b, v, _ in rows}
    with pytest.raises(FileExistsError):
        supports.write_classes(sets, out)
    supports.write_classes(sets.where("a = 3"), out, overwrite=True)
    assert not (tmp_path / "out" / "a_2_b_1.csv").exists()


def test_a_class_of_many_files(spark, tmp_path):
    """A class beyond a task's rows is a folder of files in ascending order; smaller ones stay single files."""
    rows = [(2, 1, [i, i + 7]) for i in range(500)] + [(3, 0, [1, 2, 10]), (3, 1, [5, 6, 7])]
    sets, out = spark.createDataFrame(rows, "a int, b int, vs array<int>").repartition(5), tmp_path / "out"
    assert supports.write_classes(sets, str(out), rows=100) == ["a_2_b_1.csv", "a_3_b_0.csv", "a_3_b_1.csv"]
    parts = sorted((out / "a_2_b_1.csv").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert len(parts) > 3 and text == "".join(f"{i},{i + 7}\n" for i in range(500)) and (out / "a_3_b_0.csv").is_file()
    got = sorted((r["a"], r["b"], r["vs"]) for r in supports.read_classes(spark, str(out)).collect())
    assert got == sorted(rows) and not list(out.glob(".stage*"))


DEM = """error(0.1) D0 D1 L0
repeat 2 {
    error[x](0.01) D1 D0 ^ D1 D2  # D1 counts once
    shift_detectors(0, 1) 1
}
repeat 0 {
    error(0.5) D77
}
detector(1, 2) D3
logical_observable L1
error(0.2) D1 L0
error(0.3) D3 D2 L0
"""


def test_error_model(spark, tmp_path):
    path = tmp_path / "a.dem"
    path.write_text(DEM)
    rows = dem.read(spark, str(path)).orderBy("idx").collect()
    assert [(r["dets"], r["obs"]) for r in rows] == [([0, 1], [0]), ([0, 1, 2], []), ([1, 2, 3], []), ([3], [0]), ([4, 5], [0])]
    assert dem.declared(DEM) == (6, 2)
    twice = spark.createDataFrame([(0, 0.1, [1, 0], [0]), (1, 0.2, [3], []), (2, 0.3, [0, 1], [0])], dem.ERRORS)
    cols = dem.merged(twice).orderBy("v").collect()
    assert [(r["v"], round(r["p"], 9), r["dets"]) for r in cols] == [(0, 0.4, [0, 1]), (1, 0.2, [3])]
    assert round(dem.merged(twice, "xor").where("v = 0").first()["p"], 9) == round(0.1 * 0.7 + 0.3 * 0.9, 9)
    h, o, p = dem.matrices(dem.merged(twice), 5)
    assert (h.checks, h.variables, o.checks) == (5, 2, 1) and edge_set(h.edges) == {(0, 0), (1, 0), (3, 1)} and p.count() == 2
    lines = spark.createDataFrame([(x,) for x in DEM.splitlines()], "value string")
    got = stream.symptoms(stream.parsed(lines.where("NOT value RLIKE 'repeat|shift|D1 D2'"))).count()
    assert got == 4


def test_error_model_of_many_files_and_splits(spark, tmp_path, monkeypatch):
    """Without blocks and shifts a model is read in splits and files follow by name; errors keep their numbers."""
    text = [f"error({(1 + i % 5) / 16}) D{i % 13} D{i * 7 % 31} L{i % 2}{' # repeat' * (i % 3)}" for i in range(3000)]
    text[5:5] = ["", "detector(1) D40", "  # error(0.5) D9", "logical_observable L3", "errors D1"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/part-00001").write_text("\n".join(text[1400:]) + "\x0cERROR[x](0.5) D44")
    (tmp_path / "m/part-00000").write_text("\n".join(text[:1400]) + "\n")
    (tmp_path / "one").write_text("\n".join(text) + "\nerror(0.5) D44")
    want = [tuple(x) for x in dem.parse((tmp_path / "one").read_text())]
    assert len(want) == 3001 and [x[0] for x in want] == list(range(3001))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        for path in ("m", "one"):
            rows = dem.read(spark, str(tmp_path / path))
            assert rows.rdd.getNumPartitions() > 5 and [tuple(r) for r in rows.orderBy("idx").collect()] == want
            assert dem.declared_in(spark, str(tmp_path / path)) == (45, 4)
        (tmp_path / "m/part-00002").write_text("shift_detectors 1\n")
        with pytest.raises(ValueError, match="one file"):
            dem.read(spark, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream_of_errors(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.dem").write_text("error(0.25) D0 D1\nerror(0.5) D1 D0\ndetector D0\n")
    q = stream.symptoms(stream.read_stream(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("symptoms").start()
    try:
        q.processAllAvailable()
        assert [(r["dets"], r["p"], r["n"]) for r in spark.sql("SELECT * FROM symptoms").collect()] == [([0, 1], 0.75, 2)]
    finally:
        q.stop()


def test_stream_of_tags_and_blocks(spark):
    """Tagged errors count; blocks and shifts, which need an order, are an error and not silently wrong."""
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert [tuple(r) for r in stream.parsed(lines("error[t](0.2) D5 L1 # D9", "  error(0.1) D1", "detector D7")).orderBy("p").collect()] == [(0.1, [1], []), (0.2, [5], [1])]
    for bad in ("repeat 3 {", "shift_detectors 2"):
        with pytest.raises(Exception, match="unroll"):
            stream.parsed(lines("error(0.1) D0", bad)).collect()


def test_declared_sizes_and_degree_zero(spark, tmp_path):
    """Detectors that are declared but never hit count; an error that flips no detector is a column that the search rejects."""
    path = tmp_path / "m.dem"
    path.write_text("error(0.1) D0 D1\nerror(0.1) D1 D2 L0\ndetector D6\nlogical_observable L3\n")
    assert dem.declared_in(spark, str(path)) == (7, 4)
    h = dem.matrices(dem.merged(dem.read(spark, str(path))), 7, 4)[0]
    assert (h.checks, h.variables) == (7, 2)
    path.write_text("error(0.1) D0 D1\nerror(0.1) L0\n")
    with pytest.raises(ValueError, match="degree 0"):
        pipeline.enumerate_graph(dem.matrices(dem.merged(dem.read(spark, str(path))))[0], 2, 2)


def test_numbers_in_order(spark):
    table = spark.range(0, 3000, 3).withColumn("x", F.col("id") * 7 % 3001).repartition(5)
    got = [r["k"] for r in dem.numbered(table, "x", "k", 7).orderBy("x").collect()]
    assert got == list(range(1000)) and dem.numbered(table.where("id < 0"), "x", "k").count() == 0


def test_written_priors(spark, tmp_path):
    hooks.write_priors(spark.createDataFrame([(1, 0.5), (0, 0.0), (2, 0.25)], "v int, value double"), str(tmp_path / "llr"))
    lines = [float(x) for f in sorted((tmp_path / "llr").glob("part-*")) for x in f.read_text().split()]
    assert lines[0] == float("inf") and lines[1:] == pytest.approx([0.0, np.log(3)])


def test_circuit_of_a_repetition():
    gates = [("R", (0,), 0.0), ("X_ERROR", (0,), 0.1), ("CNOT", (0, 1), 0.0), ("DEPOLARIZE1", (1,), 0.01), ("MR", (1,), 0.0), ("DETECTOR", (-1,), 0.0), ("M", (0,), 0.0), ("OBSERVABLE_INCLUDE", (-1,), 0.0)]
    found = list(circuit.errors(gates))
    assert [(d, o) for _, _, d, o in found] == [([0], [0]), ([0], []), ([0], [])] and found[0][1] == 0.1


def test_detector_matrix_and_hooks(spark):
    code, columns, h, rounds = pipeline.detector_columns(spark, "72", 2)
    assert h.checks == 3 * 36 and rounds == 2
    sep = hooks.separate(h, code.hz, rounds, 36).cache()
    data, hook = (sep.where(f"kind = '{k}'") for k in ("data", "hook"))
    parts = hooks.decompose(sep, code.hx, 36).collect()
    rows = {r["new_idx"]: set(r["rows"]) for r in data.collect()}
    for r in hook.collect():
        found = next(p["parts"] for p in parts if p["hook"] == r["new_idx"])
        total = set()
        for i in found:
            total ^= rows[i]
        assert total == set(r["rows"])
    n = data.count()
    g = hooks.noise_graph(n, spark.createDataFrame([(p["hook"], p["parts"]) for p in parts], "hook int, parts array<int>"))
    assert g.edges.count() == 2 * n + sum(len(p["parts"]) for p in parts) and g.variables == 2 * n + len(parts)
    priors = hooks.aligned_priors(columns.select("v", F.col("p").alias("value")), sep)
    assert priors.count() == g.variables and priors.where("value = 0").count() == n


def test_golden_class_of_the_108_code(spark):
    """Published class (2, 2): 3240 pairs on 108 disjoint paths of 31 variables."""
    h = pipeline.detector_columns(spark, "108")[2]
    assert h.variables == 5508
    pairs = pipeline.enumerate_graph(h, 2, 2).supports.where("b = 2").collect()
    assert len(pairs) == 3240
    near = {}
    for r in pairs:
        a, b = r["vs"]
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    assert len(near) == 3348 and sorted({len(x) for x in near.values()}) == [1, 2] and sum(len(x) == 1 for x in near.values()) == 216


def test_command_arguments():
    with pytest.raises(SystemExit):
        pipeline.arguments(["--output-dir", "x", "--singleton-etsl-seeds"])
    with pytest.raises(ValueError):
        pipeline.arguments(["--output-dir", "x", "--code", "5"])
    assert pipeline.arguments(["--output-dir", "x"]).amax == 5


def test_first_sums_against_all_combinations():
    """Pairs and triples by order, also where sums of different rows are equal."""
    rng = random.Random(1)
    for trial in range(60):
        rows = [tuple(sorted(rng.sample(range(8), rng.randrange(4)))) for _ in range(rng.randrange(12))]
        bits = [rng.randrange(3 if trial % 2 else 2**63) for _ in range(8)]
        total = lambda r: functools.reduce(operator.xor, (bits[x] for x in r), 0)  # noqa: B023, E731
        keys = [tuple(sorted(rng.sample(range(8), rng.randrange(1, 5)))) for _ in range(4)]
        got = dict(hooks.first_sums([(total(k), k) for k in keys], np.arange(len(rows)) * 3, np.array([total(r) for r in rows], np.int64), rows))
        for place, key in enumerate(keys):
            hits = (c for n in (2, 3) for c in itertools.combinations(range(len(rows)), n) if functools.reduce(operator.xor, (set(rows[i]) for i in c)) == set(key))
            first = next(hits, None)
            assert got.get(place) == (first and [3 * i for i in first])


def test_a_window_of_many_columns(spark):
    """Its combinations, 4.5 million here, are looked up and not made as rows."""
    data = [("data", i, 0, 0, "Data", i, [i]) for i in range(300)]
    sep = spark.createDataFrame([*data, ("hook", 0, 0, None, None, 300, [297, 298, 299]), ("hook", 1, 0, None, None, 301, [])], hooks.COLUMNS)
    found = hooks.decompose(sep, graph.from_edges(spark.createDataFrame([(0, 0)], "c int, v int")), 1000)
    assert sorted((r["hook"], r["parts"]) for r in found.collect()) == [(0, [297, 298, 299]), (1, [])]
