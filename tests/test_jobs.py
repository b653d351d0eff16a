"""The jobs over growing, repeated and interrupted input."""

import collections
import hashlib
import json
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from girthline.plans import enumerate as search
from girthline.sources.graph import from_edges
from jobs import common, queries, shot_symptoms, trapping_sets

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
SCHEMA = "doc_id long, text string"


def plain(rows):
    """symptom, weight, checks, shots, first_id, p, width by hand."""
    found = collections.defaultdict(list)
    for i, text in rows:
        lines = collections.Counter(x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        found[tuple(sorted(hashlib.md5(x.encode()).hexdigest() for x, n in lines.items() if n % 2))].append(i)
    return sorted((hashlib.md5(",".join(k).encode()).hexdigest(), len(k), list(k), len(v), min((i for i in v if i is not None), default=None), len(v) / len(rows), min(len(k), 50)) for k, v in found.items())


def columns(df):
    return sorted(map(tuple, df.select("symptom", "weight", "checks", "shots", "first_id", "p", "width").collect()))


ROWS = [(1, "a\nb"), (2, "b\na"), (3, "a\nb\na\na"), (4, "a\na"), (5, None), (6, ""), (7, " \t\n\n"), (None, "c"), (8, "c"), (8, "c"), (9, "\n".join(f"line {i}" for i in range(300))), (None, "only here"), (10, "é\r\nb")]
MORE = [(11, "a\nb"), (12, "new"), (0, "c"), (13, "x" * 500_000)]


def folder_of(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_shots_grow(spark, tmp_path):
    source, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder_of(spark, source, ROWS)
    assert columns(shot_symptoms.run(spark, str(source), out, ck, {})) == plain(ROWS)
    assert columns(shot_symptoms.run(spark, str(source), out, ck, {})) == plain(ROWS)
    folder_of(spark, source, MORE)
    assert columns(shot_symptoms.run(spark, str(source), out, ck, {})) == plain(ROWS + MORE)
    taken = spark.read.parquet(f"{ck}/shots").groupBy("batch").agg(F.sum("shots").alias("n")).orderBy("batch").collect()
    assert [r["n"] for r in taken] == [len(ROWS), len(MORE)]
    # A run that finds nothing new leaves everything as it is.
    assert columns(shot_symptoms.run(spark, str(source), out, ck, {})) == plain(ROWS + MORE)


def test_a_batch_that_runs_again(spark, tmp_path):
    """A run that stopped after a batch was written, but before the stream noted it."""
    source, out, ck = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"
    folder_of(spark, source, ROWS)
    shot_symptoms.run(spark, str(source), out, str(ck), {})
    folder_of(spark, source, MORE)
    shot_symptoms.run(spark, str(source), out, str(ck), {"files": 1})
    last = max((ck / "files" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (ck / "files" / "commits").glob(f".{last.name}*"):
        crc.unlink()
    assert columns(shot_symptoms.run(spark, str(source), out, str(ck), {})) == plain(ROWS + MORE)


def test_small_batches_give_the_same(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(0, len(ROWS), 4):
        folder_of(spark, source, ROWS[i : i + 4])
    got = shot_symptoms.run(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck"), {"files": 1})
    assert columns(got) == plain(ROWS) and spark.read.parquet(f"{tmp_path}/ck/shots").select("batch").distinct().count() == 4


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        assert shot_symptoms.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), {}).count() == 0


def test_settings_stay(spark, tmp_path):
    before = spark.sparkContext._jvm.scala.collection.JavaConverters.mapAsJavaMap(spark._jsparkSession.conf().getAll()).toString()
    folder_of(spark, tmp_path / "in", ROWS)
    shot_symptoms.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), {})
    assert spark.sparkContext._jvm.scala.collection.JavaConverters.mapAsJavaMap(spark._jsparkSession.conf().getAll()).toString() == before


EDGES = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 2), (3, 1), (3, 2), (4, 4), (4, 5), (5, 4), (5, 5), (None, 3), (0, 0)]
SEARCH = {"amax": 3, "bounds": [0, 0, 2, 2], "leaves": True}


def sets(df):
    return sorted((r["a"], r["b"], r["kind"], tuple(r["vs"])) for r in df.collect())


def test_sets_written_twice(spark, tmp_path):
    source = str(tmp_path / "edges")
    spark.createDataFrame(EDGES, "c int, v int").write.parquet(source)
    first = sets(trapping_sets.run(spark, source, str(tmp_path / "out"), str(tmp_path / "ck"), SEARCH))
    assert (2, 2, "leafless", (0, 1)) in first and (3, 0, "leafless", (0, 1, 2)) in first and (2, 0, "leafless", (4, 5)) in first
    assert sets(trapping_sets.run(spark, source, str(tmp_path / "out"), str(tmp_path / "ck"), SEARCH)) == first
    assert {(r["a"], r["b"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out/counts").collect()} == dict(collections.Counter(x[:2] for x in first))
    assert not list((tmp_path / "ck" / "layers").iterdir())
    # Classes that a smaller input no longer has are gone.
    spark.createDataFrame(EDGES[8:], "c int, v int").write.mode("overwrite").parquet(source)
    assert sets(trapping_sets.run(spark, source, str(tmp_path / "out"), str(tmp_path / "ck"), SEARCH)) == [(2, 0, "leafless", (4, 5))]


def test_a_search_that_was_stopped(spark, tmp_path, monkeypatch):
    """Stopped between layers, the job goes on after the last finished one, and deletes its layers in the end."""
    source, ck = str(tmp_path / "edges"), tmp_path / "ck"
    spark.createDataFrame(EDGES, "c int, v int").write.parquet(source)
    layer, made = search.Enumeration.layer, []

    def stopped(self, a):
        if a == 3:
            raise KeyboardInterrupt
        return layer(self, a)

    monkeypatch.setattr(search.Enumeration, "layer", stopped)
    with pytest.raises(KeyboardInterrupt):
        trapping_sets.run(spark, source, str(tmp_path / "out"), str(ck), SEARCH)
    (kept,) = (ck / "layers").iterdir()
    stamp = os.stat(kept / "leafless2" / "_SUCCESS").st_mtime_ns
    # A layer that was being written when the run stopped has no marker, and is made again.
    (kept / "leafless3").mkdir()
    (kept / "leafless3" / "part-00000.parquet").write_bytes(b"half a file")

    def watched(self, a):
        out = layer(self, a)
        made.append((a, os.stat(kept / "leafless2" / "_SUCCESS").st_mtime_ns))
        return out

    monkeypatch.setattr(search.Enumeration, "layer", watched)
    candidates, again = search.Enumeration.candidates, []
    monkeypatch.setattr(search.Enumeration, "candidates", lambda self, a: again.append(a) or candidates(self, a))
    got = sets(trapping_sets.run(spark, source, str(tmp_path / "out"), str(ck), SEARCH))
    assert again == [3] and made == [(2, stamp), (3, stamp)] and not kept.exists()
    monkeypatch.undo()
    assert got == sets(trapping_sets.run(spark, source, str(tmp_path / "out2"), str(tmp_path / "ck2"), SEARCH))


def test_counts_of_layers_read_again(spark, tmp_path):
    g = from_edges(spark.createDataFrame(EDGES, "c int, v int").dropna().distinct())
    run = lambda edges, amax: search.enumerate_sets(edges, 4, amax, [2] * (amax + 1), folder=str(tmp_path))
    first, again = run(g, 3), run(g, 3)
    assert first.stats == again.stats and first.layers == again.layers and first.folder == again.folder
    other = from_edges(spark.createDataFrame([*EDGES, (9, 9)], "c int, v int").dropna().distinct())
    assert run(other, 3).folder != first.folder and run(g, 2).folder != first.folder


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"files": 3}')
    assert common.configuration(spark, str(tmp_path / "c.json"), shot_symptoms.DEFAULTS) == {**shot_symptoms.DEFAULTS, "files": 3}
    (tmp_path / "c.json").write_text('{"file": 3}')
    with pytest.raises(ValueError):
        common.configuration(spark, str(tmp_path / "c.json"), shot_symptoms.DEFAULTS)
    for job in (shot_symptoms, trapping_sets):
        assert set(json.loads((ROOT / "jobs" / f"{job.__name__.split('.')[-1]}.json").read_text())) <= set(job.DEFAULTS)


def test_command_line(tmp_path):
    args = ["--input", f"{SF}/documents.parquet", "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "ck")]
    done = subprocess.run([sys.executable, "-m", "jobs.shot_symptoms", *args], cwd=ROOT, env=os.environ, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0 and "200 shots read" in done.stderr and "columns written" in done.stderr, done.stderr
    assert list((tmp_path / "out").glob("width=*/*.parquet"))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))


def test_a_finished_search_is_recognised(spark, tmp_path, monkeypatch):
    """Its sets are counted again and left; other settings, or sets that are gone, are made anew."""
    source, out, ck = str(tmp_path / "edges"), tmp_path / "out", str(tmp_path / "ck")
    spark.createDataFrame(EDGES, "c int, v int").write.parquet(source)
    searched, search_all = [], trapping_sets.enumerate_sets
    monkeypatch.setattr(trapping_sets, "enumerate_sets", lambda *a, **k: searched.append(1) or search_all(*a, **k))
    run = lambda **k: sets(trapping_sets.run(spark, source, str(out), ck, {**SEARCH, **k}))
    first = run()
    assert run() == first and len(searched) == 1
    for file in (out / "sets" / "a=3").glob("b=*/*.parquet"):
        file.unlink()
    assert run() == first and len(searched) == 2
    assert len(run(amax=2, bounds=[0, 0, 2])) < len(first) and len(searched) == 3
    assert run() == first and len(searched) == 4
