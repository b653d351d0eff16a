"""Registered queries against their SQL, and the entry point without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from girthline import queries
from girthline.sources.graph import Tanner

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "part", "nation", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))


#: A small, denser part of the graph of `lineitem`, on which deep layers have more sets.
DENSE = "e AS (SELECT DISTINCT (l_partkey % 181)::BIGINT AS c, l_orderkey::BIGINT AS v FROM lineitem WHERE l_orderkey <= 400)"


@pytest.mark.parametrize("name", sorted(queries.OVER_GRAPH))
def test_over_a_dense_graph(spark, duck, name):
    """The queries over a graph, over a denser one than their own."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey <= 400").selectExpr("int(l_partkey % 181) AS c", "int(l_orderkey) AS v").distinct()
    got = queries.OVER_GRAPH[name](spark, Tanner(rows, 181, 401))
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name].replace(queries.E, DENSE).replace(queries.E_SMALL, DENSE)})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_without_oracle(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "girthline", tmp_path / "girthline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'class_counts_a2' in q and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=60)


def test_entry_without_optional_packages(tmp_path):
    """A package that only the operators need may be missing; the engine's queries stay."""
    (tmp_path / "xxhash.py").write_text("raise ImportError('no xxhash here', name='xxhash')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'class_counts_a2' in q and 'op1_lm_scoring' not in q"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"}, check=True, timeout=60)


@pytest.mark.parametrize("name", ["lollipop_d1", "lollipop_d2", "lollipop_d3"])
def test_cycles_of_a_lollipop_are_made_once(spark, monkeypatch, name):
    """Parents and the cycles at the end come from one search."""
    made = []
    monkeypatch.setattr(queries, "Cycles", lambda *a, f=queries.Cycles: made.append(1) or f(*a))
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey <= 100").selectExpr("int(l_partkey % 41) AS c", "int(l_orderkey) AS v").distinct()
    queries.OVER_GRAPH[name](spark, Tanner(rows, 41, 101))
    assert made == [1]
