"""Searches, revisits, packing, the pipeline, and the registered queries."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from girthline.llm import packing, queries, topk, warc


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (700, 8)))]
    rows += [(1000, [0.5] * 8), (1001, [0.5] * 8), (1100, None), (1200, [float("nan")] * 8), (None, [1.0] * 8), (1300, []), (1400, [None] * 8), (1500, [0.25] * 3), (1600, [float("inf")] * 8), rows[3], rows[100]]
    table = spark.createDataFrame([(*r, 7, 1) for r in rows], "vec_id long, embedding array<float>, n int, cell int")
    got = collections.defaultdict(list)
    for r in topk.top_k(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v))) * 1024)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.defaultdict(list)
    for k, (q, x) in enumerate(good):
        if q % 100 == 0:
            best = sorted((-int(x @ v), i) for j, (i, v) in enumerate(good) if j != k)[:10]
            want[q] += [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()} and len(got[100]) == 20
    assert topk.top_k(table.where("vec_id = -1")).count() == 0
    assert sorted(topk.top_k(table.where("vec_id IN (100, 101)")).select("query_id", "vec_id").collect()) == [(100, 100), (100, 100), (100, 101), (100, 101)]


def test_top_k_large_numbers():
    x = np.array([[2.0**40, 1.0], [-(2.0**40), 3.0]])
    assert topk.dots(x / 2**20, x[0] / 2**20, 2.0**60).tolist() == [2**40, -(2**40)]
    with pytest.raises(OverflowError):
        topk.dots(x, x[0], 2.0**81)


def record(i, url, ts, kind, **kw):
    return (i, url, ts, kind, kw.get("etag"), kw.get("modified"), kw.get("digest"), kw.get("headers"), kw.get("body"))


SCHEMA = "record_id long, url string, ts long, kind string, etag string, modified string, digest string, headers map<string,string>, body string"


def test_revisits(spark):
    rows = [
        record(1, "http://www.Site.com:80/a/?b=2&a=1&utm_x=3#f", 10, "response", etag='"x"', headers={"content-type": "t", "age": "1"}, body="B1"),
        record(2, "https://site.com/a?a=1&b=2", 20, "response", etag='"y"', digest="d2", headers=None, body="B2"),
        record(3, "site.com/a?a=1&b=2", 15, "revisit", etag='W/"x"', headers={"content-type": "no", "age": "9", "date": "d"}),
        record(4, "http://site.com/a?b=2&a=1", 20, "revisit", etag='"y"'),
        record(5, "http://site.com/a?b=2&a=1", 21, "revisit", etag='"x"', digest="d2", headers={"age": "2"}),
        record(6, "http://site.com/b", 30, "revisit", etag='"x"'),
        record(7, None, 30, "revisit"),
        record(8, "http://site.com/a?b=2&a=1", None, "revisit"),
        record(9, "http://site.com/a?b=2&a=1", 99, "revisit"),
        record(None, "http://site.com/a", 1, "response"), record(10, "x", 1, "request"), record(3, "zz", 1, "revisit"),
    ]
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", base int")).collect()}
    assert sorted(got) == [3, 4, 5, 6, 7, 8, 9]
    assert (got[3]["base_id"], got[3]["status"], got[3]["validator"], got[3]["body"], got[3]["headers"]) == (1, "resolved", "etag", "B1", {"content-type": "t", "age": "9", "date": "d"})
    assert (got[4]["base_id"], got[4]["status"]) == (1, "changed")
    assert (got[5]["base_id"], got[5]["validator"], got[5]["status"], got[5]["headers"]) == (2, "digest", "resolved", {"age": "2"})
    assert [got[i]["status"] for i in (6, 7, 8)] == ["missing"] * 3 and got[9]["status"] == "changed" and got[9]["validator"] is None
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_revisits_of_folded_headers(spark):
    """Header names don't tell cases apart: what describes the body stays, what a 304 may change is there once."""
    stored = {"Content-Type": "text/html", "Content-Length": "9", "Age": "1", "X-Same": "a", "x-same": "b"}
    fresh = {"Content-Length": "0", "CONTENT-TYPE": "x/y", "age": "2", " Date": "d"}
    rows = [record(1, "http://a.b/c", 1, "response", etag="e", headers=stored, body="B"), record(2, "http://a.b/c", 2, "revisit", etag="e", headers=fresh)]
    rows += [record(i, "http://a.b/c", 3, "revisit", etag="other") for i in range(3, 40)] + [record(40, "http://a.b/c", 4, "revisit", etag="e", headers=None)]
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    same = {"content-type": "text/html", "content-length": "9", "x-same": "b"}
    assert got[2]["headers"] == same | {"age": "2", "date": "d"} and got[40]["headers"] == same | {"age": "1"}
    assert len(got) == 39 and all(got[i]["status"] == "changed" and got[i]["headers"] is None and got[i]["body"] is None for i in range(3, 40))


def test_revisits_by_brute_force(spark):
    rng = random.Random(2)
    rows = [record(i, f"http://h.com/{'hot' if rng.random() < 0.6 else rng.randrange(4)}", rng.randrange(400), rng.choice(["response", "revisit"]), etag=rng.choice("abc")) for i in range(300)]
    got = {r["record_id"]: r["base_id"] for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in rows:
        if r[3] == "revisit":
            before = [(x[2], x[0]) for x in rows if x[3] == "response" and x[1] == r[1] and x[2] < r[2]]
            assert got[r[0]] == (max(before)[1] if before else None)


def test_best_fit():
    rng = random.Random(1)
    for _ in range(200):
        lengths = np.array([rng.randint(1, 20) for _ in range(rng.randint(0, 40))], int)
        free = []
        for n in sorted(lengths.tolist(), reverse=True):
            room = [f for f in free if f >= n]
            if room:
                free.remove(min(room))
            free.append((min(room) if room else 20) - n)
        bins = packing.best_fit(lengths, 20)
        assert sorted(20 - sum(lengths[i] for i in b) for b in bins) == sorted(free)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))


def test_packing(spark, docs, docs_rows, empty):
    packed = packing.pack(docs.coalesce(2), row=64, shard=3000)
    rows = packed.collect()
    for r in rows:
        cu, pos = r["cu_seqlens"], np.frombuffer(r["positions"], "<u4")
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] == len(pos) <= 64 and len(r["ids"]) == 256
        assert pos.tolist() == [k for a, b in zip(cu, cu[1:]) for k in range(b - a)]
        assert (np.frombuffer(r["ids"], "<u4")[r["n_tokens"] :] == packing.PAD).all()
    assert len({(r["shard"], r["part"], r["row"]) for r in rows}) == len(rows) and sum(r["n_tokens"] for r in rows) > 0.9 * 64 * len(rows)
    seg = collections.defaultdict(list)
    for r in packing.unpack(packed).collect():
        seg[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    texts = collections.defaultdict(list)
    for r in docs_rows:
        texts[r[0]].append(r[1] or "")
    for i, ts in texts.items():
        if i is not None and len(ts) == 1:
            ids = np.frombuffer(b"".join(b for _, b in sorted(seg[i])), "<u4")
            assert ids.tolist() == [*ts[0].encode(), packing.END]
    assert sum(len(b) for b in map(lambda x: b"".join(y for _, y in x), seg.values())) == 4 * sum(len((r[1] or "").encode()) + 1 for r in docs_rows)
    assert packing.pack(empty).count() == 0 and packing.digest(packed).count() == len(rows)


def test_packed_rows_written(spark, docs, tmp_path):
    packed = packing.pack(docs, row=64, shard=3000)
    want = sorted(map(str, packing.digest(packed).collect()))
    for _ in range(2):
        assert sorted(map(str, packing.digest(packing.write(packed, str(tmp_path / "out"))).collect())) == want
    assert sorted(map(str, packing.digest(packing.read(spark, str(tmp_path / "out"))).collect())) == want
    assert sorted(map(str, packing.unpack(packing.read(spark, str(tmp_path / "out"))).collect())) == sorted(map(str, packing.unpack(packed).collect()))
    packed.where("row > 0").write.mode("overwrite").parquet(str(tmp_path / "out" / "rows"))
    with pytest.raises(ValueError):
        packing.read(spark, str(tmp_path / "out"))


def test_packing_of_any_partitions(spark, docs, monkeypatch):
    """The same rows however the input is split, with one shard and with several."""
    for size in (packing.SHARD_BYTES, 9000):
        monkeypatch.setattr(packing, "SHARD_BYTES", size)
        found = [sorted(map(str, packing.digest(packing.pack(x, row=256)).collect())) for x in (docs.coalesce(1), docs.repartition(7))]
        assert found[0] == found[1] and len(found[0]) > 10


def test_packing_of_ranks(spark, docs, docs_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    encode = packing.rank_encoder(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    seg = collections.defaultdict(list)
    for r in packing.unpack(packing.pack(docs, encode, row=512, pad=50256)).where("doc_id IN (3, 83, 88, 89)").collect():
        seg[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    for i in (3, 83, 88, 89):
        text = next(r[1] for r in docs_rows if r[0] == i) or ""
        ids = np.frombuffer(b"".join(b for _, b in sorted(seg[i])), "<u4").tolist()
        assert ids == [*tok.encode(text, add_special_tokens=False).ids, 50256]


def test_pipeline(spark, docs, docs_rows, tmp_path):
    from tests.llm.test_text_operators import plain_components
    from tokenizers import Tokenizer

    cols = docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    cols.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "bpe"]
    table, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        seen.append(table)
    assert all(t.columns == cols.columns for t in seen[:-1])
    # Stage 1 keeps what has a letter; stage 2 one row of each component, and rows without id.
    kept = [r for r in docs_rows if r[1] and any(c.isalpha() for c in r[1])]
    assert seen[0].count() == len(kept)
    _, root = plain_components([r[1] for r in kept])
    least = {}
    for r, c in zip(kept, root):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    assert sorted(r["doc_id"] for r in seen[1].where("doc_id IS NOT NULL").collect()) == sorted(set(least.values()))
    assert seen[1].where("doc_id IS NULL").count() == sum(r[0] is None for r in kept)
    assert seen[2].count() == seen[1].count()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter((r["doc_id"], hashlib.sha256(np.array(tok.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in seen[3].collect())
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in seen[4].collect()) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()
    # Each stage takes an empty table, and columns with the names it would use itself.
    own = ("lang", "score", "key", "base", "every", "s", "rounds", "cut", "k", "text")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cols.where("doc_id = -1"), "").count() == 0
    wide = cols.where("doc_id BETWEEN 60 AND 90").select("*", *(F.lit(1).alias(f"_{n}") for n in own))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))


def test_near_duplicates_of_repeated_ids(spark):
    """Different texts under one id are different documents, and the copy that goes is the copy."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(5, one), (5, two), (5, two), (3, one), (7, three), (None, one)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, table.repartition(3), "").collect()]
    assert sorted(got, key=str) == sorted([(3, one), (5, two), (7, three), (None, one)], key=str)
