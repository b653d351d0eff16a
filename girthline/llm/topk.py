"""Exact top-k by integer inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. A vector x at distance r from pivot p, with q at
distance d from p, is at least |d - r| away from q (triangle inequality), so with the largest norm m of a cell
<q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + m^2 - (d - r)^2) / 2. Queries first search the cells with the
highest bounds until these hold enough vectors, then only the cells whose bound reaches their k-th score; inside a cell
the vectors lie sorted by distance and the search widens from the query's own distance until the bound stops it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that choose the pivots, at most about; pivots and rings a pivot, at most; rows a task takes of a cell; queries a task takes.
SAMPLE, PIVOTS, RINGS, BLOCK, QUERY_BLOCK = 8000, 64, 32, 8192, 2048
#: Vectors that a search takes up before it tests its bound again.
STRIDE = 1024
#: Slack for rounding in distances, relative and absolute; bounds are only ever loosened.
SLACK = 1e-9


def dense(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out = np.zeros((len(column), dim))
    out[np.arange(dim)[None, :] < size[:, None]] = np.floor(flat * scale)
    return out


def pack(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype("<f8")], pa.binary())


def unpack(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), dim)


def dots(x: np.ndarray, q: np.ndarray, top: float) -> np.ndarray:
    """Inner products as exact integers. `top`: |x| |q| at most. Results beyond 64 bits are an error, as a score is a long."""
    if top < 2**53:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    return np.array(exact, np.int64)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first over the sample, from its first row."""
    if not len(sample):
        return sample
    at = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(at) < min(n, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[at[-1]], axis=1))
    return sample[at]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)))


def upper(qn: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Bound on the inner product of queries (norm qn, distance d to the pivot) with cells (distances lo to hi, norms to m)."""
    gap = np.maximum(0, np.maximum(d - hi, lo - d) - SLACK * (d + hi + 1) - 1e-6 * (qn + m))
    return np.minimum((qn * qn + m * m - gap * gap) / 2, qn * m) * (1 + SLACK) + 1


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, by falling score, then rising id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def top_k(rows: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors, exactly.

    `rows` has vec_id and embedding; queries are the rows whose vec_id is divisible by `every`. Vectors that are null
    or hold null or non-finite components, and rows without vec_id, take no part; shorter vectors count as filled with
    zeros. Rows that repeat a vec_id are rows of their own: each is a candidate for all others, and each a query if its
    id is one. Ties go to the smaller vec_id. An empty table gives an empty result; other columns are ignored. Very long
    vectors are rows like others, but all are filled up to the longest. A score beyond 64 bits is an error.
    """
    spark = rows.sparkSession
    kinds = "query long, vec_id long, score long"
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~bad)
    facts = good.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n, dim = facts["n"], facts["dim"]
    if not n:
        return none
    picked = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))).limit(2 * SAMPLE).select("embedding").toArrow()
    sample = dense(picked.column(0), dim, scale) if len(picked) else np.zeros((1, dim))
    pivots = choose_pivots(sample, int(min(PIVOTS, max(4, n**0.5 / 8))))
    near = to_pivots(sample, pivots)
    home, dist = near.argmin(1), near.min(1)
    rings = int(min(RINGS, max(2, n / len(pivots) / BLOCK)))
    edges = np.array([np.quantile(dist[home == p], np.arange(1, rings) / rings) if (home == p).any() else np.zeros(rings - 1) for p in range(len(pivots))])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A number for each row, which the written index keeps.
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            if batch.num_rows:
                number, at = np.arange(at, at + batch.num_rows), at + batch.num_rows
                x = dense(batch.column(1), dim, scale)
                near = to_pivots(x, pivots)
                p, d = near.argmin(1), near.min(1)
                ring = (edges[p] < d[:, None]).sum(1)
                yield pa.RecordBatch.from_pydict({"row": pa.array(number), "vec_id": batch.column(0), "cell": pa.array((p * rings + ring).astype(np.int64)), "dist": pa.array(d), "norm": pa.array(np.linalg.norm(x, axis=1)), "x": pack(x)})

    index = written(good.mapInArrow(key, "row long, vec_id long, cell long, dist double, norm double, x binary"), "index")
    stats = index.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("m")).orderBy("cell").toArrow().to_pydict()
    cell, size, lo, hi, m = (np.array(stats[c]) for c in ("cell", "n", "lo", "hi", "m"))
    pivot_of = cell // rings

    def plan(first: bool):
        """Cells that each query searches: at first the best bounds until they hold k others, then all the rest that may still matter."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = unpack(batch.column("x"), dim)
                ids, floor = batch.column("row").to_numpy(), batch.column("floor").to_numpy(zero_copy_only=False)
                near, qn = to_pivots(q, pivots), np.linalg.norm(q, axis=1)
                bound = upper(qn[:, None], near[:, pivot_of], lo[None, :], hi[None, :], m[None, :])
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, order, before <= k, axis=1)
                take = early if first else ~early & (bound >= floor[:, None])
                i, c = np.nonzero(take)
                yield pa.RecordBatch.from_pydict({"query": pa.array(ids[i]), "cell": pa.array(cell[c]), "floor": pa.array(floor[i]), "q": pack(q[i])})

        return run

    blocks = F.create_map(*(F.lit(int(v)) for c, s in zip(cell, size) for v in (c, -(-s // BLOCK)))) if len(cell) else None
    query_blocks = max(1, -(-n // every // QUERY_BLOCK))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            q, ids, floor = unpack(left.column("q"), dim), left.column("query").to_numpy(), left.column("floor").to_numpy()
            dist = right.column("dist").to_numpy()
            order = np.argsort(dist, kind="stable")
            dist, vec, row, x = dist[order], right.column("vec_id").to_numpy()[order], right.column("row").to_numpy()[order], unpack(right.column("x"), dim)[order]
            p = pivots[int(right.column("cell")[0].as_py()) // rings][None, :]
            most = float(right.column("norm").to_numpy().max())
            for i in range(len(ids)):
                d, qn, low = float(to_pivots(q[i : i + 1], p)[0, 0]), float(np.linalg.norm(q[i])), floor[i]
                a = b = int(np.searchsorted(dist, d))
                ids_, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
                while a > 0 or b < len(dist):
                    # The ring widens on the side that is nearer to the query's own distance.
                    down = a > 0 and (b == len(dist) or d - dist[a - 1] <= dist[b] - d)
                    edge = dist[a - 1] if down else dist[b]
                    if upper(np.array(qn), np.array(d), np.array(edge), np.array(edge), np.array(most)) < low:
                        break
                    s = slice(max(0, a - STRIDE), a) if down else slice(b, b + STRIDE)
                    a, b = (s.start, b) if down else (a, min(len(dist), b + STRIDE))
                    got, own = dots(x[s], q[i], qn * most), row[s] != ids[i]
                    keep = own & (got >= low)
                    ids_, scores = np.concatenate([ids_, vec[s][keep]]), np.concatenate([scores, got[keep]])
                    if len(scores) > k:
                        at = np.lexsort((ids_, -scores))[:k]
                        ids_, scores = ids_[at], scores[at]
                        low = max(low, float(scores[-1]))
                out_q.append(np.full(len(ids_), ids[i])), out_v.append(ids_), out_s.append(scores)
        join = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64)
        return pa.table({"query": join(out_q), "vec_id": join(out_v), "score": join(out_s)})

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        want = queries.mapInArrow(plan(first), "query long, cell long, floor double, q binary").withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(query_blocks)))
        want = want.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks[F.col("cell")] - 1).cast("int"))))
        keys = ("cell", "block", "qb")
        # Vectors go to those blocks of queries only that search their cell.
        asked = want.select(F.col("cell").alias("c"), F.col("block").alias("b"), F.col("qb").alias("asked")).distinct()
        have = index.withColumn("part", F.pmod(F.xxhash64("row"), blocks[F.col("cell")]).cast("int")).join(asked, (F.col("cell") == F.col("c")) & (F.col("part") == F.col("b")))
        have = have.select("row", "vec_id", "cell", "dist", "norm", "x", F.col("part").alias("block"), F.col("asked").alias("qb"))
        return want.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInArrow(search, kinds)

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    queries = index.where(F.col("vec_id") % every == 0).select("row", "vec_id", "x", F.lit(float("-inf")).alias("floor"))
    start = written(ranked(searched(queries, True)), "first")
    floors = start.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("floor"))
    rest = queries.drop("floor").join(floors, queries["row"] == floors["query"], "left").select("row", "x", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    found = ranked(start.select("query", "vec_id", "score").unionByName(searched(rest, False)))
    return found.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")


#: The same search for DuckDB, over all pairs of a query and a vector.
SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_has_any([true], list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 10
"""
