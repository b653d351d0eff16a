"""A Merkle manifest of a dataset: a leaf a row, a tree a source, a tree over the sources' roots, and a proof a row.

Leaves get their place within their source by a range partitioning that is written down. Aligned blocks of BLOCK
consecutive nodes are one contiguous matrix of 64-byte hexadecimal digests, which is reshaped by the fan-out and hashed
row by row, level by level. Block roots are the next round's nodes. On the way back each block gets the siblings above
it in one row, so a node's proof needs its own block and that row only. The driver holds the root and a few counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, written

FANOUT, DIGEST = 16, 64
#: Levels of a block, and its nodes.
LEVELS = 3
BLOCK = FANOUT**LEVELS
#: Rows of a range while they are put in order; more from MOST_RANGES ranges on.
RANGE, MOST_RANGES = 50_000, 10_000
#: For each place in a run, the other places.
OTHERS = np.array([[j for j in range(FANOUT) if j != i] for i in range(FANOUT)])

NODES = "source string, b long, i long, n long, d binary, pos array<int>, sibs array<binary>, sub string"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """SHA-256 over the fields of a row with `text` as its text."""
    return F.unhex(F.sha2(F.concat(field(F.col("doc_id").cast("long")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars").cast("long")), field(text)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, d, and `changed`: the leaf of the row as tampering leaves it, null where it stays as it is."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", UPPER, LOWER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(F.col("text")).alias("d"), F.when(hit & (lowered != F.col("text")), leaf(lowered)).alias("changed"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds i, the place from 0 within the source by `order`, and n, the rows of the source.

    Ranges of (source, order) are written with their number, so every row stays in the range that its count belongs to;
    equal rows may be in several ranges. Rows are numbered inside ranges, after the source's rows in the ranges before.
    """
    ranges = max(1, min(MOST_RANGES, -(-rows.count() // RANGE)))
    keys = [F.col(c).asc_nulls_first() for c in ("source", *order)]
    x = written(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys, "tie").withColumn("p", F.spark_partition_id()), "ranges")
    counts = x.groupBy("p", "source").agg(F.count("*").alias("m"))
    every = Window.partitionBy("source")
    counts = counts.select(F.col("p").alias("cp"), F.col("source").alias("cs"), (F.sum("m").over(every.orderBy("p")) - F.col("m")).alias("before"), F.sum("m").over(every).alias("n"))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("p", "source").orderBy(*keys[1:], "tie")) - 1)
    x = x.join(counts, (F.col("p") == F.col("cp")) & F.col("source").eqNullSafe(F.col("cs")))
    return x.withColumn("i", F.col("k") + F.col("before")).drop("k", "before", "tie", "p", "cp", "cs")


def hashed(run: bytes) -> bytes:
    return hashlib.sha256(run).hexdigest().encode()


def matrix(digests: pd.Series) -> np.ndarray:
    """Raw digests as a contiguous matrix of hexadecimal bytes."""
    return np.frombuffer(b"".join(digests).hex().encode(), np.uint8).reshape(-1, DIGEST)


def levels_of(d: np.ndarray, n: int) -> list[np.ndarray]:
    """A block's matrices from its nodes to its root. A source of more than a block goes up LEVELS levels, whatever the
    block holds; else up to one node."""
    out = [d]
    while len(out) <= LEVELS if n > BLOCK else len(out[-1]) > 1:
        d = out[-1]
        full = len(d) // FANOUT
        rows = [hashed(r.tobytes()) for r in d[: full * FANOUT].reshape(full, FANOUT * DIGEST)]
        if len(d) % FANOUT:
            rows.append(hashed(d[full * FANOUT :].tobytes()))
        out.append(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, DIGEST))
    return out


def siblings(d: np.ndarray) -> list[bytes]:
    """For each node of a level the digests of its run's others, in order: by index arithmetic for all whole runs."""
    full = len(d) // FANOUT
    node = np.arange(full * FANOUT)
    others = d[(node // FANOUT * FANOUT)[:, None] + OTHERS[node % FANOUT]].reshape(-1, (FANOUT - 1) * DIGEST)
    rest = d[full * FANOUT :]
    return [r.tobytes() for r in others] + [np.delete(rest, j, 0).tobytes() for j in range(len(rest))]


def above(path: list[list[bytes]], k: int) -> tuple[list[int], list[bytes]]:
    """Place and siblings of a block's node k on each level of the block."""
    return [k // FANOUT**t % FANOUT for t in range(len(path))], [s[k // FANOUT**t] for t, s in enumerate(path)]


def folded(d: bytes, pos: list[int], sibs: list[bytes]) -> bytes:
    """The root that a digest leads to."""
    for p, s in zip(pos, sibs, strict=True):
        d = hashed(s[: p * DIGEST] + d + s[p * DIGEST :])
    return d


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks of rows that come in order; a row with `first` begins one. Holds a block and a batch."""
    held: list[pd.DataFrame] = []
    for b in batches:
        at = np.flatnonzero(b["first"].to_numpy())
        edges = [0, *at[at > 0], len(b)]
        for lo, hi in zip(edges, edges[1:]):
            if held and lo < len(b) and b["first"].iloc[lo]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            if lo < hi:
                held.append(b.iloc[lo:hi])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def in_blocks(nodes: DataFrame, first: Column) -> DataFrame:
    """Rows of a block side by side and in order."""
    return nodes.repartition("source", "b").sortWithinPartitions("source", "b", "i").withColumn("first", first)


def block_roots(nodes: DataFrame) -> DataFrame:
    """source, i (the block's number), n (blocks of the source), d: the next round's nodes from this one's (source, i, n, d)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for x in blocks(batches):
            n = int(x["n"].iloc[0])
            root = levels_of(matrix(x["d"]), n)[-1].tobytes().decode()
            rows.append((x["source"].iloc[0], int(x["i"].iloc[0]) // BLOCK, -(-n // BLOCK), bytes.fromhex(root)))
            if len(rows) == 1000:
                yield pd.DataFrame(rows, columns=["source", "i", "n", "d"])
                rows = []
        yield pd.DataFrame(rows, columns=["source", "i", "n", "d"])

    x = nodes.select("source", F.expr(f"i DIV {BLOCK}").alias("b"), "i", "n", "d")
    return in_blocks(x, F.col("i") % BLOCK == 0).mapInPandas(run, "source string, i long, n long, d binary")


def with_tops(nodes: DataFrame, tops: DataFrame, *more: str) -> DataFrame:
    """A round's nodes in blocks, each block after the row of `tops` (source, i: the block's number, pos, sibs, sub)."""
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("pos", "array<int>"), ("sibs", "array<binary>"), ("sub", "string"))]
    x = nodes.select("source", F.expr(f"i DIV {BLOCK}").alias("b"), "i", "n", "d", *nulls, *more)
    y = tops.select("source", F.col("i").alias("b"), F.lit(-1).cast("long").alias("i"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("d"), "pos", "sibs", "sub")
    return in_blocks(x.unionByName(y, allowMissingColumns=True), F.col("i") == -1)


def opened(x: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray], list[list[bytes]], list[int], list[bytes], str]:
    """A block's rows, matrices, siblings by level, and what lies above it."""
    top, rows = x.iloc[0], x.iloc[1:]
    levels = levels_of(matrix(rows["d"]), int(rows["n"].iloc[0]))
    return rows, levels, [siblings(d) for d in levels[:-1]], [int(p) for p in top["pos"]], list(top["sibs"]), top["sub"]


def paths(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """source, i, pos, sibs, sub: each node's places and siblings from its own level to the root; the next round's tops."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in blocks(batches):
            rows, _, path, pos, sibs, sub = opened(x)
            for lo in range(0, len(rows), 500):
                part = rows.iloc[lo : lo + 500]
                found = [above(path, lo + k) for k in range(len(part))]
                yield pd.DataFrame({"source": part["source"], "i": part["i"], "pos": [p + pos for p, _ in found], "sibs": [s + sibs for _, s in found], "sub": sub})

    return with_tops(nodes, tops).mapInPandas(run, "source string, i long, pos array<int>, sibs array<binary>, sub string")


def proved(nodes: DataFrame, tops: DataFrame, root: str) -> DataFrame:
    """The manifest's rows from the leaves (with doc_id and changed) and what lies above their blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in blocks(batches):
            rows, levels, path, pos, sibs, sub = opened(x)
            upper, out = b"".join(sibs), []
            for k, (d, changed) in enumerate(zip(levels[0], rows["changed"])):
                p, s = above(path, k)
                d = d.tobytes()
                fold = folded(bytes(changed).hex().encode() if changed is not None else d, p + pos, s + sibs).decode()
                out.append((d.decode(), hashed(b"".join(s) + upper).decode(), fold, fold == root))
            y = pd.DataFrame(out, columns=["leaf", "proof_sha256", "folded_root", "verified"])
            y["doc_id"], y["subroot"], y["root"] = rows["doc_id"].to_numpy(), sub, root
            yield y[["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]]

    ids = nodes.withColumn("doc_id", F.col("doc_id").cast("string"))  # as text, nulls and large ids pass through pandas
    found = with_tops(ids, tops, "doc_id", "changed").mapInPandas(run, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The node tables (source, i, n, d) of all rounds but the last, and the last: one node a source, its root."""
    rounds, most = [], nodes.agg(F.max("n")).first()[0]
    while most > 1:
        rounds.append(nodes)
        nodes = written(block_roots(nodes), "nodes")
        most = -(-most // BLOCK)
    return rounds, nodes


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    Rows of one doc_id in a source are ordered by leaf, null ids come first and are never tampered with; a null field is
    `-`, the null source is a source of its own, before all others; repeated rows have leaves of their own; very long
    texts are hashed whole where they are read, and only digests move; extra columns, of any names, are ignored; an
    empty table gives an empty result. One source may hold any share of the rows: it is cut into ranges and blocks.
    """
    spark = docs.sparkSession
    first = written(leaves(docs.select("doc_id", "source", "lang", "n_chars", "text")), "leaves")
    if first.isEmpty():
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    nodes = written(placed(first, "doc_id", "d"), "placed")
    rounds, subroots = climbed(nodes)
    # The sources' roots are the nodes of one more tree, whose only source is null.
    named = subroots.select(F.lit(None).cast("string").alias("source"), F.col("source").alias("name"), "d")
    named = written(placed(named, "name"), "sources")
    over, top = climbed(named)
    root = bytes(top.first()["d"]).hex()
    none = spark.createDataFrame([(None, 0, [], [], None)], "source string, i long, pos array<int>, sibs array<binary>, sub string")
    for x in reversed(over):
        none = written(paths(x, none), "paths")
    # Back to sources: a source's row is the top of its own tree's only block.
    x = named.join(none.drop("source"), "i")
    tops = x.select(F.col("name").alias("source"), F.lit(0).cast("long").alias("i"), "pos", "sibs", F.lower(F.hex("d")).alias("sub"))
    for x in reversed(rounds[1:]):
        tops = written(paths(x, tops), "paths")
    return proved(nodes, tops, root)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"
#: The same trees for DuckDB: levels by recursion, runs as lists, a fold a row.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source AS s, {_LEAF.format("text")} AS h, CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format(_LOWERED)} ELSE {_LEAF.format("text")} END AS z FROM documents),
e AS (SELECT row_number() OVER () AS r, *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM d),
t(l, s, i, h, n) AS (SELECT 0, s, i, h, n FROM e UNION ALL SELECT l + 1, s, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY l, s, i // 16),
u AS (SELECT l, s, h, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
v(l, i, h, n) AS (SELECT 0, i, h, n FROM u UNION ALL SELECT l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM v WHERE n > 1 GROUP BY l, i // 16),
runs AS (SELECT l, s, i // 16 AS run, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY ALL),
tops AS (SELECT l, i // 16 AS run, list(h ORDER BY i) AS hs FROM v WHERE n > 1 GROUP BY ALL),
f(r, l, s, i, h, p) AS (SELECT r, 0, s, i, z, '' FROM e UNION ALL
  SELECT f.r, f.l + 1, f.s, f.i // 16, sha256(array_to_string(hs[:f.i % 16] || [f.h] || hs[f.i % 16 + 2:], '')), p || array_to_string(hs[:f.i % 16] || hs[f.i % 16 + 2:], '')
  FROM f JOIN runs q ON q.l = f.l AND q.s IS NOT DISTINCT FROM f.s AND q.run = f.i // 16),
g(r, l, i, h, p) AS (SELECT f.r, 0, u.i, f.h, f.p FROM f JOIN u ON u.s IS NOT DISTINCT FROM f.s AND u.l = f.l UNION ALL
  SELECT g.r, g.l + 1, g.i // 16, sha256(array_to_string(hs[:g.i % 16] || [g.h] || hs[g.i % 16 + 2:], '')), p || array_to_string(hs[:g.i % 16] || hs[g.i % 16 + 2:], '')
  FROM g JOIN tops q ON q.l = g.l AND q.run = g.i // 16),
z AS (SELECT l, h FROM v WHERE n = 1)
SELECT e.doc_id, e.h AS leaf, u.h AS subroot, z.h AS root, sha256(g.p) AS proof_sha256, g.h AS folded_root, g.h = z.h AS verified
FROM e JOIN z ON true JOIN g ON g.r = e.r AND g.l = z.l JOIN u ON u.s IS NOT DISTINCT FROM e.s
"""
