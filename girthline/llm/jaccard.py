"""N-gram Jaccard join of whole documents by prefix filtering under several global token orders.

A document is the set of its distinct word shingles. Two sets whose Jaccard similarity reaches the threshold share a
token among the first `size - ceil(threshold * size) + 1` of each, under any global order of tokens; so a candidate pair
must share such a prefix token under every order used, and the filters are intersected before exact verification. The
orders all put rare tokens first and break ties by different hashes.

Nothing of quadratic size is made for a group of copies:

1. Equal sets become one class. Document frequencies are counted by totals.Exchange; tokens that no other class has only
   count towards sizes. A document with too few shared tokens has no partner and is done.
2. Each class is compared with few anchors, the same for all that share prefix tokens, and the links found so far make
   components.
3. Only pairs of different components are left to compare, and all that pass the filters under every order are: those
   in short posting lists as rows, those in long ones in blocks inside a task, of which only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lean
from .common import forget, written
from .tokens import mix, ngrams, word_hashes
from .totals import MESSAGE, Exchange, bundle, pack, text_size, unbundle, unpack

#: Shingle length in words; similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Token orders, and anchors that a class is compared with in a round of step 2.
ORDERS, ANCHORS, ROUNDS = 3, 2, 2
#: Longest posting list whose pairs become rows; longer ones are compared in blocks of this many sets.
LIGHT, BLOCK = 32, 512
#: Bits of a shingle's hash by which its frequency is counted.
KEY_BITS = 44
#: Rows of a batch that are Python objects at a time.
SLICE = 256


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words has none."""
    parts = [word_hashes(t) for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    grams = ngrams(np.concatenate(parts) if parts else np.zeros(0, np.uint64), words)
    out = []
    for p, end in zip(parts, ends.tolist()):
        if len(p) >= words:
            out.append(np.unique(grams[end - len(p) : end - words + 1]))
        elif len(p):
            out.append(ngrams(p, len(p)))
        else:
            out.append(p)
    return out


def least_shared(n: np.ndarray | int, percent: int = PERCENT):
    """Tokens that a set of n must share with any partner: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def gather(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, sig1, sig2, tokens, dfs for each row: set size, a 128-bit signature of the set, and (unless too few
    for any partner) the tokens that other rows hold as an array in binary, with the number of rows that hold them, packed.

    Shingles are counted by KEY_BITS bits of their hashes. Two that share these bits are both counted too high, which
    changes their place in the orders alike for all sets and keeps tokens that could go, so no link depends on it.
    """
    way = Exchange(text_size(docs), KEY_BITS, 1)
    rows = docs.select("doc_id", "text").mapInArrow(lean.task(bundle), "unit long, docs binary")

    def opened(table: pa.Table) -> tuple[int, pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        number, table = table.column("unit")[0].as_py(), unbundle(table)
        sets = shingle_sets(table.column("text").to_pylist(), words)
        flat = np.concatenate(sets)
        keys, which = np.unique(flat >> np.uint64(64 - KEY_BITS), return_inverse=True)
        return number, table, np.array([len(s) for s in sets], np.int64), flat, keys, which

    def send(table: pa.Table) -> pa.Table:
        number, _, _, _, keys, which = opened(table)
        return way.messages(number, keys, [np.bincount(which, minlength=len(keys))])

    def assemble(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, table, size, flat, keys, which = opened(table)
        (totals,) = way.answered(keys, answers)
        doc = np.repeat(np.arange(len(size)), size)
        sums = np.zeros((2, len(size)), np.uint64)
        np.add.at(sums[0], doc, flat)
        np.add.at(sums[1], doc, mix(flat, flat))
        sums[0] ^= size.astype(np.uint64)
        df = totals[which]
        shared = df > 1
        token, df = flat[shared], df[shared]
        edge = np.searchsorted(doc[shared], np.arange(len(size) + 1))
        tokens, dfs = [None] * len(size), [None] * len(size)
        for i in np.flatnonzero((np.diff(edge) >= least_shared(size, percent)) & (size > 0)).tolist():
            own = slice(edge[i], edge[i + 1])
            tokens[i], dfs[i] = token[own].tobytes(), pack(df[own])
        return pa.table({"doc_id": table.column("doc_id"), "n": pa.array(size), "sig1": pa.array(sums[0].view(np.int64)), "sig2": pa.array(sums[1].view(np.int64)), "tokens": pa.array(tokens, pa.binary()), "dfs": pa.array(dfs, pa.binary())})

    answers = way.totals(rows.groupBy("unit").applyInArrow(lambda t: lean.group(send, t), MESSAGE))
    return rows.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(lambda t, a: lean.group(assemble, t, a), "doc_id long, n long, sig1 long, sig2 long, tokens binary, dfs binary")


def shrink(tokens: np.ndarray, dfs: np.ndarray) -> bytes:
    """Sorted tokens and the doubling of each one's frequency, compressed by byte planes."""
    order = np.argsort(tokens)
    planes = np.diff(tokens[order], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + np.log2(dfs[order]).astype(np.uint8).tobytes())


def grow(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 9
    return np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64), raw[8 * n :]


def prefix(tokens: np.ndarray, rare: np.ndarray, n: int, k: int, percent: int) -> np.ndarray:
    """Prefix tokens under global order k: rare tokens first, by doubling of frequency, then by a hash.

    Tokens that nothing else holds come first in every order, so they only shorten the prefix.
    """
    length = n - least_shared(n, percent) + 1 - (n - len(tokens))
    return tokens[np.lexsort((mix(tokens, np.full(len(tokens), k, np.uint64)), rare))[: max(0, length)]]


def prefixes(tokens: bytes, n: int, percent: int, orders: int) -> bytes:
    """A set's prefix tokens under each order, sorted within it: the orders' ends, then the tokens."""
    t, rare = grow(tokens)
    found = [np.sort(prefix(t, rare, n, k, percent)) for k in range(orders)]
    return np.concatenate([np.cumsum([len(x) for x in found]).astype(np.uint64), *found]).astype("<u8").tobytes()


def of_order(data: bytes, k: int, orders: int) -> np.ndarray:
    x = np.frombuffer(data, "<u8")
    ends = x[:orders].astype(np.int64)
    return x[orders + (ends[k - 1] if k else 0) : orders + ends[k]]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: sets are long, and a batch may hold thousands of them."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def postings(active: DataFrame, k: int, orders: int) -> DataFrame:
    """token, node, n for the prefix tokens of each set under order k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            node, n = b.column("node").to_numpy(), b.column("n").to_numpy()
            found = [of_order(p, k, orders) for p in b.column("prefixes").to_pylist()]
            size = [len(x) for x in found]
            if sum(size):
                yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(found).view(np.int64)), "node": pa.array(np.repeat(node, size)), "n": pa.array(np.repeat(n, size))})

    return active.select("node", "n", "prefixes").mapInArrow(lean.task(run), "token long, node long, n long")


def verified(pairs: DataFrame, active: DataFrame, percent: int, orders: int) -> DataFrame:
    """Of pairs (a, b) those that share a prefix token under every order and reach the threshold.

    The filters of all orders are intersected on prefixes alone; only pairs that pass them all fetch their sets.
    """

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            both = zip(batch.column("prefixes_a").to_pylist(), batch.column("prefixes_b").to_pylist())
            keep = pa.array([all(len(np.intersect1d(of_order(a, k, orders), of_order(b, k, orders), True)) for k in range(orders)) for a, b in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = np.zeros(batch.num_rows, bool)
            cols = [batch.column(c).to_pylist() for c in ("n_a", "tokens_a", "n_b", "tokens_b")]
            for i, (na, a, nb, b) in enumerate(zip(*cols)):
                both = len(np.intersect1d(grow(a)[0], grow(b)[0], True))
                keep[i] = 100 * both >= percent * (na + nb - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    side = lambda s, *cols: active.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in cols))
    left = pairs.join(side("a", "prefixes"), "a").join(side("b", "prefixes"), "b").mapInArrow(lean.task(passing), "a long, b long")
    return left.join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b").mapInArrow(lean.task(run), "a long, b long")


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices of `width` tokens at a time."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    if not m:
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    _, which, n = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    shared = n[which] > 1
    column, owner = place[which[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s = slice(*np.searchsorted(column, [at, at + width]))
        part = np.zeros((m, width), np.float32)
        part[owner[s], column[s] - at] = 1
        out += part @ part.T
    return out


def forest(mask: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric mask connects."""
    seen, out = np.zeros(len(mask), bool), []
    for root in range(len(mask)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            i = todo.pop()
            near = np.flatnonzero(mask[i] & ~seen).tolist()
            seen[near] = True
            out += [(i, j) for j in near]
            todo += near
    return out


def block_links(lists: DataFrame, active: DataFrame, percent: int, orders: int) -> DataFrame:
    """Links inside long posting lists (token, node, n, comp, m), enough to connect what all of them connect.

    A list is cut into blocks of bounded size, and each pair of blocks is one group: the filters of all orders are
    intersected as matrices, what remains is verified by exact overlaps, and only links of a spanning forest leave the
    task, so no row is made for a pair.
    """
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = lists.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = own.withColumn("other", other).select("token", "node", "n", "comp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    rows = dealt.join(active.select("node", "tokens", "prefixes"), "node")

    def run(table: pa.Table) -> pa.Table:
        node, n, comp, own = (table.column(c).to_numpy() for c in ("node", "n", "comp", "own"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sets, firsts = table.column("tokens").to_pylist(), table.column("prefixes").to_pylist()
        ok = comp[:, None] != comp[None, :]
        ok &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        if lo != hi:
            ok &= own[:, None] != own[None, :]
        for k in range(orders):
            if ok.any():
                ok &= overlaps([of_order(p, k, orders) for p in firsts]) > 0
        edges = []
        if ok.any():
            used = np.flatnonzero(ok.any(1))
            both = overlaps([grow(sets[i])[0] for i in used])
            union = n[used][:, None] + n[used][None, :] - both
            linked = ok[np.ix_(used, used)] & (100 * both >= percent * union)
            edges = [(int(node[used[i]]), int(node[used[j]])) for i, j in forest(linked)]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return rows.groupBy("token", "lo", "hi").applyInArrow(lambda t: lean.group(run, t), "a long, b long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, comp: the smallest node that each node of `edges` (a, b) reaches.

    Labels spread along edges and then jump to their label's label, so a chain takes logarithmically many rounds.
    Everything stays distributed; each round is written to the shared folder.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), label)
    held = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), label)
    while True:
        labels = held.select("node", "comp")
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("low"))
        spread = written(labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp")), label)
        jump = spread.select(F.col("node").alias("via"), F.col("comp").alias("to"))
        after = written(spread.join(jump, spread["comp"] == jump["via"], "left").select("node", "was", F.least("comp", F.coalesce("to", "comp")).alias("comp")), label)
        for x in (held, spread):
            forget(x)
        held = after
        if after.where("comp <> was").isEmpty():
            forget(both)
            return after.select("node", "comp")


def size_ok(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def links(active: DataFrame, percent: int = PERCENT, orders: int = ORDERS, anchors: int = ANCHORS, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b) between sets (node, n, tokens, prefixes) with the components of all pairs that reach the threshold."""
    edges, comps = None, None

    def with_comp(df: DataFrame) -> DataFrame:
        if comps is None:
            return df.withColumn("comp", F.col("node"))
        c = comps.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        return df.join(c, df["node"] == c["_n"], "left").withColumn("comp", F.coalesce("_c", "node")).drop("_n", "_c")

    for k in range(rounds):
        posts = written(with_comp(postings(active, k, orders)), "postings")
        # Only lists that hold several components can link anything new.
        heads = posts.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("anchor"), F.col("n").alias("m"), F.col("comp").alias("other"))).alias("x"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1")
        near = posts.join(heads.select("token", "x.*"), "token").where((F.col("comp") != F.col("other")) & size_ok("n", "m", percent))
        best = Window.partitionBy("node").orderBy(F.desc("shared"), "anchor")
        pairs = near.groupBy("node", "anchor").agg(F.count("*").alias("shared")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= anchors)
        found = written(verified(pairs.select(F.col("node").alias("a"), F.col("anchor").alias("b")), active, percent, orders), "links")
        edges = found if edges is None else edges.unionByName(found)
        comps = components(edges)

    # What is left: lists of the first order's prefixes that still hold several components. Lists of the same sets,
    # as the tokens of one passage have them, are worked on once.
    posts = written(with_comp(postings(active, 0, orders)), "postings")
    lists = posts.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1")
    lists = lists.groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token", "m")
    left = written(posts.join(lists, "token"), "crossing")
    light = left.where(F.col("m") <= LIGHT)
    side = lambda s: light.select("token", F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("comp").alias(f"c{s}"))
    pairs = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & size_ok("na", "nb", percent)).select("a", "b").distinct()
    edges = edges.unionByName(verified(written(pairs, "candidates"), active, percent, orders))
    return edges.unionByName(block_links(left.where(F.col("m") > LIGHT), active, percent, orders))


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`, exactly but for collisions of 64-bit shingle hashes.

    Null text and text without words make the empty set, which links with nothing; its component is its own id. Rows
    that share a doc_id are one document. Rows without doc_id get no component and link nothing, since links name ids.
    Repeated rows get a row each; an empty table gives an empty result; other columns are ignored. A very long text is a
    batch of its own and one large set; whole sets are compared, whatever their size. Ties in the orders go by hashes.
    """
    with lean.small_batches(docs.sparkSession):
        return classified(docs, words, percent)


def classified(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """classes(), under the caller's settings."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    every = written(gather(rows, words, percent), "sets")
    same = written(every.where("n > 0").groupBy("sig1", "sig2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    key = ["sig1", "sig2"]
    shared = every.where("tokens IS NOT NULL").join(same, key).where("doc_id = node").dropDuplicates(key)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drop the tokens that only copies hold; drop sets that then can't have a partner."""
        for b in sliced(batches):
            keep, tokens, firsts = [], [], []
            for t, d, n, c in zip(*(b.column(x).to_pylist() for x in ("tokens", "dfs", "n", "copies"))):
                t = np.frombuffer(t, np.uint64)
                d = unpack(d, len(t))
                more = d > c
                keep.append(bool(more.sum() >= least_shared(n, percent)))
                if keep[-1]:
                    tokens.append(shrink(t[more], d[more]))
                    firsts.append(prefixes(tokens[-1], n, percent, ORDERS))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("node").filter(keep), b.column("n").filter(keep), pa.array(tokens, pa.binary()), pa.array(firsts, pa.binary())], names=["node", "n", "tokens", "prefixes"])

    active = written(shared.select("node", "n", "copies", "tokens", "dfs").mapInArrow(lean.task(others), "node long, n long, tokens binary, prefixes binary"), "active")
    # Classes whose first ids are the same row id are one document already.
    comps = components(links(active, percent).unionByName(same.groupBy("node").count().where("count > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))))
    found = same.join(comps.select("node", "comp"), "node", "left").select("sig1", "sig2", F.coalesce("comp", "node").alias("component_id"))
    out = every.join(found, key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    bare = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "text")
    without = bare.mapInArrow(lambda bs: counted(bs, words), "doc_id long, n_shingles long").withColumn("component_id", F.lit(None).cast("long"))
    return out.unionByName(without)


def counted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_shingles": pa.array([len(s) for s in shingle_sets(b.column(1).to_pylist(), words)], pa.int64())})


#: The same classes for DuckDB, by joining all shingles; for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
         WHEN len(words) > 0 THEN [array_to_string(words, ' ') || ' '] ELSE [] END) AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n_shingles + nb.n_shingles - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
