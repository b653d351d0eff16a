"""Pack token sequences into rows of fixed length: best fit decreasing with a segment tree over free capacities.

Documents longer than a row are cut into pieces without loss. A hash deals documents into shards of bounded size, so the
rows are the same however the input is split, and a lost task repeats only its own shards.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row length in tokens; tokens that a shard is packed at, at most, and bytes of text that it is dealt, about; ids of the byte tokenizer's end of text and of padding.
ROW, SHARD, SHARD_BYTES, END, PAD = 2048, 4_000_000, 8_000_000, 256, 257


class Free:
    """Bins by free capacity 0 to `most`, with a segment tree that tells which capacities have a bin."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        i = self.size + capacity
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove a bin of the smallest capacity of at least `least`."""
        i = self.size + least
        if not self.tree[i]:
            # Up while there is nothing on the right, then down to the leftmost leaf.
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        number = self.bins[capacity].pop()
        if not self.bins[capacity]:
            while i and not (i < self.size and (self.tree[2 * i] or self.tree[2 * i + 1])):
                self.tree[i] = 0
                i >>= 1
        return capacity, number


def best_fit(lengths: np.ndarray, row: int) -> list[list[int]]:
    """Bins of pieces (none longer than `row`): longest first, each into the fullest bin that has room."""
    free, bins = Free(row), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = free.take(n)
        if found is None:
            bins.append([])
            found = row, len(bins) - 1
        bins[found[1]].append(i)
        if found[0] > n:
            free.add(found[0] - n, found[1])
    return bins


def byte_ids(text: str) -> np.ndarray:
    """The ids of the byte tokenizer: UTF-8 bytes and an end of text."""
    return np.append(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint16), np.uint16(END))


_encodings: dict[str, object] = {}


def rank_encoder(spark: SparkSession, path: str, pattern: str, end: int, most: int = 64_000_000) -> Callable[[str], np.ndarray]:
    """An encoder of a byte-pair rank file (a line a token: base 64, rank), which puts `end` after each text.

    The file's content goes to the executors; its size is checked. A worker builds the encoding once.
    """
    with open(path, "rb") as f:
        content = f.read(most + 1)
    if len(content) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    shared, key = spark.sparkContext.broadcast(content), hashlib.sha256(content + pattern.encode()).hexdigest()

    def encode(text: str) -> np.ndarray:
        if key not in _encodings:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return np.append(np.array(_encodings[key].encode_ordinary(text), np.uint32), np.uint32(end))

    return encode


def pack(docs: DataFrame, encode: Callable[[str], np.ndarray] = byte_ids, row: int = ROW, shard: int = SHARD, pad: int = PAD) -> DataFrame:
    """Packed rows: shard, part, row, n_tokens, ids, cu_seqlens, positions, doc_ids, starts.

    ids is a row of the id matrix (little-endian unsigned 32-bit, padded to `row`); cu_seqlens holds the segments'
    cumulative lengths from 0; positions holds each token's place in its segment, so it is reset at each; doc_ids and
    starts say of which document, and from which of its tokens on, each segment is. A document is its segments by
    rising start. (shard, part, row) is unique. Shards follow a hash of id and text; a shard that rows repeated many
    times make too large is packed in several parts, so that memory stays bounded.

    Null text is the empty text, which is its end token; null ids and repeated rows are documents like others; documents
    of equal length are packed by rising id; a very long text is cut into rows, but encoded at once; an empty table
    gives an empty result; other columns are ignored.
    """
    schema = "shard long, part int, row int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<int>"

    def rows(number: int, part: int, owners: list, seqs: list[np.ndarray]) -> pa.RecordBatch:
        pieces = [(k, s) for k, ids in enumerate(seqs) for s in range(0, len(ids), row)]
        lengths = np.array([min(row, len(seqs[k]) - s) for k, s in pieces], np.int64)
        out: dict[str, list] = {c: [] for c in ("ids", "cu", "positions", "docs", "starts", "n")}
        for b in best_fit(lengths, row):
            size = lengths[b]
            ids = np.full(row, pad, "<u4")
            ids[: size.sum()] = np.concatenate([seqs[pieces[i][0]][pieces[i][1] : pieces[i][1] + row] for i in b])
            ends = np.cumsum(size)
            positions = np.arange(ends[-1]) - np.repeat(ends - size, size)
            out["ids"].append(ids.tobytes()), out["cu"].append([0, *ends.tolist()]), out["positions"].append(positions.astype("<u4").tobytes())
            out["docs"].append([owners[pieces[i][0]] for i in b]), out["starts"].append([pieces[i][1] for i in b]), out["n"].append(int(ends[-1]))
        n = len(out["n"])
        return pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["ids"], pa.binary()), pa.array(out["cu"], pa.list_(pa.int32())), pa.array(out["positions"], pa.binary()), pa.array(out["docs"], pa.list_(pa.int64())), pa.array(out["starts"], pa.list_(pa.int32()))], names=["shard", "part", "row", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, owners, seqs, held = None, 0, [], [], 0
        for batch in batches:
            for own, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if seqs and (own != number or held >= shard):
                    yield rows(number, part, owners, seqs)
                    part, owners, seqs, held = (part + 1 if own == number else 0), [], [], 0
                number = own
                ids = encode(text.as_py() or "")
                owners.append(doc), seqs.append(ids)
                held += len(ids)
        if seqs:
            yield rows(number, part, owners, seqs)

    text = F.col("text").cast("string")
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    shards = int(size // SHARD_BYTES) + 1
    x = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(shards)).cast("long").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return x.repartition("shard").sortWithinPartitions("shard", "doc_id", F.xxhash64("text"), "text").mapInArrow(run, schema)


def write(packed: DataFrame, path: str) -> DataFrame:
    """Writes packed rows to <path>/rows, and a row a shard's part to <path>/manifest, and gives the rows read back.

    A row's matrices are binary columns: its ids and positions as little-endian unsigned 32-bit integers, beside the
    cumulative segment lengths. The manifest has the numbers of rows, tokens and segments, and a sum over the ids' CRCs
    by which a copy can be checked; it is made from the rows as written. A second run overwrites both.
    """
    packed.write.mode("overwrite").parquet(f"{path}/rows")
    rows = packed.sparkSession.read.schema(packed.schema).parquet(f"{path}/rows")
    manifest_of(rows).write.mode("overwrite").parquet(f"{path}/manifest")
    return rows


def manifest_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.sum(F.col("n_tokens").cast("long")).alias("tokens"), F.sum(F.size("starts").cast("long")).alias("segments"), F.sum(F.crc32("ids")).alias("crc"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The packed rows of a folder that write() filled, after a check against its manifest."""
    rows = spark.read.parquet(f"{path}/rows")
    if not manifest_of(rows).exceptAll(spark.read.parquet(f"{path}/manifest")).isEmpty() or not spark.read.parquet(f"{path}/manifest").exceptAll(manifest_of(rows)).isEmpty():
        raise ValueError(f"{path}: the rows are not those of the manifest")
    return rows


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, start, ids of each segment, from packed rows: the inverse of pack() up to joining a document's pieces."""
    seg = packed.select("ids", F.posexplode(F.arrays_zip("doc_ids", "starts")).alias("k", "seg"), "cu_seqlens")
    lo, hi = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    return seg.select(F.col("seg.doc_ids").alias("doc_id"), F.col("seg.starts").alias("start"), F.substring("ids", 4 * lo + 1, 4 * (hi - lo)).alias("ids"))


def digest(packed: DataFrame) -> DataFrame:
    """The packed rows with digests in place of the matrices."""
    sha = lambda c: F.sha2(F.col(c), 256)
    return packed.select("shard", "part", "row", "n_tokens", F.array_join(F.transform("doc_ids", lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",").alias("doc_ids"), F.array_join(F.transform("starts", lambda x: x.cast("string")), ",").alias("starts"), F.array_join(F.transform("cu_seqlens", lambda x: x.cast("string")), ",").alias("cu_seqlens"), sha("ids").alias("ids_sha256"), sha("positions").alias("positions_sha256"))
