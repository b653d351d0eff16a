"""Corpus-wide totals of hashed keys, such as n-grams and shingles, for the batches of texts that hold them.

A batch sends its distinct keys with their counts to hash buckets, as compressed messages; a bucket adds up all batches'
counts and answers each message with the totals. A frequent key costs a batch one entry, however often it occurs, and no
table of keys is broadcast or collected.

A sender has at most 2^FAN messages. Where more buckets are needed, batches' messages are first added up by groups of
2^FAN batches, and the sums are sent on, so the number of messages grows in proportion to the input, and a key that all
batches hold reaches its bucket once for each group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import portions

#: Text of a batch and for each hash bucket, in bytes, about; bits of the bucket's number, at least, and of one sender's.
BATCH_BYTES, BUCKET_BYTES, LEAST_BITS, FAN = 4_000_000, 4_000_000, 6, 10
MESSAGE = "unit long, bucket long, keys binary, counts binary"
_schema = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])



def apart(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, each compressed by itself: random low bytes don't spoil the code of the others."""
    planes = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in values.view(np.uint8).reshape(-1, values.itemsize).T]
    return np.array([len(x) for x in planes], "<u4").tobytes() + b"".join(planes)


def together(data: bytes, width: int) -> np.ndarray:
    ends = 4 * width + np.cumsum(np.frombuffer(data, "<u4", width, 0), dtype=np.int64)
    starts = [4 * width, *ends[:-1].tolist()]
    planes = [np.frombuffer(zstandard.ZstdDecompressor().decompress(data[a:b]), np.uint8) for a, b in zip(starts, ends.tolist())]
    return np.stack(planes, 1).view(f"<u{width}").ravel()


def squeeze(ascending: np.ndarray) -> bytes:
    return apart(np.diff(ascending, prepend=ascending.dtype.type(0)))


def unsqueeze(data: bytes) -> np.ndarray:
    return np.cumsum(together(data, 8), dtype=np.uint64)


def pack(counts: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 and more follow as 64-bit integers; compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


def bundle(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Documents in batches of about `most` bytes of text, each one compressed value, so that texts are shuffled small:
    their words only, with A-Z lower-cased and one space between.

    A batch's number is a hash of its place and content: a repeated task that met other rows gives other numbers, for
    which there are no answers, rather than wrong counts.
    """
    k = 0
    for batch in batches:
        for part, texts in portions(batch.column("text"), most, most // 20):
            some, sink = batch.slice(part.start, part.stop - part.start), pa.BufferOutputStream()
            words = pa.array([b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts], pa.binary())
            some = some.set_column(some.schema.get_field_index("text"), "text", words)
            with pa.ipc.new_stream(sink, some.schema) as out:
                out.write_batch(some)
            data, k = sink.getvalue().to_pybytes(), k + 1
            number = hashlib.blake2b(b"%d %d " % (TaskContext.get().partitionId(), k) + data, digest_size=8).digest()
            yield pa.RecordBatch.from_pydict({"unit": pa.array([int.from_bytes(number) >> 1], pa.int64()), "docs": pa.array([zstandard.ZstdCompressor(level=5).compress(data)], pa.binary())})


def unbundle(table: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x)).read_all() for x in table.column("docs").to_pylist())


class Exchange:
    """The way of messages for `size` bytes of text in batches of `batch`, with so many counts to a key. Keys have `keep` bits, or, with many
    buckets, `rest` more than a bucket's number."""

    def __init__(self, size: int, keep: int, planes: int, rest: int = 0, batch: int = BATCH_BYTES):
        self.planes, self.bits = planes, max(LEAST_BITS, int(size // BUCKET_BYTES).bit_length())
        self.keep = min(63, max(keep, rest + self.bits))
        self.fan = FAN
        self.units = size // batch + 1

    def edges(self, keys: np.ndarray, depth: int) -> np.ndarray:
        """Where the slices of ascending keys begin, and the last ends, that the bits after the first `depth` tell."""
        width = min(self.fan, self.bits - depth)
        rest = keys & np.uint64((1 << (self.keep - depth)) - 1)
        return np.searchsorted(rest, np.arange((1 << width) + 1, dtype=np.uint64) << np.uint64(self.keep - depth - width))

    def messages(self, unit: int, keys: np.ndarray, counts: list[np.ndarray], depth: int = 0) -> pa.Table:
        """The messages of a unit with distinct ascending keys, which agree in their first `depth` bits."""
        edges, width = self.edges(keys, depth), min(self.fan, self.bits - depth)
        below = np.uint64((1 << (self.keep - depth - width)) - 1)
        used = np.flatnonzero(np.diff(edges)).tolist()
        slices = [slice(edges[k], edges[k + 1]) for k in used]
        first = int(keys[0]) >> (self.keep - depth) if len(keys) else 0
        return pa.table({
            "unit": [unit] * len(used), "bucket": [first << width | k for k in used], "keys": [squeeze(keys[s] & below) for s in slices],
            "counts": [pack(np.concatenate([c[s] for c in counts])) for s in slices],
        }, schema=_schema)

    def answered(self, keys: np.ndarray, answers: pa.Table, depth: int = 0) -> list[np.ndarray]:
        """The totals of a unit's ascending keys from the answers to its messages."""
        edges = self.edges(keys, depth)
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()))
        out = np.zeros((self.planes, len(keys)), np.int64)
        first = int(keys[0]) >> (self.keep - depth) if len(keys) else 0
        width = min(self.fan, self.bits - depth)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            s = slice(edges[k], edges[k + 1])
            out[:, s] = unpack(got[first << width | k], self.planes * (s.stop - s.start)).reshape(self.planes, -1)
        return list(out)

    def summed(self, table: pa.Table, depth: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        """Distinct keys of a bucket's messages, their summed counts, and each message's places among them and counts."""
        base = np.uint64(table.column("bucket")[0].as_py() << (self.keep - depth))
        keys = [unsqueeze(k) for k in table.column("keys").to_pylist()]
        n = [len(k) for k in keys]
        found, which = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(c, self.planes * m).reshape(self.planes, m) for c, m in zip(table.column("counts").to_pylist(), n)], 1)
        # bincount adds floating-point numbers, which would lose ones from 2^53 on.
        sums = np.zeros((self.planes, len(found)), np.int64)
        for s, c in zip(sums, counts):
            if float(c.sum(dtype=float)) < 2**52:
                s[:] = np.bincount(which, c, len(found))
            else:
                np.add.at(s, which, c)
        ends = np.cumsum(n)[:-1]
        return found | base, list(sums), list(zip(np.split(which, ends), np.split(counts, ends, axis=1)))

    def replies(self, table: pa.Table, sums: list[np.ndarray], places: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, list]:
        """An answer a message: all totals of the first count; of the others those that the sender has a share in."""
        counts = [pack(np.concatenate([sums[0][w], *(s[w] * (own > 0) for s, own in zip(sums[1:], given[1:]))])) for w, given in places]
        return {"unit": table.column("unit").to_pylist(), "bucket": table.column("bucket").to_pylist(), "keys": [None] * len(counts), "counts": counts}

    def totals(self, messages: DataFrame, extra: Callable[[np.ndarray, list[np.ndarray]], bytes] | None = None, depth: int = 0) -> DataFrame:
        """The answers to `messages`. With `extra`, each bucket also gives a row of a negative unit with what `extra`
        makes of its keys and totals. Rows with a negative bucket pass as they are."""
        depth = min(self.bits, depth + self.fan)

        def last(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            if bucket < 0:
                return table
            keys, sums, places = self.summed(table, depth)
            out = self.replies(table, sums, places)
            if extra:
                for name, value in (("unit", -1 - bucket), ("bucket", -1 - bucket), ("keys", None), ("counts", extra(keys, sums))):
                    out[name].append(value)
            return pa.table(out, schema=_schema)

        if depth == self.bits:
            return messages.groupBy("bucket").applyInArrow(last, MESSAGE)
        groups = (self.units >> self.fan) + 1
        # A group of units' messages to one bucket is a unit of the next level.
        up = F.when(F.col("bucket") >= 0, F.col("bucket") * groups + F.pmod(F.xxhash64("unit"), F.lit(groups))).otherwise(F.col("bucket"))
        dealt = messages.withColumn("up", up)

        def sum_up(table: pa.Table) -> pa.Table:
            if table.column("bucket")[0].as_py() < 0:
                return table.select(_schema.names)
            keys, sums, _ = self.summed(table, depth)
            return self.messages(table.column("up")[0].as_py(), keys, sums, depth)

        def hand_down(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows or table.column("bucket")[0].as_py() < 0:
                return (answers if not table.num_rows else table).select(_schema.names)
            keys, _, places = self.summed(table, depth)
            return pa.table(self.replies(table, self.answered(keys, answers, depth), places), schema=_schema)

        above = Exchange.__new__(Exchange)
        above.__dict__.update(self.__dict__, units=groups)
        answers = above.totals(dealt.groupBy("up").applyInArrow(sum_up, MESSAGE), extra, depth)
        # What passes as it is went up with the sums and comes back under its own unit.
        through = answers.where("bucket < 0")
        back = dealt.where("bucket >= 0").groupBy("up").cogroup(answers.where("bucket >= 0").groupBy("unit")).applyInArrow(hand_down, MESSAGE)
        return back.unionByName(through)


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts, and 20 for each row."""
    facts = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    return (facts["bytes"] or 0) + 20 * facts["n"]
