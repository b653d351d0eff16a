"""What a Python worker keeps between tasks.

Spark gives a worker the tasks of later stages too, so what one operator remembers, and what the allocators hold back,
would stay beside the next operator's work, in the memory that an executor shares among its JVM and its workers.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, MutableMapping
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch of rows that goes to a worker, about; bytes of a group from which on memory is given back after it.
BATCH, LARGE = 8_000_000, 1_000_000
#: The setting of the bytes of such a batch.
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_memories: dict[str, MutableMapping] = {}


def remembered(name: str, memory: MutableMapping) -> MutableMapping:
    """`memory` as one that release() clears. It must hold nothing that can't be made again."""
    _memories[name] = memory
    return memory


def release(keep: str = "") -> None:
    """Clear what this process remembers, but for one memory, and give freed memory back to the system."""
    for name, memory in _memories.items():
        if name != keep:
            memory.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function whose tasks begin and end with release()."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def group(f: Callable[..., pa.Table], *tables: pa.Table, keep: str = "words") -> pa.Table:
    """f(*tables) for a group of rows; after a large one, freed memory is given back."""
    try:
        return f(*tables)
    finally:
        if sum(t.nbytes for t in tables) > LARGE:
            release(keep)


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH) -> Iterator[None]:
    """Queries that run inside send workers batches of about `most` bytes at the most; the setting is restored."""
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SETTING)
        else:
            spark.conf.set(SETTING, before)
