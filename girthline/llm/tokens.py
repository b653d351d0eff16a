"""Word hashes of whole texts in bulk, for operators that count or compare word n-grams.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; bytes.lower() and bytes.split() do just that on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

from .lean import remembered

#: Words whose hash a worker remembers; bounds memory, not results.
REMEMBER = 200_000
MIX, ADD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = remembered("words", Hashes())


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words, in order; none for null. Bytes are words with lower-case A-Z already."""
    words = text.split() if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its start and the next word's."""
    h = (h ^ (then + ADD + (h << np.uint64(6)))) * MIX
    return h ^ (h >> np.uint64(29))


def ngrams(flat: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word but the last n - 1."""
    out = mix(np.full(max(0, len(flat) - n + 1), n, np.uint64), flat[: max(0, len(flat) - n + 1)])
    for k in range(1, n):
        out = mix(out, flat[k : len(flat) - n + 1 + k])
    return out


def portions(texts: pa.Array, most_bytes: int, most_texts: int) -> Iterator[tuple[slice, list[str | None]]]:
    """Slices of bounded size of an Arrow column, each with its texts; a longer text is a slice of its own.

    Only one slice's texts are Python objects at a time, however many rows the batch has.
    """
    size = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at, n = 0, 0
    for i, m in enumerate([*size, None]):
        if m is None or i > at and (n + m > most_bytes or i - at == most_texts):
            if i > at:
                yield slice(at, i), texts.slice(at, i - at).to_pylist()
            at, n = i, 0
        n += m or 0


def squeeze(ascending: np.ndarray) -> bytes:
    """Ascending unsigned integers: differences, by byte planes, compressed."""
    width = ascending.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.diff(ascending, prepend=ascending.dtype.type(0)).view(np.uint8).reshape(-1, width).T.tobytes())


def unsqueeze(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel(), dtype=f"<u{width}")
