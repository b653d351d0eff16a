"""Byte-level BPE encoding and decoding by speculation and verification.

A word's tokens are guessed by greedy longest match. A guess is right exactly when every adjacent pair of its tokens is
what BPE makes of the pair's own bytes (and, for one token, when BPE makes that token of its bytes). All pairs of a
batch are tested at once against sorted arrays of known pairs; only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import remembered
from .tokens import portions

#: The split before the merges of byte-level BPE files of this family, and the name they give the split.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers at most, and bytes of text it takes up at once. Both bound memory, not results.
REMEMBER, CHUNK = 300_000, 1_000_000


def byte_chars() -> dict[str, int]:
    """The characters by which tokenizer files name the 256 bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def checked(model: dict) -> dict:
    """A tokenizer file's content, if it is of the kind that Bpe encodes; anything else would give other ids."""
    split, bpe = model.get("pre_tokenizer") or {}, model["model"]
    strange = {
        "normalizer": model.get("normalizer") is not None,
        "pre_tokenizer": (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True),
        "model": bpe.get("type", "BPE") != "BPE" or any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": any(x.get(k) for x in model.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if any(strange.values()):
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(k for k, bad in strange.items() if bad)}")
    return model


class Bpe:
    """An encoder of one tokenizer file's content, with its memory of words and pairs."""

    def __init__(self, spec: str):
        import regex

        model = checked(json.loads(spec))
        chars = byte_chars()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        self.added = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        vocab = {as_bytes(k): v for k, v in model["model"]["vocab"].items() if k not in self.added}
        self.ids = vocab
        self.bytes = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.added.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.starts = {t[:n] for t in vocab for n in range(1, len(t) + 1)}
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words: dict[str, bytes] = {}
        self.pairs, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.exact_words = self.guessed_words = 0

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first among equals; a heap keeps very long words near linear."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x in ids if x >= 0]

    def guess(self, word: bytes) -> list[int]:
        out, i, n, starts, ids = [], 0, len(word), self.starts, self.ids
        while i < n:
            j, end, found = i + 1, i + 1, ids[word[i : i + 1]]
            while j < n and word[i : j + 1] in starts:
                j += 1
                if (t := ids.get(word[i:j])) is not None:
                    end, found = j, t
            out.append(found)
            i = end
        return out

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Of each code a << 32 | b (b = 2^32 - 1: the token a alone) whether BPE leaves it as it is."""
        found = np.unique(codes)
        at = np.searchsorted(self.pairs, found)
        new = found[(at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != found)] if len(self.pairs) else found
        if len(new):
            right = []
            for c in new.tolist():
                want = [c >> 32] if (c & 0xFFFFFFFF) == 0xFFFFFFFF else [c >> 32, c & 0xFFFFFFFF]
                right.append(self.exact(b"".join(self.bytes[t] for t in want)) == want)
            if len(self.pairs) > 4_000_000:
                self.pairs, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
                return self.compatible(codes)
            pairs, good = np.concatenate([self.pairs, new]), np.concatenate([self.good, np.array(right, bool)])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.good = pairs[order], good[order]
        return self.good[np.searchsorted(self.pairs, codes)]

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't remembered."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guesses = [self.guess(w) for w in raw]
        # A code for each adjacent pair and for each token that stands alone; owner: its word.
        a = np.fromiter((x for g in guesses for x in (g[:-1] or g)), np.int64)
        b = np.fromiter((x for g in guesses for x in (g[1:] or (0xFFFFFFFF,))), np.int64)
        owner = np.repeat(np.arange(len(words)), [max(1, len(g) - 1) for g in guesses])
        failing = set(owner[~self.compatible(a << 32 | b)].tolist())
        self.guessed_words += len(words)
        self.exact_words += len(failing)
        for k, w in enumerate(words):
            self.words[w] = np.array(self.exact(raw[k]) if k in failing else guesses[k], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []
        for text in texts:
            if self.special and self.special.search(text):
                mine, at = [], 0
                for m in self.special.finditer(text):
                    mine += self.split.findall(text[at : m.start()])
                    mine.append(self.added[m[0]])
                    at = m.end()
                parts.append(mine + self.split.findall(text[at:]))
            else:
                parts.append(self.split.findall(text))
        if len(self.words) > REMEMBER:
            self.words.clear()
        new = {w for p in parts for w in p}.difference(self.words)
        if any(isinstance(w, int) for w in new):
            self.words |= {w: np.array([w], "<u4").tobytes() for w in new if isinstance(w, int)}
            new = {w for w in new if isinstance(w, str)}
        if new:
            self.learn(list(new))
        get = self.words.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = remembered("bpe", {})


def encoder(spec: str, key: str) -> Bpe:
    """One encoder a worker process, kept over its tasks."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def read_spec(path: str, most: int = 64_000_000) -> str:
    """A tokenizer file's content, which goes to the executors; its size is checked."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(most + 1)
    if len(spec) > most:
        raise ValueError(f"{path} is larger than {most} characters")
    return spec


def encode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids binary, decoded string) of every row.

    Added tokens' strings in a text are those tokens. Null text is the empty text, with no tokens; the ids' and the
    decoded text's digests are then those of nothing. Each row is encoded on its own: repeated rows and null ids give
    a row each, an empty table an empty result, and other columns are ignored.
    """
    spec = read_spec(tokenizer_path)
    key = hashlib.sha256(spec.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value, key)
        for batch in batches:
            doc = batch.column(0)
            for part, texts in portions(batch.column(1), CHUNK, CHUNK):
                ids = bpe.encode([t or "" for t in texts])
                back = [bpe.decode(x) for x in ids]
                cols = {
                    "doc_id": doc[part],
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back], pa.string()),
                }
                if with_ids:
                    cols |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(back, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids)
