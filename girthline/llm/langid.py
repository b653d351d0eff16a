"""Language identification by rank-order profiles: the out-of-place distance between the ranks of a document's most
frequent character n-grams and those of each language's profile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold
from .lean import task
from .tokens import portions

#: n-grams of 1 to 3 characters; so many of each profile and each document.
ORDERS, TOP = 3, 300
#: Documents of each language that training reads at most (about: a hash threshold chooses them).
SAMPLE = 4000
#: Documents and bytes of text that are counted at once.
GROUP, BYTES = 120, 400_000

_folded: list[np.ndarray] = []


def folded() -> np.ndarray:
    """Code point to the lower-case letter, or 0 for all that isn't a letter. Letters end below 2^18."""
    if not _folded:
        out = np.zeros(0x110000, np.int64)
        for c in range(0x40000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _folded.append(out)
    return _folded[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, gram, count of all n-grams, by doc and gram; and each text's letters. At most 120 texts a call.

    Letters are lower-cased; anything else, however long, is one space, also at either end. A gram's code holds its
    length and 18 bits a character.
    """
    fold = folded()
    codes = [fold[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts]
    letters = np.array([int((c > 0).sum()) for c in codes], np.int64)
    zero = np.zeros(1, np.int64)
    flat = np.concatenate([zero, *(x for c in codes for x in (c, zero))])
    doc = np.concatenate([zero, np.repeat(np.arange(len(codes)), [len(c) + 1 for c in codes])])
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] > 0) | (flat[:-1] > 0)
    flat, doc = flat[keep], doc[keep]
    keys = [(doc << 56 | 1 << 54 | flat)[flat > 0]]
    if len(flat) > 1:
        two = flat[:-1] << 18 | flat[1:]
        keys.append(doc[1:] << 56 | 2 << 54 | two)
        if len(flat) > 2:
            # A gram with a space in the middle spans two words, or two documents, and doesn't count.
            keys.append((doc[2:] << 56 | 3 << 54 | two[:-1] << 18 | flat[2:])[flat[1:-1] > 0])
    found = np.sort(np.concatenate(keys))
    start = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(found)))
    return found[start] >> 56, found[start] & ((1 << 56) - 1), count, letters


def ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, gram, rank of each text's `top` most frequent grams; equal counts go by gram."""
    if len(count) and count.max() < 1 << 24:
        at = np.sort(doc << 56 | (0xFFFFFF - count) << 32 | np.arange(len(doc))) & 0xFFFFFFFF
    else:
        at = np.lexsort((np.arange(len(doc)), -count, doc))
    d = doc[at]
    first = np.searchsorted(d, np.arange(int(d[-1]) + 1)) if len(d) else np.zeros(0, np.int64)
    rank = np.arange(len(d)) - first[d] if len(d) else np.zeros(0, np.int64)
    keep = rank < top
    return d[keep], gram[at[keep]], rank[keep]


def train(labelled: DataFrame, top: int = TOP, sample: int = SAMPLE) -> list[tuple[str, int, int]]:
    """(lang, gram, rank) rows of the profiles from (doc_id, text, lang).

    Reads about `sample` documents a language (all, if there are fewer), chosen by a hash of id and language. The result
    has at most `top` rows for each language, however many documents there are.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy(F.col("lang").alias("_lang")).agg((F.lit(float(sample)) / F.count("*") * (1 << 30)).alias("_below"))
    picked = labelled.join(counts, F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) < F.col("_below"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for k, (g, n) in total.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(g), pa.string()), "gram": pa.array(g), "n": pa.array(n)})
            total.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part, texts in portions(batch.column(1), BYTES, GROUP):
                doc, gram, n, _ = grams(texts)
                mine = np.array(langs[part], object)[doc] if len(doc) else np.zeros(0, object)
                for k in set(langs[part]):
                    own = mine == k
                    g0, n0 = total.get(k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    g, where = np.unique(np.concatenate([g0, gram[own]]), return_inverse=True)
                    total[k] = g, np.bincount(where, np.concatenate([n0, n[own]]), len(g)).astype(np.int64)
                if sum(len(g) for g, _ in total.values()) > 2_000_000:
                    yield from rows()
        yield from rows()

    found = picked.select("lang", "text").mapInArrow(task(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top)
    return [(r["lang"], r["gram"], r["rank"]) for r in best.select("lang", "gram", "rank").collect()]


def predict(docs: DataFrame, profiles: list[tuple[str, int, int]], top: int = TOP, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of `docs` and two more, `names`: the language and the score.

    score is 1 less the mean out-of-place distance to the best language as a share of the largest (`top`, which a
    gram outside the profile counts). Ties go to the first language in code-point order. Text that is null or has no
    letter, or any text when no profile was learned, is `und` with score 0. Null ids, repeated rows and other columns
    stay as they are; an empty table gives an empty result; a very long text is counted whole, by itself.
    """
    langs = sorted({p[0] for p in profiles}, key=lambda s: s.encode())
    number = {name: i for i, name in enumerate(langs)}
    # A row a gram of a profile, by gram: only the languages that have a gram are looked at.
    rows = np.array(sorted((gram, number[lang], rank) for lang, gram, rank in profiles), np.int64).reshape(-1, 3)
    # As Spark finds a column: by its name, or in any case.
    text_at = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")
    known, first, many = np.unique(rows[:, 0], return_index=True, return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for _, texts in portions(batch.column(text_at), BYTES, GROUP):
                doc, gram, n, letters = grams([t or "" for t in texts])
                doc, gram, rank = ranked(doc, gram, n, top)
                size, count = len(letters), np.bincount(doc, minlength=len(letters))
                best, far = np.zeros(size, np.int64), np.full(size, float(top))
                if langs and len(doc):
                    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    some = known[at] == gram
                    n = many[at[some]]
                    place = np.repeat(first[at[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    # Every gram is `top` away from a language that doesn't have it; what a profile has comes nearer.
                    nearer = np.maximum(top - np.abs(rows[place, 2] - np.repeat(rank[some], n)), 0)
                    dist = (count * top)[:, None] - np.bincount(np.repeat(doc[some], n) * len(langs) + rows[place, 1], nearer, size * len(langs)).reshape(size, -1)
                    best = dist.argmin(1)
                    far = dist[np.arange(size), best] / np.maximum(count, 1)
                ok = (letters > 0) & bool(langs)
                pred += [langs[b] if k else "und" for b, k in zip(best.tolist(), ok.tolist())]
                score += np.where(ok, np.clip(1 - far / top, 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, *names])

    schema = docs.limit(0).schema.add(names[0], "string").add(names[1], "double")
    return docs.mapInArrow(task(run), schema)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents outside the held-out fold, predicted for all.

    A null id hashes as the empty text. Repeated rows get a row each; an empty table gives an empty result; a table
    without labelled text predicts `und` everywhere; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", (crc_fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    profiles = train(rows.where("NOT held_out").select("doc_id", "text", "lang"))
    return predict(rows.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
