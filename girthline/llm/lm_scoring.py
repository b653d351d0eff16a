"""Language-model scores by deleted interpolation.

Maximum-likelihood n-gram estimates of each order are mixed: P_j(w|h) = l_j f_j(w|h) + (1 - l_j) P_{j-1}(w|h'), down to
the uniform P_0 = 1 / (V + 1). The weights l_j belong to buckets of the context's frequency and are learned by
expectation-maximisation on the tokens of a fold of the training documents, with the counts of the other training
documents. The final estimates use the counts of all of them.

N-grams are counted by totals.Exchange: batches of documents send their distinct n-grams and get the totals back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, written
from .tokens import ngrams, word_hashes
from .totals import MESSAGE, Exchange, apart, bundle, text_size, together, unbundle

#: Order of the model; folds of the ids' crc32: which one is held out, and which training fold sets the weights.
ORDER, FOLDS, HELD_OUT, TUNING = 3, 10, 0, 1
#: Steps of expectation-maximisation; weights to begin with and for context frequencies that tuning never saw.
STEPS, PRIOR = 8, 0.5
#: Frequencies of contexts fall into buckets by doubling.
LEVELS = 32
#: Bits of an n-gram's key, at least, and beyond those of its bucket: as the input grows, so do the keys, and about one
#: in a million meets another at any size. The last bit tells words from longer n-grams.
KEY_BITS, KEY_REST = 48, 40
#: Text of a batch in bytes: the larger, the fewer n-grams are sent, each in fewer bits, and the more memory a task takes.
BATCH_BYTES = 8_000_000
#: Hashes that no word has: the end of a text, and what stands before its first word.
END, START = np.uint64(0xE3D5A1F0C2B49687), np.uint64(0x1B7C93D2E8F60A45)


class Batch:
    """The tokens of a batch of texts: their numbers, and each one's place among the distinct n-grams of all orders."""

    def __init__(self, texts: list[str | None], order: int, key_bits: int):
        parts = [word_hashes(t) for t in texts]
        self.size = np.array([len(p) + 1 for p in parts], np.int64)
        pad, end = np.full(order - 1, START), np.array([END])
        seq = np.concatenate([x for p in parts for x in (pad, p, end)])
        at = np.arange(int(self.size.sum())) + np.repeat((order - 1) * np.arange(1, len(parts) + 1), self.size)
        key = lambda j: ngrams(seq, j)[at - (j - 1)] >> np.uint64(65 - key_bits) << np.uint64(1) | np.uint64(j == 1)
        self.keys, which = np.unique(np.concatenate([key(j) for j in range(1, order + 1)]), return_inverse=True)
        self.which = which.reshape(order, -1)

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """How often each n-gram ends at one of these tokens (a mask)."""
        return np.bincount(self.which[:, tokens].ravel(), minlength=len(self.keys))


def shrink(planes: np.ndarray) -> bytes:
    return apart(planes.ravel().astype("<u8"))


def grow(data: bytes, planes: int) -> np.ndarray:
    return together(data, 8).reshape(planes, -1).astype(np.float64)


def estimates(counts: np.ndarray, size: np.ndarray, total: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order the maximum-likelihood estimate of each token and its context's bucket (0: context never seen).

    The context of a token is the n-gram that ends before it; at the start of a text it was seen once a document,
    which is the count of the end.
    """
    first = np.cumsum(size) - size
    f, bucket = [], []
    for j, c in enumerate(counts):
        if j:
            context = np.concatenate([[0.0], counts[j - 1][:-1]])
            context[first] = counts[0][first + size - 1] if len(size) else 0
        else:
            context = np.full(len(c), total)
        f.append(c / np.maximum(context, 1))
        bucket.append(np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, LEVELS - 1), 0))
    return f, bucket


def mixtures(f: list[np.ndarray], bucket: list[np.ndarray], weights: np.ndarray, uniform: float) -> list[np.ndarray]:
    """P_0 to P_n of each token."""
    p = [np.full(len(f[0]), uniform)]
    for j, (fj, b) in enumerate(zip(f, bucket)):
        w = weights[j][b]
        p.append(w * fj + (1 - w) * p[-1])
    return p


def gather(docs: DataFrame, order: int) -> DataFrame:
    """A row a batch: its documents, the training counts of each token's n-grams of every order, for the tuning fold's
    documents the counts without that fold, and its training and tuning tokens; a further row a bucket holds its
    distinct training words."""
    way = Exchange(text_size(docs), KEY_BITS, 2, KEY_REST, BATCH_BYTES)
    fold = crc_fold(F.col("doc_id"), FOLDS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.cast("int").alias("fold")).mapInArrow(lambda batches: bundle(batches, BATCH_BYTES), "unit long, docs binary")

    def opened(table: pa.Table) -> tuple[int, pa.Table, Batch, np.ndarray]:
        number, table = table.column("unit")[0].as_py(), unbundle(table)
        b = Batch(table.column("text").to_pylist(), order, way.keep)
        return number, table, b, np.repeat(table.column("fold").to_numpy(), b.size)

    def send(table: pa.Table) -> pa.Table:
        number, _, b, fold = opened(table)
        return way.messages(number, b.keys, [b.counts(fold != HELD_OUT), b.counts(fold == TUNING)])

    def words(keys: np.ndarray, sums: list[np.ndarray]) -> bytes:
        return np.array([((keys & np.uint64(1) == 1) & (sums[0] > 0)).sum()], "<i8").tobytes()

    kinds = "unit long, ids array<long>, folds binary, sizes binary, counts binary, tuning binary, tokens long, tuned long, words long"
    out_schema = pa.schema([("unit", pa.int64()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("folds", "sizes", "counts", "tuning")), *((c, pa.int64()) for c in ("tokens", "tuned", "words"))])

    def receive(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            n = answers.num_rows
            own = {"unit": answers.column("unit"), "words": [int(np.frombuffer(x, "<i8")[0]) for x in answers.column("counts").to_pylist()]}
            return pa.table({c: own.get(c, [None] * n) for c in out_schema.names}, schema=out_schema)
        number, table, b, fold = opened(table)
        train, tune = way.answered(b.keys, answers)
        folds, tuned = table.column("fold").to_numpy(), fold == TUNING
        row = {"unit": [number], "ids": [table.column("doc_id").to_pylist()], "folds": [folds.astype(np.uint8).tobytes()], "sizes": [b.size.astype("<i8").tobytes()], "counts": [shrink(train[b.which])], "tuning": [shrink((train - tune)[b.which[:, tuned]])], "tokens": [int((fold != HELD_OUT).sum())], "tuned": [int(tuned.sum())], "words": [None]}
        return pa.table(row, schema=out_schema)

    answers = way.totals(rows.groupBy("unit").applyInArrow(send, MESSAGE), words)
    return rows.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(receive, kinds)


def learn(gathered: DataFrame, order: int, tokens: int, uniform: float, steps: int = STEPS) -> np.ndarray:
    """Mixture weights by order and context bucket. Each step is one pass over the tuning fold's counts; the driver
    gets sums by order and bucket."""
    weights = np.full((order, LEVELS), PRIOR)
    weights[:, 0] = 0.0
    tuning = gathered.where("tuning IS NOT NULL").select("folds", "sizes", "tuning")

    for _ in range(steps):
        now = weights.copy()

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            num, den = np.zeros((order, LEVELS)), np.zeros((order, LEVELS))
            for batch in batches:
                for folds, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("folds", "sizes", "tuning"))):
                    size = np.frombuffer(sizes, "<i8")[np.frombuffer(folds, np.uint8) == TUNING]
                    if not len(size):
                        continue
                    f, bucket = estimates(grow(data, order), size, tokens)
                    p = mixtures(f, bucket, now, uniform)
                    reach = np.ones(len(f[0]))
                    for j in range(order - 1, -1, -1):
                        w = now[j][bucket[j]]
                        stay = reach * w * f[j] / p[j + 1]
                        num[j] += np.bincount(bucket[j], stay, LEVELS)
                        den[j] += np.bincount(bucket[j], reach, LEVELS)
                        reach = reach - stay
            j, b = np.indices(num.shape)
            yield pa.RecordBatch.from_pydict({"level": pa.array(j.ravel()), "bucket": pa.array(b.ravel()), "num": pa.array(num.ravel()), "den": pa.array(den.ravel())})

        sums = tuning.mapInArrow(expect, "level long, bucket long, num double, den double").groupBy("level", "bucket").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).collect()
        for r in sums:
            if r["bucket"] and r["den"] > 0:
                weights[r["level"], r["bucket"]] = min(max(r["num"] / r["den"], 1e-6), 1 - 1e-6)
    return weights


def score(docs: DataFrame, order: int = ORDER, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`.

    Tokens are a text's words, A-Z lower-cased, and one end; base_score is the smoothed unigram log10 probability and
    score that of the interpolated model. Null text is the empty text: only its end is scored. A null id hashes as the
    empty text. Repeated rows get a row each, with equal scores; an empty table gives an empty result; other columns are
    ignored. A very long text is a batch of its own and its memory grows with it. Nothing is ranked, so ties don't
    matter. Where there is nothing to tune on, all weights are one half. N-grams are known by keys of KEY_BITS bits and more.
    """
    gathered = written(gather(docs, order), "counts")
    facts = gathered.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "tuned"))).first()
    tokens, kinds, tuned = facts["tokens"], facts["words"], facts["tuned"]
    uniform = 1 / (kinds + 1)
    weights = learn(gathered, order, tokens - tuned, uniform, steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, folds, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("ids", "folds", "sizes", "counts"))):
                size = np.frombuffer(sizes, "<i8")
                counts = grow(data, order)
                first = np.cumsum(size) - size
                f, bucket = estimates(counts, size, tokens)
                model = np.log10(mixtures(f, bucket, weights, uniform)[-1])
                base = np.log10((counts[0] + 0.1) / (tokens + 0.1 * (kinds + 1)))
                add = lambda x: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(np.frombuffer(folds, np.uint8) == HELD_OUT), "n_tokens": pa.array(size), "n_known": pa.array(add((counts[0] > 0).astype(np.int64))),
                    "train_tokens": pa.array(np.full(len(size), tokens)), "base_score": pa.array(add(base)), "score": pa.array(add(model)),
                })

    return gathered.where("ids IS NOT NULL").select("ids", "folds", "sizes", "counts").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
