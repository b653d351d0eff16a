"""The queries of the operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cleaning, jaccard, langid, lm_scoring, merkle, mixing, packing, secrets, syncmers, topk, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve(warc.records_of_pages(table(spark, sf_dir, "pages"))))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # 50256 is the id that the rank file leaves free; it ends texts and fills rows.
    encode = packing.rank_encoder(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), bpe.PATTERN, 50256)
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), encode, pad=50256))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(table(spark, sf_dir, "documents"))


def op11_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.judge(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_jaccard": op4_jaccard,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_top_k": op9_top_k,
    "op10_syncmers": op10_syncmers,
    "op11_line_cleaning": op11_line_cleaning,
    "op12_merkle": op12_merkle,
}

ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.SQL, "op3_warc": warc.SQL, "op4_jaccard": jaccard.SQL, "op9_top_k": topk.SQL, "op11_line_cleaning": cleaning.SQL, "op12_merkle": merkle.SQL}
