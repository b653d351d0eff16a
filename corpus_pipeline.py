"""A training-data pipeline over `documents`: stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girthline.llm import bpe, jaccard, langid, mixing, secrets
from girthline.llm.common import crc_fold, unused, written
from girthline.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which language identification finds a language; those without a letter, or without text, go. Null
    ids, repeated rows, very long texts and other columns stay as they are; an empty table gives an empty result.

    The profiles learn from the labelled documents outside fold 2 of 4, as in the operator's own query.
    """
    labelled = docs.where(crc_fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")
    lang, score = unused(docs, "lang", "score")
    return langid.predict(docs, langid.train(labelled), names=(lang, score)).where(F.col(lang) != "und").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest id, once even if its row repeats.

    A document is an id and a text, known by a 64-bit hash of both, so different texts under one id are documents of
    their own. Rows without id stay, as do all columns; null and empty texts are like nothing; very long texts are
    compared whole; an empty table gives an empty result."""
    (key,) = unused(docs, "key")
    named = docs.where("doc_id IS NOT NULL").withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = jaccard.classes(named.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = named.select(F.col(key).alias("key"), F.col("doc_id").alias("id"))
    first = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first")).select(F.col("first.key").alias(key))
    kept = named.join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked. Null and empty texts, null ids, repeated rows, very long texts and other
    columns are as in secrets.redacted(); an empty table gives an empty result."""
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null and empty texts, null ids and sources, repeated rows, very long
    texts and other columns are as in mixing.mixed(); an empty table gives an empty result."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, repeats included. Null text is the empty text; null ids and
    repeated rows get a row each, very long texts are encoded whole, other columns are dropped, an empty table gives an
    empty result."""
    return bpe.encode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("bpe", encoded),
]
#: Byte-pair encoding can't be expressed in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
