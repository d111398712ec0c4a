"""A corpus pipeline of five stages over documents: language ID, line dedup, near-dedup, decontamination, tokens.

Each stage works on all that its predecessor kept. All but the last return the columns of documents; other columns go.

Empty tables give empty results. Rows without a doc_id take part like others, under a number made from their text, and keep their
null; it is above usual ids, so that of two copies the one with an id stays. Rows that repeat a doc_id and text stay once after
near_dedup; different texts under one doc_id are one document, and stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.llm import bpe, decontaminate, langid, lines
from fenmark.llm.common import Scratch
from fenmark.llm.minhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: null texts, texts without a letter, and those between two languages."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.predict(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier line repeats or nearly repeats, and documents that have no other line; n_chars follows the text."""
    named = _named(docs).withColumnRenamed("doc_id", "_given").withColumnRenamed("_id", "doc_id")
    kept = lines.dedup_lines(named).where("n_dropped = 0 or n_dropped < n_lines")
    kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.drop("doc_id").withColumnRenamed("_given", "doc_id").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of smallest doc_id, and one of each set of equal rows."""
    rows = _named(docs)
    gone = near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("_id"))
    kept = _without(rows, gone)
    with Scratch(spark) as scratch:
        again = rows.groupBy("_id", F.xxhash64("text").alias("h")).count().where("count > 1").select("_id").distinct()
        again = scratch.keep(scratch.table(again))
        if again.isEmpty():
            return kept.select(*COLUMNS)
        once = kept.join(scratch.small(again), "_id", "left_semi").dropDuplicates(["_id", "text"])
        return kept.join(scratch.small(again), "_id", "left_anti").unionByName(once).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows = _named(docs)
    held = decontaminate.contaminated(rows.select(F.col("_id").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, held.select(F.col("doc_id").alias("_id")).distinct()).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document's whole text."""
    found = bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _named(docs: DataFrame) -> DataFrame:
    """docs with _id: doc_id, or a number made from the text where it is null."""
    made = F.pmod(F.xxhash64("text"), F.lit(1 << 61)) + F.lit(1 << 62)
    return docs.select(*COLUMNS, F.coalesce("doc_id", made).alias("_id"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without the named documents. Their list is broadcast where small, so that the texts need not be shuffled."""
    with Scratch(rows.sparkSession) as scratch:
        gone = scratch.keep(scratch.table(gone))
        return rows.join(scratch.small(gone), "_id", "left_anti")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: Compression classes, connected components and byte-level merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        scratch.keep(docs)
        return STAGES[-1][1](spark, docs, sf_dir)
