"""The corpus pipeline: quality rules, language, near copies, benchmark passages, packing.

Every stage takes documents with doc_id, text, lang, source and n_chars; further columns, whatever their names, are
left out. Null texts count as empty and go with the first stage; null languages and sources are no evidence; a null id
never makes a row a copy of another one; an empty table gives no rows. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import decontaminate, language_id, near_dedup, packing, quality_rules
from telemill.session import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with failing lines removed from their texts; each row is judged by itself."""
    judged = quality_rules.judge(docs).where("kept")
    return judged.withColumn("text", F.col("cleaned_text")).withColumn("n_chars", F.length("cleaned_text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language found; lang becomes that language. Equal rows get equal ones."""
    found = language_id.identify(docs, declared="lang", host="source").where("kept")
    return found.withColumn("lang", F.col("language")).select(*COLUMNS)


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id", limit: int = 1 << 20) -> DataFrame:
    """Rows whose key isn't in ``gone``; its keys are written and counted, and broadcast only up to ``limit``."""
    ids = materialize(gone.select(key).distinct(), "gone")
    return docs.join(F.broadcast(ids) if ids.count() <= limit else ids, key, "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Rows of one id are one document: they stay or go together, and equal rows of it stay once. Rows without an id stay.
    """
    left = without(docs, near_dedup.near_groups(docs).where("not kept"))
    repeated = materialize(left.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left.select(*COLUMNS)
    once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return without(left, repeated).unionByName(once).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    A row goes by its id and text, so another text of the same id stays, and rows without an id go too.
    """
    by_text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")))
    keyed = docs.select(*COLUMNS, by_text.alias("row"))
    hit = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), key="row").where("contaminated")
    return without(keyed, hit, "row").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids in windows of 1024; equal rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("packed", packed)]
#: Tokenisation and seeded signatures can't be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each writing its rows as Parquet for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
