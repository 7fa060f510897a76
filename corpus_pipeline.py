"""Corpus preparation: language, near copies, benchmark leaks, personal data, packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm import decontam, langid, packing, pii, simhash
from oddsmith.llm.common import store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    known = langid.profiles(docs.select("doc_id", "lang", "text"))
    return langid.identified(docs, known).filter(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the smallest id, once if the row is repeated.

    Rows without id count as larger than any row with one; rows of one id, or none, follow a hash of the row.
    """
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*docs.columns).alias("mark"))
    groups = simhash.near_duplicates(rows.select("mark", F.col("row.text").alias("text")), "mark")
    marks = rows.groupBy(F.col("mark").alias("id")).agg(F.min("row.doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    members = groups.select("id", "component").distinct().join(marks, "id")
    least = F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "id", "n")).alias("least")
    chosen = members.groupBy("component").agg(least).select(F.col("least.id").alias("keep"), "least.n")
    kept = rows.join(chosen, F.col("mark") == F.col("keep"))
    return kept.filter("n = 1").select("row.*").unionByName(kept.filter("n > 1").select("row").dropDuplicates().select("row.*"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; clean texts stay whatever their id is."""
    found = decontam.leaking(docs, table(spark, sf_dir, "benchmark")).select(F.col("row").alias("leaking")).distinct()
    rows = docs.select(F.struct("*").alias("row"), decontam.row_key().alias("mark"))  # no column of docs can clash
    return rows.join(found, F.col("mark") == F.col("leaking"), "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal spans replaced by their kind."""
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed_report(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("leaks", leaks), ("personal_data", personal_data), ("packed", packed)]

#: Fitted profiles, components, span classifier and tokens have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    return reduce(lambda docs, stage: store(stage[1](spark, docs, sf_dir), stage[0]), STAGES, table(spark, sf_dir, "documents"))
