"""Revision lineage: which earlier records a new request continues.

Two questions are asked of file sets on one commit.  *Inside*: is a record's set contained in the
request's?  A contained set brings all its files, its rarest one included, so every distinct set is
keyed by that file alone and meets a request at most once; a size test and the set difference
decide.  A file that all sets share is nobody's rarest and multiplies nothing.  *Overlap*: what is
asked of overlapping records (any, least row, least and greatest lineage, most attempts) stays
the same if a record counts twice, so it is folded to one row per file before requests look it up.

Cases: a record without files is inside every request of its commit; repeated files count once;
a null repository or commit matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.functions.columns import posix

PLACE = ["repo_id", "assessed_commit"]


def file_set(c: str = "files") -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda p: posix(p))))


def by_rarest_file(sets: DataFrame, keys: list[str] = PLACE) -> DataFrame:
    """``sets`` (``keys``, ``own_files``, further columns) with ``file``: the one fewest sets of the same keys hold."""
    held = sets.select(*keys, F.explode("own_files").alias("file")).groupBy(*keys, "file").agg(F.count(F.lit(1)).alias("n"))
    marked = sets.withColumn("set_key", F.struct(*keys, "own_files"))
    each = marked.select("set_key", *keys, F.explode("own_files").alias("file")).distinct()
    rarest = each.join(held, [*keys, "file"]).groupBy("set_key").agg(F.min(F.struct("n", "file"))["file"].alias("file"))
    return marked.join(rarest, "set_key", "left").drop("set_key")


def contained(requests: DataFrame, sets: DataFrame, keys: list[str] = PLACE) -> DataFrame:
    """Each request (``keys``, ``files``) with each of ``sets`` whose files it holds all of; no pair twice."""
    keyed = by_rarest_file(sets, keys)
    wanted = requests.withColumn("all_files", file_set())
    met = wanted.withColumn("file", F.explode("all_files")).join(keyed.filter("file IS NOT NULL"), [*keys, "file"])
    inside = (F.size("own_files") <= F.size("all_files")) & (F.size(F.array_except("own_files", "all_files")) == 0)
    bare = wanted.join(keyed.filter("file IS NULL"), keys).withColumn("file", F.lit(None).cast("string"))
    return met.filter(inside).unionByName(bare.select(met.columns)).drop("file", "own_files", "all_files")


FACTS = ("unnamed", "first_lineage", "last_lineage", "origin", "spent")


def matches(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Per request ``live`` and ``old`` (a live or legacy record matches), and ``FACTS`` of the live ones that count for it.

    With a baseline, live records that overlap match, and those with the same baseline count; without
    one, live records inside match and count.  Legacy records match if they are inside.
    """
    clean = records.withColumn("own_files", file_set()).withColumn("lineage", F.coalesce("lineage_key", F.lit("")))
    spent = clean.filter("NOT is_legacy AND lineage <> ''").groupBy(*PLACE, "lineage").agg(
        (F.count_if(~F.col("retryable")) + F.greatest(F.lit(0).cast("bigint"), F.count_if("retryable") - 1)).alias("spent"))  # one retry is free
    clean = clean.join(spent, [*PLACE, "lineage"], "left")
    own = [(F.col("lineage") == "").alias("unnamed"), F.col("lineage").alias("first_lineage"), F.col("lineage").alias("last_lineage"), F.col("row_id").alias("origin"), "spent"]
    rows = clean.select(*PLACE, "own_files", "is_legacy", F.col("baseline").alias("own_baseline"), *own)
    fold = [f(c).alias(c) for f, c in zip((F.bool_or, F.min, F.max, F.min, F.max), FACTS)]

    inside = contained(requests.select("request_id", "baseline", *PLACE, "files"), rows.groupBy(*PLACE, "own_files", "is_legacy").agg(*fold))
    old = inside.filter("is_legacy").select("request_id").distinct().withColumn("old", F.lit(True))
    unbound = inside.filter("NOT is_legacy AND baseline IS NULL").groupBy("request_id").agg(*fold)

    by_file = rows.filter("NOT is_legacy").withColumn("file", F.explode("own_files")).groupBy(*PLACE, "file", "own_baseline").agg(*fold)
    bound = requests.filter("baseline IS NOT NULL").select("request_id", "baseline", *PLACE, F.explode(file_set()).alias("file"))
    any_file = bound.join(by_file.select(*PLACE, "file").distinct(), [*PLACE, "file"]).select("request_id").distinct()
    same = bound.join(by_file.withColumnRenamed("own_baseline", "baseline"), [*PLACE, "file", "baseline"]).groupBy("request_id").agg(*fold)

    met = any_file.join(same, "request_id", "left").unionByName(unbound).withColumn("live", F.lit(True))
    return requests.select("request_id", "baseline").join(met, "request_id", "left").join(old, "request_id", "left")


def revision_attempts(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Attempts already spent on a request's lineage; one infrastructure retry is free."""
    spent = F.coalesce("spent", F.when(F.col("live") | F.col("old"), F.lit(1)), F.lit(0))
    return matches(requests, records).select("request_id", spent.cast("bigint").alias("attempts"))


def revision_origin(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Earliest record of the one matching lineage, or why there is none."""
    status = (
        F.when(F.col("live").isNull(), F.when(F.col("old"), "predates_lineage").otherwise("none"))
        .when(F.col("baseline").isNull(), "baseline_unbound")
        .when(F.col("origin").isNull(), "none").when(F.col("unnamed"), "predates_lineage")
        .when(F.col("first_lineage") != F.col("last_lineage"), "ambiguous").otherwise("available")
    )
    found = matches(requests, records)
    return found.select("request_id", status.alias("status"), F.when(status == "available", F.col("origin")).alias("origin_row_id"))


def revision_completeness(requests: DataFrame, origins: DataFrame, records: DataFrame) -> DataFrame:
    """Origin files the revision no longer touches, and the stored lineage digest."""
    o = origins.filter("status = 'available'").select("request_id", F.col("origin_row_id").alias("row_id")).join(
        records.select("row_id", F.col("files").alias("origin_files"), "lineage_key"), "row_id")
    return requests.join(o, "request_id").select(
        "request_id", "row_id", F.array_sort(F.array_except("origin_files", "files")).alias("missing_files"),
        F.sha2("lineage_key", 256).alias("lineage_digest"))
