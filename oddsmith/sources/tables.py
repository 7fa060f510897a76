"""Table and file sources, append-once and scorecard sinks."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmith.session import checkpoint_root, written
from oddsmith.sources.schemas import PAIRS


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, reachable by every executor."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object per non-blank line; a line that is not an object fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Observed calibration pairs of a CSV, as (binary, continuous)."""
    rows = spark.read.csv(path, header=True, schema=PAIRS, mode="FAILFAST").filter("outcome_label_status = 'observed'")
    binary = rows.filter("predicted_probability IS NOT NULL AND actual_outcome IS NOT NULL")
    continuous = rows.filter("predicted_value IS NOT NULL AND actual_value IS NOT NULL")
    return (binary.select("target_type", "target_name", "predicted_probability", "actual_outcome"),
            continuous.select("target_type", "target_name", "predicted_value", "actual_value"))


def write_scorecard(df: DataFrame, path: str) -> None:
    """Deterministic one-row artefact: sorted keys, doubles at twelve decimals."""
    cols = [
        F.round(f.name, 12).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in sorted(df.schema.fields, key=lambda f: f.name)
    ]
    df.select(*cols).coalesce(1).write.mode("overwrite").json(path)


#: Key-hash partitions of an append-once table, 64-bit words of each one's membership filter, and bits set per key.
BUCKETS, FILTER_WORDS, PROBES = 16, 1 << 14, 5


def _probes(keyed: DataFrame, key: str) -> DataFrame:
    """``key, bucket, word, mask`` of the filter bits that stand for each key, and how many there are (``needed``)."""
    places = F.array_distinct(F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64 * FILTER_WORDS)) for i in range(PROBES)]))
    bits = keyed.select(key, "bucket").distinct().select(key, "bucket", F.size(places).alias("needed"), F.explode(places).alias("at"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    return bits.select(key, "bucket", "needed", F.floor(F.col("at") / 64).cast("int").alias("word"), mask.alias("mask"))


def _maybe_known(keyed: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """``key, bucket`` of the rows whose bits are all set: every key of the table, and a few others."""
    probes = _probes(keyed, key)
    hit = probes.join(members, ["bucket", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) != 0).select(*probes.columns).distinct()
    return hit.groupBy(key, "bucket", "needed").agg(F.count(F.lit(1)).alias("got")).filter("got = needed").select(key, "bucket")


def append_once(batch: DataFrame, path: str, key: str, order: str, batch_id: int) -> None:
    """Append rows whose key is not in the table yet; of repeats in one batch the first counts.

    Each batch owns one partition folder and overwrites it when replayed, so a task or
    driver lost half-way leaves no duplicate.  ``batch_id`` must be new for new data.

    The table is partitioned by a hash of the key, and a Bloom filter of every partition is kept next to it (``<path>-members``).  A
    batch asks the filters of its own partitions first; only partitions in which a key may be known are
    read, and an anti-join on the keys themselves decides.  A null key is a key like any other.
    """
    spark = batch.sparkSession
    first = batch.groupBy(key).agg(F.min_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r")).select(key, "r.*")
    first = written(first.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")))
    members, new = f"{path}-members", first
    if table_exists(spark, path) and table_exists(spark, members):
        own = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # at most BUCKETS
        kept = spark.read.parquet(members).filter(F.col("bucket").isin(own) & (F.col("batch_id") != batch_id)).select("bucket", "word", "bits")
        doubtful = [r["bucket"] for r in _maybe_known(first, key, kept).select("bucket").distinct().collect()]
        known = spark.read.parquet(path).filter(F.col("bucket").isin(doubtful) & (F.col("batch_id") != batch_id)).select(F.col(key).alias("known"))
        new = first.join(known, F.col(key).eqNullSafe(F.col("known")), "left_anti")
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch_id={batch_id}")
    bits = _probes(new, key).groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
    bits.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{members}/batch_id={batch_id}")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the table folder holds any data (works on any file system Spark reads)."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
