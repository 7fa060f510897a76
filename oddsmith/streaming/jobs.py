"""Structured Streaming jobs over ledger streams.

Each job takes a streaming DataFrame and a target path and returns the started query.
Results are written per batch under ``batch_id`` and replaced on replay, so a restarted
query neither loses nor repeats anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from oddsmith.operators.priors import apply_facts
from oddsmith.sources.tables import append_once


def table_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """Stream of a table that is one file or a folder of part files.

    A pattern, as a plain path to a single file is not taken by the file source.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{table}[.]parquet")


def _per_batch(stream: DataFrame, path: str, checkpoint: str, mode: str, write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    def default(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(write or default).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def overview_counters(actions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running counts by decision and status; each batch emits the counters it changed."""
    counts = actions.groupBy("decision", F.coalesce("terminal_status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return _per_batch(counts, path, checkpoint, "update")


def score_trend(scores: DataFrame, path: str, checkpoint: str, columns: tuple[str, ...]) -> StreamingQuery:
    """Daily sums and counts of the score series, one additive partial per batch: rows may come in any order."""
    def write(batch: DataFrame, batch_id: int) -> None:
        day = F.date_trunc("day", "recorded_at").alias("day")
        sums = [x for c in columns for x in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]
        batch.groupBy(day).agg(F.count(F.lit(1)).alias("n"), *sums).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _per_batch(scores, path, checkpoint, "append", write)


def trend(partials: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Daily means from the partials of ``score_trend``."""
    return partials.groupBy("day").agg(F.sum("n").alias("n"), *[(F.sum(f"{c}_sum") / F.sum(f"{c}_n")).alias(c) for c in columns])


def apply_facts_stream(targets: DataFrame, features: DataFrame, facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch of new actions is resolved against the active facts."""
    def write(batch: DataFrame, batch_id: int) -> None:
        apply_facts(batch, features, facts).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _per_batch(targets, path, checkpoint, "append", write)


def append_outcomes(outcomes: DataFrame, path: str, checkpoint: str, key: str = "assessment_id", order: str = "recorded_at") -> StreamingQuery:
    """Exactly-once append: one outcome per assessment across batches and restarts."""
    return _per_batch(outcomes, path, checkpoint, "append", lambda df, i: append_once(df, path, key, order, i))


def latest(df: DataFrame, keys: list[str], *values: str | Column) -> DataFrame:
    """Current state of an update-mode table: the newest batch wins per key."""
    return df.groupBy(*keys).agg(*[F.max_by(v, "batch_id").alias(v) for v in values])
