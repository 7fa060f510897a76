"""Explicit schemas of the file sources; nothing is inferred.  Ledger tables are Parquet and carry their own."""

from __future__ import annotations

from pyspark.sql import types as T

PAIRS = T.StructType([
    T.StructField("target_type", T.StringType()),
    T.StructField("target_name", T.StringType()),
    T.StructField("predicted_probability", T.DoubleType()),
    T.StructField("predicted_value", T.DoubleType()),
    T.StructField("actual_outcome", T.IntegerType()),
    T.StructField("actual_value", T.DoubleType()),
    T.StructField("outcome_label_status", T.StringType()),
])

CASE = T.StructType([
    T.StructField("case_id", T.LongType()),
    T.StructField("action_id", T.StringType()),
    T.StructField("partition", T.StringType()),
    T.StructField("criticality_stage", T.StringType()),
    T.StructField("predicted_value", T.DoubleType()),
])
