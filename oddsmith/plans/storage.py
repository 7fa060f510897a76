"""Source and sink plans: each writes data derived from the tables and reads it back."""

from pyspark.sql import functions as F

from oddsmith.operators import calibration as C
from oddsmith.plans.calibration import _LL
from oddsmith.plans.catalog import plan
from oddsmith.sources import tables as S
from oddsmith.sources.schemas import CASE


@plan("a02_jsonl_cases", """
SELECT ledger_id AS case_id, 'a' || action_id AS action_id, CASE WHEN assessment_id % 4 = 0 THEN 'score' ELSE 'promote' END AS partition, criticality_stage, R(predicted_probability) AS predicted_value FROM risk_rows WHERE target_name = 'p_success'
""")
def _(m):
    rows = m.risk_rows.filter("target_name = 'p_success'").select(
        F.col("ledger_id").cast("bigint").alias("case_id"), F.concat(F.lit("a"), F.col("action_id").cast("string")).alias("action_id"),
        F.when(F.col("assessment_id") % 4 == 0, "score").otherwise("promote").alias("partition"), "criticality_stage", F.col("predicted_probability").alias("predicted_value"))
    path = S.scratch(m.spark, "cases")
    rows.write.json(path)
    return S.read_jsonl(m.spark, path, CASE)


@plan("a03_csv_pairs", """
SELECT target_type, target_name, count(*) AS n, R(avg(coalesce(predicted_probability, predicted_value))) AS mean_predicted, R(avg(coalesce(actual_outcome, actual_value))) AS mean_actual
FROM prediction_errors WHERE outcome_label_status = 'observed' GROUP BY 1, 2
""")
def _(m):
    path = S.scratch(m.spark, "pairs")
    m.prediction_errors.select("target_type", "target_name", "predicted_probability", "predicted_value", "actual_outcome", "actual_value", "outcome_label_status").write.csv(path, header=True)
    binary, continuous = S.read_pairs(m.spark, path)
    flat = binary.withColumnsRenamed({"predicted_probability": "p", "actual_outcome": "a"}).withColumn("a", F.col("a").cast("double")).unionByName(
        continuous.withColumnsRenamed({"predicted_value": "p", "actual_value": "a"}))
    return flat.groupBy("target_type", "target_name").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("a").alias("mean_actual"))


@plan("a06_append_once", """
SELECT assessment_id, terminal_status, cast(CASE WHEN assessment_id % 3 = 0 THEN 0 ELSE 1 END as int) AS batch_id FROM outcomes
""")
def _(m):
    path = S.scratch(m.spark, "outcomes")
    rows = m.outcomes.select("assessment_id", "terminal_status", "recorded_at")
    S.append_once(rows.filter("assessment_id % 3 = 0"), path, "assessment_id", "recorded_at", 0)
    late = rows.withColumn("recorded_at", F.col("recorded_at") + F.expr("INTERVAL 1 DAY")).withColumn("terminal_status", F.lit("contradiction"))
    S.append_once(rows.unionByName(late), path, "assessment_id", "recorded_at", 1)
    S.append_once(rows.unionByName(late), path, "assessment_id", "recorded_at", 1)  # a replayed batch changes nothing
    return m.spark.read.parquet(path).select("assessment_id", "terminal_status", "batch_id")


@plan("a07_scorecard_sink", f"""
WITH r AS (SELECT predicted_probability AS p, actual_outcome AS y FROM risk_rows)
SELECT 'logged' AS track, count(*) AS n, R(avg((p - y) ** 2)) AS brier, R(avg({_LL})) AS log_loss FROM r
""")
def _(m):
    base = m.risk_rows.select(F.lit("logged").alias("track"), "predicted_probability", "actual_outcome", (F.col("actual_outcome") == 1).alias("harmful"), F.lit(True).alias("proceeded"), "criticality_stage")
    path = S.scratch(m.spark, "scorecard")
    S.write_scorecard(C.metric_bundle(base, ["track"], "predicted_probability", "actual_outcome"), path)
    return m.spark.read.schema("brier double, log_loss double, n bigint, track string").json(path).select("track", "n", "brier", "log_loss")
