"""Calibration plans."""

from pyspark.sql import functions as F

from oddsmith.functions import stats as S
from oddsmith.operators import calibration as C
from oddsmith.plans.catalog import plan

_LL = ("-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))")


@plan("b01_production_filter", """
SELECT target_type, target_name, ledger_id, assessment_id FROM prediction_errors
WHERE NOT (shadow_mode <> 0 OR hash_version <> 2) AND outcome_label_status = 'observed'
  AND calibration_scope = 'proceeded_edits_only' AND guidance_packet_id IS NULL
  AND CASE WHEN target_type LIKE 'benefit%' THEN benefit_guidance_influenced = 0 ELSE true END
""")
def _(m):
    keep = C.production_filter("risk_binary")
    for t in ("benefit_binary", "benefit_continuous", "cost_continuous"):
        keep = keep | C.production_filter(t)
    return m.prediction_errors.filter(keep).select("target_type", "target_name", F.col("ledger_id").cast("bigint"), "assessment_id")


@plan("c12_row_errors", f"""
WITH e AS (SELECT *, predicted_probability AS p, actual_outcome AS y FROM prediction_errors)
SELECT ledger_id, R((p - y) * (p - y)) AS brier_error, R({_LL}) AS log_loss,
  R((actual_value - predicted_value) * (actual_value - predicted_value)) AS squared_error,
  R(CASE WHEN y IS NULL THEN actual_value - predicted_value ELSE y - p END) AS residual FROM e
""")
def _(m):
    return C.error_columns(m.prediction_errors).select(
        F.col("ledger_id").cast("bigint"), "brier_error", "log_loss", "squared_error", "residual")


@plan("e03_calibration_summary", f"""
WITH o AS (SELECT *, predicted_probability AS p, actual_outcome AS y FROM prediction_errors WHERE outcome_label_status = 'observed'),
b AS (SELECT target_type, count(*) AS n, avg((y - p) ** 2) AS brier, avg({_LL}) AS log_loss,
        cast(NULL as double) AS mse, avg(y - p) AS bias FROM o WHERE target_type IN ('risk_binary', 'benefit_binary') GROUP BY 1
      UNION ALL
      SELECT target_type, count(*), NULL, NULL, avg((actual_value - predicted_value) ** 2), avg(actual_value - predicted_value)
      FROM o WHERE target_type IN ('benefit_continuous', 'cost_continuous') GROUP BY 1),
t AS (SELECT unnest(['risk_binary', 'benefit_binary', 'benefit_continuous', 'cost_continuous']) AS target_type)
SELECT target_type, CASE WHEN n IS NULL THEN 'pending_min_n' ELSE 'ok' END AS status, coalesce(n, 0) AS n,
  R(brier) AS brier, R(log_loss) AS log_loss, R(mse) AS mse, R(bias) AS bias,
  (SELECT count(*) FROM o) AS observed,
  (SELECT count(*) FROM prediction_errors WHERE outcome_label_status <> 'observed') AS censored,
  (SELECT count(*) FROM prediction_errors) AS total
FROM t LEFT JOIN b USING (target_type)
""")
def _(m):
    return C.calibration_summary(m.prediction_errors)


_BIN = "len(list_filter(range(1, 10), lambda i: i * (cast(1 as double) / 10) <= predicted_probability))"


@plan("e04_ece", f"""
WITH b AS (SELECT target_name, {_BIN} AS bin, count(*) AS n, avg(actual_outcome) AS acc,
  avg(predicted_probability) AS conf FROM risk_rows GROUP BY 1, 2)
SELECT target_name, cast(sum(n) as bigint) AS n, R(sum(n * abs(acc - conf)) / sum(n)) AS ece FROM b GROUP BY 1
""")
def _(m):
    return C.expected_calibration_error(
        m.risk_rows, ["target_name"], "predicted_probability", "actual_outcome")


@plan("e05_reliability_bins", f"""
WITH g AS (SELECT target_name, {_BIN} AS b, predicted_probability AS p, actual_outcome AS y FROM risk_rows),
f AS (SELECT DISTINCT target_name FROM g), k AS (SELECT cast(unnest(range(0, 10)) as int) AS bin)
SELECT f.target_name, k.bin, R(k.bin * (cast(1 as double) / 10)) AS predicted_lo, R((k.bin + 1) * (cast(1 as double) / 10)) AS predicted_hi,
  count(g.p) AS count, R(avg(g.y)) AS observed_rate, R(avg(g.p)) AS mean_predicted
FROM f CROSS JOIN k LEFT JOIN g ON g.target_name = f.target_name AND g.b = k.bin GROUP BY 1, 2
""")
def _(m):
    return C.reliability_bins(m.risk_rows, ["target_name"], "predicted_probability", "actual_outcome")


def _decided(m):
    """Replay rows: an event row is held back when probability × disutility reaches 0.10."""
    p, d = F.col("predicted_probability"), F.col("event_disutility")
    return m.risk_rows.select(
        "target_name", "criticality_stage", "predicted_probability", "actual_outcome",
        (F.col("actual_outcome") == 1).alias("harmful"),
        F.when(d.isNull(), p < 0.5).otherwise(p * d < 0.10).alias("proceeded"))


_DECIDED = """
d AS (SELECT target_name, criticality_stage, predicted_probability, actual_outcome, actual_outcome = 1 AS harmful,
  CASE WHEN event_disutility IS NULL THEN predicted_probability < 0.5 ELSE predicted_probability * event_disutility < 0.10 END AS proceeded FROM risk_rows)
"""


@plan("e06_safety_rates", f"""
WITH {_DECIDED}
SELECT target_name, R(avg(CASE WHEN harmful THEN cast(proceeded as int) END)) AS false_proceed_rate,
  R(avg(CASE WHEN NOT harmful AND criticality_stage IN ('C0', 'C1', 'C2') THEN 1 - cast(proceeded as int) END)) AS false_block_rate
FROM d GROUP BY 1
""")
def _(m):
    return C.safety_rates(_decided(m), ["target_name"])


def _tracks(m):
    """Two replay tracks over the same rows: the logged belief and one pulled toward 0.3."""
    rows = _decided(m)
    p = F.col("predicted_probability")
    tracks = F.explode(F.array(
        F.struct(F.lit("genesis").alias("track"), p.alias("p")),
        F.struct(F.lit("learned").alias("track"), ((p + 0.3) / 2).alias("p"))))
    return rows.withColumn("t", tracks).select(
        "t.track", "t.p", "actual_outcome", "harmful", "proceeded", "criticality_stage")


_TRACKS = _DECIDED + f""",
t AS (SELECT 'genesis' AS track, predicted_probability AS p, * FROM d
  UNION ALL SELECT 'learned', (predicted_probability + 0.3) / 2, * FROM d),
q AS (SELECT track, p, actual_outcome AS y, harmful, proceeded, criticality_stage,
  len(list_filter(range(1, 10), lambda i: i * (cast(1 as double) / 10) <= p)) AS bin FROM t),
e AS (SELECT track, sum(n * abs(acc - conf)) / sum(n) AS ece FROM
  (SELECT track, bin, count(*) AS n, avg(y) AS acc, avg(p) AS conf FROM q GROUP BY 1, 2) GROUP BY 1),
mb AS (SELECT track, count(*) AS n, avg((p - y) ** 2) AS brier, avg({_LL}) AS log_loss,
  avg(CASE WHEN harmful THEN cast(proceeded as int) END) AS fpr,
  avg(CASE WHEN NOT harmful AND criticality_stage IN ('C0', 'C1', 'C2') THEN 1 - cast(proceeded as int) END) AS fbr
  FROM q GROUP BY 1)
"""


@plan("e07_metric_bundle", f"""
WITH {_TRACKS} SELECT track, n, R(brier) AS brier, R(log_loss) AS log_loss, R(ece) AS ece,
  R(fpr) AS false_proceed_rate, R(fbr) AS false_block_rate FROM mb JOIN e USING (track)
""")
def _(m):
    return C.metric_bundle(_tracks(m), ["track"], "p", "actual_outcome")


@plan("e07_metric_lift", f"""
WITH {_TRACKS}, j AS (SELECT * FROM mb JOIN e USING (track)),
g AS (SELECT * FROM j WHERE track = 'genesis'), l AS (SELECT * FROM j WHERE track = 'learned')
SELECT R(g.brier - l.brier) AS brier_lift, R(g.log_loss - l.log_loss) AS log_loss_lift, R(g.ece - l.ece) AS ece_lift,
  R(g.fpr - l.fpr) AS false_proceed_rate_lift, R(g.fbr - l.fbr) AS false_block_rate_lift,
  g.brier > l.brier AS brier_improved FROM g, l
""")
def _(m):
    return C.lift(C.metric_bundle(_tracks(m), ["track"], "p", "actual_outcome"), "track", "genesis", "learned")


_LABELLED = f"""
lab AS (SELECT p.assessment_id, target_type, target_name, predicted,
  CASE WHEN label_source = 'host' THEN CASE WHEN target_name = 'p_success' THEN cast(actual_success as int)
      WHEN target_name LIKE 'p\\_event.%' ESCAPE '\\' THEN cast(l.observed as int)
      WHEN target_type = 'benefit_binary' THEN cast(benefit_realized as int) END END AS y,
  CASE WHEN target_name = 'measured_benefit' THEN measured_benefit
      WHEN target_name = 'review_cost' AND label_source = 'host' THEN actual_review_cost END AS a, o.terminal_status
  FROM predictions p LEFT JOIN outcomes o ON o.assessment_id = p.assessment_id
  LEFT JOIN event_labels l ON l.assessment_id = p.assessment_id AND 'p_event.' || l.event = p.target_name),
err AS (SELECT *, predicted AS p, CASE WHEN y IS NULL AND a IS NULL THEN 'censored' ELSE 'observed' END AS st FROM lab)
"""


@plan("d01_label_join", f"""
WITH {_LABELLED}
SELECT assessment_id, target_type, target_name, R(predicted) AS predicted, y AS actual_outcome, R(a) AS actual_value,
  R((y - p) ** 2) AS brier_error, R({_LL}) AS log_loss, R((a - p) ** 2) AS squared_error, R(coalesce(y - p, a - p)) AS residual,
  st AS outcome_label_status FROM err
""")
def _(m):
    return C.label_predictions(m.predictions, m.outcomes, m.event_labels).select(
        "assessment_id", "target_type", "target_name",
        F.coalesce("predicted_probability", "predicted_value").alias("predicted"),
        "actual_outcome", "actual_value", "brier_error", "log_loss", "squared_error", "residual",
        "outcome_label_status")


@plan("d02_production_stamp", """
SELECT p.assessment_id, target_name, CASE WHEN terminal_status = 'completed' THEN 'proceeded_edits_only' ELSE 'shadow' END AS calibration_scope,
  CASE WHEN terminal_status = 'completed' THEN 0 ELSE 1 END AS shadow_mode
FROM predictions p LEFT JOIN outcomes o ON o.assessment_id = p.assessment_id
""")
def _(m):
    joined = m.predictions.join(m.outcomes, "assessment_id", "left")
    return C.stamp_scope(joined).select("assessment_id", "target_name", "calibration_scope", "shadow_mode")


@plan("h08_measurement_run", f"""
WITH {_LABELLED}
SELECT assessment_id, CASE WHEN terminal_status = 'completed' THEN 'proceeded_edits_only' ELSE 'shadow' END AS calibration_scope,
  CASE WHEN terminal_status = 'completed' THEN 0 ELSE 1 END AS shadow_mode, count(*) AS targets,
  count(*) FILTER (st = 'observed') AS observed, count(*) FILTER (st = 'censored') AS censored
FROM err WHERE terminal_status IS NOT NULL AND NOT EXISTS (SELECT 1 FROM actions d WHERE d.action_id = err.assessment_id AND d.repo_id = 4)
GROUP BY 1, 2, 3
""")
def _(m):
    done = m.actions.filter("repo_id = 4").select(F.col("action_id").alias("assessment_id"))
    return C.measurement_counts(C.measure(m.predictions, m.outcomes, m.event_labels, done))


@plan("b02_host_labels", """
SELECT assessment_id, CASE WHEN label_source = 'host' THEN actual_success END AS actual_success,
  CASE WHEN label_source = 'host' THEN benefit_realized END AS benefit_realized,
  R(CASE WHEN label_source = 'host' THEN actual_review_cost END) AS actual_review_cost FROM outcomes
""")
def _(m):
    host = F.col("label_source") == "host"
    return m.outcomes.select("assessment_id", *[
        F.when(host, F.col(c)).alias(c) for c in ("actual_success", "benefit_realized", "actual_review_cost")])


_DETAIL = """CASE assessment_id % 8 WHEN 0 THEN '{"actual_success": true, "note": 3}' WHEN 1 THEN '{"actual_success": "yes"}'
  WHEN 2 THEN '{"actual_review_cost": -1}' WHEN 3 THEN '{"actual_review_cost": true}' WHEN 4 THEN '{"event_outcomes": {"a": true, "b": 1}}'
  WHEN 5 THEN '{"event_outcomes": 7, "benefit_realized": 0}' WHEN 6 THEN '{"actual_rework_cost": 0.5, "event_outcomes": {"a": false}}' END"""


@plan("b03_label_violations", """
WITH v AS (SELECT assessment_id, unnest(CASE assessment_id % 8 WHEN 1 THEN ['actual_success: must be a boolean']
  WHEN 2 THEN ['actual_review_cost: must be non-negative'] WHEN 3 THEN ['actual_review_cost: must be a number']
  WHEN 4 THEN ['event_outcomes: values must be boolean'] WHEN 5 THEN ['benefit_realized: must be a boolean', 'event_outcomes: must be an object']
  ELSE [] END) AS violation FROM outcomes) SELECT * FROM v
""")
def _(m):
    details = m.outcomes.select("assessment_id", F.expr(_DETAIL).alias("detail"))
    return C.label_violations(details).select("assessment_id", "violation")


@plan("d15_metric_parity", """
WITH m AS (SELECT target_name AS metric, avg((predicted_probability - actual_outcome) ** 2) AS v,
  sum((predicted_probability - actual_outcome) ** 2) / count(*) AS rv FROM risk_rows GROUP BY 1),
x AS (SELECT metric, v, rv FROM m UNION ALL SELECT 'absent', NULL, 0.5)
SELECT metric, R(v) AS value, R(rv) AS reference_value, R(1e-10) AS tolerance, R(abs(v - rv)) AS abs_diff,
  coalesce(abs(v - rv) <= 1e-10, false) AS passed, false AS all_passed FROM x
""")
def _(m):
    errors = m.risk_rows.withColumn("e", S.brier("predicted_probability", "actual_outcome"))
    engine = errors.groupBy(F.col("target_name").alias("metric")).agg(F.avg("e").alias("value"))
    reference = (
        errors.groupBy(F.col("target_name").alias("metric"))
        .agg((F.sum("e") / F.count(F.lit(1))).alias("reference_value"))
        .unionByName(m.spark.range(1).select(F.lit("absent").alias("metric"), F.lit(0.5).alias("reference_value")))
        .withColumn("tolerance", F.lit(1e-10)))
    return C.parity(engine, reference)


@plan("e14_beta_posterior", """
WITH g AS (SELECT target_name, symbol_id, count(*) AS n, sum(actual_outcome) AS s FROM risk_rows GROUP BY 1, 2)
SELECT target_name, symbol_id, n, R((1.0 + s) / (2 + n)) AS p_mean,
  R(((1.0 + s) / (2 + n)) * (1 - (1.0 + s) / (2 + n)) / (3 + n)) AS parameter_variance,
  R((1.0 + s) / (2 + n) * (1.0 + n - s) / (3 + n)) AS outcome_variance FROM g
""")
def _(m):
    g = m.risk_rows.groupBy("target_name", "symbol_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual_outcome").alias("s"))
    return g.select("target_name", "symbol_id", "n", S.beta_mean("n", "s").alias("p_mean"),
                    S.beta_variance("n", "s").alias("parameter_variance"),
                    S.bernoulli_variance("n", "s").alias("outcome_variance"))


@plan("e15_mean_variance", """
SELECT action_type, symbol_id, assessment_id, count(*) AS n, R(avg(actual_value)) AS mean_value,
  R(coalesce(var_samp(actual_value), 0)) AS sample_variance, R(coalesce(var_samp(actual_value), 0) / count(*)) AS mean_variance
FROM benefit_rows GROUP BY 1, 2, 3
""")
def _(m):
    g = m.benefit_rows.groupBy("action_type", "symbol_id", "assessment_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("actual_value").alias("mean_value"),
        F.var_samp("actual_value").alias("v"))
    v = S.sample_variance("n", "v")
    return g.select("action_type", "symbol_id", "assessment_id", "n", "mean_value",
                    v.alias("sample_variance"), (v / F.col("n")).alias("mean_variance"))


@plan("e16_wilson_bound", """
WITH g AS (SELECT target_name, symbol_id, count(*) AS n, sum(actual_outcome) AS s FROM risk_rows GROUP BY 1, 2),
z AS (SELECT *, cast(s as double) / n AS p, cast(1.645 as double) AS z FROM g)
SELECT target_name, symbol_id, n, R(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * cast(n as double) * n))) / (1 + z * z / n))) AS lower_bound FROM z
""")
def _(m):
    g = m.risk_rows.groupBy("target_name", "symbol_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual_outcome").alias("s"))
    return g.select("target_name", "symbol_id", "n", S.wilson_lower("s", "n").alias("lower_bound"))
