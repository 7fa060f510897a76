"""Prediction errors, calibration summaries and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddsmith import constants as K
from oddsmith.functions.columns import finite
from oddsmith.functions.stats import brier, equal_width_bin, log_loss, rate

BINARY = ("risk_binary", "benefit_binary")


def production_filter(target_type: str) -> Column:
    """Rows a promotion may learn from: live, observed, carried out and unguided."""
    keep = (
        (F.col("target_type") == target_type)
        & (F.col("shadow_mode") == 0)
        & (F.col("hash_version") == 2)
        & (F.col("outcome_label_status") == "observed")
        & (F.col("calibration_scope") == "proceeded_edits_only")
        & F.col("guidance_packet_id").isNull()
    )
    if target_type.startswith("benefit"):
        keep = keep & (F.col("benefit_guidance_influenced") == 0)
    return keep


def production_rows(errors: DataFrame, target_type: str) -> DataFrame:
    return errors.filter(production_filter(target_type))


def error_columns(df: DataFrame) -> DataFrame:
    """Per-row scoring rules; a missing label leaves every error NULL."""
    p, y = F.col("predicted_probability"), F.col("actual_outcome")
    v, a = F.col("predicted_value"), F.col("actual_value")
    return df.withColumns(
        {
            "brier_error": brier(p, y),
            "log_loss": log_loss(p, y),
            "squared_error": F.pow(a - v, F.lit(2.0)),
            "residual": F.coalesce(y - p, a - v),
        }
    )


def calibration_summary(errors: DataFrame) -> DataFrame:
    """One row per target type, present or not; proper scores and squared errors never mix."""
    observed = F.col("outcome_label_status") == "observed"
    scored = error_columns(errors)
    binary = F.col("target_type").isin(*BINARY)
    pick = lambda cond, c: F.avg(F.when(observed & cond, F.col(c)))
    stats = scored.groupBy("target_type").agg(
        F.count_if(observed).alias("n"),
        pick(binary, "brier_error").alias("brier"),
        pick(binary, "log_loss").alias("log_loss"),
        pick(~binary, "squared_error").alias("mse"),
        F.avg(F.when(observed, F.col("residual"))).alias("bias"),
        F.count_if(~observed).alias("censored"),
    )
    types = errors.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in K.TARGET_TYPES])).alias("target_type")
    )
    every = W.partitionBy()
    n = F.coalesce("n", F.lit(0))
    c = F.coalesce("censored", F.lit(0))
    return types.join(stats, "target_type", "left").select(
        "target_type",
        F.when(n > 0, F.lit("ok")).otherwise("pending_min_n").alias("status"),
        n.alias("n"),
        "brier",
        "log_loss",
        "mse",
        "bias",
        F.sum(n).over(every).alias("observed"),
        F.sum(c).over(every).alias("censored"),
        F.sum(n + c).over(every).alias("total"),
    )


def expected_calibration_error(
    pairs: DataFrame, by: list[str], p: str, y: str, n_bins: int = 10
) -> DataFrame:
    bins = (
        pairs.withColumn("bin", equal_width_bin(p, n_bins))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(p).alias("sp"))
    )
    return bins.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("n")).alias("ece")
    )


def reliability_bins(pairs: DataFrame, by: list[str], p: str, y: str, n_bins: int = 10) -> DataFrame:
    """All bins, the empty ones with NULL rates; malformed pairs are dropped."""
    step = 1.0 / n_bins
    good = pairs.filter(finite(p) & F.col(p).between(0.0, 1.0) & F.col(y).isin(0, 1))
    filled = (
        good.withColumn("bin", equal_width_bin(p, n_bins))
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("observed_rate"),
            F.avg(p).alias("mean_predicted"),
        )
    )
    frame = (
        filled.select(*by)
        .distinct()
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    )
    return frame.join(filled, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("bin") * F.lit(step)).alias("predicted_lo"),
        ((F.col("bin") + 1) * F.lit(step)).alias("predicted_hi"),
        F.coalesce("n", F.lit(0)).alias("count"),
        "observed_rate",
        "mean_predicted",
    )


def safety_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of harmful rows let through and of safe low-stage rows held back."""
    return df.groupBy(*by).agg(*safety_rate_columns())


def safety_rate_columns() -> list[Column]:
    harmful, proceeded = F.col("harmful"), F.col("proceeded")
    safe_low = ~harmful & F.col("criticality_stage").isin(*K.LOW_STAGES)
    return [
        rate(F.count_if(harmful & proceeded), F.count_if(harmful)).alias("false_proceed_rate"),
        rate(F.count_if(safe_low & ~proceeded), F.count_if(safe_low)).alias("false_block_rate"),
    ]


def metric_bundle(df: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    """Scores, reliability and safety rates of each replay track, from one shuffle.

    Everything is additive over (track, bin), so one pre-aggregated table feeds all of it.
    """
    harmful, proceeded = F.col("harmful"), F.col("proceeded")
    safe_low = ~harmful & F.col("criticality_stage").isin(*K.LOW_STAGES)
    cells = (
        df.withColumn("bin", equal_width_bin(p))
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(y).alias("sy"),
            F.sum(p).alias("sp"),
            F.sum(brier(p, y)).alias("sb"),
            F.sum(log_loss(p, y)).alias("sl"),
            F.count_if(harmful).alias("h"),
            F.count_if(harmful & proceeded).alias("hp"),
            F.count_if(safe_low).alias("s"),
            F.count_if(safe_low & ~proceeded).alias("sh"),
        )
    )
    n = F.sum("n")
    r12 = lambda c: F.round(c, 12)
    return cells.groupBy(*by).agg(
        n.alias("n"),
        r12(F.sum("sb") / n).alias("brier"),
        r12(F.sum("sl") / n).alias("log_loss"),
        r12(F.sum(F.abs(F.col("sy") - F.col("sp"))) / n).alias("ece"),
        r12(rate(F.sum("hp"), F.sum("h"))).alias("false_proceed_rate"),
        r12(rate(F.sum("sh"), F.sum("s"))).alias("false_block_rate"),
    )


METRICS = ("brier", "log_loss", "ece", "false_proceed_rate", "false_block_rate")


def lift(bundle: DataFrame, track: str, baseline: str, learned: str) -> DataFrame:
    """baseline − learned for each lower-is-better metric; NULL if either side is NULL."""
    at = lambda name, m: F.max(F.when(F.col(track) == name, F.col(m)))
    return bundle.agg(
        *[F.round(at(baseline, m) - at(learned, m), 12).alias(f"{m}_lift") for m in METRICS],
        (at(baseline, "brier") - at(learned, "brier") > 0).alias("brier_improved"),
    )


def label_predictions(
    predictions: DataFrame, outcomes: DataFrame, event_labels: DataFrame, tasks: int | None = None
) -> DataFrame:
    """Attach the observed label of each target; a target without one is kept as censored.

    Only host-stamped outcomes carry labels.  Measured benefit comes from verification and
    needs no stamp.  With ``tasks`` the rows are dealt out to so many tasks, by assessment in the end.
    """
    dealt = lambda df, *keys: df if tasks is None else df.repartition(tasks, *keys)
    host = F.col("label_source") == "host"
    event = F.when(
        F.startswith("target_name", F.lit("p_event.")), F.substr("target_name", F.lit(9))
    )
    labels = dealt(predictions.withColumn("event", event), "assessment_id", "event").join(event_labels, ["assessment_id", "event"], "left")
    joined = dealt(labels, "assessment_id").join(outcomes, "assessment_id", "left")
    tn, tt = F.col("target_name"), F.col("target_type")
    binary = (
        F.when(~F.coalesce(host, F.lit(False)), None)
        .when(tn == "p_success", F.col("actual_success").cast("int"))
        .when(F.col("event").isNotNull(), F.col("observed").cast("int"))
        .when(tt == "benefit_binary", F.col("benefit_realized").cast("int"))
    )
    value = F.when(tn == "measured_benefit", F.col("measured_benefit")).when(
        (tn == "review_cost") & host, F.col("actual_review_cost")
    )
    is_binary = tt.isin(*BINARY)
    labelled = joined.select(
        "assessment_id",
        "target_type",
        "target_name",
        F.when(is_binary, F.col("predicted")).alias("predicted_probability"),
        F.when(~is_binary, F.col("predicted")).alias("predicted_value"),
        F.when(is_binary, binary).alias("actual_outcome"),
        F.when(~is_binary, value).alias("actual_value"),
        "terminal_status",
    )
    seen = F.col("actual_outcome").isNotNull() | F.col("actual_value").isNotNull()
    return error_columns(labelled).withColumn(
        "outcome_label_status", F.when(seen, "observed").otherwise("censored")
    )


def stamp_scope(errors: DataFrame) -> DataFrame:
    """Only a completed edit yields production rows; everything else stays shadow."""
    done = F.coalesce(F.col("terminal_status") == "completed", F.lit(False))
    return errors.withColumns(
        {
            "calibration_scope": F.when(done, "proceeded_edits_only").otherwise("shadow"),
            "shadow_mode": F.when(done, 0).otherwise(1),
        }
    )


#: Outcomes whose predictions one task measures.
TASK_OUTCOMES = 20_000


def measure(
    predictions: DataFrame, outcomes: DataFrame, event_labels: DataFrame, measured: DataFrame
) -> DataFrame:
    """Error rows of every assessment with an outcome that has not been measured before.

    What was measured is left out of the outcomes, which are fewer than the predictions; tasks follow their number.
    """
    due = outcomes.filter(F.col("terminal_status").isNotNull()).join(measured.select("assessment_id"), "assessment_id", "left_anti")
    rows = label_predictions(predictions, due, event_labels, 1 + outcomes.count() // TASK_OUTCOMES)
    return stamp_scope(rows.filter(F.col("terminal_status").isNotNull()))


def measurement_counts(rows: DataFrame) -> DataFrame:
    seen = F.col("outcome_label_status") == "observed"
    return rows.groupBy("assessment_id", "calibration_scope", "shadow_mode").agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(seen).alias("observed"),
        F.count_if(~seen).alias("censored"),
    )


def parity(engine: DataFrame, reference: DataFrame) -> DataFrame:
    """Metric-by-metric comparison; a metric the engine lacks fails."""
    diff = F.abs(F.col("value") - F.col("reference_value"))
    every = W.partitionBy()
    ok = F.coalesce(diff <= F.col("tolerance"), F.lit(False))
    return (
        reference.join(engine, "metric", "left")
        .select("metric", "value", "reference_value", "tolerance", diff.alias("abs_diff"), ok.alias("passed"))
        .withColumn("all_passed", F.every("passed").over(every))
    )


def label_violations(details: DataFrame) -> DataFrame:
    """Type violations in the JSON label payload, one row per violation."""
    v = F.try_parse_json("detail")

    def kind(path):
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    number = lambda k: k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL")
    flags = []
    for key in ("actual_success", "benefit_realized"):
        k = kind(f"$.{key}")
        flags.append(F.when(k.isNotNull() & (k != "BOOLEAN"), F.lit(f"{key}: must be a boolean")))
    for key in ("actual_review_cost", "actual_rework_cost"):
        k = kind(f"$.{key}")
        amount = F.try_variant_get(v, f"$.{key}", "double")
        flags.append(F.when(k.isNotNull() & ~number(k), F.lit(f"{key}: must be a number")))
        flags.append(F.when(number(k) & (amount < 0), F.lit(f"{key}: must be non-negative")))
    k = kind("$.event_outcomes")
    events = F.try_variant_get(v, "$.event_outcomes", "map<string,variant>")
    bad = F.exists(F.map_values(events), lambda x: F.schema_of_variant(x) != "BOOLEAN")
    flags.append(
        F.when(k.isNotNull() & ~k.startswith("OBJECT") & (k != "VOID"), F.lit("event_outcomes: must be an object"))
    )
    flags.append(F.when(bad, F.lit("event_outcomes: values must be boolean")))
    return details.withColumn("violation", F.explode(F.array_compact(F.array(*flags))))
