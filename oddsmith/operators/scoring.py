"""Scoring of candidate actions as batch jobs over action and event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddsmith import constants as K
from oddsmith.functions.columns import clamp, col, finite, lookup

V = K.COLD_START_VARIANCE


def stage_value(stage: str | Column = "criticality_stage") -> Column:
    return lookup(K.STAGE_VALUE, stage)


def floored_disutility(event="event", disutility="elicited_disutility", criticality="criticality_value"):
    """Criticality lifts the disutility of consequence-bearing events only."""
    d = col(disutility)
    return F.when(col(event).isin(*K.CONSEQUENCE_EVENTS), F.greatest(d, col(criticality))).otherwise(d)


def floor_events(events: DataFrame, actions: DataFrame) -> DataFrame:
    d = floored_disutility()
    return (
        events.join(actions.select("action_id", "criticality_stage"), "action_id")
        .withColumn("criticality_value", stage_value())
        .withColumn("disutility", d)
        .withColumn("floor_applied", F.col("disutility") > F.col("elicited_disutility"))
        .withColumn("expected_loss", F.col("p_event") * F.col("disutility"))
    )


def loss_by_action(floored: DataFrame, components: bool = False, by: tuple[str, ...] = ("action_id",)) -> DataFrame:
    """Expected loss and event variance per action (or per ``by``) in one aggregation.

    The loss is rounded to twelve decimals because partial sums meet in any order and a loss
    equal to a threshold must not flip a gate.  ``p_variance`` is optional; where absent the cold-start component applies.  Components
    are only collected on request: they are bounded by the events of one action.
    """
    p, d = F.col("p_event"), F.col("disutility")
    pv = F.col("p_variance") if "p_variance" in floored.columns else F.lit(None)
    variance = d * d * F.coalesce(pv, F.lit(V["p_event"])) + p * p * V["disutility"]
    aggs = [
        F.round(F.sum(p * d), 12).alias("expected_loss"),
        F.sum(variance).alias("event_variance"),
        F.count(F.lit(1)).alias("n_events"),
    ]
    for name, names in (("has_terminal", K.TERMINAL_EVENTS), ("has_structural", K.STRUCTURAL_EVENTS),
                        ("has_contract_event", ("api_contract_break", "public_api_break"))):
        aggs.append(F.bool_or(F.col("event").isin(*names)).alias(name))
    if components:
        item = F.struct("event", "p_event", "disutility", "expected_loss")
        aggs.append(F.sort_array(F.collect_list(item)).alias("loss_components"))
    return floored.groupBy(*by).agg(*aggs)


def expected_utility(p="p_success", benefit="benefit", loss="expected_loss", cost="review_cost"):
    return col(p) * col(benefit) - col(loss) - col(cost)


def net_benefit(benefit="benefit", loss="expected_loss", cost="review_cost"):
    return col(benefit) - col(loss) - col(cost)


# --- benefit ------------------------------------------------------------------------------------


def unit_benefit(c) -> Column:
    c = col(c)
    return F.when(finite(c), clamp(c, 0.0, 1.0)).otherwise(0.0)


def maintainability_gain(deltas: DataFrame, actions: DataFrame) -> DataFrame:
    """Mean bounded directional signal over known finite metrics, weighted by exposure."""
    x = F.col("delta")
    direction = lookup(K.METRIC_DIRECTION, "metric")
    signal = F.when(direction.isNotNull() & finite(x), direction * x / (1.0 + F.abs(x)))
    gain = deltas.groupBy("action_id").agg(F.avg(signal).alias("_signal"))
    exposure = F.when(finite("future_change_exposure"), clamp("future_change_exposure", 0.0, 1.0)).otherwise(0.0)
    return actions.join(gain, "action_id", "left").withColumn(
        "maintainability_gain", F.coalesce(F.col("_signal"), F.lit(0.0)) * exposure
    ).drop("_signal")


def aggregate_deltas(files: DataFrame) -> DataFrame:
    """Per action: summed complexity, and maintainability by file count and weights."""
    w = F.greatest(F.lit(0.0), F.col("weight"))
    scaled = F.col("mi_delta") * F.when(w > 0, 1.0 + w / (w + 10.0)).otherwise(1.0)
    mi = (
        F.when(F.count(F.lit(1)) == 1, F.max("mi_delta"))
        .when(F.max("weight") <= 0, F.avg("mi_delta"))
        .otherwise(F.sum(scaled))
    )
    return files.groupBy("action_id").agg(
        F.sum("cc_delta").alias("complexity_delta"), mi.alias("maintainability_index_delta")
    )


def resolve_benefit(df: DataFrame) -> DataFrame:
    """Benefit and its variance by evidence source; projected evidence earns no credit."""
    src, over = F.col("benefit_source"), F.col("benefit_variance_override")
    credited = F.when(src == "projected", 0.0).otherwise(F.col("maintainability_gain"))
    by_source = F.when(src == "measured", K.MEASURED_BENEFIT_VARIANCE).otherwise(K.PROJECTED_BENEFIT_VARIANCE)
    overridden = F.when(
        finite(over) & (over >= 0), F.least(F.lit(K.PROJECTED_BENEFIT_VARIANCE), over)
    ).otherwise(K.PROJECTED_BENEFIT_VARIANCE)
    out = df.withColumns(
        {
            "credited_gain": credited,
            "benefit": unit_benefit(unit_benefit("immediate_benefit") + credited),
            "benefit_variance": F.when(over.isNull(), by_source).otherwise(overridden),
        }
    )
    if "benefit_override" in df.columns:
        o = F.col("benefit_override")
        out = out.withColumn("benefit", F.when(o.isNotNull(), clamp(o, 0.0, 1.0)).otherwise(F.col("benefit")))
    return out


# --- variance and utility ---------------------------------------------------------------------------


def variance_from_confidence(confidence) -> Column:
    return F.pow((1.0 - clamp(confidence, 0.0, 1.0)) / 2.0, F.lit(2.0))


def component_variance(supplied, component: str, confidence=None) -> Column:
    """Supplied, finite and non-negative, else from confidence, else the cold-start value."""
    out = F.when((col(supplied) >= 0) & (col(supplied) < float("inf")), col(supplied))
    if confidence is not None:
        out = out.when(col(confidence).isNotNull(), variance_from_confidence(confidence))
    return out.otherwise(V[component])


def utility_variance(df: DataFrame) -> DataFrame:
    """explicit map → first-order propagation → cold start, with the source named."""
    b, p = F.col("benefit"), F.col("p_success")
    conf = lambda c: c if c in df.columns else None
    terms = {
        "p_success": b * b * component_variance("p_success_variance", "p_success", conf("p_success_confidence")),
        "benefit": p * p * component_variance("benefit_variance", "benefit", conf("benefit_confidence")),
        "event_losses": F.coalesce(F.col("event_variance"), F.lit(V["p_event"] + V["disutility"])),
        "review_cost": component_variance("review_cost_variance", "review_cost", conf("review_cost_confidence")),
        "scenario_variance": F.lit(V["scenario_variance"]),
    }
    first_order = reduce(lambda a, c: a + c, terms.values())
    cold = sum(V.values())
    total = F.when(b.isNotNull() & p.isNotNull(), first_order).otherwise(cold)
    source = F.when(b.isNotNull() & p.isNotNull(), "first_order").otherwise("cold_start")
    if "variance_breakdown" in df.columns:
        m = F.col("variance_breakdown")
        explicit = m.isNotNull() & (F.size(m) > 0)
        total = F.when(
            explicit, F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)
        ).otherwise(total)
        source = F.when(explicit, "explicit").otherwise(source)
    return df.withColumns({"utility_variance": total, "variance_source": source})


def risk_adjusted_utility(eu="expected_utility", variance="utility_variance", z: float = K.Z_90):
    return col(eu) - z * F.sqrt(col(variance))


# --- confidence ---------------------------------------------------------------------------------------


def penalized(factor, penalty) -> Column:
    return F.greatest(F.lit(K.MIN_CONFIDENCE_FACTOR), F.coalesce(col(factor), F.lit(1.0)) - penalty)


def edit_confidence(factors=K.CONFIDENCE_FACTORS) -> Column:
    """Geometric mean; NULL marks a factor outside (0, 1]."""
    logs = reduce(lambda a, c: a + c, [F.log(F.col(f)) for f in factors])
    valid = reduce(lambda a, c: a & c, [(F.col(f) > 0) & (F.col(f) <= 1) for f in factors])
    return F.when(valid, F.exp(logs / len(factors)))


def architecture_penalty() -> Column:
    god = F.col("god_node_score")
    total = (
        F.when(god >= 0.90, 0.08).when(god >= 0.75, 0.04).otherwise(0.0)
        + F.when(F.col("cycle_participation"), 0.04).otherwise(0.0)
        + F.when(F.col("bridge_centrality") >= 0.50, 0.03).otherwise(0.0)
        + F.when(F.col("domain_entrypoint"), 0.03).otherwise(0.0)
    )
    return F.least(F.lit(0.15), total)


def structural_penalties(df: DataFrame) -> DataFrame:
    """Lower scope control and evidence quality where structure makes evidence weaker."""
    arch = architecture_penalty()
    errors = F.col("graph_file_error_count")
    crowd = F.when(F.col("graph_file_size_bytes") >= 200000, 0.04).otherwise(0.0) + F.when(
        F.col("graph_file_node_count") >= 500, 0.04
    ).otherwise(0.0)
    has = F.col("has_fanin")
    scope = F.when(arch > 0, penalized("scope_control", arch)).otherwise(F.col("scope_control"))
    crowd = F.least(F.lit(0.12), crowd)
    return df.withColumn("scope_control", scope).withColumns(
        {
            "scope_control": F.when(has & (crowd > 0), penalized("scope_control", crowd)).otherwise(F.col("scope_control")),
            "evidence_quality": F.when(
                has & (errors > 0), penalized("evidence_quality", F.least(F.lit(0.20), 0.08 * errors))
            ).otherwise(F.col("evidence_quality")),
        }
    )


def partial_resolution_penalty(df: DataFrame) -> DataFrame:
    """Candidates only partly resolved in a trusted graph lose evidence quality."""
    cov = F.col("resolution_coverage")
    applies = F.col("trusted") & (F.col("owner_count") > 0) & (cov > 0) & (cov < 1)
    cut = F.least(F.lit(0.20), 0.20 * (1.0 - cov))
    return df.withColumn(
        "evidence_quality",
        F.when(applies, penalized("evidence_quality", cut)).otherwise(F.col("evidence_quality")),
    )


def confidence_band(confidence="edit_confidence", low: float = 0.50, high: float = 0.75) -> Column:
    c = col(confidence)
    return F.when(c >= high, "high").when(c >= low, "medium").otherwise("low")


# --- thresholds and bands ---------------------------------------------------------------------------------

STAGE_THRESHOLDS = {"C3": 0.30, "C4": 0.15}


def threshold_columns(df: DataFrame, overall: float = 0.45, by_stage=STAGE_THRESHOLDS) -> DataFrame:
    """The tighter of the global and the stage limit, its name, and the budget used."""
    own = lookup(by_stage, "criticality_stage")
    tighter = own < overall
    eff = F.when(tighter, own).otherwise(overall)
    key = F.when(
        tighter, F.concat(F.lower("criticality_stage"), F.lit("_max_expected_loss_without_human"))
    ).otherwise("max_expected_loss_without_human")
    return df.withColumns(
        {
            "effective_threshold": eff,
            "budget_threshold_key": key,
            "risk_budget_used": F.when(eff > 0, F.col("expected_loss") / eff),
        }
    )


def risk_band(used="risk_budget_used") -> Column:
    u = col(used)
    return F.when(u >= 1.0, "Critical").when(u >= 0.75, "High").when(u >= 0.25, "Moderate").otherwise("Low")


def value_band(rau="rau", reject_below=0.0, borderline_below=0.15, strong_at=0.40) -> Column:
    r = col(rau)
    return (
        F.when(r < reject_below, "Negative")
        .when(r < borderline_below, "Borderline")
        .when(r < strong_at, "Positive")
        .otherwise("Strong")
    )


def blast_score(direct, transitive, scale: float = 1.0) -> Column:
    raw = col(direct) + 0.5 * col(transitive)
    return raw / (raw + scale)


def normalize_weights(df: DataFrame, by: str, criterion: str, weight: str) -> DataFrame:
    """Weights per set summing to one; a set without any weight is shared equally.

    Negative weights and zero totals make the set invalid: its weights become NULL.
    """
    whole = W.partitionBy(by)
    w = F.coalesce(F.col(weight), F.lit(0.0))
    total, low = F.sum(w).over(whole), F.min(w).over(whole)
    given, n = F.count(weight).over(whole), F.count(F.lit(1)).over(whole)
    return df.select(
        by,
        criterion,
        F.when(given == 0, 1.0 / n).when((low < 0) | (total <= 1e-9), None).otherwise(w / total).alias("normalized"),
        F.when(given == 0, "cold_start").when(low < 0, "negative_weight").when(total <= 1e-9, "zero_sum")
        .otherwise("provided").alias("source"),
        (F.abs(total - 1.0) > 1e-6).alias("rescaled"),
    )


# --- the composed batch ----------------------------------------------------------------------------------------


def score_batch(actions: DataFrame, events: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """events → floor → loss → benefit → variance → RAU → confidence → budget, one lazy plan.

    Two shuffles on ``action_id`` (events, deltas); everything after is projection.
    """
    loss = loss_by_action(floor_events(events, actions))
    if deltas is None:
        gained = actions.withColumn("maintainability_gain", F.lit(0.0))
    else:
        gained = maintainability_gain(deltas, actions)
    return _scored(gained.join(loss, "action_id", "left"))


def _scored(df: DataFrame) -> DataFrame:
    """Everything after the joins, for actions with their losses."""
    df = df.withColumns(
        {
            "expected_loss": F.coalesce("expected_loss", F.lit(0.0)),
            "event_variance": F.coalesce("event_variance", F.lit(0.0)),
            "n_events": F.coalesce("n_events", F.lit(0)),
            **{f: F.coalesce(f, F.lit(False)) for f in ("has_terminal", "has_structural", "has_contract_event")},
        }
    )
    df = resolve_benefit(df).withColumn("expected_utility", expected_utility())
    df = utility_variance(df).withColumns(
        {"utility_sd": F.sqrt("utility_variance"), "rau": risk_adjusted_utility()}
    )
    df = structural_penalties(df).withColumn("edit_confidence", edit_confidence())
    return threshold_columns(df.withColumn("confidence_band", confidence_band()))


def prediction_manifest(scored: DataFrame, events: DataFrame) -> DataFrame:
    """Typed target rows of each scored action; event targets come straight from the events."""
    item = lambda t, n, v: F.struct(F.lit(t).alias("target_type"), F.lit(n).alias("target_name"), v.alias("predicted_value"))
    fixed = F.array(
        item("risk_binary", "p_success", F.col("p_success")),
        item("benefit_binary", "immediate_benefit_realized", clamp("immediate_benefit", 0.0, 1.0)),
        item("benefit_continuous", "measured_benefit", F.col("benefit")),
        item("cost_continuous", "review_cost", F.col("review_cost")),
    )
    own = scored.select("action_id", F.explode(fixed).alias("t")).select("action_id", "t.*")
    per_event = events.select(
        "action_id",
        F.lit("risk_binary").alias("target_type"),
        F.concat(F.lit("p_event."), "event").alias("target_name"),
        F.col("p_event").alias("predicted_value"),
    )
    return own.unionByName(per_event).filter(F.col("predicted_value").isNotNull())


def policy_probe(actions: DataFrame, events: DataFrame) -> DataFrame:
    """Every action scored under three priors × two postures (a fixed six-row design).

    Rows are multiplied after the joins: an exploded side looks as small as its table to the planner, which
    would send all its rows through the driver as a broadcast.
    """
    postures = (("safe", 0.0), ("harmful", 0.2))
    design = [
        F.struct(F.lit(p).alias("prior"), F.lit(h).alias("posture"), F.lit(dp).alias("dp"), F.lit(pv).alias("pv"))
        for p, dp, pv in (("cold", 0.0, 0.04), ("shipped", 0.1, 0.008), ("local", 0.2, 0.004)) for h, _ in postures
    ]
    shifted = F.explode(F.array(*[F.struct(F.lit(h).alias("posture"), F.lit(de).alias("de")) for h, de in postures]))
    floored = floor_events(events, actions).withColumn("_c", shifted).withColumns(
        {"posture": F.col("_c.posture"), "p_event": F.least(F.lit(1.0), F.col("p_event") + F.col("_c.de"))})
    floored = floored.withColumn("expected_loss", F.col("p_event") * F.col("disutility"))
    loss = loss_by_action(floored, by=("action_id", "posture"))
    fields = [c for c in loss.columns if c not in ("action_id", "posture")]
    # two entries an action
    both = loss.groupBy("action_id").agg(F.map_from_entries(F.collect_list(F.struct("posture", F.struct(*fields)))).alias("_l"))
    cases = actions.withColumn("maintainability_gain", F.lit(0.0)).join(both, "action_id", "left").withColumn("case", F.explode(F.array(*design)))
    found = F.col("_l")[F.col("case.posture")]
    return _scored(cases.select(
        *[c for c in cases.columns if c not in ("action_id", "p_success", "p_success_variance", "_l", "case")],
        F.concat_ws("_", "case.prior", "case.posture", F.col("action_id").cast("string")).alias("action_id"),
        F.col("action_id").alias("base_id"),
        "case.prior",
        "case.posture",
        F.least(F.lit(1.0), F.col("p_success") + F.col("case.dp")).alias("p_success"),
        F.col("case.pv").alias("p_success_variance"),
        *[found[c].alias(c) for c in fields],
    ))
