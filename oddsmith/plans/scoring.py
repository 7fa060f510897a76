"""Scoring plans."""

from pyspark.sql import functions as F

from oddsmith.operators import scoring as S
from oddsmith.plans.catalog import plan

_CONS = "('public_api_break', 'migration_failure', 'dependency_break')"
_FLOOR = f"""
fl AS (SELECT e.action_id, e.event, e.p_event, e.elicited_disutility AS ed,
  CASE WHEN e.event IN {_CONS} AND list_extract([0.10, 0.30, 0.50, 0.80, 1.00]::double[], 1 + cast(substr(a.criticality_stage, 2) as int)) > e.elicited_disutility
    THEN list_extract([0.10, 0.30, 0.50, 0.80, 1.00]::double[], 1 + cast(substr(a.criticality_stage, 2) as int)) ELSE e.elicited_disutility END AS d
  FROM action_events e JOIN actions a ON a.action_id = e.action_id),
ls AS (SELECT action_id, round(sum(p_event * d), 12) AS loss, sum(d ** 2 * 0.0025 + p_event ** 2 * 0.0025) AS ev, count(*) AS n FROM fl GROUP BY 1)
"""
_GAIN = """
dir AS (SELECT * FROM (VALUES ('complexity_delta', -1), ('coupling_delta', -1), ('maintainability_index_delta', 1),
  ('testability_delta', 1), ('cohesion_delta', 1)) t(metric, s)),
gn AS (SELECT action_id, avg(s * delta / (1 + abs(delta))) AS sig FROM metric_deltas JOIN dir USING (metric) GROUP BY 1)
"""
_SCORED = _FLOOR + "," + _GAIN + """,
s0 AS (SELECT e.*, coalesce(loss, 0) AS loss, coalesce(ev, 0) AS ev, coalesce(sig, 0) * future_change_exposure AS gain
  FROM evidence e LEFT JOIN ls USING (action_id) LEFT JOIN gn USING (action_id)),
s1 AS (SELECT *, greatest(0, least(1, immediate_benefit + CASE benefit_source WHEN 'projected' THEN 0 ELSE gain END)) AS benefit,
  CASE WHEN benefit_variance_override IS NOT NULL THEN least(0.04, benefit_variance_override) WHEN benefit_source = 'measured' THEN 0.0004 ELSE 0.04 END AS bv FROM s0),
s2 AS (SELECT *, p_success * benefit - loss - review_cost AS eu,
  benefit ** 2 * coalesce(p_success_variance, 0.04) + p_success ** 2 * bv + ev + coalesce(review_cost_variance, 0.01) + 0.0003 AS uv FROM s1),
s3 AS (SELECT *, sqrt(uv) AS sd, eu - 1.28 * sqrt(uv) AS rau,
  least(0.15, CASE WHEN god_node_score >= 0.9 THEN 0.08 WHEN god_node_score >= 0.75 THEN 0.04 ELSE 0 END + CASE WHEN cycle_participation THEN 0.04 ELSE 0 END
    + CASE WHEN bridge_centrality >= 0.5 THEN 0.03 ELSE 0 END + CASE WHEN domain_entrypoint THEN 0.03 ELSE 0 END) AS arch,
  CASE WHEN has_fanin THEN least(0.12, CASE WHEN graph_file_size_bytes >= 200000 THEN 0.04 ELSE 0 END + CASE WHEN graph_file_node_count >= 500 THEN 0.04 ELSE 0 END) ELSE 0 END AS crowd,
  CASE WHEN has_fanin THEN least(0.2, 0.08 * graph_file_error_count) ELSE 0 END AS pe FROM s2),
s4 AS (SELECT *, greatest(1e-6, scope_control - arch - crowd) AS sc2, greatest(1e-6, evidence_quality - pe) AS eq2 FROM s3),
s5 AS (SELECT *, (p_success * eq2 * testability * reversibility * source_reliability * sc2) ** (1.0 / 6) AS conf,
  CASE criticality_stage WHEN 'C3' THEN 0.30 WHEN 'C4' THEN 0.15 ELSE 0.45 END AS thr FROM s4),
sc AS (SELECT *, CASE WHEN conf < 0.5 THEN 'low' WHEN conf < 0.75 THEN 'medium' ELSE 'high' END AS band FROM s5)
"""


def scored(m):
    return S.score_batch(m.evidence, m.action_events, m.metric_deltas)


@plan("c01_criticality_floor", f"WITH {_FLOOR} SELECT action_id, event, R(p_event) AS p_event, R(d) AS disutility, d > ed AS floor_applied FROM fl")
def _(m):
    return S.floor_events(m.action_events, m.actions).select(
        "action_id", "event", "p_event", "disutility", "floor_applied")


@plan("e01_expected_loss", f"""WITH {_FLOOR}
SELECT action_id, R(sum(p_event * d)) AS expected_loss, string_agg(event, ',' ORDER BY event) AS components FROM fl GROUP BY 1""")
def _(m):
    loss = S.loss_by_action(S.floor_events(m.action_events, m.actions), components=True)
    return loss.select("action_id", "expected_loss", F.array_join("loss_components.event", ",").alias("components"))


@plan("e02_event_variance", f"WITH {_FLOOR} SELECT action_id, R(ev) AS event_variance, n AS n_events FROM ls")
def _(m):
    return S.loss_by_action(S.floor_events(m.action_events, m.actions)).select("action_id", "event_variance", "n_events")


@plan("c02_expected_utility", f"""WITH {_SCORED} SELECT action_id, R(p_success * benefit - (loss + review_cost)) AS expected_utility,
  R(benefit - (loss + review_cost)) AS net_benefit FROM sc""")
def _(m):
    return scored(m).select("action_id", "expected_utility", S.net_benefit().alias("net_benefit"))


@plan("c03_utility_variance", """
SELECT action_id, R(CASE WHEN action_id % 4 = 0 THEN p_success / 10 + review_cost / 10
    WHEN action_id % 4 = 1 THEN 0.04 + 0.01 + 0.0025 + 0.0025 + 0.01 + 0.0003
    ELSE immediate_benefit ** 2 * CASE WHEN p_success_variance IS NOT NULL THEN p_success_variance WHEN action_id % 4 = 2 THEN ((1 - testability) / 2) ** 2 ELSE 0.04 END
      + p_success ** 2 * coalesce(benefit_variance_override, 0.01) + 0.005 + coalesce(review_cost_variance, 0.01) + 0.0003 END) AS utility_variance,
  CASE action_id % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'cold_start' ELSE 'first_order' END AS variance_source
FROM evidence
""")
def _(m):
    k = F.col("action_id") % 4
    rows = m.evidence.select(
        "action_id", "p_success", "p_success_variance", "review_cost_variance",
        F.when(k != 1, F.col("immediate_benefit")).alias("benefit"),
        F.col("benefit_variance_override").alias("benefit_variance"),
        F.lit(None).cast("double").alias("event_variance"),
        F.when(k == 2, F.col("testability")).alias("p_success_confidence"),
        F.when(k == 0, F.create_map(F.lit("p_success"), F.col("p_success") / 10, F.lit("review_cost"),
                                    F.col("review_cost") / 10)).alias("variance_breakdown"))
    return S.utility_variance(rows).select("action_id", "utility_variance", "variance_source")


@plan("c04_risk_adjusted_utility", f"WITH {_SCORED} SELECT action_id, R(sd) AS utility_sd, R(eu - 1.28 * sd) AS rau FROM sc")
def _(m):
    return scored(m).select("action_id", "utility_sd", "rau")


@plan("c05_edit_confidence", """
SELECT action_id, R((p_success * evidence_quality * testability * reversibility * source_reliability * scope_control) ** (1.0 / 6)) AS edit_confidence FROM evidence
""")
def _(m):
    return m.evidence.select("action_id", S.edit_confidence().alias("edit_confidence"))


@plan("c06_structural_penalties", f"WITH {_SCORED} SELECT action_id, R(sc2) AS scope_control, R(eq2) AS evidence_quality FROM sc")
def _(m):
    return S.structural_penalties(m.evidence).select("action_id", "scope_control", "evidence_quality")


@plan("c07_confidence_band", f"WITH {_SCORED} SELECT action_id, R(conf) AS edit_confidence, band AS confidence_band FROM sc")
def _(m):
    df = S.structural_penalties(m.evidence).withColumn("edit_confidence", S.edit_confidence())
    return df.select("action_id", "edit_confidence", S.confidence_band().alias("confidence_band"))


@plan("c08_effective_threshold", f"""WITH {_SCORED} SELECT action_id, R(thr) AS effective_threshold,
  CASE WHEN thr = 0.45 THEN 'max_expected_loss_without_human' ELSE lower(criticality_stage) || '_max_expected_loss_without_human' END AS budget_threshold_key,
  R(loss / thr) AS risk_budget_used FROM sc""")
def _(m):
    return scored(m).select("action_id", "effective_threshold", "budget_threshold_key", "risk_budget_used")


@plan("c09_blast_score", """
SELECT action_id, R(1 - 2.0 / (2 + 2 * symbol_caller_count + modify_transitive_impact_count)) AS blast_score FROM evidence
""")
def _(m):
    return m.evidence.select("action_id", S.blast_score("symbol_caller_count", "modify_transitive_impact_count").alias("blast_score"))


@plan("c10_maintainability_gain", f"""WITH {_GAIN} SELECT e.action_id, R(coalesce(sig, 0) * future_change_exposure) AS maintainability_gain
FROM evidence e LEFT JOIN gn USING (action_id)""")
def _(m):
    return S.maintainability_gain(m.metric_deltas, m.evidence).select("action_id", "maintainability_gain")


@plan("c11_resolve_benefit", f"WITH {_SCORED} SELECT action_id, R(benefit) AS benefit, R(bv) AS benefit_variance, benefit_source AS source_type FROM sc")
def _(m):
    df = S.resolve_benefit(S.maintainability_gain(m.metric_deltas, m.evidence))
    return df.select("action_id", "benefit", "benefit_variance", F.col("benefit_source").alias("source_type"))


@plan("c15_normalize_weights", """
WITH w AS (SELECT l_orderkey AS s, l_partkey * 1000 + l_suppkey AS c, CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 7 = 0 THEN l_quantity - 10
  WHEN l_orderkey % 11 = 0 THEN cast(0 as double) ELSE l_quantity / 10 END AS w FROM lineitem),
t AS (SELECT s, sum(coalesce(w, 0)) AS tot, min(coalesce(w, 0)) AS lo, count(w) AS g, count(*) AS n FROM w GROUP BY 1)
SELECT s AS weight_set, c AS criterion, R(CASE WHEN g = 0 THEN cast(1 as double) / n WHEN lo < 0 OR tot <= 1e-9 THEN NULL ELSE coalesce(w, 0) / tot END) AS normalized,
  CASE WHEN g = 0 THEN 'cold_start' WHEN lo < 0 THEN 'negative_weight' WHEN tot <= 1e-9 THEN 'zero_sum' ELSE 'provided' END AS source, abs(tot - 1) > 1e-6 AS rescaled
FROM w JOIN t USING (s)
""")
def _(m):
    k = F.col("l_orderkey")
    w = (F.when(k % 5 == 0, None).when(k % 7 == 0, F.col("l_quantity") - 10).when(k % 11 == 0, 0.0)
         .otherwise(F.col("l_quantity") / 10))
    rows = m.lineitem.select(k.alias("weight_set"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("criterion"), w.alias("weight"))
    return S.normalize_weights(rows, "weight_set", "criterion", "weight")


@plan("c25_explanation_bands", f"""WITH {_SCORED} SELECT action_id,
  CASE WHEN loss / thr < 0.25 THEN 'Low' WHEN loss / thr < 0.75 THEN 'Moderate' WHEN loss / thr < 1 THEN 'High' ELSE 'Critical' END AS risk_level,
  CASE WHEN rau >= 0.4 THEN 'Strong' WHEN rau >= 0.15 THEN 'Positive' WHEN rau >= 0 THEN 'Borderline' ELSE 'Negative' END AS value_after_risk FROM sc""")
def _(m):
    return scored(m).select("action_id", S.risk_band().alias("risk_level"), S.value_band().alias("value_after_risk"))


@plan("c30_partial_resolution_penalty", """
WITH t AS (SELECT *, modify_repo_blast_fraction AS cov, resolved_symbol_count AS oc, graph_freshness = 'fresh' AND resolution_method IN ('location', 'name_fallback') AND graph_file_error_count = 0 AS tr FROM evidence)
SELECT action_id, R(CASE WHEN tr AND oc > 0 AND cov > 0 AND cov < 1 THEN greatest(1e-6, evidence_quality - 0.2 * (1 - cov)) ELSE evidence_quality END) AS evidence_quality FROM t
""")
def _(m):
    from oddsmith.operators.evidence import trusted

    rows = m.evidence.select("action_id", "evidence_quality", trusted().alias("trusted"),
                             F.col("modify_repo_blast_fraction").alias("resolution_coverage"),
                             F.col("resolved_symbol_count").alias("owner_count"))
    return S.partial_resolution_penalty(rows).select("action_id", "evidence_quality")


@plan("e11_file_delta_aggregation", """
WITH f AS (SELECT l_orderkey AS action_id, l_quantity - 25 AS cc, l_tax * 10 - 0.3 AS mi, CASE WHEN l_orderkey % 4 = 0 THEN cast(0 as double) ELSE l_discount * 100 - 2 END AS w FROM lineitem)
SELECT action_id, R(sum(cc)) AS complexity_delta, R(CASE WHEN count(*) = 1 THEN min(mi) WHEN bool_and(w <= 0) THEN sum(mi) / count(*)
  ELSE sum(mi + CASE WHEN w > 0 THEN mi * w / (w + 10) ELSE 0 END) END) AS maintainability_index_delta FROM f GROUP BY 1
""")
def _(m):
    files = m.lineitem.select(
        F.col("l_orderkey").alias("action_id"), (F.col("l_quantity") - 25).alias("cc_delta"),
        (F.col("l_tax") * 10 - 0.3).alias("mi_delta"),
        F.when(F.col("l_orderkey") % 4 == 0, 0.0).otherwise(F.col("l_discount") * 100 - 2).alias("weight"))
    return S.aggregate_deltas(files)


@plan("h07_prediction_manifest", f"""WITH {_SCORED},
u AS (UNPIVOT (SELECT action_id, p_success, least(1, immediate_benefit) AS immediate_benefit_realized, benefit AS measured_benefit, review_cost FROM sc)
  ON p_success, immediate_benefit_realized, measured_benefit, review_cost INTO NAME target_name VALUE v)
SELECT action_id, CASE target_name WHEN 'p_success' THEN 'risk_binary' WHEN 'immediate_benefit_realized' THEN 'benefit_binary'
  WHEN 'measured_benefit' THEN 'benefit_continuous' ELSE 'cost_continuous' END AS target_type, target_name, R(v) AS predicted_value FROM u
UNION ALL SELECT action_id, 'risk_binary', 'p_event.' || event, R(p_event) FROM action_events""")
def _(m):
    return S.prediction_manifest(scored(m), m.action_events)


@plan("h09_score_batch", f"""WITH {_SCORED} SELECT action_id, request_id, R(loss) AS expected_loss, R(benefit) AS benefit, R(eu) AS expected_utility,
  R(sd) AS utility_sd, R(rau) AS rau, R(conf) AS edit_confidence, band AS confidence_band, R(loss / thr) AS risk_budget_used FROM sc""")
def _(m):
    return scored(m).select("action_id", "request_id", "expected_loss", "benefit", "expected_utility", "utility_sd",
                            "rau", "edit_confidence", "confidence_band", "risk_budget_used")


@plan("h11_policy_probe", f"""
WITH ds AS (SELECT * FROM (VALUES ('cold', 0.0, 0.04), ('shipped', 0.1, 0.008), ('local', 0.2, 0.004)) a(prior, dp, pv), (VALUES ('safe', 0.0), ('harmful', 0.2)) b(posture, de)),
x AS (SELECT a.*, ds.prior, ds.posture, least(1.0, p_success + cast(dp as double)) AS p2, cast(pv as double) AS pv, cast(de as double) AS de FROM evidence a, ds),
{_FLOOR},
l2 AS (SELECT x.action_id, prior, posture, sum(least(1.0, p_event + de) * d) AS loss, sum(d ** 2 * 0.0025 + least(1.0, p_event + de) ** 2 * 0.0025) AS ev
  FROM x JOIN fl ON fl.action_id = x.action_id GROUP BY 1, 2, 3),
y AS (SELECT x.*, coalesce(loss, 0) AS loss, coalesce(ev, 0) AS ev,
  CASE WHEN benefit_variance_override IS NOT NULL THEN least(0.04, benefit_variance_override) WHEN benefit_source = 'measured' THEN 0.0004 ELSE 0.04 END AS bv
  FROM x LEFT JOIN l2 USING (action_id, prior, posture)),
z AS (SELECT *, p2 * immediate_benefit - loss - review_cost AS eu,
  sqrt(immediate_benefit ** 2 * pv + p2 ** 2 * bv + ev + coalesce(review_cost_variance, 0.01) + 0.0003) AS sd FROM y)
SELECT prior, posture, count(*) AS n, R(avg(loss)) AS expected_loss, R(avg(eu)) AS expected_utility, R(avg(eu - 1.28 * sd)) AS rau,
  count(*) FILTER (eu - 1.28 * sd < 0) AS n_negative FROM z GROUP BY 1, 2
""")
def _(m):
    return S.policy_probe(m.evidence, m.action_events).groupBy("prior", "posture").agg(
        F.count(F.lit(1)).alias("n"), F.avg("expected_loss").alias("expected_loss"),
        F.avg("expected_utility").alias("expected_utility"), F.avg("rau").alias("rau"),
        F.count_if(F.col("rau") < 0).alias("n_negative"))
