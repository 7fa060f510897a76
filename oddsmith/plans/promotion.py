"""Promotion plans."""

from pyspark.sql import functions as F

from oddsmith.functions.columns import clamp
from oddsmith.operators import calibration as C
from oddsmith.operators import promotion as P
from oddsmith.plans.calibration import _LL
from oddsmith.plans.catalog import plan
from oddsmith.session import cut_lineage


def scopes_sql(src: str) -> str:
    """The scope table spelled out as one SELECT per scope kind."""
    return f"""
ds AS (SELECT *, domains[1] AS dom FROM {src}),
xs AS (SELECT *, 'global' AS scope_kind, '' AS scope_value FROM ds UNION ALL SELECT *, 'action_type', action_type FROM ds
  UNION ALL SELECT *, 'public_api', '' FROM ds WHERE is_public_api UNION ALL SELECT *, 'high_symbol_fan_in', '' FROM ds WHERE is_high_symbol_fan_in OR symbol_fan_in_percentile >= 0.9
  UNION ALL SELECT *, 'symbol', symbol_id FROM ds UNION ALL SELECT *, 'domain', dom FROM ds UNION ALL SELECT *, 'public_api_domain', dom FROM ds WHERE is_public_api
  UNION ALL SELECT *, 'domain_change_kind', dom || '|' || change_kind FROM ds UNION ALL SELECT *, 'domain_high_symbol_fan_in', dom FROM ds WHERE symbol_fan_in_percentile >= 0.9)"""


_K = "target_name, scope_kind, scope_value"
_POS = f"""
po AS (SELECT *, count(*) OVER (PARTITION BY {_K}) AS n, row_number() OVER (PARTITION BY {_K} ORDER BY ledger_id) - 1 AS pos FROM xs),
fd AS (SELECT *, len(list_filter(range(1, 10), lambda i: i < greatest(2, least(10, n)) AND round_even(i * cast(n as double) / greatest(2, least(10, n)), 0) <= pos)) AS fold FROM po)"""


@plan("h01_scope_candidates", f"""WITH {scopes_sql('risk_rows')}
SELECT {_K}, count(*) AS n FROM xs GROUP BY ALL""")
def _(m):
    return P.explode_scopes(m.risk_rows).groupBy("target_name", "scope_kind", "scope_value").agg(F.count(F.lit(1)).alias("n"))


@plan("f07_leave_one_out", f"""WITH {scopes_sql('risk_rows')}
SELECT ledger_id, target_name, scope_kind, scope_value, R((sum(actual_outcome) OVER w - actual_outcome) / (count(*) OVER w - 1)) AS p_loo FROM xs WHERE scope_kind IN ('global', 'domain', 'symbol')
WINDOW w AS (PARTITION BY {_K})""")
def _(m):
    return P.leave_one_out(m.risk_rows, ("global", "domain", "symbol")).select(F.col("ledger_id").cast("bigint"), "target_name", "scope_kind", "scope_value", "p_loo")


_BCOV = f"""
ff AS (SELECT {_K}, fold, count(*) AS fn, sum(actual_outcome) AS fs FROM fd GROUP BY ALL),
tt AS (SELECT *, cast(sum(fn) OVER (PARTITION BY {_K}) - fn as double) AS m, cast(sum(fs) OVER (PARTITION BY {_K}) - fs as double) AS t FROM ff),
mm AS (SELECT *, (1 + t) / (2 + m) AS mu, (1 + t) * (1 + m - t) / ((2 + m) ** 2 * (3 + m)) AS pv, (1 + t) * (1 + m - t) / ((2 + m) * (3 + m)) AS av FROM tt WHERE m > 0),
bc AS (SELECT {_K}, avg(CASE WHEN fs / cast(fn as double) BETWEEN greatest(0, mu - 1.645 * sqrt(pv + mu * (1 - mu) / fn)) AND least(1, mu + 1.645 * sqrt(pv + mu * (1 - mu) / fn)) THEN 1 ELSE 0 END) AS cov,
  cast(sum(CASE WHEN 0 >= mu - 1.645 * sqrt(pv + av) THEN fn - fs ELSE 0 END + CASE WHEN 1 <= mu + 1.645 * sqrt(pv + av) THEN fs ELSE 0 END) as double) AS k, cast(sum(fn) as double) AS e FROM mm GROUP BY ALL),
bw AS (SELECT *, greatest(0, (k / e + 2.706025 / (2 * e) - 1.645 * sqrt((k / e * (1 - k / e) + 2.706025 / (4 * e)) / e)) / (1 + 2.706025 / e)) AS lcb FROM bc)"""


@plan("f08_fold_coverage", f"WITH {scopes_sql('risk_rows')}, {_POS}, {_BCOV} SELECT {_K}, R(cov) AS interval_coverage, cast(k as bigint) AS covered, cast(e as bigint) AS evaluated, R(lcb) AS interval_coverage_lcb FROM bw")
def _(m):
    return P.binary_coverage(m.risk_rows).drop("target_type")


_BGATE = f"""
lo AS (SELECT *, predicted_probability AS p0, (sum(actual_outcome) OVER w - actual_outcome) / cast(n - 1 as double) AS p1, actual_outcome AS y FROM po WHERE n >= 100 WINDOW w AS (PARTITION BY {_K})),
sc AS (SELECT {_K}, avg((p0 - y) ** 2) AS b0, avg((p1 - y) ** 2) AS b1, avg({_LL.replace('1 - p', '1 - p').replace(', p)', ', p0)')}) AS l0, avg({_LL.replace(', p)', ', p1)')}) AS l1,
  avg(CASE WHEN y = 1 THEN CASE WHEN CASE WHEN event_disutility IS NULL THEN p0 < 0.5 ELSE p0 * event_disutility < 0.1 END THEN 1 ELSE 0 END END) AS f0,
  avg(CASE WHEN y = 1 THEN CASE WHEN CASE WHEN event_disutility IS NULL THEN p1 < 0.5 ELSE p1 * event_disutility < 0.1 END THEN 1 ELSE 0 END END) AS f1,
  avg(CASE WHEN y = 1 AND criticality_stage = 'C4' THEN CASE WHEN CASE WHEN event_disutility IS NULL THEN p0 < 0.5 ELSE p0 * event_disutility < 0.1 END THEN 1 ELSE 0 END END) AS c0,
  avg(CASE WHEN y = 1 AND criticality_stage = 'C4' THEN CASE WHEN CASE WHEN event_disutility IS NULL THEN p1 < 0.5 ELSE p1 * event_disutility < 0.1 END THEN 1 ELSE 0 END END) AS c1,
  sum(y) AS s FROM lo GROUP BY ALL),
nn AS (SELECT {_K}, count(*) AS n FROM xs GROUP BY ALL UNION ALL SELECT DISTINCT target_name, 'domain_high_symbol_fan_in', dom, 0 FROM ds),
n2 AS (SELECT {_K}, max(n) AS n FROM nn GROUP BY ALL),
gt AS (SELECT n2.*, s, b0, b1, l0, l1, f0, f1, c0, c1, cov, lcb, CASE WHEN n < 100 THEN 'INSUFFICIENT_N' WHEN b0 - b1 < 0 THEN 'DELTA_BRIER_NEGATIVE' WHEN l0 - l1 < 0 THEN 'DELTA_LOG_LOSS_NEGATIVE'
  WHEN target_name LIKE 'p_event.%' AND f1 > f0 THEN 'FALSE_PROCEED_RATE_INCREASE' WHEN target_name LIKE 'p_event.%' AND c1 IS NOT NULL AND (c0 IS NULL OR c1 > c0) THEN 'C4_WEAKENING_DETECTED'
  WHEN cov < 0.9 OR lcb < 0.9 THEN 'INTERVAL_COVERAGE_LOW' END AS veto FROM n2 LEFT JOIN sc USING ({_K}) LEFT JOIN bw USING ({_K}))"""
_RISK = f"{scopes_sql('risk_rows')}, {_POS}, {_BCOV}, {_BGATE}"


@plan("h02_binary_gate", f"""WITH {_RISK}
SELECT {_K}, n AS n_group, R(b0 - b1) AS delta_brier, R(l0 - l1) AS delta_log_loss, R(CASE WHEN n >= 100 THEN cov END) AS interval_coverage, R(CASE WHEN n >= 100 THEN lcb END) AS interval_coverage_lcb,
  R(f0) AS fpr_without, R(f1) AS fpr_with, R(c0) AS c4_without, R(c1) AS c4_with, veto AS veto_reason, veto IS NULL AS promoted FROM gt""")
def _(m):
    return P.binary_gate(m.risk_rows).select(
        "target_name", "scope_kind", "scope_value", "n_group", "delta_brier", "delta_log_loss", "interval_coverage",
        "interval_coverage_lcb", "fpr_without", "fpr_with", "c4_without", "c4_with", "veto_reason", "promoted")


def _cont(src):
    return f"""{scopes_sql(src)}, {_POS},
cf AS (SELECT *, count(*) OVER w - count(*) OVER v AS m, (sum(actual_value) OVER w - sum(actual_value) OVER v) / (count(*) OVER w - count(*) OVER v) AS mu, count(*) OVER v AS fn, avg(actual_value) OVER v AS fm,
  (sum((actual_value - 0.5) ** 2) OVER w - sum((actual_value - 0.5) ** 2) OVER v) AS q, (sum(actual_value - 0.5) OVER w - sum(actual_value - 0.5) OVER v) AS t
  FROM fd WHERE n >= 100 WINDOW w AS (PARTITION BY {_K}), v AS (PARTITION BY {_K}, fold)),
cv AS (SELECT *, (q - t * t / m) / (m - 1) AS v FROM cf),
ch AS (SELECT {_K}, fold, max(CASE WHEN abs(fm - mu) <= 1.645 * sqrt(v / m + v / fn) THEN 1 ELSE 0 END) AS hit, count(*) FILTER (abs(actual_value - mu) <= 1.645 * sqrt(v / m + v)) AS k, count(*) AS e FROM cv GROUP BY ALL),
cb AS (SELECT {_K}, avg(hit) AS cov, cast(sum(k) as double) AS k, cast(sum(e) as double) AS e FROM ch GROUP BY ALL),
cw AS (SELECT *, greatest(0, (k / e + 2.706025 / (2 * e) - 1.645 * sqrt((k / e * (1 - k / e) + 2.706025 / (4 * e)) / e)) / (1 + 2.706025 / e)) AS lcb FROM cb),
ca AS (SELECT {_K}, avg((actual_value - predicted_value) ** 2) - avg((actual_value - p1) ** 2) AS dm FROM (SELECT *, (sum(actual_value) OVER w - actual_value) / (n - 1) AS p1 FROM po WHERE n > 1 WINDOW w AS (PARTITION BY {_K})) GROUP BY ALL),
nn AS (SELECT {_K}, count(*) AS n, avg(actual_value) AS mean, var_samp(actual_value) AS vs FROM xs GROUP BY ALL),
n2 AS (SELECT * FROM nn UNION ALL SELECT DISTINCT target_name, 'domain_high_symbol_fan_in', dom, 0, NULL, NULL FROM ds WHERE (target_name, 'domain_high_symbol_fan_in', dom) NOT IN (SELECT ({_K}) FROM nn)),
cg AS (SELECT *, CASE WHEN n < 100 THEN 'INSUFFICIENT_N' WHEN dm < 0 THEN 'DELTA_MSE_NEGATIVE' WHEN cov < 0.9 OR lcb < 0.9 THEN 'INTERVAL_COVERAGE_LOW' END AS veto FROM n2 LEFT JOIN ca USING ({_K}) LEFT JOIN cw USING ({_K}))"""


@plan("h03_continuous_gate", f"""WITH {_cont('benefit_rows')}
SELECT {_K}, n AS n_group, R(dm) AS delta_mse, R(cov) AS interval_coverage, R(lcb) AS interval_coverage_lcb, veto AS veto_reason, veto IS NULL AS promoted FROM cg""")
def _(m):
    return P.continuous_gate(m.benefit_rows).select(
        "target_name", "scope_kind", "scope_value", "n_group", "delta_mse", "interval_coverage", "interval_coverage_lcb", "veto_reason", "promoted")


_PROV = f"""
pm AS (SELECT {_K}, provider_version AS v, count(*) AS c, min(ledger_id) AS f FROM xs GROUP BY ALL), pv2 AS (SELECT {_K}, arg_max(v, (c, -f)) AS provider_version FROM pm GROUP BY ALL),
im AS (SELECT {_K}, index_version AS v, count(*) AS c, min(ledger_id) AS f FROM xs GROUP BY ALL), iv2 AS (SELECT {_K}, arg_max(v, (c, -f)) AS index_version FROM im GROUP BY ALL),
gs AS (SELECT {_K}, CASE WHEN count(DISTINCT graph_scope_digest) = 1 AND count(*) = count(graph_scope_digest) THEN min(graph_scope_digest) END AS graph_scope_digest FROM xs GROUP BY ALL)"""


@plan("e19_scope_provenance", f"WITH {scopes_sql('risk_rows')}, {_PROV} SELECT * FROM pv2 JOIN iv2 USING ({_K}) JOIN gs USING ({_K})")
def _(m):
    return P.scope_provenance(m.risk_rows).drop("target_type")


_RANKS = "CASE scope_kind WHEN 'global' THEN 0 WHEN 'action_type' THEN 2 WHEN 'public_api' THEN 3 WHEN 'domain' THEN 4 WHEN 'domain_change_kind' THEN 5 WHEN 'high_symbol_fan_in' THEN 6 WHEN 'domain_high_symbol_fan_in' THEN 7 WHEN 'public_api_domain' THEN 8 ELSE 9 END"
_LATE = "CASE WHEN scope_kind LIKE '%high_symbol_fan_in' AND graph_scope_digest IS NULL THEN 'GRAPH_SCOPE_COHORT_MISMATCH' END"


@plan("h04_fact_rows", f"""WITH {_RISK}, {_PROV}
SELECT {_K}, {_RANKS} AS specificity_rank, R(s / cast(n as double)) AS value, n AS sample_size, R((1 + s) * (1 + n - s) / (cast(2 + n as double) ** 2 * (3 + n))) AS variance,
  R((1 + s) * (1 + n - s) / (cast(2 + n as double) * (3 + n))) AS aleatoric_variance, provider_version, graph_scope_digest, {_LATE} AS late_veto
FROM gt JOIN pv2 USING ({_K}) JOIN gs USING ({_K}) WHERE veto IS NULL""")
def _(m):
    f = P.fact_rows(P.binary_gate(m.risk_rows), P.scope_provenance(m.risk_rows), True)
    return f.drop("target_type", "calibration_method", "index_version")


def _run(m, family):
    if family == "risk":
        rows, gate = m.risk_rows, P.binary_gate
    elif family == "benefit":
        rows, gate = m.benefit_rows, P.continuous_gate
    else:
        rows, gate = C.production_rows(m.prediction_errors, "cost_continuous"), P.continuous_gate
    gates = cut_lineage(gate(rows))
    return P.promotion_summary(family, gates, P.fact_rows(gates, P.scope_provenance(rows), family == "risk"))


def _summary_sql(gates, veto):
    return f"SELECT coalesce({veto}, {_LATE}, 'PROMOTED') AS verdict, count(*) AS n FROM {gates} LEFT JOIN gs USING ({_K}) GROUP BY 1"


@plan("h05_promotion_run_risk", f"WITH {_RISK}, {_PROV} SELECT *, 'risk' AS family FROM ({_summary_sql('gt', 'veto')})")
def _(m):
    return _run(m, "risk")


@plan("h05_promotion_run_benefit", f"WITH {_cont('benefit_rows')}, {_PROV} SELECT *, 'benefit' AS family FROM ({_summary_sql('cg', 'veto')})")
def _(m):
    return _run(m, "benefit")


@plan("h05_promotion_run_cost", f"""WITH cr AS (SELECT * FROM prediction_errors WHERE target_type = 'cost_continuous' AND shadow_mode = 0 AND hash_version = 2 AND outcome_label_status = 'observed' AND guidance_packet_id IS NULL),
{_cont('cr')}, {_PROV} SELECT *, 'cost' AS family FROM ({_summary_sql('cg', 'veto')})""")
def _(m):
    return _run(m, "cost")


@plan("e18_drift", f"""
WITH {scopes_sql('risk_rows')}, old AS (SELECT {_K}, avg(actual_outcome) AS v FROM xs WHERE assessment_id % 2 = 0 GROUP BY ALL), cur AS (SELECT {_K}, avg(actual_outcome) AS r FROM xs GROUP BY ALL)
SELECT count(*) AS facts_compared, R(avg(abs(v - r))) AS drift, avg(abs(v - r)) >= 0.05 AS frozen FROM old JOIN cur USING ({_K})
""")
def _(m):
    old = P.explode_scopes(m.risk_rows.filter("assessment_id % 2 = 0"), "actual_outcome").groupBy(*P.SCOPE).agg(F.avg("actual_outcome").alias("value"))
    return P.drift(old, m.risk_rows)


@plan("e17_cluster_fit", """
WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS owner, l_returnflag <> 'N' AS ok FROM lineitem),
d AS (SELECT owner, count(*) AS k, bool_or(ok) AS y FROM r GROUP BY 1)
SELECT 'duplicate_owner' AS status, count(*) AS owners, count(*) FILTER (y) AS successes, count(*) FILTER (k > 1) AS repeated_owners, NULL AS p_success, NULL AS p_success_variance, NULL AS aleatoric_variance FROM d
UNION ALL SELECT 'ok', count(*), count(*) FILTER (y), 0, R((1.0 + count(*) FILTER (y)) / (2 + count(*))), R((1.0 + count(*) FILTER (y)) * (1 + count(*) FILTER (NOT y)) / (cast(2 + count(*) as double) ** 2 * (3 + count(*)))),
  R((1.0 + count(*) FILTER (y)) * (1 + count(*) FILTER (NOT y)) / (cast(2 + count(*) as double) * (3 + count(*)))) FROM d WHERE k = 1
""")
def _(m):
    rows = m.lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("owner"), (F.col("l_returnflag") != "N").alias("action_success"), F.lit(True).alias("eligible"))
    every = P.cluster_fit(rows.withColumn("proof_fired", F.lit(True)))
    once = rows.groupBy("owner").agg(F.count(F.lit(1)).alias("k"))
    single = rows.join(once, "owner").withColumn("proof_fired", F.col("k") == 1)
    return every.unionByName(P.cluster_fit(single))


_CASES = """
cs AS (SELECT *, CASE WHEN assessment_id % 4 = 0 THEN 'score' ELSE 'promote' END AS part FROM risk_rows WHERE target_name = 'p_success')
"""


def _case_tables(m):
    """Cases, predictions and outcomes of the p_success rows as three separate tables."""
    rows = m.risk_rows.filter("target_name = 'p_success'").withColumnRenamed("ledger_id", "case_id")
    part = F.when(F.col("assessment_id") % 4 == 0, "score").otherwise("promote")
    features = [c for c in rows.columns if c not in ("predicted_probability", "actual_outcome")]
    return (rows.select(*features, part.alias("partition")), rows.select("case_id", "predicted_probability"),
            rows.select("case_id", "actual_outcome"))


@plan("d18_case_triples", f"WITH {_CASES} SELECT ledger_id AS case_id, R(predicted_probability) AS predicted_probability, actual_outcome FROM cs WHERE part = 'score'")
def _(m):
    return P.join_cases(*_case_tables(m), "score").select(F.col("case_id").cast("bigint"), "predicted_probability", "actual_outcome")


@plan("e28_corpus_coverage", f"""WITH {_CASES}, pr AS (SELECT * FROM cs WHERE part = 'promote'), {scopes_sql('pr')}, {_POS}, {_BCOV}, {_BGATE}
SELECT (SELECT count(*) FROM pr) AS n_promote, R((SELECT avg(actual_outcome) FROM pr)) AS rate, (SELECT count(*) FROM cs WHERE part = 'score') AS n_score, coalesce(veto, 'PROMOTED') AS gate,
  CASE WHEN n < 120 THEN 'promote_partition_too_small' WHEN s / n - 0.25 < 0.05 THEN 'rate_not_above_prior' WHEN veto IS NOT NULL THEN veto ELSE 'ok' END AS status FROM gt WHERE scope_kind = 'global'""")
def _(m):
    tables = _case_tables(m)
    promote = P.join_cases(*tables, "promote").withColumnRenamed("case_id", "ledger_id")
    return P.corpus_coverage(promote, P.join_cases(*tables, "score"), 0.25, P.binary_gate(promote))


@plan("h06_replay_comparison", f"""
WITH {_CASES}, pr AS (SELECT * FROM cs WHERE part = 'promote'), {scopes_sql('pr')}, {_POS}, {_BCOV}, {_BGATE},
v AS (SELECT CASE WHEN veto IS NULL THEN s / cast(n as double) END AS v, veto IS NULL AS fired FROM gt WHERE scope_kind = 'global'),
t AS (SELECT 'genesis' AS track, predicted_probability AS p, actual_outcome AS y FROM cs WHERE part = 'score' UNION ALL SELECT 'learned', CASE WHEN fired THEN least(0.99, greatest(0.01, v)) ELSE predicted_probability END, actual_outcome FROM cs, v WHERE part = 'score'),
q AS (SELECT track, count(*) AS n, avg((p - y) ** 2) AS b, avg({_LL}) AS l FROM t GROUP BY 1),
e AS (SELECT track, sum(k * abs(a - c)) / sum(k) AS e FROM (SELECT track, len(list_filter(range(1, 10), lambda i: i * (cast(1 as double) / 10) <= p)) AS bin, count(*) AS k, avg(y) AS a, avg(p) AS c FROM t GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT * FROM q JOIN e USING (track)), g AS (SELECT * FROM j WHERE track = 'genesis'), w AS (SELECT * FROM j WHERE track = 'learned')
SELECT g.n AS genesis_n, w.n AS learned_n, R(g.b) AS genesis_brier, R(w.b) AS learned_brier, R(g.l) AS genesis_log_loss, R(w.l) AS learned_log_loss, R(g.e) AS genesis_ece, R(w.e) AS learned_ece,
  R(g.b - w.b) AS brier_lift, R(g.l - w.l) AS log_loss_lift, R(g.e - w.e) AS ece_lift, fired AS promotion_fired,
  array_to_string(list_filter([CASE WHEN NOT fired THEN 'PROMOTION_NOT_FIRED' END, CASE WHEN NOT w.b < g.b THEN 'LEARNED_NOT_BETTER' END, CASE WHEN g.b - w.b <= 0 THEN 'BRIER_NOT_IMPROVED' END], lambda x: x IS NOT NULL), ',') AS failure_reasons, fired AND w.b < g.b AS passed,
  CASE WHEN g.b > w.b AND g.l > w.l AND g.e > w.e THEN 'improved_on_fixture' ELSE 'mixed_on_fixture' END AS verdict FROM g, w, v
""")
def _(m):
    tables = _case_tables(m)
    promote = P.join_cases(*tables, "promote").withColumnRenamed("case_id", "ledger_id")
    score = P.join_cases(*tables, "score")
    gate = P.binary_gate(promote).filter("scope_kind = 'global' AND promoted")
    learned = gate.agg(F.max(F.col("successes") / F.col("n_group")).alias("v"))
    value = clamp(learned.select("v").scalar(), 0.01, 0.99)
    base = score.select("predicted_probability", "actual_outcome", (F.col("actual_outcome") == 1).alias("harmful"), F.lit(True).alias("proceeded"), "criticality_stage")
    tracks = base.withColumn("track", F.lit("genesis")).withColumn("p", F.col("predicted_probability")).unionByName(
        base.withColumn("track", F.lit("learned")).withColumn("p", F.coalesce(value, F.col("predicted_probability"))))
    fired = gate.agg(F.count(F.lit(1)).alias("n")).select(F.col("n") > 0).scalar()
    return P.replay_comparison(C.metric_bundle(tracks, ["track"], "p", "actual_outcome"), fired)
