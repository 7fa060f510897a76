"""Prior plans."""

from pyspark.sql import functions as F

from oddsmith import constants as K
from oddsmith.functions.columns import lookup
from oddsmith.functions.stats import bernoulli_variance, beta_variance
from oddsmith.operators import priors as P
from oddsmith.operators.promotion import FEATURES, SCOPE, explode_scopes, scope_features, teaches
from oddsmith.plans.catalog import plan
from oddsmith.plans.promotion import _RANKS, scopes_sql

_FACTS = f"""
{scopes_sql('risk_rows')},
f0 AS (SELECT target_name, scope_kind, scope_value, count(*) AS n, cast(sum(actual_outcome) as double) AS s, min(recorded_at) AS created_at FROM xs GROUP BY ALL),
facts AS (SELECT 'lrf_' || target_name || ':' || scope_kind || ':' || scope_value AS fact_id, 'risk_binary' AS target_type, target_name, scope_kind, scope_value, {_RANKS} AS specificity_rank, s / n AS value, n AS sample_size,
  created_at, cast(n % 11 as double) / 10 AS weight, cast(n % 40 as int) AS scope_change_count, CASE WHEN n % 3 <> 0 THEN (1 + s) * (1 + n - s) / (cast(2 + n as double) ** 2 * (3 + n)) END AS variance,
  CASE WHEN n % 3 = 2 THEN (1 + s) * (1 + n - s) / (cast(2 + n as double) * (3 + n)) END AS aleatoric_variance, n % 13 = 0 AS requires_ratification FROM f0
  UNION ALL SELECT 'lrf_' || t || ':' || g, 'risk_binary', t, 'path_glob', g, 1, 0.4, 150, TIMESTAMP '1999-01-01', 1.0, 0, 0.001, NULL, false
  FROM (SELECT unnest(['p_success', 'p_event.public_api_break']) AS t), (SELECT unnest(['pkg1/mod*.py', '*mod2?.py', 'pkg2/*']) AS g)),
af AS (SELECT *, domains[1] AS dom FROM action_features),
sk AS (SELECT action_id, 'global' AS scope_kind, '' AS scope_value FROM af UNION ALL SELECT action_id, 'action_type', action_type FROM af UNION ALL SELECT action_id, 'public_api', '' FROM af WHERE is_public_api
  UNION ALL SELECT action_id, 'high_symbol_fan_in', '' FROM af WHERE is_high_symbol_fan_in OR symbol_fan_in_percentile >= 0.9 UNION ALL SELECT action_id, 'symbol', symbol_id FROM af UNION ALL SELECT action_id, 'domain', dom FROM af
  UNION ALL SELECT action_id, 'public_api_domain', dom FROM af WHERE is_public_api UNION ALL SELECT action_id, 'domain_change_kind', dom || '|' || change_kind FROM af
  UNION ALL SELECT action_id, 'domain_high_symbol_fan_in', dom FROM af WHERE symbol_fan_in_percentile >= 0.9 UNION ALL SELECT DISTINCT action_id, 'path_glob', g FROM af, (SELECT unnest(['pkg1/mod*.py', '*mod2?.py', 'pkg2/*']) AS g) WHERE file_path GLOB g)
"""
_MATCHED = f"""{_FACTS},
ma AS (SELECT t.action_id, t.target_name, t.prior, t.prior_variance, f.* EXCLUDE (target_name), weight * exp(-scope_change_count / cast(20 as double)) AS ew FROM action_targets t JOIN sk ON sk.action_id = t.action_id
  JOIN facts f ON f.target_name = t.target_name AND f.scope_kind = sk.scope_kind AND f.scope_value = sk.scope_value),
el AS (SELECT * FROM ma WHERE NOT requires_ratification AND sample_size > 0 AND ew >= 0.1),
rk AS (SELECT *, row_number() OVER (PARTITION BY action_id, target_name ORDER BY specificity_rank DESC, sample_size DESC, created_at DESC, fact_id DESC) AS r,
  row_number() OVER (PARTITION BY action_id, target_name ORDER BY value DESC, specificity_rank DESC, sample_size DESC, created_at DESC, fact_id DESC) AS rv FROM el),
wi AS (SELECT * FROM rk WHERE CASE WHEN target_name LIKE 'p_event.%' THEN rv ELSE r END = 1)"""


def facts(m):
    """Facts as measured on the risk rows, counted per set of features first, plus a few path-glob facts."""
    rows = m.risk_rows
    sets = scope_features(rows.filter(teaches(rows))).groupBy(*FEATURES).agg(
        F.count(F.lit(1)).alias("n"), F.sum("actual_outcome").alias("s"), F.min("recorded_at").alias("created_at"))
    g = explode_scopes(sets, "n", "s", "created_at").groupBy(*SCOPE).agg(
        F.sum("n").alias("n"), F.sum("s").cast("double").alias("s"), F.min("created_at").alias("created_at"))
    n = F.col("n")
    learned = g.select(
        F.concat(F.lit("lrf_"), "target_name", F.lit(":"), "scope_kind", F.lit(":"), "scope_value").alias("fact_id"), *SCOPE,
        lookup(K.SCOPE_RANK, "scope_kind").alias("specificity_rank"), (F.col("s") / n).alias("value"), n.alias("sample_size"), "created_at",
        ((n % 11).cast("double") / 10).alias("weight"), (n % 40).cast("int").alias("scope_change_count"),
        F.when(n % 3 != 0, beta_variance("n", "s")).alias("variance"), F.when(n % 3 == 2, bernoulli_variance("n", "s")).alias("aleatoric_variance"),
        (n % 13 == 0).alias("requires_ratification"))
    globs = m.spark.sql("""SELECT concat('lrf_', t, ':', g) AS fact_id, 'risk_binary' AS target_type, t AS target_name, 'path_glob' AS scope_kind, g AS scope_value,
      1 AS specificity_rank, 0.4D AS value, 150L AS sample_size, TIMESTAMP '1999-01-01' AS created_at, 1.0D AS weight, 0 AS scope_change_count, 0.001D AS variance,
      cast(NULL as double) AS aleatoric_variance, false AS requires_ratification
      FROM (SELECT explode(array('p_success', 'p_event.public_api_break')) AS t) LATERAL VIEW explode(array('pkg1/mod*.py', '*mod2?.py', 'pkg2/*')) AS g""")
    return learned.unionByName(globs).withColumns({"calibration_method": F.lit("observed_rate_v1"), "calibration_quality": F.lit(1.0)})


_FJ = """SELECT p_partkey AS id, p_partkey % 3 AS repo_id, cast(p_partkey % 20 as int) AS snapshot_id,
  CASE p_partkey % 4 WHEN 0 THEN 'risk_binary' WHEN 1 THEN 'benefit_binary' WHEN 2 THEN 'benefit_continuous' ELSE 'cost_continuous' END AS target_type,
  CASE p_partkey % 9 WHEN 0 THEN 'not json' WHEN 1 THEN '{{"value": 0.5, "sample_size": 200}}' ELSE
  '{{"value": 0.25, "sample_size": ' || cast(p_partkey % 300 as string) || ', "calibration_method": "m", "weight": ' || CASE WHEN p_partkey % 7 = 0 THEN '-1' ELSE '0.5' END || '}}' END AS fact_json FROM {part}"""
_FJD = f"fj AS ({_FJ.replace('{part}', 'part').replace('{{', '{').replace('}}', '}')}), us AS (SELECT * FROM fj WHERE id % 9 > 1 AND id % 300 >= 100 AND id % 7 <> 0)"


@plan("b04_fact_usability", f"WITH {_FJD} SELECT id FROM us")
def _(m):
    return P.decode_facts(m.spark.sql(_FJ, part=m.part)).filter(P.usable()).select("id")


@plan("f09_active_snapshots", f"""WITH {_FJD}, fm AS (SELECT *, CASE target_type WHEN 'risk_binary' THEN 'risk' WHEN 'cost_continuous' THEN 'cost' ELSE 'benefit' END AS family FROM us),
d AS (SELECT *, dense_rank() OVER (PARTITION BY repo_id, family ORDER BY snapshot_id DESC) AS r FROM fm) SELECT id, repo_id, family, snapshot_id FROM d WHERE r = 1""")
def _(m):
    return P.active_facts(P.decode_facts(m.spark.sql(_FJ, part=m.part))).select("id", "repo_id", "family", "snapshot_id")


@plan("b05_fact_applicability", f"WITH {_FACTS} SELECT fact_id FROM facts WHERE NOT requires_ratification AND sample_size > 0")
def _(m):
    return facts(m).filter(P.applicable()).select("fact_id")


@plan("c14_churn_decay", f"WITH {_FACTS} SELECT fact_id, R(weight * exp(-scope_change_count / 20.0)) AS effective_weight, weight * exp(-scope_change_count / 20.0) >= 0.1 AS auto_applies FROM facts")
def _(m):
    return facts(m).select("fact_id", P.effective_weight().alias("effective_weight"), P.auto_applies().alias("auto_applies"))


@plan("c13_bounded_variance", f"""WITH {_FACTS} SELECT fact_id, R(CASE WHEN variance IS NULL THEN NULL WHEN aleatoric_variance IS NULL THEN cap ELSE greatest(cap / 10, least(cap, variance + aleatoric_variance)) END) AS applied_variance
FROM (SELECT *, CASE target_name WHEN 'p_success' THEN 0.04 ELSE 0.0025 END AS cap FROM facts)""")
def _(m):
    return facts(m).select("fact_id", P.bounded_variance(P.variance_component(), "variance", "aleatoric_variance").alias("applied_variance"))


@plan("b06_scope_predicate", f"WITH {_FACTS} SELECT f.fact_id, count(sk.action_id) AS matched_actions FROM facts f LEFT JOIN sk ON sk.scope_kind = f.scope_kind AND sk.scope_value = f.scope_value WHERE f.target_name = 'p_success' GROUP BY 1")
def _(m):
    f = facts(m).filter("target_name = 'p_success'")
    hits = P.match_facts(m.action_features.select("action_id", F.lit("p_success").alias("target_name")), m.action_features, f)
    counts = hits.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"))
    return f.select("fact_id").join(counts, "fact_id", "left").select("fact_id", F.coalesce("n", F.lit(0)).alias("matched_actions"))


@plan("d07_fact_match", f"WITH {_MATCHED} SELECT action_id, target_name, count(*) AS facts, R(sum(value)) AS value_sum FROM el GROUP BY 1, 2")
def _(m):
    hits = P.match_facts(m.action_targets, m.action_features, P.eligible(facts(m)))
    return hits.groupBy("action_id", "target_name").agg(F.count(F.lit(1)).alias("facts"), F.sum("value").alias("value_sum"))


@plan("d06_churn_count", f"""WITH {_FACTS}
SELECT fact_id, CASE WHEN scope_kind = 'path_glob' THEN (SELECT count(DISTINCT action_id) FROM af WHERE file_path GLOB f.scope_value AND af.verified AND af.recorded_at > f.created_at)
  ELSE (SELECT count(DISTINCT sk.action_id) FROM sk JOIN af ON af.action_id = sk.action_id WHERE sk.scope_kind = f.scope_kind AND sk.scope_value = f.scope_value AND af.verified AND af.recorded_at > f.created_at) END AS scope_change_count
FROM facts f""")
def _(m):
    return P.churn_counts(facts(m), m.action_features)


@plan("f02_most_specific", f"WITH {_MATCHED} SELECT action_id, target_name, fact_id, R(value) AS value FROM wi")
def _(m):
    won = P.resolved(m.action_targets, m.action_features, P.eligible(facts(m)))
    return won.filter("fact_id IS NOT NULL").select("action_id", "target_name", "fact_id", "value")


@plan("f03_log_pool", f"""WITH {_MATCHED}, lg AS (SELECT *, ln(least(0.99, greatest(0.01, value)) / (1 - least(0.99, greatest(0.01, value)))) AS l FROM rk WHERE r <= 3),
po AS (SELECT action_id, target_name, min(prior) AS prior, sum(ew * l) / sum(ew) AS l, count(*) AS contributors FROM lg GROUP BY 1, 2),
an AS (SELECT *, ln(least(0.99, greatest(0.01, prior)) / (1 - least(0.99, greatest(0.01, prior)))) AS a FROM po)
SELECT action_id, target_name, contributors, R(least(0.99, greatest(0.01, 1 / (1 + exp(-greatest(a - 2, least(a + 2, l))))))) AS pooled_value FROM an""")
def _(m):
    hits = P.match_facts(m.action_targets, m.action_features, P.eligible(facts(m)))
    return P.pooled(hits, m.action_targets).select("action_id", "target_name", "contributors", "pooled_value")


_APPLIED = """
ap AS (SELECT t.*, w.fact_id, w.value, w.variance, w.aleatoric_variance, least(0.99, greatest(0.01, w.value)) AS cv, CASE WHEN t.target_name = 'p_success' THEN 0.04 ELSE 0.0025 END AS cap
  FROM @T@ t LEFT JOIN wi w ON w.action_id = t.action_id AND w.target_name = t.target_name),
aq AS (SELECT *, value IS NOT NULL AND cv < prior AND target_name IN ('p_event.public_api_break', 'p_event.dependency_break', 'p_event.migration_failure') AS held,
  CASE WHEN variance IS NULL THEN NULL WHEN aleatoric_variance IS NULL THEN cap ELSE greatest(cap / 10, least(cap, variance + aleatoric_variance)) END AS lv FROM ap)"""


@plan("f04_apply_snapshot", f"""WITH {_MATCHED}, {_APPLIED.replace('@T@', 'action_targets')}
SELECT action_id, target_name, R(CASE WHEN value IS NULL OR held THEN prior ELSE cv END) AS new_value, R(CASE WHEN value IS NULL OR held THEN prior_variance ELSE coalesce(lv, prior_variance) END) AS new_variance, fact_id,
  CASE WHEN held THEN 'consequence_event_non_decreasing' END AS safety_constraint FROM aq""")
def _(m):
    return P.apply_facts(m.action_targets, m.action_features, facts(m)).select("action_id", "target_name", "new_value", "new_variance", "fact_id", "safety_constraint")


CELLS = [
    P.PriorCell("base_edit", 400, action_type="F", p_success=0.62, p_success_variance=0.002, p_success_aleatoric_variance=0.001, review_cost=0.3),
    P.PriorCell("ts_full", 150, language="TypeScript", language_tier="full", p_success=0.71, review_cost_variance=0.001, review_cost_aleatoric_variance=0.02),
    P.PriorCell("py", 300, language="python", review_cost=0.22, p_success_variance=0.03),
    P.PriorCell("graph", 90, action_type="F", graph_fact_kind="exported_binding_continuity", min_graph_confidence=0.9, p_success=0.9),
    P.PriorCell("unscoped", 500, p_success=0.1),
]
_CELLS = """
ce AS (SELECT * FROM (VALUES ('base_edit', 400, 'F', NULL, NULL, NULL, NULL, 1, 0.62, 0.008, 0.3, NULL), ('ts_full', 150, NULL, 'typescript', 'full', NULL, NULL, 2, 0.71, NULL, NULL, 0.01),
  ('py', 300, NULL, 'python', NULL, NULL, NULL, 1, NULL, 0.04, 0.22, NULL), ('graph', 90, 'F', NULL, NULL, 'exported_binding_continuity', 0.9, 3, 0.9, NULL, NULL, NULL)) t(tag, n, aty, la, lt, gk, mc, sp, p, pv, c, cv)),
cm AS (SELECT a.action_id, p_success_given, review_cost_given, ce.* FROM action_features a JOIN ce ON (aty IS NULL OR aty = a.action_type) AND (la IS NULL OR la = a.language) AND (lt IS NULL OR lt = a.language_tier)
  AND (gk IS NULL OR (gk = a.graph_fact_kind AND a.graph_confidence >= mc)))"""
_WARM = _CELLS + """,
wp AS (SELECT a.action_id, (SELECT p FROM cm WHERE cm.action_id = a.action_id AND p IS NOT NULL AND NOT a.p_success_given ORDER BY sp DESC, n DESC, tag DESC LIMIT 1) AS p, (SELECT tag FROM cm WHERE cm.action_id = a.action_id AND p IS NOT NULL AND NOT a.p_success_given ORDER BY sp DESC, n DESC, tag DESC LIMIT 1) AS pt,
  (SELECT c FROM cm WHERE cm.action_id = a.action_id AND c IS NOT NULL AND NOT a.review_cost_given ORDER BY sp DESC, n DESC, tag DESC LIMIT 1) AS c, (SELECT pv FROM cm WHERE cm.action_id = a.action_id AND pv IS NOT NULL ORDER BY sp DESC, n DESC, tag DESC LIMIT 1) AS pv,
  (SELECT cv FROM cm WHERE cm.action_id = a.action_id AND cv IS NOT NULL ORDER BY sp DESC, n DESC, tag DESC LIMIT 1) AS cv FROM action_features a)"""


@plan("d08_wildcard_cells", f"WITH {_CELLS} SELECT action_id, tag AS calibration_tag, sp AS specificity FROM cm")
def _(m):
    return P.match_cells(m.action_features, CELLS).select("action_id", "calibration_tag", "specificity")


@plan("f05_warm_prior", f"WITH {_WARM} SELECT action_id, R(p) AS warm_p_success, pt AS p_success_tag, R(c) AS warm_review_cost, R(pv) AS warm_p_success_variance, R(cv) AS warm_review_cost_variance FROM wp")
def _(m):
    return P.warm_priors(m.action_features, CELLS).drop("review_cost_tag")


@plan("f06_prior_layers", f"""WITH {_MATCHED}, {_WARM},
sh AS (SELECT t.action_id, t.target_name, prior_variance AS rv, coalesce(CASE target_name WHEN 'p_success' THEN p WHEN 'review_cost' THEN c END, prior) AS prior, coalesce(CASE target_name WHEN 'p_success' THEN pv WHEN 'review_cost' THEN cv END, prior_variance) AS prior_variance,
  CASE target_name WHEN 'p_success' THEN p WHEN 'review_cost' THEN c END IS NOT NULL AS used FROM action_targets t JOIN wp USING (action_id)), {_APPLIED.replace('@T@', 'sh')}
SELECT action_id, target_name, R(CASE WHEN value IS NULL OR held THEN prior ELSE cv END) AS value, R(CASE WHEN fact_id IS NOT NULL AND variance IS NULL AND target_name IN ('p_success', 'review_cost') THEN rv WHEN value IS NULL OR held THEN prior_variance ELSE coalesce(lv, prior_variance) END) AS variance,
  CASE WHEN fact_id IS NOT NULL THEN 'local_learned' WHEN used THEN 'shipped' ELSE 'request' END AS source FROM aq""")
def _(m):
    return P.layer_priors(m.action_targets, P.warm_priors(m.action_features, CELLS), m.action_features, facts(m))
