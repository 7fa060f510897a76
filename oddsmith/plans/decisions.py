"""Decision gate plans."""

from pyspark.sql import functions as F

from oddsmith.operators import decisions as D
from oddsmith.plans.catalog import plan
from oddsmith.plans.scoring import _SCORED, scored

_EV = """
ek AS (SELECT action_id, bool_or(event = 'migration_failure') AS ht, bool_or(event IN ('public_api_break', 'dependency_break')) AS hs,
  bool_or(event = 'public_api_break') AS hc FROM action_events GROUP BY 1),
g0 AS (SELECT sc.*, coalesce(ht, false) AS ht, coalesce(hs, false) AS hs, coalesce(hc, false) AS hc,
  has_fanin AND graph_freshness = 'fresh' AND resolution_method IN ('location', 'name_fallback') AND graph_file_error_count = 0 AS tr,
  revise_attempt >= max_revise_attempts AS exh,
  verification_status = 'passed' AND all_checks_passed AND patch_bound AND proposed_patch IS NOT NULL AS proof,
  file_operation_kind IN ('DELETE', 'RENAME', 'MOVE') AS dest, criticality_stage IN ('C3', 'C4') AS sens
  FROM sc LEFT JOIN ek USING (action_id)),
g1 AS (SELECT *, NOT exh AND benefit > 0 AND NOT ht AND hs AND (dest OR (hc AND max_change_kind = 'CONTRACT' AND (consequential_symbol_changed OR visibility = 'public_api'))
    OR CASE WHEN proposed_patch IS NOT NULL AND file_operation_kind = 'NONE' AND changed_symbol_count = 0 AND max_change_kind = 'UNKNOWN' THEN has_fanin AND resolved_symbol_count > 1
       ELSE changed_symbol_count > 1 OR expected_file_count > 1 END) AS nar,
  tr AND modify_repo_node_count >= 50 AND modify_repo_blast_fraction >= 0.4 AS big,
  CASE WHEN NOT is_revision THEN 'none' WHEN NOT origin_available OR missing_origin_items > 0 THEN CASE WHEN exh THEN 'ask_human' ELSE 'revise_safer' END
    WHEN origin_rau IS NULL THEN 'ask_human' WHEN benefit <= 0 THEN 'reject' WHEN loss >= origin_expected_loss OR rau < 0 THEN 'ask_human'
    WHEN verification_status <> 'not_applicable' AND NOT proof THEN CASE WHEN exh THEN 'ask_human' ELSE 'revise_safer' END ELSE 'approved' END AS rev FROM g0),
g2 AS (SELECT *, CASE WHEN policy_violation THEN 1
  WHEN criticality_stage = 'C4' AND (consequential_symbol_changed OR max_change_kind = 'UNKNOWN' OR structure_tier LIKE 'codegraph%') THEN 2
  WHEN rev NOT IN ('none', 'approved') THEN 9 WHEN rev = 'none' AND loss > thr THEN 3 WHEN rev = 'none' AND rau < 0 THEN 4
  WHEN rev = 'none' AND sd > 0.2 AND eu > 0 THEN 5 WHEN import_cycle_detected AND NOT proof THEN 16 WHEN band <> 'high' THEN 8 WHEN arch_freshness = 'stale' THEN 12
  WHEN NOT tr AND (dest OR max_change_kind IN ('CONTRACT', 'SIDE_EFFECT', 'UNKNOWN') OR consequential_symbol_changed OR is_migration OR is_schema_change) THEN 13
  WHEN big THEN 14 ELSE 11 END AS gate FROM g1),
g3 AS (SELECT *, CASE WHEN gate = 1 THEN 'reject' WHEN gate IN (2, 5) THEN 'ask_human' WHEN gate = 9 THEN rev
  WHEN gate IN (3, 4) THEN CASE WHEN nar THEN 'revise_safer' WHEN gate = 3 AND eu < 0 THEN 'reject' ELSE 'ask_human' END
  WHEN gate = 16 THEN 'test_first' WHEN gate = 11 THEN CASE WHEN obligations_missing THEN 'ask_human' ELSE 'proceed' END ELSE 'inspect_first' END AS dec,
  CASE WHEN gate = 11 AND obligations_missing THEN 15 ELSE gate END AS fg FROM g2),
g4 AS (SELECT *, sanction_valid AND sanction_controls_satisfied AND sanction_gates LIKE '%,' || fg || ',%'
  AND ((fg = 11 AND sens) OR (fg IN (2, 3, 4, 9) AND dec IN ('ask_human', 'reject'))) AS san FROM g3)
"""


@plan("c16_decision_gates", f"""WITH {_SCORED}, {_EV}
SELECT action_id, CASE WHEN san AND fg <> 11 AND obligations_missing THEN 'revise_safer' WHEN san THEN 'proceed' ELSE dec END AS recommended_decision,
  fg AS fired_gate, san AS sanction_applied, CASE WHEN san OR fg = 1 THEN false ELSE dec = 'ask_human' OR (fg = 11 AND sens) END AS requires_confirmation,
  CASE WHEN san AND NOT (fg <> 11 AND obligations_missing) THEN 'controlled_high_risk' WHEN NOT san AND sens AND dec IN ('inspect_first', 'test_first', 'revise_safer') THEN 'elevated_review'
    WHEN sens THEN 'sensitive_context' ELSE 'normal' END AS risk_mode FROM g4""")
def _(m):
    return D.decide(scored(m)).select(
        "action_id", "recommended_decision", "fired_gate", "sanction_applied", "requires_confirmation", "risk_mode")


@plan("c17_large_reach_gate", f"WITH {_SCORED}, {_EV} SELECT action_id, R(modify_repo_blast_fraction) AS fraction FROM g1 WHERE big")
def _(m):
    return m.evidence.filter(D.large_reach()).select("action_id", F.col("modify_repo_blast_fraction").alias("fraction"))


@plan("c18_revise_eligibility", f"WITH {_SCORED}, {_EV} SELECT action_id, nar AS may_revise FROM g1")
def _(m):
    return scored(m).select("action_id", D.may_revise().alias("may_revise"))


@plan("c19_revision_comparison", f"""WITH {_SCORED}
SELECT r.action_id, o.action_id AS origin_id, CASE WHEN o.action_id IS NULL THEN 'revision_origin_scores_unavailable' WHEN r.benefit <= 0 THEN 'revision_has_no_credible_benefit'
  WHEN r.loss >= o.loss THEN 'revision_risk_not_reduced' WHEN r.rau < 0 THEN 'revision_risk_still_outweighs_benefit' ELSE 'revision_risk_benefit_improved' END AS comparison,
  R(o.loss) AS origin_expected_loss FROM sc r LEFT JOIN sc o ON o.action_id = r.action_id - 1 AND o.action_id % 5 <> 0 WHERE r.is_revision""")
def _(m):
    s = scored(m)
    prior = F.when((F.col("action_id") - 1) % 5 != 0, F.col("action_id") - 1)
    revisions = s.filter("is_revision").select("action_id", "expected_loss", "benefit", "rau", prior.alias("origin_id"))
    out = D.compare_revisions(revisions, s)
    known = F.col("origin_expected_loss").isNotNull()
    return out.select("action_id", F.when(known, F.col("origin_id")).alias("origin_id"), "comparison", "origin_expected_loss")


@plan("c20_task_obligations", """
WITH x AS (SELECT *, action_id AS k FROM evidence),
y AS (SELECT action_id,
  [f FOR f IN ['src/a.py', 'src/b' || k % 3 || '.py'] IF NOT list_contains(['src/a.py', 'src/b' || request_id % 3 || '.py'], f)] AS mf,
  [s FOR s IN ['S' || k % 4, 'T'] IF NOT list_contains(['S' || request_id % 4], s)] AS ms,
  CASE WHEN verification_status = 'passed' AND patch_bound THEN CASE WHEN k % 3 = 0 THEN ['lint'] ELSE [] END ELSE ['lint', 'unit'] END AS mc FROM x)
SELECT action_id, array_to_string(list_sort(mf), ',') AS missing_files, array_to_string(list_sort(ms), ',') AS missing_symbols, array_to_string(list_sort(mc), ',') AS missing_checks,
  len(mf) + len(ms) + len(mc) > 0 AS incomplete FROM y
""")
def _(m):
    k = F.col("action_id")
    s = lambda c, n: (c % n).cast("string")
    rows = m.evidence.select(
        "action_id", "verification_status", "patch_bound",
        F.array(F.lit("src/a.py"), F.concat(F.lit("src\\b"), s(k, 3), F.lit(".py"))).alias("required_files"),
        F.array(F.lit("src/a.py"), F.concat(F.lit("src/b"), s(F.col("request_id"), 3), F.lit(".py"))).alias("touched_files"),
        F.array(F.concat(F.lit("S"), s(k, 4)), F.lit("T")).alias("required_symbols"),
        F.array(F.concat(F.lit("S"), s(F.col("request_id"), 4))).alias("changed_symbols"),
        F.array(F.lit("unit"), F.lit("lint")).alias("required_checks"),
        F.create_map(F.lit("unit"), F.lit("Passed"), F.lit("lint"),
                     F.when(k % 3 == 0, "failed").otherwise("passed")).alias("checks"))
    out = D.obligations_missing(rows)
    return out.select("action_id", *[F.array_join(c, ",").alias(c) for c in ("missing_files", "missing_symbols", "missing_checks")], "incomplete")


@plan("c27_envelope_check", """
WITH x AS (SELECT *, action_id AS k, request_id AS c FROM evidence),
r AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'unknown' WHEN k % 4 = c % 4 THEN 'fresh' ELSE 'stale' END AS fr,
  (CASE WHEN k % 6 = c % 6 THEN 0 ELSE 1 END) AS unx, (k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0) AS broad,
  CASE max_change_kind WHEN 'COSMETIC' THEN 0 WHEN 'TEST_ONLY' THEN 1 WHEN 'DIRECTIVE' THEN 2 WHEN 'BEHAVIORAL' THEN 3 WHEN 'UNKNOWN' THEN 4 WHEN 'CONTRACT' THEN 5 ELSE 6 END AS ps,
  CASE c % 4 WHEN 0 THEN 'COSMETIC' WHEN 1 THEN 'BEHAVIORAL' WHEN 2 THEN 'UNKNOWN' ELSE 'CONTRACT' END AS ak FROM x),
t AS (SELECT *, ak <> 'UNKNOWN' AND CASE ak WHEN 'COSMETIC' THEN 0 WHEN 'BEHAVIORAL' THEN 3 ELSE 5 END > ps AS mm, ak = 'UNKNOWN' AND k % 2 = 0 AS uc,
  c % 3 = 0 AND NOT consequential_symbol_changed AS nw, structure_tier = 'codegraph_semantic' AND c % 2 = 0 AS tl,
  CASE k % 5 WHEN 0 THEN 5 WHEN 1 THEN CASE WHEN c % 2 = 0 THEN 0 ELSE 4 END WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 0 END AS rr, CASE WHEN k % 5 < 4 THEN 1 ELSE 0 END AS rt,
  CASE WHEN c % 8 = 0 THEN 1 ELSE 0 END AS ms, CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS fl FROM r)
SELECT action_id, fr AS evidence_freshness, unx AS unexpected_files, CASE WHEN unx > 0 OR broad THEN 'violated' ELSE 'ok' END AS safe_scope_status,
  unx > 0 OR broad OR mm AS scope_drift, mm AS symbol_change_mismatch, uc AS classification_failed, nw AS newly_consequential, rt AS risky_triggered, ms AS missing_checks, fl AS failed_checks,
  CASE WHEN rr = 5 OR policy_violation THEN 'reject' WHEN broad OR mm OR rr = 4 OR k % 43 = 0 OR fl > 0 THEN 'ask_human' WHEN ms > 0 THEN 'test_first'
    WHEN fr <> 'fresh' OR unx > 0 OR uc OR nw OR tl OR k % 47 = 0 OR rr = 1 THEN 'inspect_first' ELSE 'proceed' END AS verify_decision FROM t
""")
def _(m):
    k, c = F.col("action_id"), F.col("request_id")
    s = lambda x, n: (x % n).cast("string")
    entry = F.struct(
        F.when(k % 5 == 2, "schema_changed").otherwise("custom").alias("signal"),
        F.when(k % 5 == 0, "forbidden").when(k % 5 == 1, "avoid_unless_required").otherwise("requires_reassessment").alias("action"),
        (c % 2 == 0).alias("necessity"))
    rows = m.evidence.select(
        "action_id", "policy_violation",
        F.when(k % 17 != 0, F.concat(F.lit("h"), s(k, 4))).alias("assessed_commit"),
        F.concat(F.lit("h"), s(c, 4)).alias("current_head"),
        F.array(F.concat(F.lit("src/m"), s(k, 6), F.lit(".py::fn")), F.lit("glob:docs/*.md")).alias("safe_scope_files"),
        F.array(F.concat(F.lit("src/m"), s(c, 6), F.lit(".py")), F.lit("docs/a/b.md")).alias("changed_files"),
        (k % 31 == 0).alias("dependency_changed"), (k % 37 == 0).alias("schema_changed"), (k % 41 == 0).alias("migration_changed"),
        F.col("max_change_kind").alias("pre_change_kind"),
        F.when(c % 4 == 0, "COSMETIC").when(c % 4 == 1, "BEHAVIORAL").when(c % 4 == 2, "UNKNOWN").otherwise("CONTRACT").alias("actual_change_kind"),
        (k % 2 == 0).alias("reclassification_attempted"),
        (c % 3 == 0).alias("actual_consequential"), F.col("consequential_symbol_changed").alias("pre_consequential"),
        F.col("structure_tier").alias("pre_tier"), F.when(c % 2 == 0, "python_ast").otherwise("codegraph_semantic").alias("actual_tier"),
        F.when(k % 43 == 0, F.array(F.lit("api"))).otherwise(F.array().cast("array<string>")).alias("contract_changes"),
        F.array(entry).alias("risky_scope"),
        F.when(k % 5 == 4, F.array(F.lit("other"))).otherwise(F.array(F.lit("custom"), F.lit("schema_changed"))).alias("triggered_signals"),
        F.array(F.lit("unit"), F.lit("lint")).alias("required_checks"),
        F.map_concat(F.create_map(F.lit("lint"), F.when(k % 19 == 0, "failed").otherwise("passed")),
                     F.when(c % 8 != 0, F.create_map(F.lit("unit"), F.lit("passed"))).otherwise(
                         F.create_map().cast("map<string,string>"))).alias("completed_checks"),
        (k % 47 == 0).alias("requires_dry_run"), F.lit(False).alias("dry_run_present"),
        F.col("policy_violation").alias("policy_forbidden"))
    return D.check_envelope(rows).select(
        "action_id", "evidence_freshness", "unexpected_files", "safe_scope_status", "scope_drift", "symbol_change_mismatch",
        "classification_failed", "newly_consequential", "risky_triggered", "missing_checks", "failed_checks", "verify_decision")
