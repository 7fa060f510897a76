"""Binds the delivered tables to the ledger/graph/experiment model.

Each view is one SQL text that means the same in Spark and in the checking engine, so a
query and its oracle read identical inputs.  ``{name}`` marks a table or another view.
Where the two dialects spell an array differently the view carries two texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str | tuple[str, str]] = {}

VIEWS["actions"] = """
SELECT o_orderkey AS action_id, o_custkey AS request_id, o_custkey % 5 AS repo_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'reject' WHEN '2' THEN 'ask_human'
    WHEN '3' THEN 'inspect_first' WHEN '4' THEN 'test_first' ELSE 'proceed' END AS decision,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'rejected' END AS terminal_status,
  o_orderdate AS recorded_at,
  CASE WHEN o_totalprice >= 500000 THEN cast(1.0 as double) ELSE o_totalprice / 500000 END AS immediate_benefit,
  cast(o_orderkey % 19 + 1 as double) / 20 AS p_success,
  cast(o_custkey % 10 as double) / 20 AS review_cost,
  'C' || cast(o_orderkey % 5 as string) AS criticality_stage,
  CASE o_orderkey % 3 WHEN 0 THEN 'edit' WHEN 1 THEN 'refactor' ELSE 'delete' END AS action_type,
  'commit' || cast(o_custkey % 7 as string) AS assessed_commit,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'patch ' || cast(o_orderkey as string) END AS proposed_patch
FROM {orders}
"""

VIEWS["action_events"] = """
SELECT l_orderkey AS action_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'test_regression' WHEN 1 THEN 'public_api_break'
    WHEN 2 THEN 'dependency_break' ELSE 'migration_failure' END AS event,
  cast(round(l_discount * 100) as int) / cast(20.0 as double) AS p_event,
  l_quantity / 50 AS elicited_disutility,
  l_partkey AS part_id, l_suppkey AS owner_id,
  CASE WHEN l_partkey % 3 = 0 THEN 'graph_modify_risk' ELSE 'request' END AS risk_source
FROM {lineitem}
"""

# a line's ledger id: from order key 36 million on it exceeds a bigint, so Spark reads it as a decimal; plans that return it cast it to the bigint of their SQL
_LINE = "((cast(l_orderkey as bigint) * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey)"
_LEDGER_ID = (
    f"cast(cast({_LINE} as decimal(19, 0)) * 32 + extract(day FROM l_shipdate) as decimal(21, 0))",
    f"{_LINE} * 32 + cast(extract(day FROM l_shipdate) as bigint)",
)

_PE_COMMON = """
  @ID@ AS ledger_id,
  l_orderkey AS assessment_id, l_orderkey % 1000 AS action_id,
  CASE WHEN l_orderkey % 100 = 0 THEN 1 ELSE 2 END AS hash_version,
  CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS shadow_mode,
  CASE WHEN l_orderkey % 7 = 0 THEN 'shadow' ELSE 'proceeded_edits_only' END AS calibration_scope,
  CASE WHEN l_quantity > 48 THEN 'censored' ELSE 'observed' END AS outcome_label_status,
  CASE WHEN l_suppkey % 50 = 0 THEN 'mgp_' || cast(l_suppkey as string) END AS guidance_packet_id,
  CASE WHEN l_partkey % 33 = 0 THEN 1 ELSE 0 END AS benefit_guidance_influenced,
  l_shipdate AS recorded_at
"""

_FEATURES = """
  l_linestatus AS action_type, 'sym' || cast(l_partkey % 50 as string) AS symbol_id,
  (l_partkey % 3 = 0) AS is_public_api,
  CASE l_suppkey % 3 WHEN 0 THEN 'BEHAVIORAL' WHEN 1 THEN 'CONTRACT' ELSE 'COSMETIC' END AS change_kind,
  'C' || cast(l_suppkey % 5 as string) AS criticality_stage,
  cast(l_partkey % 20 as double) / 20 AS symbol_fan_in_percentile,
  (l_partkey % 20 >= 18) AS is_high_symbol_fan_in,
  'v' || cast(l_suppkey % 3 as string) AS provider_version,
  'idx' || cast(l_partkey % 2 as string) AS index_version,
  CASE WHEN l_suppkey % 4 = 3 THEN NULL ELSE 'scope0' END AS graph_scope_digest
"""

_DOMAINS = (
    "array('d' || cast(l_suppkey % 4 as string))",
    "['d' || cast(l_suppkey % 4 as string)]",
)


def _pe(core: str) -> tuple[str, str]:
    body = "SELECT " + core + "," + _PE_COMMON + "," + _FEATURES + ", @D@ AS domains FROM {lineitem}"
    return tuple(body.replace("@D@", d).replace("@ID@", i) for d, i in zip(_DOMAINS, _LEDGER_ID))


# every row a production risk prediction
VIEWS["risk_rows"] = _pe("""
  'risk_binary' AS target_type,
  CASE l_linenumber % 4 WHEN 0 THEN 'p_success' WHEN 1 THEN 'p_event.public_api_break'
    WHEN 2 THEN 'p_event.dependency_break' ELSE 'p_event.migration_failure' END AS target_name,
  cast(round(l_discount * 100) as int) / cast(10.0 as double) AS predicted_probability,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS actual_outcome,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity / 50 END AS event_disutility
""")

VIEWS["benefit_rows"] = _pe("""
  'benefit_continuous' AS target_type, 'measured_benefit' AS target_name,
  l_tax * 10 AS predicted_value, l_quantity / 50 AS actual_value
""")

# the four target types mixed, with shadow, guided and censored rows
VIEWS["prediction_errors"] = _pe("""
  CASE WHEN l_orderkey % 10 < 6 THEN 'risk_binary' WHEN l_orderkey % 10 < 8 THEN 'benefit_binary'
    WHEN l_orderkey % 10 = 8 THEN 'benefit_continuous' ELSE 'cost_continuous' END AS target_type,
  CASE WHEN l_orderkey % 10 >= 9 THEN 'review_cost' WHEN l_orderkey % 10 = 8 THEN 'measured_benefit'
    WHEN l_orderkey % 10 >= 6 THEN 'immediate_benefit_realized'
    WHEN l_linenumber % 4 = 0 THEN 'p_success' WHEN l_linenumber % 4 = 1 THEN 'p_event.public_api_break'
    WHEN l_linenumber % 4 = 2 THEN 'p_event.dependency_break' ELSE 'p_event.migration_failure' END AS target_name,
  CASE WHEN l_orderkey % 10 < 8 THEN cast(round(l_discount * 100) as int) / cast(10.0 as double) END AS predicted_probability,
  CASE WHEN l_orderkey % 10 >= 8 THEN l_tax * 10 END AS predicted_value,
  CASE WHEN l_orderkey % 10 < 8 AND l_quantity <= 48 THEN CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END END AS actual_outcome,
  CASE WHEN l_orderkey % 10 >= 8 AND l_quantity <= 48 THEN l_quantity / 50 END AS actual_value,
  CASE WHEN l_orderkey % 10 >= 8 AND l_quantity <= 48 THEN l_quantity / 50 - l_tax * 10
    WHEN l_orderkey % 10 < 8 AND l_quantity <= 48 THEN
      CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END - cast(round(l_discount * 100) as int) / cast(10.0 as double) END AS residual
""")

VIEWS["evidence"] = """
SELECT a.*,
  CASE action_id % 7 WHEN 0 THEN 'COSMETIC' WHEN 1 THEN 'DIRECTIVE' WHEN 2 THEN 'TEST_ONLY'
    WHEN 3 THEN 'BEHAVIORAL' WHEN 4 THEN 'CONTRACT' WHEN 5 THEN 'SIDE_EFFECT' ELSE 'UNKNOWN' END AS max_change_kind,
  CASE action_id % 6 WHEN 0 THEN 'codegraph_structural' WHEN 1 THEN 'codegraph_semantic'
    WHEN 2 THEN 'unavailable' ELSE 'python_ast' END AS structure_tier,
  CASE request_id % 5 WHEN 0 THEN 'public_api' WHEN 1 THEN 'exported' WHEN 2 THEN 'public'
    WHEN 3 THEN 'internal' ELSE 'unknown' END AS visibility,
  (action_id % 4 = 0) AS consequential_symbol_changed,
  CASE action_id % 13 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'RENAME' WHEN 2 THEN 'MOVE' WHEN 3 THEN 'CREATE'
    ELSE 'NONE' END AS file_operation_kind,
  cast(action_id % 3 as int) AS changed_symbol_count, cast(1 + request_id % 2 as int) AS expected_file_count,
  (action_id % 41 = 0) AS is_migration, (action_id % 37 = 0) AS is_schema_change,
  (action_id % 11 <> 0) AS has_fanin,
  CASE WHEN action_id % 9 = 0 THEN 'stale' ELSE 'fresh' END AS graph_freshness,
  CASE action_id % 8 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'name_fallback_ambiguous' WHEN 2 THEN 'name_fallback'
    ELSE 'location' END AS resolution_method,
  cast(CASE WHEN action_id % 10 = 0 THEN 1 + action_id % 3 ELSE 0 END as int) AS graph_file_error_count,
  cast((action_id % 50) * 8000 as int) AS graph_file_size_bytes, cast((request_id % 60) * 10 as int) AS graph_file_node_count,
  cast(action_id % 6 as int) AS symbol_caller_count, cast(action_id % 21 as double) / 20 AS symbol_fan_in_percentile,
  cast(action_id % 5 as int) AS modify_impact_count, cast(request_id % 21 as double) / 20 AS modify_impact_percentile,
  cast(request_id % 4 as int) AS modify_transitive_impact_count,
  cast((action_id + request_id) % 21 as double) / 20 AS modify_transitive_impact_percentile,
  cast(request_id % 50 as double) / 50 AS modify_repo_blast_fraction, cast(request_id % 120 as int) AS modify_repo_node_count,
  cast(action_id % 4 as int) AS resolved_symbol_count, cast((action_id % 30) * 6 as int) AS max_owner_span_lines,
  cast(action_id % 12 as int) AS outgoing_edge_total,
  (request_id % 6 = 0) AS is_exported_contract, (request_id % 14 = 0) AS is_abstract_contract,
  CASE action_id % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'route' ELSE 'function' END AS owner_kind,
  cast(request_id % 21 as double) / 20 AS god_node_score, cast(action_id % 11 as double) / 10 AS bridge_centrality,
  (request_id % 9 = 0) AS cycle_participation, (action_id % 12 = 0) AS domain_entrypoint,
  CASE WHEN action_id % 10 = 0 THEN cast(0.5 as double) ELSE cast(0.0 as double) END AS anchor_score,
  CASE WHEN action_id % 29 = 0 THEN 'stale' ELSE 'fresh' END AS arch_freshness,
  (action_id % 23 = 0) AS import_cycle_detected,
  CASE action_id % 7 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'unavailable'
    ELSE 'not_applicable' END AS verification_status,
  (action_id % 14 <> 7) AS all_checks_passed, (action_id % 28 = 0) AS patch_bound,
  (action_id % 6 = 0) AS is_revision, (action_id % 18 <> 0) AS origin_available,
  cast(CASE WHEN action_id % 24 = 6 THEN 1 ELSE 0 END as int) AS missing_origin_items,
  CASE WHEN action_id % 30 <> 0 THEN cast(request_id % 20 as double) / 40 END AS origin_expected_loss,
  CASE WHEN action_id % 30 <> 0 THEN cast(request_id % 10 as double) / 20 END AS origin_rau,
  (action_id % 15 = 0) AS obligations_missing,
  (action_id % 4 = 1) AS sanction_valid, (action_id % 3 <> 0) AS sanction_controls_satisfied,
  CASE action_id % 3 WHEN 1 THEN ',2,3,4,9,' ELSE ',11,' END AS sanction_gates,
  (action_id % 97 = 0) AS policy_violation,
  cast(action_id % 3 as int) AS revise_attempt, cast(1 + action_id % 2 as int) AS max_revise_attempts,
  cast(action_id % 20 + 1 as double) / 20 AS evidence_quality, cast(request_id % 19 + 2 as double) / 20 AS testability,
  cast(action_id % 9 + 12 as double) / 20 AS reversibility, cast(request_id % 7 + 14 as double) / 20 AS source_reliability,
  cast(action_id % 5 + 16 as double) / 20 AS scope_control,
  cast(action_id % 5 as double) / 4 AS future_change_exposure,
  CASE action_id % 4 WHEN 0 THEN 'projected' WHEN 1 THEN 'measured' ELSE 'derived' END AS benefit_source,
  CASE WHEN action_id % 8 = 0 THEN cast(action_id % 80 as double) / 1000 END AS benefit_variance_override,
  CASE WHEN action_id % 6 = 1 THEN cast(action_id % 50 as double) / 1000 END AS p_success_variance,
  CASE WHEN action_id % 6 = 2 THEN cast(action_id % 20 as double) / 1000 END AS review_cost_variance
FROM {actions} a
"""

VIEWS["metric_deltas"] = """
SELECT l_orderkey AS action_id, 'file' || cast(l_suppkey % 5 as string) AS file_path,
  CASE l_linenumber WHEN 1 THEN 'complexity_delta' WHEN 2 THEN 'maintainability_index_delta'
    WHEN 3 THEN 'coupling_delta' WHEN 4 THEN 'testability_delta' WHEN 5 THEN 'cohesion_delta'
    WHEN 6 THEN 'unknown_metric' ELSE 'complexity_delta' END AS metric,
  (l_quantity - 25) / 10 AS delta, l_tax * 100 AS weight
FROM {lineitem}
"""

VIEWS["nodes"] = """
SELECT 'p' || cast(p_partkey as string) AS id, 'function' AS kind, p_name AS name,
  CASE WHEN p_partkey % 4 = 0 THEN 'Mod' || cast(p_partkey % 40 as string) || '::fn' || cast(p_partkey as string)
    WHEN p_partkey % 4 = 1 THEN 'Mod' || cast(p_partkey % 40 as string) || '.fn' || cast(p_partkey as string)
    ELSE 'fn' || cast(p_partkey as string) END AS qualified_name,
  'dir' || cast(cast(floor(p_partkey / 50) as bigint) % 8 as string) || '/file' || cast(cast(floor(p_partkey / 50) as bigint) as string) AS file_path,
  CASE p_partkey % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'csharp' ELSE 'rust' END AS language,
  cast((p_partkey % 97) * 10 as int) AS start_line, cast((p_partkey % 97) * 10 + p_size as int) AS end_line,
  CASE WHEN p_partkey % 3 = 0 THEN p_type END AS signature,
  CASE WHEN p_partkey % 6 = 0 THEN p_brand END AS return_type,
  CASE p_partkey % 5 WHEN 1 THEN 'public' WHEN 3 THEN '' WHEN 4 THEN 'private' END AS visibility,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE cast(p_partkey % 2 as int) END AS is_exported,
  CASE WHEN p_partkey % 50 = 0 THEN 1 ELSE 0 END AS is_abstract
FROM {part}
UNION ALL
SELECT 's' || cast(s_suppkey as string), CASE WHEN s_suppkey % 10 = 0 THEN 'interface' ELSE 'class' END, s_name, 'Svc' || cast(s_suppkey as string),
  'dir' || cast(cast(floor(s_suppkey / 3) as bigint) % 8 as string) || '/file' || cast(cast(floor(s_suppkey / 3) as bigint) as string),
  CASE WHEN s_suppkey % 2 = 0 THEN 'python' ELSE 'go' END, cast((s_suppkey % 9) * 100 as int), cast((s_suppkey % 9) * 100 + 120 as int),
  NULL, NULL, CASE WHEN s_suppkey % 3 = 0 THEN 'public' END, cast(s_suppkey % 2 as int), 0
FROM {supplier}
UNION ALL
SELECT 'c' || cast(c_custkey as string), 'module', c_name, 'Pkg' || cast(c_custkey as string),
  'dir' || cast(cast(floor(c_custkey / 50) as bigint) % 8 as string) || '/' || CASE WHEN cast(floor(c_custkey / 50) as bigint) % 6 = 0 THEN 'test_' ELSE '' END || 'file' || cast(cast(floor(c_custkey / 50) as bigint) as string),
  'python', cast((c_custkey % 50) * 20 as int), cast((c_custkey % 50) * 20 + 90 as int), NULL, NULL, NULL, NULL, 0
FROM {customer}
"""

# every line takes part; the graph is sparse because a key keeps the other end of its newest order only
_NEWEST = "max(cast(l_orderkey as bigint) * 1000000000 + {end}) % 1000000000"
VIEWS["edges"] = f"""
SELECT 's' || cast({_NEWEST.format(end="l_suppkey")} as string) AS source, 'p' || cast(l_partkey as string) AS target, 'calls' AS kind
FROM {{lineitem}} GROUP BY l_partkey, l_linestatus
UNION ALL
SELECT DISTINCT 'p' || cast(part as string), 's' || cast(l_suppkey as string), 'references'
FROM (SELECT l_suppkey, {_NEWEST.format(end="l_partkey")} AS part FROM {{lineitem}} GROUP BY l_suppkey, l_linenumber)
UNION ALL
SELECT 'c' || cast(o_custkey as string), 'p' || cast({_NEWEST.format(end="l_partkey")} as string), 'instantiates'
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY o_custkey
UNION ALL
SELECT 'c' || cast({_NEWEST.format(end="o_custkey")} as string), 's' || cast(l_suppkey as string), 'contains'
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY l_suppkey
"""

VIEWS["files"] = """
SELECT file_path AS path, count(*) * 1000 AS size, count(*) AS node_count,
  CASE WHEN count(*) % 3 = 0 THEN '[1, 2]' WHEN count(*) % 3 = 1 THEN '[]' ELSE 'broken' END AS errors
FROM {nodes} GROUP BY file_path
"""

# owners an action touches: at most one service and one function per action
VIEWS["touched"] = """
SELECT l_orderkey AS action_id, CASE WHEN service THEN 's' || cast(max(l_suppkey) as string)
  ELSE 'p' || cast(max(l_partkey) as string) END AS id
FROM (SELECT *, l_linenumber % 5 = 0 AS service FROM {lineitem}) GROUP BY l_orderkey, service
"""

VIEWS["import_files"] = """
SELECT 'dir' || cast(p_partkey % 12 as string) || '/m' || cast(p_partkey as string) || '.py' AS path,
  (p_partkey % 31 = 0) AS is_entrypoint, (p_partkey % 53 = 0) AS parse_error,
  p_type AS content_hash, p_brand AS old_content_hash
FROM {part}
"""

VIEWS["raw_imports"] = """
SELECT 'dir' || cast(l_partkey % 12 as string) || '/m' || cast(l_partkey as string) || '.py' AS src,
  CASE WHEN l_linenumber % 7 = 6 THEN NULL ELSE
    'dir' || cast((l_suppkey * 7 + l_linenumber) % 12 as string) || '/m' || cast(l_suppkey * 7 + l_linenumber as string) || '.py' END AS tgt,
  CASE l_linenumber WHEN 1 THEN 'static' WHEN 2 THEN 'relative' WHEN 3 THEN 'wildcard' WHEN 4 THEN 'dynamic'
    WHEN 6 THEN CASE l_suppkey % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'dynamic' ELSE 'external' END ELSE 'static' END AS kind,
  'mod' || cast(l_suppkey as string) AS name
FROM (SELECT l_partkey, l_linenumber, max(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_partkey, l_linenumber)
WHERE l_partkey <> l_suppkey * 7 + l_linenumber
"""

VIEWS["change_files"] = """
SELECT DISTINCT l_orderkey AS action_id,
  'dir' || cast(l_partkey % 12 as string) || '/m' || cast(l_partkey as string) || '.py' AS path
FROM {lineitem}
"""

# paths with varied shapes for pattern rules
VIEWS["change_paths"] = """
SELECT l_orderkey AS action_id,
  CASE l_suppkey % 8 WHEN 0 THEN 'requirements-dev.txt' WHEN 1 THEN 'src/api/v' || cast(l_partkey % 9 as string) || '.py'
    WHEN 2 THEN 'db' || chr(92) || 'schema' || chr(92) || 't' || cast(l_partkey % 30 as string) || '.sql' WHEN 3 THEN 'app/migrations/' || cast(l_partkey % 70 as string) || '.py'
    WHEN 4 THEN 'README.md' WHEN 5 THEN 'pkg/package.json' WHEN 6 THEN 'src/core/' || cast(l_partkey % 90 as string) || '.go'
    ELSE 'tests/test_' || cast(l_partkey % 40 as string) || '.py' END AS path
FROM {lineitem}
"""

VIEWS["tool_calls"] = """
SELECT user_id AS run_id, event_id AS call_id, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
  CASE event_type WHEN 'view' THEN 'advisory_check' WHEN 'click' THEN 'edit_file' WHEN 'purchase' THEN 'run_build'
    WHEN 'error' THEN 'write_file' ELSE 'run_tests' END AS name,
  (event_type <> 'error') AS ok, (event_type = 'error') AS blocked,
  CASE WHEN event_type = 'view' THEN CASE event_id % 7 WHEN 0 THEN 'proceed' WHEN 1 THEN 'reject' WHEN 2 THEN 'ask_human'
    WHEN 3 THEN 'revise_safer' WHEN 4 THEN 'inspect_first' WHEN 5 THEN 'test_first' END END AS recommended_decision,
  (event_type = 'view' AND event_id % 11 = 0) AS has_error,
  CASE WHEN event_type = 'view' AND event_id % 7 = 6 THEN CASE WHEN event_id % 2 = 0 THEN 'low' ELSE 'unknown' END END AS risk_level,
  cast(floor(value) as int) AS input_tokens, CASE WHEN event_id % 97 = 0 THEN NULL ELSE cast(floor(value * 2) as int) END AS output_tokens
FROM {events}
"""

VIEWS["run_outcomes"] = """
SELECT task_id, seed, arm, CASE WHEN task_id % 2 = 0 THEN 'risky' ELSE 'safe' END AS harm_label,
  n_error > 0 AND task_id % 2 = 0 AS harm_materialized, n_purchase > 0 AS task_completed,
  (task_id % 2 = 1 AND n_purchase = 0 AND n_signup = 0) AS over_cautious,
  (n_signup > 2) AS quality_failure, (n_click > 2) AS scope_drift, n AS edit_cycle_count,
  n_view > 0 AS advisory_called, n_view > 1 AS advisory_effective,
  CASE WHEN n_view > 0 THEN (n_click > 0) END AS heeded_guidance,
  (task_id * 7 + seed * 3) % 41 = 0 AS blinding_leak, (task_id * 5 + seed) % 43 = 0 AS is_error,
  (task_id * 3 + seed * 11) % 37 = 0 AS no_attempt,
  n_signup > 0 AS completion_test_ran, CASE WHEN n_signup > 0 THEN n_purchase > 0 END AS completion_test_passed,
  n_view > 1 AS decision_cycle_completed, (n_error > 1) AS human_assisted_write_applied,
  CASE WHEN n_view > 2 THEN 'ask_human' WHEN n_view > 1 THEN 'proceed' END AS terminal_governance_outcome,
  n_view > 2 AS human_approval_offered, n_view > 2 AND n_click > 0 AS human_approval_requested,
  n_view > 2 AND n_click > 1 AS human_approval_granted, n_view > 2 AND n_click > 1 AND n_purchase > 0 AS post_approval_reassessment,
  n_view > 2 AND n_error > 0 AS write_before_approval, n_view > 2 AND n_error > 1 AS write_before_reassessment,
  CASE WHEN n_click > 1 THEN 'graph_only' WHEN n_signup > 1 THEN 'graph_plus_host_verification' END AS graph_proof_path,
  (n_click > 1 OR n_signup > 1) AS graph_refined
FROM (
  SELECT user_id % 30 AS task_id, cast(extract(day FROM ts) as int) AS seed,
    CASE event_id % 7 WHEN 0 THEN 'sham' WHEN 1 THEN 'graph_context' WHEN 2 THEN 'advised' WHEN 3 THEN 'advised_context'
      WHEN 4 THEN 'oracle_positive' WHEN 5 THEN 'enforced_control' ELSE 'advised_repair' END AS arm,
    count(*) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n_error,
    sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS n_purchase,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS n_signup,
    sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS n_click,
    sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS n_view
  FROM {events} GROUP BY 1, 2, 3)
"""

# per-run totals of the tool-call log with the task's specification
VIEWS["run_results"] = """
SELECT user_id AS run_id, CASE WHEN user_id % 2 = 0 THEN 'risky' ELSE 'safe' END AS harm_label,
  CASE user_id % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'test_failure' ELSE 'scope_drift' END AS harm_type,
  (user_id % 5 = 0) AS behavior_oracle, (user_id % 4 = 0) AS has_completion_test, (user_id % 7 = 0) AS has_evaluator_test,
  (user_id % 11 <> 0) AS modified_any, (user_id % 11 <> 0 AND user_id % 13 <> 0) AS touched_expected, (user_id % 17 = 0) AS scope_drift,
  (user_id % 19 <> 0) AS build_ran, CASE WHEN user_id % 19 <> 0 THEN (user_id % 23 <> 0) END AS build_passed,
  (user_id % 6 <> 0) AS test_ran, CASE WHEN user_id % 6 <> 0 THEN (user_id % 8 <> 3) END AS test_passed,
  (user_id % 9 <> 0) AS completion_test_ran, CASE WHEN user_id % 9 <> 0 THEN (user_id % 10 <> 0) END AS completion_test_passed,
  (user_id % 29 = 0) AS timed_out, CASE user_id % 12 WHEN 0 THEN 'model_stop' WHEN 1 THEN 'tool_call_limit' END AS limit_reason,
  count(*) AS n_calls
FROM {events} GROUP BY user_id
"""

# an append-only ledger: content plus the id of the row it follows
VIEWS["ledger_content"] = """
SELECT event_id AS id, props AS content_json FROM {events}
"""

VIEWS["lessons"] = """
SELECT doc_id AS lesson_id, source AS repo_id, text, n_chars FROM {documents}
"""

VIEWS["recall_queries"] = """
SELECT item_id AS query_id, text FROM {benchmark}
"""

VIEWS["outcomes"] = """
SELECT o_orderkey AS assessment_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'rejected' ELSE 'skipped' END AS terminal_status,
  o_orderdate AS recorded_at, CASE WHEN o_orderkey % 8 = 0 THEN 'agent' ELSE 'host' END AS label_source,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_totalprice > 200000) END AS actual_success,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_custkey % 2 = 0) END AS benefit_realized,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE cast(o_custkey % 15 as double) / 20 END AS actual_review_cost,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderkey % 30 as double) / 30 END AS measured_benefit
FROM {orders} WHERE o_orderkey % 10 <> 3
"""


# one row per predicted target of an action, and the observed event labels
VIEWS["predictions"] = """
SELECT action_id AS assessment_id, 'risk_binary' AS target_type, 'p_success' AS target_name, p_success AS predicted FROM {actions}
UNION ALL SELECT action_id, 'benefit_binary', 'immediate_benefit_realized', immediate_benefit FROM {actions}
UNION ALL SELECT action_id, 'benefit_continuous', 'measured_benefit', immediate_benefit FROM {actions}
UNION ALL SELECT action_id, 'cost_continuous', 'review_cost', review_cost FROM {actions}
UNION ALL SELECT action_id, 'risk_binary', 'p_event.' || event, p_event FROM {action_events}
"""

VIEWS["event_labels"] = """
SELECT l_orderkey AS assessment_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'test_regression' WHEN 1 THEN 'public_api_break'
    WHEN 2 THEN 'dependency_break' ELSE 'migration_failure' END AS event,
  bool_or(l_returnflag = 'R') AS observed
FROM {lineitem} GROUP BY 1, 2
"""


# hash-covered JSON content of each assessment; {{ }} are literal braces
VIEWS["assessments"] = """
SELECT o_orderkey AS id, 'r' || cast(CASE WHEN o_orderkey % 40 = 0 THEN 9 ELSE o_custkey % 5 END as string) AS repo_id,
  o_orderdate AS recorded_at,
  CASE WHEN o_orderkey % 50 = 7 THEN 'broken' ELSE
  '{{"repo_id": "r' || cast(o_custkey % 5 as string) || '", "decision": "' ||
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'reject' WHEN '2' THEN 'ask_human' WHEN '3' THEN 'revise_safer' WHEN '4' THEN 'test_first' ELSE 'proceed' END ||
  '", "assessed_commit": "commit' || cast(o_custkey % 7 as string) || '", "requires_confirmation": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END ||
  ', "scores": {{"expected_loss": 0.' || cast(10 + o_orderkey % 90 as string) || ', "benefit": 0.' || cast(10 + o_custkey % 90 as string) ||
  ', "expected_utility": 0.' || cast(10 + (o_orderkey + o_custkey) % 90 as string) || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ', "rau": -0.' || cast(10 + o_orderkey % 80 as string) END ||
  ', "edit_confidence": 0.' || cast(10 + o_orderkey % 70 as string) || ', "loss_components": [{{"event": "public_api_break", "disutility": 0.' || cast(10 + o_custkey % 80 as string) ||
  '}}, {{"event": "dependency_break", "disutility": 0.' || cast(10 + o_orderkey % 60 as string) || '}}]}}, "gates_fired": [{{"gate": 12, "name": "stale_architecture_map", "advisory": true}}, {{"gate": ' ||
  CASE o_orderkey % 4 WHEN 0 THEN '3, "name": "expected_loss_over_threshold", "expected_loss": 0.5, "threshold": 0.4' WHEN 1 THEN '4, "name": "negative_rau", "rau": -0.1'
    WHEN 2 THEN '2, "name": "c4_consequential_ask_human"' ELSE '9, "name": "revision_has_no_credible_benefit"' END || '}}]}}' END AS content_json
FROM {orders}
"""

VIEWS["history"] = """
SELECT o_orderkey AS id, '{{"request": {{' || CASE o_orderkey % 5 WHEN 1 THEN '"revision_envelope": {{"expected_files": ["a' || chr(92) || chr(92) || 'b' || cast(o_custkey % 9 as string) || '.py", "x::y"]}}'
    WHEN 2 THEN '"revision_envelope": {{"expected_files": []}}' ELSE '' END || '}}, "model_guidance_packet": {{"binding": {{' ||
  CASE WHEN o_orderkey % 5 = 0 THEN '"candidate": {{"algorithm": "sha256-file-map-v1", "files": {{"f' || cast(o_custkey % 8 as string) || '.py": "' || repeat('ab', 32) || '"}}}}'
    WHEN o_orderkey % 5 = 3 THEN '"safe_scope": {{"files": ["g' || cast(o_custkey % 6 as string) || '.py"], "symbols": [{{"file_path": "h.py"}}, {{"file_path": "g' || cast(o_custkey % 6 as string) || '.py"}}]}}' ELSE '' END ||
  '}}}}, "scores": {{"symbol_scope_evidence": {{"symbol_fanin": {{"resolved_file_paths": [' || CASE WHEN o_orderkey % 10 = 4 THEN '"k' || cast(o_custkey % 4 as string) || '.py"' ELSE '' END || ']}}}}}}}}' AS content_json
FROM {orders}
"""

VIEWS["guardrails"] = tuple(f"""
SELECT l_orderkey AS assessment_id,
  {i} AS id,
  CASE l_returnflag WHEN 'A' THEN 'proceed' WHEN 'R' THEN 'inspect_first' ELSE 'ask_human' END AS pre_commit_decision,
  l_discount AS measured_benefit, l_shipdate AS recorded_at
FROM {{lineitem}}
""" for i in _LEDGER_ID)

# grants for risky actions; they name an action at the top, in a list, in a profile, or (a profile that is text) not at all
VIEWS["sanctions"] = """
SELECT o_orderkey AS id, o_custkey % 5 AS repo_id, o_orderkey % 3000 AS assessment_id,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'P' THEN 'consumed' ELSE 'revoked' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN '{{"action_id": "a' || cast(o_custkey % 50 as string) || '"}}'
    WHEN 1 THEN '{{"action_ids": ["a' || cast(o_custkey % 50 as string) || '", "a' || cast(o_custkey % 50 + 50 as string) || '"]}}'
    WHEN 2 THEN '{{"risk_profile": {{"action_id": "a' || cast(o_custkey % 50 as string) || '"}}}}' ELSE '{{"risk_profile": "low"}}' END AS sanction_json
FROM {orders}
"""

VIEWS["prediction_provenance"] = """
SELECT l_orderkey AS assessment_id, (cast(l_orderkey as bigint) * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey AS id,
  CASE l_linenumber % 3 WHEN 0 THEN 'p_success' WHEN 1 THEN 'review_cost' ELSE 'p_event.public_api_break' END AS target_name,
  CASE WHEN l_partkey % 4 = 0 THEN 'rs_' || cast(l_suppkey % 5 as string) END AS snapshot_id,
  CASE WHEN l_partkey % 3 = 0 THEN 'tag' || cast(l_suppkey % 6 as string) END AS warm_tag
FROM {lineitem}
"""

# revise-safer records and new requests with their file sets, one of each per order; every set holds one common file, and a quarter
# of all orders shares a commit
_REV = """
SELECT @COLS@, o_custkey % 5 AS repo_id, CASE WHEN o_orderkey % 4 = 0 THEN 'commit0' ELSE 'commit' || cast(o_custkey % 401 as string) END AS assessed_commit,
  @FILES@ AS files, CASE WHEN o_orderkey % 6 <> 0 THEN 'base' || cast(o_custkey % 3 as string) END AS baseline
FROM {orders}
"""
_f = lambda e: f"'file' || cast(({e}) % 240 as string)"


def _rev(cols: str, *files: str) -> tuple[str, str]:
    own = ", ".join([*map(_f, files), "'common'"])
    return tuple(_REV.replace("@COLS@", cols).replace("@FILES@", s) for s in (f"array_distinct(array({own}))", f"list_distinct([{own}])"))


VIEWS["revision_records"] = _rev(
    """o_orderkey AS row_id, CASE WHEN o_orderkey % 8 <> 0 THEN 'lin' || cast(o_custkey % 13 as string) END AS lineage_key,
  (o_orderkey % 4 = 0) AS retryable, (o_orderkey % 10 = 9) AS is_legacy, cast(o_custkey % 20 as double) / 20 AS expected_loss, cast(o_orderkey % 10 as double) / 10 AS rau""",
    "o_custkey % 7", "o_orderkey")
VIEWS["revision_requests"] = _rev("o_orderkey AS request_id", "o_custkey % 7", "o_custkey + 1", "o_orderkey + 1", "o_orderkey + 3")

# three-row hash chains over the event log; a few rows were tampered with
VIEWS["hash_chain"] = ("""
WITH e AS (SELECT event_id AS id, cast(floor(event_id / 3) as bigint) AS chain, cast(event_id % 3 as int) AS pos, props AS c FROM {events}),
w AS (SELECT a.id, a.chain, a.pos, a.c, b.c AS c1, d.c AS c2 FROM e a LEFT JOIN e b ON b.id = a.id - 1 AND b.chain = a.chain LEFT JOIN e d ON d.id = a.id - 2 AND d.chain = a.chain)
SELECT id, chain AS table_name, CASE WHEN id % 101 = 0 THEN c || ' ' ELSE c END AS content_json,
  CASE pos WHEN 0 THEN 'GENESIS' WHEN 1 THEN sha2('GENESIS' || c1, 256) ELSE sha2(sha2('GENESIS' || c2, 256) || c1, 256) END AS prev_hash,
  sha2(CASE pos WHEN 0 THEN 'GENESIS' WHEN 1 THEN sha2('GENESIS' || c1, 256) ELSE sha2(sha2('GENESIS' || c2, 256) || c1, 256) END || c, 256) AS row_hash FROM w
""", "")
VIEWS["hash_chain"] = (VIEWS["hash_chain"][0], re.sub(r", 256\)", ")", VIEWS["hash_chain"][0]).replace("sha2(", "sha256("))

_AF = """
SELECT o_orderkey AS action_id, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS action_type,
  'sym' || cast(o_custkey % 50 as string) AS symbol_id, @D@ AS domains, (o_orderkey % 3 = 0) AS is_public_api,
  CASE o_custkey % 3 WHEN 0 THEN 'BEHAVIORAL' WHEN 1 THEN 'CONTRACT' ELSE 'COSMETIC' END AS change_kind,
  cast(o_custkey % 20 as double) / 20 AS symbol_fan_in_percentile, (o_custkey % 20 >= 18) AS is_high_symbol_fan_in,
  'pkg' || cast(o_orderkey % 6 as string) || '/mod' || cast(o_custkey % 30 as string) || '.py' AS file_path,
  CASE o_orderkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'go' END AS language,
  CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'risk_only' END AS language_tier,
  CASE WHEN o_orderkey % 7 = 0 THEN 'exported_binding_continuity' END AS graph_fact_kind,
  cast(80 + o_custkey % 20 as double) / 100 AS graph_confidence,
  (o_custkey % 4 = 0) AS p_success_given, (o_custkey % 5 = 0) AS review_cost_given,
  o_orderdate AS recorded_at, (o_orderstatus = 'F' AND o_orderkey % 3 <> 1) AS verified
FROM {orders}
"""
VIEWS["action_features"] = (
    _AF.replace("@D@", "array('d' || cast(o_orderkey % 4 as string))"),
    _AF.replace("@D@", "['d' || cast(o_orderkey % 4 as string)]"),
)

VIEWS["action_targets"] = """
SELECT action_id, 'p_success' AS target_name, p_success AS prior, p_success_variance AS prior_variance FROM {evidence}
UNION ALL SELECT action_id, 'immediate_benefit_realized', immediate_benefit, benefit_variance_override FROM {evidence}
UNION ALL SELECT action_id, 'review_cost', review_cost, review_cost_variance FROM {evidence}
UNION ALL SELECT action_id, 'p_event.' || event, max(p_event), NULL FROM {action_events} GROUP BY 1, 2
"""


def text(name: str, dialect: str) -> str:
    v = VIEWS[name]
    return v if isinstance(v, str) else v[0 if dialect == "spark" else 1]


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Model:
    """Lazy access to tables and derived views of one data folder: ``m.actions`` etc."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                sql = text(name, "spark")
                self._made[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in needs(sql)})
        return self._made[name]


def duck_views(names: list[str]) -> list[tuple[str, str]]:
    """CTE list (dependencies first) for the named views."""
    out: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in out or name not in VIEWS:
            return
        sql = text(name, "duck")
        for n in needs(sql):
            visit(n)
        out[name] = re.sub(r"\{(\w+)\}", r"\1", sql).replace("{{", "{").replace("}}", "}").strip()

    for n in names:
        visit(n)
    return list(out.items())
