"""Fixed values shared by every operator.

They define the scoring vocabulary: changing one changes results.  Values that a
deployment may tune are function parameters whose defaults live here.
"""

# --- fixed values: decision vocabulary, mildest first -------------------------------------
DECISION_RANK = {
    "proceed": 0,
    "inspect_first": 1,
    "test_first": 2,
    "revise_safer": 3,
    "ask_human": 4,
    "reject": 5,
}

# --- fixed values: criticality stage -> cardinal value ------------------------------------
STAGE_VALUE = {"C0": 0.10, "C1": 0.30, "C2": 0.50, "C3": 0.80, "C4": 1.00}
SENSITIVE_STAGES = ("C3", "C4")
LOW_STAGES = ("C0", "C1", "C2")

# --- fixed values: event classes -----------------------------------------------------------
CONSEQUENCE_EVENTS = (
    "public_api_break",
    "security_sensitive_change",
    "external_state_damage",
    "migration_failure",
    "dependency_break",
    "api_contract_break",
    "route_behavior_break",
    "tool_schema_break",
    "response_shape_mismatch",
    "consumer_shape_mismatch",
    "path_migration_break",
)
TERMINAL_EVENTS = (
    "security_sensitive_change",
    "external_state_damage",
    "migration_failure",
)
STRUCTURAL_EVENTS = (
    "public_api_break",
    "dependency_break",
    "api_contract_break",
    "route_behavior_break",
    "tool_schema_break",
    "response_shape_mismatch",
    "consumer_shape_mismatch",
)

# --- fixed values: scoring -----------------------------------------------------------------
LOG_LOSS_EPS = 1e-15
Z_90 = 1.28
Z_95_ONE_SIDED = 1.645
CONFIDENCE_FACTORS = (
    "p_success",
    "evidence_quality",
    "testability",
    "reversibility",
    "source_reliability",
    "scope_control",
)
MIN_CONFIDENCE_FACTOR = 1e-6
COLD_START_VARIANCE = {
    "p_success": 0.04,
    "benefit": 0.01,
    "p_event": 0.0025,
    "disutility": 0.0025,
    "review_cost": 0.01,
    "scenario_variance": 0.0003,
}
LEARNED_VARIANCE_FLOOR_RATIO = 0.10
WARM_VARIANCE_FLOOR_RATIO = 0.20
PROJECTED_BENEFIT_VARIANCE = 0.04
MEASURED_BENEFIT_VARIANCE = 0.0004

# --- fixed values: metric direction (+1 more is better, -1 less is better) -----------------
METRIC_DIRECTION = {
    "complexity_delta": -1,
    "coupling_delta": -1,
    "duplication_delta": -1,
    "api_surface_delta": -1,
    "technical_debt_interest_delta": -1,
    "recurrence_delta": -1,
    "maintainability_index_delta": 1,
    "testability_delta": 1,
    "cohesion_delta": 1,
    "modularity_delta": 1,
    "encapsulation_delta": 1,
    "observability_delta": 1,
    "operability_delta": 1,
    "analyzability_delta": 1,
    "modifiability_delta": 1,
    "reusability_delta": 1,
    "portability_delta": 1,
}

# --- fixed values: change kinds by severity ------------------------------------------------
CHANGE_SEVERITY = {
    "COSMETIC": 0,
    "TEST_ONLY": 1,
    "DIRECTIVE": 2,
    "BEHAVIORAL": 3,
    "UNKNOWN": 4,
    "CONTRACT": 5,
    "SIDE_EFFECT": 6,
}
CONSEQUENTIAL_KINDS = ("BEHAVIORAL", "CONTRACT", "SIDE_EFFECT", "DIRECTIVE", "UNKNOWN")
UNCERTAIN_TIERS = ("codegraph_structural", "codegraph_semantic")

# --- fixed values: calibration and promotion ------------------------------------------------
TARGET_TYPES = ("risk_binary", "benefit_binary", "benefit_continuous", "cost_continuous")
MIN_CALIBRATION_SAMPLES = 100
SCOPE_RANK = {
    "global": 0,
    "action_type": 2,
    "public_api": 3,
    "domain": 4,
    "domain_change_kind": 5,
    "high_symbol_fan_in": 6,
    "domain_high_symbol_fan_in": 7,
    "public_api_domain": 8,
    "symbol": 9,
}
HIGH_PERCENTILE = 0.90
DECAY_STRENGTH = 20.0
MIN_EFFECTIVE_WEIGHT = 0.10
PROBABILITY_CLAMP = (0.01, 0.99)

# --- fixed values: dependency graph vocabulary ---------------------------------------------
FANIN_EDGES = ("calls", "references", "instantiates")
IMPACT_EDGES = ("calls", "references", "instantiates", "implements", "extends")
CALLABLE_KINDS = ("function", "method", "class", "struct", "interface", "trait", "protocol")
OWNER_KINDS = CALLABLE_KINDS + ("component", "route", "namespace", "module")
CONTRACT_CONTAINERS = ("class", "struct", "interface", "trait", "protocol")
CONTAINER_KINDS = CONTRACT_CONTAINERS + ("namespace", "module", "file", "component", "route")
REACH_DEPTH = 3
CONTAINER_DEPTH = 8
EXPORT_LANGUAGES = ("go", "javascript", "jsx", "tsx", "typescript")

# --- fixed values: import graph -------------------------------------------------------------
IMPORT_CONFIDENCE = {
    "static": 0.85,
    "relative": 0.75,
    "wildcard": 0.35,
    "dynamic": 0.15,
    "unknown": 0.10,
}
IMPORT_CONFIDENCE_DEFAULT = 0.10
ANCHOR_MIN_IN_DEGREE = 3
UNCERTAINTY_CAP = 0.25
UNCERTAINTY_WEIGHT = {
    "missing_file": 0.05,
    "parse_error_file": 0.08,
    "unresolved_import": 0.03,
    "dynamic_import": 0.02,
    "wildcard_import": 0.01,
    "repo_dynamic_import": 0.01,
    "repo_wildcard_import": 0.005,
}

# --- fixed values: review gates ---------------------------------------------------------------
CONVERTIBLE_GATES = (2, 3, 4, 9)
REJECT_GATE_NAME = {
    3: "expected_loss_over_threshold",
    4: "negative_rau",
    9: "revision_has_no_credible_benefit",
}
