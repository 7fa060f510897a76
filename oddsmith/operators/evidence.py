"""Evidence operators: trust, path rules, injected risk events, change classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith import constants as K
from oddsmith.functions.columns import clamp, col, finite, lookup, matches_any_glob, matches_glob, posix, top_domain


def trusted() -> Column:
    """Fresh, unambiguous and parse-clean graph evidence."""
    return (
        (F.col("graph_freshness") == "fresh")
        & F.col("resolution_method").isin("location", "name_fallback")
        & (F.col("graph_file_error_count") == 0)
    )


def impact_percentile() -> Column:
    """Strongest reach percentile; each channel counts only with support of its own."""
    pick = lambda n, p: F.when(F.col(n) > 0, F.col(p)).otherwise(0.0)
    return F.greatest(
        pick("symbol_caller_count", "symbol_fan_in_percentile"),
        pick("modify_impact_count", "modify_impact_percentile"),
        pick("modify_transitive_impact_count", "modify_transitive_impact_percentile"),
    )


def future_exposure(cap: float = 1.0) -> Column:
    bound = max(0.0, min(1.0, cap))
    return F.when(trusted(), clamp(impact_percentile(), 0.0, bound)).otherwise(0.0)


def derived_visibility() -> Column:
    """Fill a missing visibility from the export flag where the language means it."""
    v = F.nullif(F.col("visibility"), F.lit(""))
    from_flag = F.when(
        F.col("language").isin(*K.EXPORT_LANGUAGES) & F.col("is_exported").isNotNull(),
        F.when(F.col("is_exported") != 0, "exported").otherwise("unexported"),
    )
    return F.coalesce(v, from_flag)


# --- path rules ------------------------------------------------------------------------------------


def criticality_from_paths(paths: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Highest stage among the glob rules any path of the action matches.

    ``rules`` is configuration, so it is compiled into one expression: no join at all.
    """
    hits = F.array_compact(F.array(*[F.when(matches_glob("path", g), F.lit(s)) for g, s in rules]))
    return paths.groupBy("action_id").agg(F.max(F.array_max(hits)).alias("config_stage"))


def raise_criticality(actions: DataFrame, config: DataFrame) -> DataFrame:
    """Configuration may raise a stage, never lower it."""
    return actions.join(config, "action_id", "left").withColumn(
        "criticality_stage",
        F.greatest("criticality_stage", F.coalesce("config_stage", "criticality_stage")),
    )


def policy_violations(paths: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Violated rules per action, in rule order."""
    flags = [F.bool_or(matches_glob("path", g)).alias(f"r{i}") for i, (g, _) in enumerate(rules)]
    hit = F.array_compact(F.array(*[F.when(F.col(f"r{i}"), F.lit(v)) for i, (_, v) in enumerate(rules)]))
    return (
        paths.groupBy("action_id").agg(*flags).select("action_id", hit.alias("violations"))
        .filter(F.size("violations") > 0)
    )


# fixed values: manifest and lock files
DEPENDENCY_FILES = (
    "*requirements*.txt", "pyproject.toml", "poetry.lock", "Pipfile", "Pipfile.lock",
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.mod", "go.sum",
    "Cargo.toml", "Cargo.lock",
)


def change_signals(paths: DataFrame) -> DataFrame:
    low = F.lower(posix("path"))
    base = F.substring_index(posix("path"), "/", -1)
    return paths.groupBy("action_id").agg(
        F.bool_or(matches_any_glob(base, DEPENDENCY_FILES)).alias("dependency_changed"),
        F.bool_or(
            F.endswith(low, F.lit(".sql")) | F.contains(low, F.lit("/schema")) | F.startswith(low, F.lit("schema/"))
        ).alias("schema_changed"),
        F.bool_or(F.contains(low, F.lit("migration"))).alias("migration_changed"),
    )


# --- change classification --------------------------------------------------------------------------

SIDE_EFFECT_FLAGS = ("payment_api_changed", "db_write_changed", "migration_changed", "external_side_effect_changed")
CONTRACT_FLAGS = (
    "identity_replacement_suspected", "signature_changed", "return_shape_changed", "visibility_changed",
    "abstract_contract_member_changed", "abstract_member_changed",
)


def change_kind(columns: list[str]) -> Column:
    """First matching rule names the kind of one changed symbol; absent flags are false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in columns else F.lit(False)
    anyof = lambda cs: reduce(lambda a, b: a | b, [flag(c) for c in cs])
    exported = F.coalesce(F.col("visibility").isin("exported", "public_api"), F.lit(False))
    return (
        F.when(anyof(SIDE_EFFECT_FLAGS), "SIDE_EFFECT")
        .when(anyof(CONTRACT_FLAGS) | (exported & flag("body_changed")), "CONTRACT")
        .when(flag("body_changed") | flag("control_flow_changed"), "BEHAVIORAL")
        .when(flag("directive_comment_changed"), "DIRECTIVE")
        .when(flag("test_only"), "TEST_ONLY")
        .otherwise("COSMETIC")
    )


def diff_summary(symbols: DataFrame, by: str, order: str, fan_in_threshold: float = 0.90) -> DataFrame:
    """Worst change kind of an action, its visibility, and why it is consequential."""
    cols = symbols.columns
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in cols else F.lit(False)
    kind = change_kind(cols)
    fan = F.coalesce(F.col("callers_percentile"), F.lit(0.0)) if "callers_percentile" in cols else F.lit(0.0)
    consequential_kind = F.col("kind").isin(*K.CONSEQUENTIAL_KINDS)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("visibility").isin("exported", "public_api"), F.concat(F.lit("visibility="), "visibility")),
            F.when(fan >= fan_in_threshold, F.lit(f"callers_percentile>={fan_in_threshold}")),
            F.when(flag("transitive_reaches_consequence_symbol"), F.lit("transitive_reaches_consequence_symbol")),
            *[F.when(flag(c), F.lit(f"{c}=true")) for c in
              ("external_side_effect_changed", "db_write_changed", "payment_api_changed", "migration_changed")],
        )
    )
    rows = symbols.withColumn("kind", kind).withColumns(
        {
            "sev": lookup(K.CHANGE_SEVERITY, "kind"),
            "why": F.when(consequential_kind, reasons).otherwise(F.array().cast("array<string>")),
        }
    )
    # distinct reasons are at most a handful of fixed strings, so a set per action is small
    return rows.groupBy(by).agg(
        F.max_by("kind", "sev").alias("max_change_kind"),
        F.max_by(F.coalesce("visibility", F.lit("unknown")), F.struct(F.col("sev"), -F.col(order))).alias("visibility"),
        F.count(F.lit(1)).alias("changed_symbols"),
        F.bool_or(F.size("why") > 0).alias("consequential_symbol_changed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("why")))).alias("consequence_reason"),
    )


def symbol_rows(owners: DataFrame, diff: DataFrame) -> DataFrame:
    """One coarse change row per resolved owner, enriched only by a unique identity match."""
    per = owners.groupBy("action_id").agg(F.count(F.lit(1)).alias("_owners"))
    changed = diff.filter(
        (F.col("operation") == "modified")
        & reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in
                 ("signature_changed", "return_type_changed", "visibility_changed", "is_abstract_changed")])
    )
    keyed = changed.groupBy("file_path", "qualified_name").agg(
        F.count(F.lit(1)).alias("_hits"),
        *[F.max(c).alias(f"d_{c}") for c in ("signature_changed", "return_type_changed", "visibility_changed", "is_abstract_changed")],
    ).filter("_hits = 1").drop("_hits")
    joined = owners.withColumn("file_path", posix("file_path")).join(per, "action_id").join(
        keyed, ["file_path", "qualified_name"], "left")
    only = F.col("_owners") == 1
    pick = lambda c: F.coalesce(F.when(only, F.col(f"d_{c}")), F.lit(False))
    return joined.select(
        "action_id", F.col("qualified_name").alias("symbol_id"), F.lit(True).alias("body_changed"),
        F.when(F.col("is_contract"), "exported").otherwise("internal").alias("visibility"),
        "callers_percentile",
        pick("signature_changed").alias("signature_changed"),
        pick("return_type_changed").alias("return_shape_changed"),
        pick("visibility_changed").alias("visibility_changed"),
        pick("is_abstract_changed").alias("abstract_member_changed"),
    )


# --- injected events ------------------------------------------------------------------------------------

_P_CAP = 0.45


def modify_event(df: DataFrame) -> DataFrame:
    """The single dominant event an ordinary edit of an important symbol adds; no row otherwise."""
    public = F.col("visibility").isin("public", "public_api", "exported")
    contract = F.col("is_exported_contract") | F.col("is_abstract_contract")
    kind = F.col("max_change_kind")
    kind = F.when(kind.isin(*K.CHANGE_SEVERITY), kind).otherwise("UNKNOWN")
    contractish = kind.isin("CONTRACT", "SIDE_EFFECT")
    unknown = (kind == "UNKNOWN") | F.col("structure_tier").isin(*K.UNCERTAIN_TIERS)
    reach = impact_percentile()
    high = reach >= 0.90
    span, n = F.col("max_owner_span_lines"), F.col("resolved_symbol_count")
    storage = F.col("is_schema_change") | F.col("is_migration")
    consequential = F.col("consequential_symbol_changed")
    important = (high | (span >= 60) | (n > 1)) & (contractish | unknown | consequential | storage)
    fires = important | (public & consequential) | (public & contractish) | (contract & contractish & high)

    base = F.when(public | contract, 0.12).otherwise(0.08)
    base = F.when(storage, F.greatest(base, F.lit(0.18))).otherwise(base)
    base = base + F.when(F.col("domain_entrypoint") | (F.col("anchor_score") > 0), 0.04).otherwise(0.0)
    base = base + F.when(span >= 120, 0.10).when(span >= 60, 0.06).otherwise(0.0)
    base = base + F.when(
        F.col("owner_kind").isin("class", "interface", "trait", "protocol", "component", "route"), 0.03
    ).otherwise(0.0)
    many = F.when(n > 1, F.least(F.lit(0.05), 0.02 * (n - 1))).otherwise(0.0)
    if "breadth_bonus" in df.columns:
        many = F.when(F.col("owner_count") > 0, F.col("breadth_bonus")).otherwise(many)
    base = base + many + F.least(F.lit(0.06), 0.01 * F.col("outgoing_edge_total"))
    # the fixed parts are decimals: their sum is rounded back to one, so that equal probabilities compare as equal
    p = F.least(F.lit(_P_CAP), F.round(base, 12) + F.least(F.lit(0.28), reach * 28 / 90))
    event = F.when(storage, "api_contract_break").when(public | contract, "public_api_break").otherwise("dependency_break")
    return df.filter(F.col("has_fanin") & (F.col("file_operation_kind") == "NONE") & trusted() & fires).select(
        "action_id",
        event.alias("event"),
        p.alias("p_event"),
        F.when(event == "dependency_break", 0.60).otherwise(0.70).alias("elicited_disutility"),
        F.lit("graph_modify_risk").alias("risk_source"),
    )


def destructive_event(df: DataFrame) -> DataFrame:
    """Event of a delete/rename/move: floor by context plus a fan-in bonus, capped."""
    storage = F.col("is_migration") | F.col("is_schema_change")
    base = F.greatest(
        F.lit(0.03),
        F.when(F.col("domain_entrypoint"), 0.15).otherwise(0.0),
        F.when(storage, 0.20).otherwise(0.0),
        F.when(F.col("god_node_score") >= 0.75, 0.10).otherwise(0.0),
        F.when(F.col("anchor_score") > 0, 0.08).otherwise(0.0),
    )
    bonus = F.when(F.col("rollup_method") == "unresolved", 0.0).otherwise(
        F.least(F.lit(0.25), F.greatest(F.lit(0.0), F.col("rollup_percentile")) * (0.25 / 0.90))
    )
    op = F.col("file_operation_kind")
    public = F.col("visibility").isin("public_api", "exported")
    event = F.when(op.isin("RENAME", "MOVE"), "path_migration_break").when(public, "public_api_break").otherwise("dependency_break")
    return df.filter(op.isin("DELETE", "RENAME", "MOVE")).select(
        "action_id",
        event.alias("event"),
        F.least(F.lit(_P_CAP), base + bonus + F.col("breadth_bonus")).alias("p_event"),
        lookup({"path_migration_break": 0.55, "public_api_break": 0.70, "dependency_break": 0.60}, event).alias("elicited_disutility"),
        F.lit("request").alias("risk_source"),
    )


def merge_events(existing: DataFrame, injected: DataFrame) -> DataFrame:
    """Fold injected events into same-named ones: stronger values win, ownership only if dominant."""
    e = existing.groupBy("action_id", "event").agg(
        F.max("p_event").alias("e_p"), F.max("elicited_disutility").alias("e_d"), F.min("risk_source").alias("e_s"))
    i = injected.groupBy("action_id", "event").agg(
        F.max("p_event").alias("i_p"), F.max("elicited_disutility").alias("i_d"), F.min("risk_source").alias("i_s"))
    both = e.join(i, ["action_id", "event"], "full_outer")
    dominant = (
        (F.col("i_p") >= F.col("e_p")) & (F.col("i_d") >= F.col("e_d"))
        & ((F.col("i_p") > F.col("e_p")) | (F.col("i_d") > F.col("e_d")))
    )
    met = F.col("e_p").isNotNull() & F.col("i_p").isNotNull()
    return both.select(
        "action_id",
        "event",
        F.greatest("e_p", "i_p").alias("p_event"),
        F.greatest("e_d", "i_d").alias("elicited_disutility"),
        F.when(met & ~dominant, None).when(F.col("i_p").isNotNull(), F.col("i_s")).otherwise(F.col("e_s")).alias("risk_source"),
        F.when(met & dominant, F.col("e_p")).alias("independent_floor"),
    )


def refine_probabilities(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Lower an event probability where exactly one structural fact fits exactly one event.

    The key is (action, event, source, owner set); a key that repeats on either side, or a
    fact of unproven kind or confidence, changes nothing.
    """
    key = ["action_id", "event", "risk_source", "owner_key"]
    unique = facts.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_f"), F.max("confidence").alias("confidence"), F.max("fact_kind").alias("fact_kind"))
    counts = events.groupBy(*key).agg(F.count(F.lit(1)).alias("_e"))
    c = F.col("confidence")
    fits = (
        (F.col("_f") == 1) & (F.col("_e") == 1) & (F.col("owner_key") != "")
        & (F.col("fact_kind") == "exported_binding_continuity")
        & (F.col("event") == "public_api_break") & (F.col("risk_source") == "graph_modify_risk")
        & finite(c) & c.between(0.90, 1.0)
    )
    p, own = F.col("p_event"), F.col("independent_floor")
    own = F.when(finite(own) & (own >= 0), own).otherwise(0.0)
    floor = F.greatest(F.lit(0.05), own)
    scaled = p * (1.0 - (1.0 - 0.35) * c)
    revised = F.least(p, F.greatest(floor, scaled))
    return events.join(counts, key, "left").join(unique, key, "left").select(
        *events.columns,
        F.when(fits, revised).otherwise(p).alias("revised_probability"),
        F.when(~F.coalesce(fits, F.lit(False)), None)
        .when(revised == p, "original_probability")
        .when((floor >= scaled) & (own > 0.05), "independent_probability_floor")
        .when(floor >= scaled, "structural_probability_floor")
        .otherwise("probability_multiplier").alias("binding_term"),
    )


def merge_evidence(actions: DataFrame, events: DataFrame, security: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append security events not already present; raise criticality; penalise quality."""
    from oddsmith.operators.scoring import penalized

    extra = security.join(events.select("action_id", "event"), ["action_id", "event"], "left_anti")
    merged = events.unionByName(extra, allowMissingColumns=True)
    pen = F.col("quality_penalty")
    acts = raise_criticality(actions, config).withColumn(
        "evidence_quality", F.when(pen > 0, penalized("evidence_quality", pen)).otherwise(F.col("evidence_quality")))
    return acts, merged


# --- multi-owner evidence -----------------------------------------------------------------------------------


def aggregate_owners(owners: DataFrame, reached: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per candidate from its owners, their reached nodes and its declared files."""
    exposure = clamp(F.greatest("fan_in_percentile", "impact_percentile", "transitive_impact_percentile"), 0.0, 1.0)
    size = reached.groupBy("action_id", "owner_id").agg(F.countDistinct("node_id").alias("reach"))
    union = reached.groupBy("action_id").agg(F.countDistinct("node_id").alias("impacted_node_count"))
    weighted = owners.join(size, ["action_id", "owner_id"], "left").withColumns(
        {"exposure": exposure, "w": F.coalesce(F.col("reach").cast("double"), F.lit(1.0))})
    per = weighted.groupBy("action_id").agg(
        F.countDistinct("owner_id").alias("owner_count"),
        F.countDistinct("language").alias("language_count"),
        F.count_if("is_public_contract").alias("public_contract_count"),
        F.max("exposure").alias("max_owner_exposure"),
        (F.sum(F.col("exposure") * F.col("w")) / F.sum("w")).alias("weighted_owner_exposure"),
    )
    files = (
        owners.select("action_id", posix("file_path").alias("file"), F.lit(1).alias("r"))
        .unionByName(expected.select("action_id", posix("file_path").alias("file"), F.lit(0).alias("r")))
        .groupBy("action_id", "file").agg(F.max("r").alias("r"))
    )
    span = files.groupBy("action_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("r").alias("resolved_file_count"),
        F.countDistinct(top_domain("file")).alias("domain_count"),
    )
    log2 = lambda c: F.log2(F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(0))).cast("double"))
    more = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)) - 1)
    breadth = 0.025 * log2("owner_count") + 0.020 * log2("file_count") + 0.010 * more("domain_count") + 0.010 * more("public_contract_count")
    return span.join(per, "action_id", "left").join(union, "action_id", "left").select(
        "action_id",
        "file_count",
        "resolved_file_count",
        "domain_count",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("owner_count", "language_count", "public_contract_count", "impacted_node_count")],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("max_owner_exposure", "weighted_owner_exposure")],
        F.least(F.lit(0.08), breadth).alias("breadth_bonus"),
        (F.col("resolved_file_count") / F.col("file_count")).alias("resolution_coverage"),
    )


def rollup_files(rollups: DataFrame, callers: DataFrame) -> DataFrame:
    """Cumulative roll-up of several destroyed files of one action."""
    ok = F.col("resolution_method") != "unresolved"
    hot = F.struct("percentile", "distinct_callers")
    per = rollups.groupBy("action_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(~ok).alias("unresolved"),
        F.max(F.when(ok, hot)).alias("hot"),
        F.max(F.when(ok, F.col("max_callers"))).alias("max_caller_count"),
        F.max(F.when(ok, F.col("distinct_callers"))).alias("known"),
        F.sum(F.when(ok, F.col("symbol_count"))).alias("symbol_count"),
    )
    union = callers.groupBy("action_id").agg(F.countDistinct("caller_id").alias("callers"))
    n, bad = F.col("file_count"), F.col("unresolved")
    all_bad = n == bad
    return per.join(union, "action_id", "left").select(
        "action_id",
        "file_count",
        F.coalesce("max_caller_count", F.lit(0)).alias("max_caller_count"),
        F.when(all_bad, 0).otherwise(F.greatest("known", F.coalesce("callers", F.lit(0)))).alias("distinct_caller_count"),
        F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"),
        F.coalesce("hot.percentile", F.lit(0.0)).alias("percentile"),
        F.when(all_bad, "unresolved").otherwise("file_location").alias("resolution_method"),
        F.when(bad > 0, F.format_string("%d of %d file rollups unresolved", bad, n)).alias("fallback_reason"),
        F.when(all_bad, 0.0).otherwise(F.least(F.lit(0.08), 0.02 * F.log2(n.cast("double")))).alias("cumulative_breadth_bonus"),
    )


# --- features and languages -----------------------------------------------------------------------------------


def feature_payload() -> Column:
    """Versioned structural feature record of an action with its threshold flags."""
    high = lambda c: F.col(c) >= K.HIGH_PERCENTILE
    return F.struct(
        F.lit(2).alias("schema_version"),
        F.struct(
            F.col("symbol_id"), F.col("file_path"), F.col("action_type"),
            F.col("max_change_kind").alias("change_kind"), F.col("visibility"),
            F.col("visibility").isin("public_api", "exported").alias("is_public_api"),
            F.col("max_change_kind").isin("BEHAVIORAL", "SIDE_EFFECT").alias("body_changed"),
            F.col("max_change_kind").isin("CONTRACT", "SIGNATURE").alias("signature_changed"),
            F.col("file_operation_kind"), F.col("consequential_symbol_changed"),
        ).alias("symbol"),
        F.struct(
            F.col("god_node_score").alias("container_file_fan_in_percentile"),
            high("god_node_score").alias("is_high_container_fan_in"),
            F.col("symbol_fan_in_percentile"),
            high("symbol_fan_in_percentile").alias("is_high_symbol_fan_in"),
            F.col("bridge_centrality"), F.col("cycle_participation"), F.col("domain_entrypoint"),
        ).alias("structural"),
        F.struct(F.array(top_domain("file_path")).alias("matched_domains"), F.col("criticality_stage")).alias("domain"),
        F.struct(F.col("graph_freshness"), F.col("resolution_method")).alias("provenance"),
    )


def language_tier(status="probe_status", n="node_count", sig="signature_ratio", vis="visibility_ratio") -> Column:
    has_vis, has_sig = col(vis) >= 0.5, col(sig) >= 0.5
    return (
        F.when(col(status) != "measured", "unknown")
        .when(col(n) <= 0, "risk_only")
        .when(has_sig & has_vis, "full")
        .when(has_vis, "partial")
        .otherwise("risk_only")
    )


def choose_capability(langs: DataFrame, capability: DataFrame) -> DataFrame:
    """Capability of an action: its single language's measured row, else mixed or unknown."""
    n = F.size("languages")
    one = F.when(n == 1, F.element_at("languages", 1))
    joined = langs.withColumn("language", one).join(capability, "language", "left")
    status = F.when(n == 1, "measured").otherwise("unmeasured")
    out = joined.select(
        "action_id",
        F.when(n == 1, F.col("language")).when(n > 1, "mixed").otherwise("unknown").alias("language"),
        status.alias("probe_status"),
        F.when(n > 1, "multiple resolved languages").when(n == 0, "no resolved language").alias("fallback_reason"),
        F.coalesce("node_count", F.lit(0)).alias("node_count"),
        F.coalesce("signature_ratio", F.lit(0.0)).alias("signature_ratio"),
        F.coalesce("visibility_ratio", F.lit(0.0)).alias("visibility_ratio"),
    ).withColumn("tier", language_tier())
    return out.withColumn("structural_tier_allowed", F.col("tier").isin("full", "partial"))
