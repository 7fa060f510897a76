"""Ordered decision gates and post-edit checks as plain CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith import constants as K
from oddsmith.functions.columns import glob_regex_column, lookup
from oddsmith.operators.evidence import trusted

_DECISIONS = list(K.DECISION_RANK)


def decision_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in _DECISIONS]), (rank + 1).cast("int"))


def sensitive() -> Column:
    return F.col("criticality_stage").isin(*K.SENSITIVE_STAGES)


def trusted_fanin() -> Column:
    return F.col("has_fanin") & trusted()


def large_reach(min_fraction: float = 0.40, min_nodes: int = 50) -> Column:
    """A trusted graph says the edit reaches a large share of a repository worth measuring."""
    f, n = F.col("modify_repo_blast_fraction"), F.col("modify_repo_node_count")
    return trusted_fanin() & (f > 0) & (n >= min_nodes) & (f >= min_fraction)


def graph_required() -> Column:
    return (
        F.col("file_operation_kind").isin("DELETE", "RENAME", "MOVE")
        | F.col("max_change_kind").isin("CONTRACT", "SIDE_EFFECT", "UNKNOWN")
        | F.col("consequential_symbol_changed")
        | F.col("is_migration")
        | F.col("is_schema_change")
    )


def exhausted() -> Column:
    cap = F.least(F.lit(3), F.col("max_revise_attempts"))
    return (cap <= 0) | (F.col("revise_attempt") >= cap)


def verification_holds() -> Column:
    """Passed, complete, and bound to the very patch under assessment."""
    return (
        (F.col("verification_status") == "passed")
        & F.col("all_checks_passed")
        & F.col("proposed_patch").isNotNull()
        & F.col("patch_bound")
    )


def narrowable() -> Column:
    op, kind = F.col("file_operation_kind"), F.col("max_change_kind")
    contract = (
        F.col("has_contract_event")
        & (kind == "CONTRACT")
        & (F.col("consequential_symbol_changed") | (F.col("visibility") == "public_api"))
    )
    graph_only = (
        F.col("proposed_patch").isNotNull() & (op == "NONE") & (F.col("changed_symbol_count") == 0) & (kind == "UNKNOWN")
    )
    return (
        F.when(op.isin("DELETE", "RENAME", "MOVE") | contract, True)
        .when(graph_only, F.col("has_fanin") & (F.col("resolved_symbol_count") > 1))
        .otherwise((F.col("changed_symbol_count") > 1) | (F.col("expected_file_count") > 1))
    )


def may_revise() -> Column:
    """A risky route that is plausibly narrowable before a human is asked."""
    return ~exhausted() & (F.col("benefit") > 0) & ~F.col("has_terminal") & F.col("has_structural") & narrowable()


def revision_outcome() -> Column:
    """approved / ask_human / revise_safer / reject for a revision, NULL for other actions."""
    retry = F.when(exhausted(), "ask_human").otherwise("revise_safer")
    incomplete = ~F.col("origin_available") | (F.col("missing_origin_items") > 0)
    return F.when(
        F.col("is_revision"),
        F.when(incomplete, retry)
        .when(F.col("origin_expected_loss").isNull() | F.col("origin_rau").isNull(), "ask_human")
        .when(F.col("benefit") <= 0, "reject")
        .when(F.col("expected_loss") >= F.col("origin_expected_loss"), "ask_human")
        .when(F.col("rau") < 0, "ask_human")
        .when((F.col("verification_status") != "not_applicable") & ~verification_holds(), retry)
        .otherwise("approved"),
    )


def decide(df: DataFrame, max_sd: float = 0.20) -> DataFrame:
    """First matching gate decides; a missing obligation may downgrade, a sanction may convert."""
    unsure = (
        F.col("consequential_symbol_changed")
        | (F.col("max_change_kind") == "UNKNOWN")
        | F.col("structure_tier").isin(*K.UNCERTAIN_TIERS)
    )
    out = df.withColumns({"_rev": revision_outcome(), "_narrow": may_revise()})
    approved = F.coalesce(F.col("_rev") == "approved", F.lit(False))
    terminal = F.col("_rev").isNotNull() & ~approved
    gate = (
        F.when(F.col("policy_violation"), 1)
        .when((F.col("criticality_stage") == "C4") & unsure, 2)
        .when(terminal, 9)
        .when((F.col("expected_loss") > F.col("effective_threshold")) & ~approved, 3)
        .when((F.col("rau") < 0) & ~approved, 4)
        .when((F.col("utility_sd") > max_sd) & (F.col("expected_utility") > 0) & ~approved, 5)
        .when(F.col("import_cycle_detected") & ~verification_holds(), 16)
        .when(F.col("confidence_band").isin("low", "medium"), 8)
        .when(F.col("arch_freshness") == "stale", 12)
        .when(graph_required() & ~trusted_fanin(), 13)
        .when(large_reach(), 14)
        .otherwise(11)
    )
    g = F.col("_gate")
    provisional = (
        F.when(g == 1, "reject")
        .when(g.isin(2, 5), "ask_human")
        .when(g == 9, F.col("_rev"))
        .when(g.isin(3, 4) & F.col("_narrow"), "revise_safer")
        .when((g == 3) & (F.col("expected_utility") < 0), "reject")
        .when(g.isin(3, 4), "ask_human")
        .when(g == 16, "test_first")
        .when(g == 11, "proceed")
        .otherwise("inspect_first")
    )
    out = out.withColumn("_gate", gate).withColumn("_dec", provisional)
    short = (F.col("_dec") == "proceed") & F.col("obligations_missing")
    out = out.withColumns(
        {"_gate": F.when(short, 15).otherwise(g), "_dec": F.when(short, "ask_human").otherwise(F.col("_dec"))}
    )
    d = F.col("_dec")
    confirm = F.when(g == 1, False).when(d == "ask_human", True).when(g == 11, sensitive()).otherwise(False)
    named = F.contains("sanction_gates", F.concat(F.lit(","), g.cast("string"), F.lit(",")))
    granted = F.col("sanction_valid") & F.col("sanction_controls_satisfied") & named
    confirmed = granted & (g == 11) & (d == "proceed") & sensitive()
    converted = granted & d.isin("ask_human", "reject") & g.isin(*K.CONVERTIBLE_GATES)
    incomplete = converted & F.col("obligations_missing")
    free = confirmed | (converted & ~F.col("obligations_missing"))
    elevated = d.isin("inspect_first", "test_first", "revise_safer") & sensitive() & (g != 1)
    return out.select(
        *df.columns,
        F.when(incomplete, "revise_safer").when(free, "proceed").otherwise(d).alias("recommended_decision"),
        g.alias("fired_gate"),
        (confirmed | converted).alias("sanction_applied"),
        F.when(free | incomplete, False).otherwise(confirm).alias("requires_confirmation"),
        F.when(free, "controlled_high_risk")
        .when(elevated & ~incomplete, "elevated_review")
        .when(sensitive(), "sensitive_context")
        .otherwise("normal").alias("risk_mode"),
    )


def compare_revisions(revisions: DataFrame, origins: DataFrame) -> DataFrame:
    """Each revision against the scores of the action it came from."""
    o = origins.select(
        F.col("action_id").alias("origin_id"),
        *[F.col(c).alias(f"origin_{c}") for c in ("expected_loss", "benefit", "rau")],
    )
    name = (
        F.when(F.col("origin_expected_loss").isNull() | F.col("origin_rau").isNull(), "revision_origin_scores_unavailable")
        .when(F.col("benefit") <= 0, "revision_has_no_credible_benefit")
        .when(F.col("expected_loss") >= F.col("origin_expected_loss"), "revision_risk_not_reduced")
        .when(F.col("rau") < 0, "revision_risk_still_outweighs_benefit")
        .otherwise("revision_risk_benefit_improved")
    )
    return revisions.join(o, "origin_id", "left").withColumn("comparison", name)


def obligations_missing(df: DataFrame) -> DataFrame:
    """Declared files, symbols and checks a candidate has not satisfied."""
    proof = (F.col("verification_status") == "passed") & F.col("patch_bound")
    files = F.transform("required_files", lambda p: F.replace(p, F.lit("\\"), F.lit("/")))
    checks = F.when(
        proof,
        F.filter("required_checks", lambda c: F.lower(F.coalesce(F.element_at(F.col("checks"), c), F.lit(""))) != "passed"),
    ).otherwise(F.col("required_checks"))
    missing = {
        "missing_files": F.array_sort(F.array_except(files, F.col("touched_files"))),
        "missing_symbols": F.array_sort(F.array_except("required_symbols", "changed_symbols")),
        "missing_checks": F.array_sort(checks),
    }
    return df.withColumns(missing).withColumn(
        "incomplete", F.size("missing_files") + F.size("missing_symbols") + F.size("missing_checks") > 0
    )


# fixed values: signals that already have a rule of their own
_DEDICATED = ("dependency_changed", "schema_changed", "migration_changed", "contract_change")


def check_envelope(df: DataFrame) -> DataFrame:
    """Is the final diff inside the approved envelope?  The most severe rule wins."""
    part = lambda e: F.substring_index(e, "::", 1)

    def covered(path):
        def hit(e):
            e = part(e)
            return F.when(
                F.startswith(e, F.lit("glob:")),
                F.regexp_like(path, glob_regex_column(F.regexp_replace(e, "^glob:", ""))),
            ).otherwise(path == e)

        return F.exists("safe_scope_files", hit)

    unexpected = F.filter("changed_files", lambda p: ~covered(p))
    broad = F.col("dependency_changed") | F.col("schema_changed") | F.col("migration_changed")
    fresh = (
        F.when(F.col("assessed_commit").isNull() | F.col("current_head").isNull(), "unknown")
        .when(F.col("assessed_commit") == F.col("current_head"), "fresh")
        .otherwise("stale")
    )
    sev = lambda c: F.coalesce(lookup(K.CHANGE_SEVERITY, c), F.lit(K.CHANGE_SEVERITY["UNKNOWN"]))
    actual = F.col("actual_change_kind")
    mismatch = (actual != "UNKNOWN") & (sev("actual_change_kind") > sev("pre_change_kind"))
    unclassified = (actual == "UNKNOWN") & F.col("reclassification_attempted")
    newly = F.col("actual_consequential") & ~F.col("pre_consequential")
    tier_lost = (F.col("pre_tier") == "codegraph_semantic") & (F.col("actual_tier") != "codegraph_semantic")
    dry_run = F.col("requires_dry_run") & ~F.col("dry_run_present")
    touched = F.filter("risky_scope", lambda e: F.array_contains(F.col("triggered_signals"), e["signal"]))
    entry_rank = lambda e: (
        F.when(e["action"] == "forbidden", 5)
        .when(e["action"] == "avoid_unless_required", F.when(e["necessity"], 0).otherwise(4))
        .when(e["signal"].isin(*_DEDICATED), 0)
        .otherwise(1)
    )
    missing = F.filter("required_checks", lambda c: ~F.map_contains_key("completed_checks", c))
    failed = F.map_filter("completed_checks", lambda k, v: v == "failed")
    rule = lambda cond, decision: F.when(cond, K.DECISION_RANK[decision]).otherwise(0)
    rank = F.greatest(
        rule(fresh != "fresh", "inspect_first"),
        rule(F.size(unexpected) > 0, "inspect_first"),
        rule(broad, "ask_human"),
        rule(mismatch, "ask_human"),
        rule(unclassified | newly | tier_lost | dry_run, "inspect_first"),
        rule(F.size("contract_changes") > 0, "ask_human"),
        F.coalesce(F.array_max(F.transform(touched, entry_rank)), F.lit(0)),
        rule(F.size(missing) > 0, "test_first"),
        rule(F.size(failed) > 0, "ask_human"),
        rule(F.col("policy_forbidden"), "reject"),
    )
    return df.withColumns(
        {
            "evidence_freshness": fresh,
            "unexpected_files": F.size(unexpected),
            "safe_scope_status": F.when((F.size(unexpected) > 0) | broad, "violated").otherwise("ok"),
            "scope_drift": (F.size(unexpected) > 0) | broad | mismatch,
            "symbol_change_mismatch": mismatch,
            "classification_failed": unclassified,
            "newly_consequential": newly,
            "risky_triggered": F.size(touched),
            "missing_checks": F.size(missing),
            "failed_checks": F.size(failed),
            "verify_decision": decision_of(rank),
        }
    )
