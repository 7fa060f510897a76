"""Promotion of learned facts: scope derivation, replay gates, coverage and fact rows.

A production row supports up to nine kinds of scope, so rows are exploded once to narrow
(scope, outcome) tuples.  Every gate metric is additive over a scope, which lets the
``global`` scope, holding every row, be aggregated by partials like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddsmith import constants as K
from oddsmith.functions.columns import lookup, with_ranges
from oddsmith.functions.stats import (
    bernoulli_variance, beta_variance, brier, log_loss, rate, sample_variance, wilson_lower,
)
from oddsmith.session import written

SCOPE = ["target_type", "target_name", "scope_kind", "scope_value"]
BY = ["scope"]  #: scopes by number
FOLDS = 10


def scope_array() -> Column:
    """Every scope a row's own features match."""
    item = lambda kind, value: F.struct(F.lit(kind).alias("scope_kind"), value.alias("scope_value"))
    none = F.lit("")
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    public = F.coalesce(F.col("is_public_api"), F.lit(False))
    high = F.coalesce(F.col("symbol_fan_in_percentile") >= K.HIGH_PERCENTILE, F.lit(False))
    single = F.array(
        item("global", none),
        F.when(filled("action_type"), item("action_type", F.col("action_type"))),
        F.when(public, item("public_api", none)),
        F.when(high | F.coalesce(F.col("is_high_symbol_fan_in"), F.lit(False)), item("high_symbol_fan_in", none)),
        F.when(filled("symbol_id"), item("symbol", F.col("symbol_id"))),
    )
    domains = F.coalesce(F.array_distinct("domains"), F.array().cast("array<string>"))

    def per_domain(d):
        return F.array(
            item("domain", d),
            F.when(public, item("public_api_domain", d)),
            F.when(filled("change_kind"), item("domain_change_kind", F.concat(d, F.lit("|"), F.col("change_kind")))),
            F.when(high, item("domain_high_symbol_fan_in", d)),
        )

    return F.array_compact(F.concat(single, F.flatten(F.transform(domains, per_domain))))


def teaches(rows: DataFrame) -> Column:
    """False for candidate-conditioned (graph-refined) rows."""
    return F.coalesce(F.col("refinement_status") != "available", F.lit(True)) if "refinement_status" in rows.columns else F.lit(True)


def explode_scopes(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows × matched scopes; candidate-conditioned (graph-refined) rows never teach a prior."""
    return rows.filter(teaches(rows)).withColumn("_s", F.explode(scope_array())).select(
        "target_type", "target_name", "_s.scope_kind", "_s.scope_value", *keep)


FEATURES = ["target_type", "target_name", "action_type", "symbol_id", "change_kind", "is_public_api", "is_high_symbol_fan_in", "symbol_fan_in_percentile", "domains"]


def scope_features(rows: DataFrame) -> DataFrame:
    """``rows`` with what their scopes do not tell apart made equal in the columns of ``FEATURES``."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("action_type", "symbol_id", "change_kind")}
    high = F.coalesce(F.col("symbol_fan_in_percentile") >= K.HIGH_PERCENTILE, F.lit(False))
    flags = {"is_public_api": F.coalesce("is_public_api", F.lit(False)),
             "is_high_symbol_fan_in": high | F.coalesce("is_high_symbol_fan_in", F.lit(False)), "symbol_fan_in_percentile": F.when(high, 1.0).otherwise(0.0)}
    return rows.withColumns({**text, **flags, "domains": F.coalesce(F.array_distinct("domains"), F.array().cast("array<string>"))})


def scoped(rows: DataFrame, sums: list[Column], *keep: str) -> tuple[DataFrame, DataFrame]:
    """Scopes by number, and rows × the numbers of their scopes.

    The first table has (scope columns, ``scope``, what ``sums`` gives for one set of features, per set that belongs to the scope).  Rows
    with equal features have equal scopes, so scopes are made and ``sums`` taken once per set of features; a row
    then looks up a list of numbers, and only numbers are multiplied, hashed and grouped.
    """
    rows = scope_features(rows.filter(teaches(rows)).withColumn("_flag", F.col("is_high_symbol_fan_in")))
    sets = written(rows.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n_group"), F.bool_or("_flag").alias("_flag"), *sums))
    sets = written(sets.withColumn("set", F.monotonically_increasing_id()))
    matched = written(sets.withColumn("_s", F.explode(scope_array())).select("set", "target_type", "target_name", "_s.scope_kind", "_s.scope_value"))
    scopes = written(matched.select(*SCOPE).distinct().withColumn("scope", F.monotonically_increasing_id()))
    same = [matched[c].eqNullSafe(scopes[c]) for c in SCOPE]
    matched = written(matched.join(scopes, reduce(Column.__and__, same)).select("set", *[scopes[c] for c in (*SCOPE, "scope")]))
    lists = written(matched.groupBy("set").agg(F.collect_list("scope").alias("scopes")).join(sets.select("set", *FEATURES), "set").drop("set"))
    looked = rows.select(*FEATURES, *keep).join(
        lists.select(*[F.col(c).alias(f"_{c}") for c in FEATURES], "scopes"), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FEATURES]))
    return matched.join(sets.drop(*FEATURES), "set").drop("set"), looked.select(F.explode("scopes").alias("scope"), *keep)


def proposed_domains(rows: DataFrame) -> DataFrame:
    """High-fan-in-in-domain scopes are proposed for every domain, matched by a row or not."""
    return rows.select("target_type", "target_name", F.explode("domains").alias("scope_value")).distinct().select(
        "target_type", "target_name", F.lit("domain_high_symbol_fan_in").alias("scope_kind"), "scope_value")


def leave_one_out(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rate of each row's scope with the row itself left out; NULL for a scope of one row."""
    x = explode_scopes(rows, "ledger_id", "actual_outcome").filter(F.col("scope_kind").isin(*kinds))
    totals = x.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"), F.sum("actual_outcome").alias("s"))
    return x.join(totals, SCOPE).withColumn("p_loo", rate(F.col("s") - F.col("actual_outcome"), F.col("n") - 1))


# --- contiguous folds ---------------------------------------------------------------------------------------


#: Rows of one range of ledger ids; shorter ranges leave fewer rows to sort.
FOLD_ROWS = 5_000


def ranged(rows: DataFrame) -> DataFrame:
    """Rows with ``_b``, the even range of ledger ids they fall in; found before rows are multiplied by their scopes."""
    return with_ranges(rows, "ledger_id", "_b", FOLD_ROWS)


def _fold(pos: Column, n: str = "n") -> Column:
    """Fold of a 0-based position; fold edges are half-even rounded shares of n."""
    k = F.greatest(F.lit(2), F.least(F.lit(FOLDS), F.col(n)))
    return reduce(
        lambda a, b: a + b,
        [((F.lit(i) < k) & (F.bround(F.lit(i) * F.col(n) / k, 0) <= pos)).cast("int") for i in range(1, FOLDS)],
    )


def _placed(cells: DataFrame, by: list[str], min_n: int) -> DataFrame:
    """Cells (scope, ``_b``, ``_n`` rows) of scopes with at least ``min_n`` rows, with the scope's n, the rows before the cell, and the folds of its first and last row."""
    scope = W.partitionBy(*by)
    before = scope.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    c = cells.withColumns({"_off": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(scope)}).filter(F.col("n") >= min_n)
    return c.withColumns({"fold": _fold(F.col("_off")), "_last": _fold(F.col("_off") + F.col("_n") - 1)})


def _numbered(x: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the given cells with their fold, from their place inside the cell."""
    inside = W.partitionBy(*by, "_b").orderBy("ledger_id")
    placed = x.join(cells.select(*by, "_b", "_off", "n"), [*by, "_b"]).withColumn("_r", F.row_number().over(inside))
    return placed.withColumn("fold", _fold(F.col("_r") + F.col("_off") - 1)).drop("_b", "_r", "_off")


def folded(x: DataFrame, value: str, min_n: int = 2) -> DataFrame:
    """Adds scope totals (n, s) and the fold of each row in ledger order.

    Rows are numbered per (scope, range ``_b`` of ids) and shifted by the sizes of earlier ranges,
    so no scope is ever one task.
    """
    x = x if "_b" in x.columns else ranged(x)
    cells = x.groupBy(*SCOPE, "_b").agg(F.count(F.lit(1)).alias("_n"))
    totals = x.groupBy(*SCOPE).agg(F.sum(value).alias("s"))
    return _numbered(x, _placed(cells, SCOPE, min_n), SCOPE).join(totals, SCOPE)


def fold_cells(x: DataFrame, sums: list[Column], min_n: int = 2) -> tuple[DataFrame, DataFrame]:
    """``sums`` per (scope, range of ids): ranges that lie in one fold as (.., fold, n, _n, sums), and the rows of the others with their fold.

    A scope has at most nine fold edges, so of hundreds of ranges at most nine hold rows of two folds.  Only those rows are
    numbered and sorted; all others are added up where they are read.  ``x`` has ``_b`` (:func:`ranged`) and
    numbered scopes (:func:`scoped`).
    """
    cells = written(x.groupBy(*BY, "_b").agg(F.count(F.lit(1)).alias("_n"), *sums))
    placed = written(_placed(cells, BY, min_n))
    split = written(placed.filter(F.col("fold") != F.col("_last")).select(*BY, "_b", "_off", "n"))
    return placed.filter(F.col("fold") == F.col("_last")).drop("_off", "_last"), _numbered(x, split, BY)


def _binary_coverage(folds: DataFrame) -> DataFrame:
    """Fold-rate and per-outcome coverage of posterior intervals from fold sums alone."""
    scope = W.partitionBy(*BY)
    fn, fs = F.col("fn"), F.col("fs")
    n, s = F.sum("fn").over(scope), F.sum("fs").over(scope)
    z = K.Z_95_ONE_SIDED
    t = folds.withColumns({"m": n - fn, "ts": s - fs}).withColumns(
        {"mean": (1.0 + F.col("ts")) / (2.0 + F.col("m")), "pv": beta_variance("m", "ts"), "av": bernoulli_variance("m", "ts")})
    mean = F.col("mean")
    wide = z * F.sqrt(F.col("pv") + mean * (1.0 - mean) / fn)
    point = z * F.sqrt(F.col("pv") + F.col("av"))
    lo = lambda r: F.greatest(F.lit(0.0), mean - r)
    hi = lambda r: F.least(F.lit(1.0), mean + r)
    hit = ((fs / fn >= lo(wide)) & (fs / fn <= hi(wide))).cast("int")
    ones = F.when((lo(point) <= 1) & (hi(point) >= 1), fs).otherwise(0)
    zeros = F.when(lo(point) <= 0, fn - fs).otherwise(0)
    return t.filter("m > 0").groupBy(*BY).agg(
        F.avg(hit).alias("interval_coverage"), F.sum(ones + zeros).alias("covered"), F.sum("fn").alias("evaluated"), F.sum("fs").alias("fs"),
    ).withColumn("interval_coverage_lcb", wilson_lower("covered", "evaluated"))


def _fold_rates(whole: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows and positives per fold, from the cells and rows of :func:`fold_cells`."""
    parts = whole.select(*BY, "fold", F.col("_n").alias("fn"), "fs").unionByName(
        rows.groupBy(*BY, "fold").agg(F.count(F.lit(1)).alias("fn"), F.sum("actual_outcome").alias("fs")))
    return parts.groupBy(*BY, "fold").agg(F.sum("fn").alias("fn"), F.sum("fs").alias("fs"))


def binary_coverage(rows: DataFrame, min_n: int = 2) -> DataFrame:
    sets, x = scoped(ranged(rows), [], "_b", "ledger_id", "actual_outcome")
    cover = _binary_coverage(_fold_rates(*fold_cells(x, [F.sum("actual_outcome").alias("fs")], min_n)))
    return sets.select(*SCOPE, "scope").distinct().join(cover, "scope").drop("scope", "fs")


def continuous_coverage(x: DataFrame, means: DataFrame, min_n: int = 2) -> DataFrame:
    """Mean and point coverage; point hits need each value, so fold bounds join back to rows.

    ``means`` has ``mean_value`` of each scope.  Values are taken about it before squaring, which keeps the sums well scaled;
    a range of ids comes with its mean and variance and is moved there as a whole.
    """
    scope = W.partitionBy(*BY)
    value, centre = F.col("actual_value"), F.col("mean_value")
    whole, rows = fold_cells(x, [F.count(value).alias("_k"), F.avg(value).alias("_m"), F.var_pop(value).alias("_p")], min_n)
    rows = written(rows.select(*BY, "fold", "actual_value").join(means, BY))
    off = F.col("_m") - centre
    parts = whole.join(means, BY).select(
        *BY, "fold", F.col("_n").alias("fn"), (F.col("_k") * off).alias("fs"), (F.col("_k") * (F.col("_p") + off * off)).alias("fq"))
    parts = parts.unionByName(rows.withColumn("_a", value - centre).groupBy(*BY, "fold").agg(
        F.count(F.lit(1)).alias("fn"), F.sum("_a").alias("fs"), F.sum(F.col("_a") * F.col("_a")).alias("fq")))
    folds = parts.groupBy(*BY, "fold").agg(*[F.sum(c).alias(c) for c in ("fn", "fs", "fq")])
    m, ts, tq = (F.sum(c).over(scope) - F.col(c) for c in ("fn", "fs", "fq"))
    z = K.Z_95_ONE_SIDED
    t = folds.withColumns({"m": m, "ts": ts, "tq": tq}).filter("m >= 2")
    t = t.withColumns({"mean": F.col("ts") / F.col("m"), "v": (F.col("tq") - F.col("ts") * F.col("ts") / F.col("m")) / (F.col("m") - 1)})
    wide = z * F.sqrt(F.col("v") / F.col("m") + F.col("v") / F.col("fn"))
    point = z * F.sqrt(F.col("v") / F.col("m") + F.col("v"))
    t = written(t.join(means, BY).select(
        *BY, "fold", (F.abs(F.col("fs") / F.col("fn") - F.col("mean")) <= wide).cast("int").alias("hit"),
        "mean_value", (F.col("mean") - point).alias("lo"), (F.col("mean") + point).alias("hi")))
    bounds = written(whole.select(*BY, "_b", "fold").join(t.drop("hit"), [*BY, "fold"]).drop("fold"))
    inside = F.count_if((value - centre >= F.col("lo")) & (value - centre <= F.col("hi"))).alias("covered")
    every = F.count(F.lit(1)).alias("evaluated")
    points = x.join(bounds, [*BY, "_b"]).groupBy(*BY).agg(inside, every).unionByName(
        rows.join(t.drop("hit", "mean_value"), [*BY, "fold"]).groupBy(*BY).agg(inside, every))
    points = points.groupBy(*BY).agg(F.sum("covered").alias("covered"), F.sum("evaluated").alias("evaluated"))
    means = t.groupBy(*BY).agg(F.avg("hit").alias("interval_coverage"))
    return points.join(means, BY).withColumn("interval_coverage_lcb", wilson_lower("covered", "evaluated"))


# --- gates --------------------------------------------------------------------------------------------------------


def _coverage_low(min_coverage: float) -> Column:
    return (F.col("interval_coverage") < min_coverage) | (F.col("interval_coverage_lcb") < min_coverage)


def binary_gate(rows: DataFrame, min_n: int = K.MIN_CALIBRATION_SAMPLES, concern: float = 0.10, min_coverage: float = 0.90) -> DataFrame:
    """Verdict per candidate scope by leave-one-out replay, in fixed veto order.

    Inside a scope the left-out rate takes two values, (S−1)/(n−1) after a positive and
    S/(n−1) after a negative, so the replayed scores are closed forms of n and S.
    """
    cols = ("_b", "ledger_id", "actual_outcome", "event_disutility", "criticality_stage")
    p, y, d = F.col("predicted_probability"), F.col("actual_outcome"), F.col("event_disutility")
    held = lambda q: F.when(d.isNull(), q < 0.5).otherwise(q * d < concern)
    harm, c4 = y == 1, F.col("criticality_stage") == "C4"
    # all but the folds and the left-out scores of harmful rows is a sum over the scope
    sums = {"s": F.sum(y), "b0": F.sum(brier(p, y)), "l0": F.sum(log_loss(p, y)), "fp0": F.count_if(harm & held(p)),
            "h4": F.count_if(harm & c4), "f40": F.count_if(harm & c4 & held(p))}
    sets, x = scoped(ranged(rows), [c.alias(name) for name, c in sums.items()], *cols)
    totals = written(sets.groupBy(*SCOPE, "scope").agg(F.bool_or("_flag").alias("_flag"), *[F.sum(c).alias(c) for c in ("n_group", *sums)]))
    sizes = totals.filter((F.col("scope_kind") != "high_symbol_fan_in") | F.col("_flag")).select(*SCOPE, "n_group")
    sizes = sizes.unionByName(proposed_domains(rows).withColumn("n_group", F.lit(0).cast("bigint"))).groupBy(*SCOPE).agg(F.max("n_group").alias("n_group"))

    least = max(2, min_n)
    left_out = (F.col("s") - 1) / (F.col("n_group") - 1)
    harmful = x.filter(harm).join(written(totals.filter(F.col("n_group") >= least).select("scope", "n_group", "s")), "scope").groupBy("scope").agg(
        F.count_if(held(left_out)).alias("fp1"), F.count_if(c4 & held(left_out)).alias("f41"))
    g = _binary_coverage(_fold_rates(*fold_cells(x, [F.sum(y).alias("fs")], least)))
    g = g.join(totals.select(*SCOPE, "scope", "b0", "l0", "fp0", "h4", "f40"), "scope").join(harmful, "scope", "left")
    g = g.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fp1", "f41")})
    n, s = F.col("evaluated").cast("double"), F.col("fs").cast("double")
    up, down = (s - 1) / (n - 1), s / (n - 1)
    with_b = (s * brier(up, F.lit(1)) + (n - s) * brier(down, F.lit(0))) / n
    with_l = (s * log_loss(up, F.lit(1)) + (n - s) * log_loss(down, F.lit(0))) / n
    g = g.select(
        *SCOPE, "interval_coverage", "interval_coverage_lcb", F.col("fs").alias("successes"),
        (F.col("b0") / n).alias("brier_without"), with_b.alias("brier_with"),
        (F.col("l0") / n).alias("log_loss_without"), with_l.alias("log_loss_with"),
        rate(F.col("fp0"), F.col("fs")).alias("fpr_without"), rate(F.col("fp1"), F.col("fs")).alias("fpr_with"),
        rate(F.col("f40"), F.col("h4")).alias("c4_without"), rate(F.col("f41"), F.col("h4")).alias("c4_with"))
    g = sizes.join(g, SCOPE, "left").withColumns({
        "delta_brier": F.col("brier_without") - F.col("brier_with"),
        "delta_log_loss": F.col("log_loss_without") - F.col("log_loss_with")})
    event = F.startswith("target_name", F.lit("p_event."))
    rises = lambda w, wo: F.col(w).isNotNull() & (F.col(wo).isNull() | (F.col(w) > F.col(wo)))
    veto = (
        F.when(F.col("n_group") < max(2, min_n), "INSUFFICIENT_N")
        .when(F.col("delta_brier") < 0, "DELTA_BRIER_NEGATIVE").when(F.col("delta_brier") == 0, "DELTA_BRIER_NOT_POSITIVE")
        .when(F.col("delta_log_loss") < 0, "DELTA_LOG_LOSS_NEGATIVE").when(F.col("delta_log_loss") == 0, "DELTA_LOG_LOSS_NOT_POSITIVE")
        .when(event & rises("fpr_with", "fpr_without"), "FALSE_PROCEED_RATE_INCREASE")
        .when(event & rises("c4_with", "c4_without"), "C4_WEAKENING_DETECTED")
        .when((F.col("n_group") >= 100) & _coverage_low(min_coverage), "INTERVAL_COVERAGE_LOW")
    )
    return g.withColumn("veto_reason", veto).withColumn("promoted", F.col("veto_reason").isNull())


def continuous_gate(rows: DataFrame, min_n: int = K.MIN_CALIBRATION_SAMPLES, min_coverage: float = 0.90) -> DataFrame:
    """Leave-one-out MSE replay; the replayed error is n·SS/(n−1)² with SS the squared spread."""
    a, p = F.col("actual_value"), F.col("predicted_value")
    n = F.col("n_group").cast("double")
    error = F.pow(a - p, F.lit(2.0))
    sums = [F.count(a).alias("k"), F.avg(a).alias("m"), F.var_pop(a).alias("v"), F.sum(error).alias("e"), F.count(error).alias("ek")]
    sets, x = scoped(ranged(rows), sums, "_b", "ledger_id", "actual_value")
    sets = written(sets)
    g = written(sets.groupBy(*SCOPE, "scope").agg(
        F.sum("n_group").alias("n_group"), F.bool_or("_flag").alias("_flag"), F.try_divide(F.sum("e"), F.sum("ek")).alias("mse_without"),
        F.sum("k").alias("_k"), F.try_divide(F.sum(F.col("k") * F.col("m")), F.sum("k")).alias("mean_value")))
    # squared spread about the scope's mean, from each set's own spread and the distance of its mean
    away = F.col("m") - F.col("mean_value")
    spread = sets.join(g.select("scope", "mean_value"), "scope").groupBy("scope").agg(F.sum(F.col("k") * (F.col("v") + away * away)).alias("_q"))
    g = written(g.join(spread, "scope").withColumns({"_vp": F.try_divide("_q", "_k"), "_vs": F.try_divide("_q", F.col("_k") - 1)}).drop("_q", "_k"))
    means = written(g.select("scope", "mean_value"))
    g = g.filter((F.col("scope_kind") != "high_symbol_fan_in") | F.col("_flag"))
    proposed = proposed_domains(rows).join(g.select(*SCOPE), SCOPE, "left_anti").withColumn("n_group", F.lit(0).cast("bigint"))
    g = g.unionByName(proposed, allowMissingColumns=True)
    g = g.withColumn("mse_with", n * n * F.col("_vp") / F.pow(n - 1, F.lit(2.0))).withColumn("delta_mse", F.col("mse_without") - F.col("mse_with"))
    g = g.join(continuous_coverage(x, means, max(2, min_n)), "scope", "left").drop("scope")
    veto = (
        F.when(F.col("n_group") < max(2, min_n), "INSUFFICIENT_N")
        .when(F.col("delta_mse") < 0, "DELTA_MSE_NEGATIVE").when(F.col("delta_mse") == 0, "DELTA_MSE_NOT_POSITIVE")
        .when((F.col("n_group") >= 100) & _coverage_low(min_coverage), "INTERVAL_COVERAGE_LOW")
    )
    return g.withColumns({
        "veto_reason": veto, "sample_variance": sample_variance("n_group", "_vs"),
    }).withColumn("promoted", F.col("veto_reason").isNull()).drop("_flag", "_vp", "_vs")


# --- facts --------------------------------------------------------------------------------------------------------------


def scope_provenance(rows: DataFrame) -> DataFrame:
    """Most common provider and index version per scope, and its graph scope if there is only one."""
    by = ["provider_version", "index_version"]
    digest = F.col("graph_scope_digest")
    # rows with equal features are folded before they are multiplied by their scopes
    state = [c for c in ("refinement_status",) if c in rows.columns]
    sets = rows.groupBy(*FEATURES, *state, *by).agg(
        F.count(F.lit(1)).alias("c"), F.min("ledger_id").alias("first"), F.min(digest).alias("lo"), F.max(digest).alias("hi"),
        F.count_if(F.coalesce(digest, F.lit("")) == "").alias("missing"))
    cells = written(explode_scopes(sets, *by, "c", "first", "lo", "hi", "missing").groupBy(*SCOPE, *by).agg(
        F.sum("c").alias("c"), F.min("first").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("missing").alias("missing")))

    def modal(c):
        per = cells.groupBy(*SCOPE, c).agg(F.sum("c").alias("k"), F.min("first").alias("f"))
        return per.groupBy(*SCOPE).agg(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col("k"), -F.col("f")))).alias(c))

    whole = cells.groupBy(*SCOPE).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("missing").alias("missing"))
    graph = F.when((F.col("lo") == F.col("hi")) & (F.col("missing") == 0), F.col("lo"))
    return modal("provider_version").join(modal("index_version"), SCOPE).join(whole, SCOPE).select(
        *SCOPE, "provider_version", "index_version", graph.alias("graph_scope_digest"))


def fact_rows(gates: DataFrame, provenance: DataFrame, binary: bool) -> DataFrame:
    """Facts of promoted scopes; graph-derived scopes need one graph scope behind them."""
    ok = gates.filter("promoted").join(provenance, SCOPE, "left")
    graphy = F.col("scope_kind").isin("high_symbol_fan_in", "domain_high_symbol_fan_in")
    n = F.col("n_group")
    if binary:
        value, var, alea, method = F.col("successes") / n, beta_variance(n, "successes"), bernoulli_variance(n, "successes"), "observed_rate_v1"
    else:
        value, var, alea, method = F.col("mean_value"), F.col("sample_variance") / n, F.col("sample_variance"), "observed_mean_v1"
    return ok.select(
        *SCOPE, lookup(K.SCOPE_RANK, "scope_kind").alias("specificity_rank"), value.alias("value"), n.alias("sample_size"),
        var.alias("variance"), alea.alias("aleatoric_variance"), F.lit(method).alias("calibration_method"),
        "provider_version", "index_version", "graph_scope_digest",
        F.when(graphy & F.col("graph_scope_digest").isNull(), "GRAPH_SCOPE_COHORT_MISMATCH").alias("late_veto"))


def promotion_summary(family: str, gates: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts of one promotion run: every verdict with its number, late vetoes included."""
    late = facts.filter("late_veto IS NOT NULL").select(*SCOPE, "late_veto")
    verdict = F.coalesce("veto_reason", "late_veto", F.lit("PROMOTED"))
    return gates.join(late, SCOPE, "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.lit(family))


def drift(facts: DataFrame, rows: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Mean distance of active fact values from the current rates of their scopes."""
    now = explode_scopes(rows, "actual_outcome").groupBy(*SCOPE).agg(F.avg("actual_outcome").alias("rate"))
    per = facts.join(now, SCOPE).select(F.abs(F.col("value") - F.col("rate")).alias("d"))
    score = F.coalesce(F.avg("d"), F.lit(0.0))
    return per.agg(F.count(F.lit(1)).alias("facts_compared"), score.alias("drift"), (score >= threshold).alias("frozen"))


# --- corpus checks and replay -----------------------------------------------------------------------------------------------


def cluster_fit(rows: DataFrame, minimum: int = 3) -> DataFrame:
    """Success prior over independent owners, refused unless each gives exactly one eligible row."""
    per = rows.filter("eligible AND proof_fired").groupBy("owner").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("action_success").cast("int")).alias("y"))
    g = per.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("s"), F.count_if(F.col("k") > 1).alias("repeated"))
    status = F.when(F.col("repeated") > 0, "duplicate_owner").when(F.col("n") < minimum, "too_few_owners").otherwise("ok")
    ok = F.col("status") == "ok"
    g = g.withColumn("status", status)
    return g.select("status", F.col("n").alias("owners"), F.col("s").alias("successes"), F.col("repeated").alias("repeated_owners"),
                    F.when(ok, (1.0 + F.col("s")) / (2.0 + F.col("n"))).alias("p_success"),
                    F.when(ok, beta_variance("n", "s")).alias("p_success_variance"),
                    F.when(ok, bernoulli_variance("n", "s")).alias("aleatoric_variance"))


def join_cases(cases: DataFrame, predictions: DataFrame, outcomes: DataFrame, partition: str) -> DataFrame:
    """(case, prediction, outcome) triples of one partition."""
    return cases.filter(F.col("partition") == partition).join(predictions, "case_id").join(outcomes, "case_id")


def corpus_coverage(promote: DataFrame, score: DataFrame, prior: float, gate: DataFrame) -> DataFrame:
    """Can this corpus fire a promotion and improve on the prior?"""
    p = promote.agg(F.count(F.lit(1)).alias("n_promote"), F.avg("actual_outcome").alias("rate"))
    n_score = score.agg(F.count(F.lit(1)).alias("n")).scalar()
    verdict = gate.filter("scope_kind = 'global'").agg(F.coalesce(F.max("veto_reason"), F.lit("PROMOTED")).alias("v")).scalar()
    problem = (
        F.when(F.col("n_promote") < K.MIN_CALIBRATION_SAMPLES + 20, "promote_partition_too_small")
        .when(F.col("n_score") < 10, "score_partition_too_small")
        .when(F.col("rate") - prior < 0.05, "rate_not_above_prior")
        .when(F.col("gate") != "PROMOTED", F.col("gate")).otherwise("ok")
    )
    return p.withColumns({"n_score": n_score, "gate": verdict}).withColumn("status", problem)


def replay_comparison(bundle: DataFrame, promoted: Column, chain_valid: bool = True) -> DataFrame:
    """Genesis against learned track with explicit failure reasons."""
    at = lambda t, c: F.max(F.when(F.col("track") == t, F.col(c)))
    j = bundle.agg(*[at(t, c).alias(f"{t}_{c}") for t in ("genesis", "learned") for c in ("n", "brier", "log_loss", "ece")])
    lifts = {f"{c}_lift": F.round(F.col(f"genesis_{c}") - F.col(f"learned_{c}"), 12) for c in ("brier", "log_loss", "ece")}
    j = j.withColumns({**lifts, "promotion_fired": promoted})
    reasons = F.array_compact(F.array(
        F.when(~F.col("promotion_fired"), "PROMOTION_NOT_FIRED"),
        F.when(~F.lit(chain_valid), "CHAIN_INVALID"),
        F.when(~(F.col("learned_brier") < F.col("genesis_brier")), "LEARNED_NOT_BETTER"),
        F.when(F.col("brier_lift") <= 0, "BRIER_NOT_IMPROVED")))
    better = (F.col("brier_lift") > 0) & (F.col("log_loss_lift") > 0) & (F.col("ece_lift") > 0)
    return j.withColumns({
        "failure_reasons": F.array_join(reasons, ","), "passed": F.size(reasons) == 0,
        "verdict": F.when(better, "improved_on_fixture").otherwise("mixed_on_fixture")})
