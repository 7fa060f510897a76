"""Vetoes that the large tables do not reach, and closed forms against row-by-row replay."""

import math

import pytest
from pyspark.sql import functions as F

from oddsmith.operators import promotion as P

COLS = """ledger_id long, target_type string, target_name string, predicted_probability double, actual_outcome int, event_disutility double,
action_type string, symbol_id string, domains array<string>, is_public_api boolean, change_kind string, criticality_stage string,
symbol_fan_in_percentile double, is_high_symbol_fan_in boolean"""


def frame(spark, n, p, y, target="p_success", dis=None, stage="C1", symbol=None):
    rows = [(i, "risk_binary", target, p(i), y(i), dis, "edit", symbol, ["d0"], False, None, stage, 0.1, False) for i in range(n)]
    return spark.createDataFrame(rows, COLS)


def verdicts(df):
    return {(r.scope_kind, r.scope_value): r for r in P.binary_gate(df).collect()}


def test_small_group_and_unmatched_domain(spark):
    v = verdicts(frame(spark, 99, lambda i: 0.9, lambda i: i % 2))
    assert v["global", ""].veto_reason == "INSUFFICIENT_N"
    assert v["domain_high_symbol_fan_in", "d0"].n_group == 0
    assert v["domain_high_symbol_fan_in", "d0"].veto_reason == "INSUFFICIENT_N"


def test_promotes_a_bad_forecast_and_matches_replay(spark):
    n, y = 200, lambda i: i % 2
    r = verdicts(frame(spark, n, lambda i: 0.9, y))["global", ""]
    s = sum(y(i) for i in range(n))
    loo = [((s - y(i)) / (n - 1), y(i)) for i in range(n)]
    assert r.promoted
    assert r.brier_with == pytest.approx(sum((p - t) ** 2 for p, t in loo) / n, abs=1e-12)
    assert r.log_loss_with == pytest.approx(-sum(t * math.log(p) + (1 - t) * math.log(1 - p) for p, t in loo) / n, abs=1e-12)


def test_good_forecast_is_not_replaced(spark):
    r = verdicts(frame(spark, 120, lambda i: 0.95 if i % 2 else 0.05, lambda i: i % 2))["global", ""]
    assert r.veto_reason == "DELTA_BRIER_NEGATIVE"


def test_exact_equality_is_its_own_veto(spark):
    r = verdicts(frame(spark, 120, lambda i: 0.0, lambda i: 0))["global", ""]
    assert r.delta_brier == 0.0 and r.veto_reason == "DELTA_BRIER_NOT_POSITIVE"


def test_false_proceed_veto_only_for_events(spark):
    p, y = lambda i: 0.9, lambda i: int(i % 20 == 0)
    harmful = verdicts(frame(spark, 200, p, y, "p_event.dependency_break", 0.5))["global", ""]
    assert harmful.veto_reason == "FALSE_PROCEED_RATE_INCREASE" and harmful.fpr_with == 1.0 and harmful.fpr_without == 0.0
    assert verdicts(frame(spark, 200, p, y))["global", ""].veto_reason != "FALSE_PROCEED_RATE_INCREASE"


def test_regime_shift_fails_coverage(spark):
    r = verdicts(frame(spark, 200, lambda i: 0.02, lambda i: int(i >= 100)))["global", ""]
    assert r.veto_reason == "INTERVAL_COVERAGE_LOW" and r.interval_coverage < 0.9


def test_fold_edges_round_half_even(spark):
    n = 105  # 105/10 = 10.5 rounds to 10, 31.5 to 32
    x = P.explode_scopes(frame(spark, n, lambda i: 0.5, lambda i: i % 2), "ledger_id", "actual_outcome").filter("scope_kind = 'global'")
    sizes = {r.fold: r.k for r in P.folded(x, "actual_outcome").groupBy("fold").agg(F.count(F.lit(1)).alias("k")).collect()}
    edges = [round(i * n / 10) for i in range(11)]
    assert sizes == {i: edges[i + 1] - edges[i] for i in range(10)}
