"""Fold sums from whole ranges of ids and the sorted rows of the few ranges that hold a fold edge."""

import random

from pyspark.sql import functions as F

from oddsmith.functions import columns as Cx
from oddsmith.operators import promotion as P
from tests.test_promotion_gates import COLS


def test_ranges_by_steps_equal_the_nested_form_and_stay_compiled(spark):
    df = spark.createDataFrame([(x,) for x in [*range(3000), *([7] * 50), None]], "id long")
    both = Cx.with_ranges(df, "id", "b", 10).withColumn("c", Cx.equi_depth(df, "id", 10))
    assert both.filter("b <> c").isEmpty() and both.agg(F.countDistinct("b")).first()[0] > 250
    plan = Cx.with_ranges(df, "id", "b", 10)._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" in plan and plan.count("CASE WHEN") < 12  # not one branch a range


def test_folds_of_cells_equal_folds_of_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "FOLD_ROWS", 7)
    rnd = random.Random(3)
    rows = [(rnd.randrange(10**9) * 1000 + i, "risk_binary", "p_success", 0.5, rnd.randrange(2), None, "edit" if i % 3 else None, f"s{i % 4}", [f"d{i % 2}"],
             bool(i % 5), "X" if i % 2 else None, "C1", 0.95 if i % 7 == 0 else 0.1, i % 11 == 0) for i in range(700)]
    df = spark.createDataFrame(rows, COLS)
    sets, x = P.scoped(P.ranged(df), [], "_b", "ledger_id", "actual_outcome")
    whole, split = P.fold_cells(x, [F.sum("actual_outcome").alias("fs")])
    assert whole.agg(F.sum("_n")).first()[0] > 0 and split.count() > 0
    got = {(r.scope, r.fold): (r.fn, r.fs) for r in P._fold_rates(whole, split).collect()}
    name = {r.scope: (r.scope_kind, r.scope_value) for r in sets.select(*P.SCOPE, "scope").distinct().collect()}
    plain = P.folded(P.explode_scopes(df, "ledger_id", "actual_outcome"), "actual_outcome").groupBy(*P.SCOPE, "fold").agg(
        F.count(F.lit(1)).alias("fn"), F.sum("actual_outcome").alias("fs"))
    assert {(name[s], f): v for (s, f), v in got.items()} == {((r.scope_kind, r.scope_value), r.fold): (r.fn, r.fs) for r in plain.collect()}
