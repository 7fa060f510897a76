"""Facts and shipped priors resolved once per kind of action."""

import random

from pyspark.sql import functions as F

from oddsmith.operators import priors as P
from oddsmith.plans import bindings, priors


def _inputs(spark, n=400):
    rnd = random.Random(5)
    features = spark.createDataFrame(
        [(i, rnd.choice(["F", "", None]), rnd.choice(["s1", "s2", None]), [rnd.choice("ab")] * 2 if i % 9 else None, rnd.choice([True, False, None]), rnd.choice(["X", None]),
          rnd.choice([0.1, 0.95, None]), rnd.choice([True, None]), rnd.choice(["pkg1/m.py", "pkg2/n.go", None]), rnd.choice(["available", "none", None])) for i in range(n)],
        "action_id long, action_type string, symbol_id string, domains array<string>, is_public_api boolean, change_kind string, symbol_fan_in_percentile double, is_high_symbol_fan_in boolean, file_path string, refinement_status string")
    kinds = [("global", "", 0), ("action_type", "F", 1), ("symbol", "s1", 2), ("domain", "a", 3), ("public_api_domain", "b", 4), ("high_symbol_fan_in", "", 2), ("path_glob", "pkg1/*", 1), ("path_glob", "*.go", 5)]
    facts = spark.createDataFrame(
        [(f"{t}{k}{v}", t, k, v, r, rnd.random(), rnd.randrange(3), i, rnd.choice([0.01, None]), None) for t in ("p_success", "p_event.x") for i, (k, v, r) in enumerate(kinds)],
        "fact_id string, target_name string, scope_kind string, scope_value string, specificity_rank int, value double, sample_size long, created_at int, variance double, aleatoric_variance double")
    targets = features.select("action_id", F.explode(F.array(*map(F.lit, ("p_success", "p_event.x", "review_cost")))).alias("target_name"))
    return targets, features, facts


def test_resolution_per_set_equals_resolution_per_row(spark):
    targets, features, facts = _inputs(spark)
    cols = ["action_id", "target_name", "fact_id", "value", "variance"]
    want = {tuple(r) for r in P.winners(P.match_facts(targets, features, facts)).select(cols).collect()}
    got = P.resolved(targets, features, facts)
    assert {tuple(r) for r in got.filter("fact_id IS NOT NULL").select(cols).collect()} == want and len(want) > 500
    assert got.count() == targets.count()


def test_targets_are_not_multiplied_by_their_scopes(spark):
    plan = P.resolved(*_inputs(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.split("Join")[0] and plan.count("explode") <= 1  # the targets' own


def test_risk_rows_are_counted_before_they_are_multiplied(spark):
    plan = priors.facts(bindings.Model(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Generate")[1]  # below the explosion


def test_warm_priors_by_kind_at_the_edges_of_confidence(spark):
    cells = [P.PriorCell("g9", 9, graph_fact_kind="k", min_graph_confidence=0.9, p_success=0.9), P.PriorCell("g0", 5, graph_fact_kind="k", p_success=0.4),
             P.PriorCell("a", 3, action_type="F", p_success=0.2)]
    rows = [(0, "k", 0.9), (1, "k", 0.89), (2, "k", 1.5), (3, "k", float("nan")), (4, "k", None), (5, "k", -0.1), (6, None, 1.0), (7, " K ", 1.0)]
    df = spark.createDataFrame([(i, "f", None, None, k, c, False, False) for i, k, c in rows],
                               "action_id int, action_type string, language string, language_tier string, graph_fact_kind string, graph_confidence double, p_success_given boolean, review_cost_given boolean")
    got = {r.action_id: r.p_success_tag for r in P.warm_priors(df, cells).collect()}
    assert got == {0: "g9", 1: "g0", 2: "a", 3: "a", 4: "a", 5: "a", 6: "a", 7: "g9"}
    assert "Generate" not in P.warm_priors(df, cells)._jdf.queryExecution().optimizedPlan().toString()
