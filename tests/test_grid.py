"""The planned grid stays where it is when it meets the runs."""

from oddsmith.operators import experiment as X


def test_grid_keeps_unplanned_runs_and_is_not_shuffled_whole(spark):
    planned = X.planned_grid(spark.createDataFrame([(i, "risky", "go") for i in range(40)], "task_id long, harm_label string, language string"), 3, ("a", "b"))
    observed = spark.createDataFrame([(1, 1, "a", "safe"), (99, 1, "a", "safe"), (None, 2, "b", "safe")], "task_id long, seed int, arm string, harm_label string")
    out = X.grid_status(planned, observed)
    assert "FullOuter" not in out._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == 40 * 3 * 2 + 2 and sum(r[3] == "done" for r in rows) == 3
    assert (1, 1, "a", "done", "safe", "go") in rows and (99, 1, "a", "done", "safe", None) in rows
