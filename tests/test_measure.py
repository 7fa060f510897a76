"""Measuring against plain rows, in tasks that follow the number of outcomes."""

import re
from datetime import datetime

from oddsmith.operators import calibration as C


def test_tasks_follow_the_outcomes_and_measured_ones_stay_out(spark, monkeypatch):
    monkeypatch.setattr(C, "TASK_OUTCOMES", 10, raising=False)
    at = datetime(2024, 1, 1)
    predictions = spark.createDataFrame(
        [(i, "risk_binary", t, 0.5) for i in range(28) for t in ("p_success", "p_event.public_api_break")],
        "assessment_id long, target_type string, target_name string, predicted double")
    outcomes = spark.createDataFrame(
        [(i, "completed" if i % 2 else None, at, "host", True, None, None, None) for i in range(25)],
        "assessment_id long, terminal_status string, recorded_at timestamp, label_source string, actual_success boolean, benefit_realized boolean, actual_review_cost double, measured_benefit double")
    labels = spark.createDataFrame([(i, "public_api_break", True) for i in range(0, 28, 3)], "assessment_id long, event string, observed boolean")
    out = C.measure(predictions, outcomes, labels, spark.range(5).withColumnRenamed("id", "assessment_id"))
    got = {(r.assessment_id, r.target_name, r.actual_outcome) for r in out.collect()}
    want = {(i, "p_success", 1) for i in range(5, 25, 2)} | {(i, "p_event.public_api_break", 1 if i % 3 == 0 else None) for i in range(5, 25, 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert got == want and len(re.findall(r"RepartitionByExpression .*, 3\b", plan)) == 2
