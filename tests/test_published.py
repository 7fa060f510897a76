"""The published quality numbers from the seventeen calibration pairs."""

import pytest
from pyspark.sql import functions as F

from oddsmith.operators import calibration as C
from oddsmith.sources.tables import read_pairs

BINARY = [(0.2, 0), (0.45, 0), (0.6, 1), (0.8, 1), (0.9, 1), (0.08, 0), (0.15, 0), (0.27, 0), (0.42, 1), (0.55, 0), (0.68, 1), (0.85, 1), (0.93, 1)]
CONTINUOUS = [(0.1, 0.12), (0.3, 0.25), (0.5, 0.61), (0.8, 0.77)]
HEAD = "target_type,target_name,predicted_probability,predicted_value,actual_outcome,actual_value,outcome_label_status"


@pytest.fixture(scope="module")
def pairs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pairs") / "pairs.csv"
    lines = [HEAD] + [f"risk_binary,p_success,{p},,{y},,observed" for p, y in BINARY]
    lines += [f"benefit_continuous,measured_benefit,,{p},,{a},observed" for p, a in CONTINUOUS]
    lines.append("risk_binary,p_success,0.5,,1,,censored")
    path.write_text("\n".join(lines) + "\n")
    return read_pairs(spark, str(path))


def test_binary_numbers(pairs):
    rows = pairs[0].select("predicted_probability", "actual_outcome", (F.col("actual_outcome") == 1).alias("harmful"),
                           F.lit(True).alias("proceeded"), F.lit("C2").alias("criticality_stage"), F.lit("t").alias("track"))
    r = C.metric_bundle(rows, ["track"], "predicted_probability", "actual_outcome").first()
    assert r.n == 13
    assert r.brier == pytest.approx(0.101769230769, abs=1e-10)
    assert r.ece == pytest.approx(0.14, abs=1e-10)
    assert r.log_loss == pytest.approx(0.346744761012, abs=1e-9)
    assert r.false_proceed_rate == 1.0


def test_mse(pairs):
    e = pairs[1].agg(F.avg(F.pow(F.col("predicted_value") - F.col("actual_value"), F.lit(2.0)))).first()[0]
    assert e == pytest.approx(0.003975, abs=1e-10)


def test_bin_edges_are_doubles(spark):
    from oddsmith.functions.stats import equal_width_bin

    df = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (0.7,), (1.0,), (0.1,)], "p double")
    assert [r.b for r in df.select(equal_width_bin("p").alias("b")).collect()] == [0, 2, 5, 6, 9, 1]


def test_ece_is_the_weighted_reliability_gap(pairs):
    b = C.reliability_bins(pairs[0].withColumn("k", F.lit(1)), ["k"], "predicted_probability", "actual_outcome").collect()
    n = sum(r["count"] for r in b)
    gap = sum(r["count"] / n * abs(r.observed_rate - r.mean_predicted) for r in b if r["count"])
    assert len(b) == 10 and gap == pytest.approx(0.14, abs=1e-10)
    assert any(r["count"] == 0 and r.observed_rate is None for r in b)


def test_empty_type_is_pending(spark, pairs):
    rows = pairs[0].withColumns({"predicted_value": F.lit(None).cast("double"), "actual_value": F.lit(None).cast("double"), "outcome_label_status": F.lit("observed")})
    s = {r.target_type: r for r in C.calibration_summary(rows).collect()}
    assert s["risk_binary"].status == "ok" and s["cost_continuous"].status == "pending_min_n" and s["cost_continuous"].n == 0
    assert s["benefit_binary"].brier is None and s["risk_binary"].total == 13
