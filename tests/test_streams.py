"""Streams over several batches and restarts."""

from datetime import datetime as D
from datetime import timedelta

from pyspark.sql import functions as F

from oddsmith.streaming import measure as S

PREDICTION = "assessment_id long, predicted_at timestamp, p double"
OUTCOME = "assessment_id long, outcome_at timestamp, status string"


def day(n):
    return D(2024, 1, 1) + timedelta(days=n)


def feed(spark, root, name, schema):
    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/{name}")

    put([])
    return put


def run(spark, root):
    sides = (spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{root}/{n}") for n, s in (("predictions", PREDICTION), ("outcomes", OUTCOME)))
    query = S.measure_stream(*sides, f"{root}/out", f"{root}/ck")
    query.awaitTermination()
    return query


def table(spark, root, part):
    return sorted((r.assessment_id, r.p, r.status) for r in S.settled(spark, f"{root}/out", part).collect())


def waiting(spark, root):
    return sorted((r.assessment_id, r.p) for r in S.pending(spark, f"{root}/ck").collect())


def test_measurement_keeps_state_per_assessment(spark, tmp_path):
    root = str(tmp_path)
    predict, observe = feed(spark, root, "predictions", PREDICTION), feed(spark, root, "outcomes", OUTCOME)
    predict([(1, day(0), 0.1), (2, day(0), 0.2), (3, day(0), 0.3), (3, day(1), 0.35)])
    observe([(1, day(4), "completed"), (1, day(4), "completed"), (9, day(1), "early")])
    run(spark, root)
    assert table(spark, root, S.JOINED) == [(1, 0.1, "completed")]
    assert waiting(spark, root) == [(2, 0.2), (3, 0.3), (3, 0.35)]
    # a restart from the checkpoint: what is settled has left the state, the rest is still known
    predict([(4, day(60), 0.4), (9, day(2), 0.9)])
    observe([(2, day(3), "completed"), (1, day(2), "contradiction"), (8, day(59), "completed")])
    run(spark, root)
    assert table(spark, root, S.JOINED) == [(1, 0.1, "completed"), (2, 0.2, "completed")]
    assert table(spark, root, S.LATE) == [(9, 0.9, "early")]  # the outcome came before its prediction was made
    assert table(spark, root, S.OVERDUE) == [(3, 0.3, None), (3, 0.35, None)]  # both streams have passed their last moment
    # far behind the watermark, and not lost
    predict([(5, day(1), 0.5)])
    observe([(3, day(20), "rejected"), (5, day(2), "completed")])
    run(spark, root)
    assert table(spark, root, S.LATE) == [(3, 0.3, "rejected"), (3, 0.35, "rejected"), (9, 0.9, "early")]
    assert (5, 0.5, "completed") in table(spark, root, S.JOINED)
    assert waiting(spark, root) == [(4, 0.4)]


def test_a_batch_writes_what_it_settles(spark, tmp_path):
    root = str(tmp_path)
    predict, observe = feed(spark, root, "predictions", PREDICTION), feed(spark, root, "outcomes", OUTCOME)
    predict([(i, day(0), i / 100) for i in range(60)])
    run(spark, root)
    observe([(7, day(1), "completed")])
    query = run(spark, root)
    rows = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(rows) <= 4 and spark.read.parquet(f"{root}/out").count() == 1
    assert spark.read.parquet(f"{root}/out").select(F.max("batch_id")).first()[0] > 0
    assert len(waiting(spark, root)) == 59
