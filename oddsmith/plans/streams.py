"""Streaming plans: each drives a stream over the given tables to completion."""

from pyspark.sql import functions as F

from oddsmith.plans.catalog import plan
from oddsmith.plans.priors import _APPLIED, _MATCHED, facts
from oddsmith.sources.tables import scratch
from oddsmith.streaming import jobs as J
from oddsmith.streaming import measure as S


def _orders(m):
    return J.table_stream(m.spark, m.folder, "orders", m.orders.schema)


def _instant(c):
    """Stored wall-clock times are UTC; an event-time column must be an instant."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp")


def _wall(c):
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz"))


def _actions(m, orders):
    return orders.select(
        F.col("o_orderkey").alias("action_id"), _instant("o_orderdate").alias("recorded_at"),
        F.expr("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'reject' WHEN '2' THEN 'ask_human' WHEN '3' THEN 'inspect_first' WHEN '4' THEN 'test_first' ELSE 'proceed' END").alias("decision"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'rejected' END").alias("terminal_status"),
        ((F.col("o_orderkey") % 19 + 1).cast("double") / 20).alias("p_success"), ((F.col("o_custkey") % 10).cast("double") / 20).alias("review_cost"))


def _finish(*queries):
    for query in queries:
        query.awaitTermination()


@plan("k02_overview_counters", "SELECT decision, coalesce(terminal_status, 'pending') AS status, count(*) AS n FROM actions GROUP BY 1, 2")
def _(m):
    path = scratch(m.spark, "counters")
    _finish(J.overview_counters(_actions(m, _orders(m)), path, f"{path}-ck"))
    return J.latest(m.spark.read.parquet(path), ["decision", "status"], "n")


@plan("k03_score_trend", "SELECT date_trunc('day', recorded_at)::timestamp AS day, count(*) AS n, R(avg(p_success)) AS p_success, R(avg(review_cost)) AS review_cost FROM actions GROUP BY 1")
def _(m):
    path = scratch(m.spark, "trend")
    _finish(J.score_trend(_actions(m, _orders(m)), path, f"{path}-ck", ("p_success", "review_cost")))
    return J.trend(m.spark.read.parquet(path), ("p_success", "review_cost")).withColumn("day", _wall("day"))


@plan("k01_stream_measurement", """
WITH o AS (SELECT action_id AS assessment_id, recorded_at + to_days(cast(action_id % 14 as int)) AS outcome_at, terminal_status FROM actions WHERE terminal_status IS NOT NULL)
SELECT a.action_id AS assessment_id, R(p_success) AS p_success, o.terminal_status, 'joined' AS part FROM actions a JOIN o ON o.assessment_id = a.action_id AND outcome_at <= recorded_at + INTERVAL 10 DAY
UNION ALL SELECT a.action_id, R(p_success), o.terminal_status, 'late' FROM actions a JOIN o ON o.assessment_id = a.action_id AND outcome_at > recorded_at + INTERVAL 10 DAY
UNION ALL SELECT action_id, R(p_success), NULL, 'pending' FROM actions WHERE terminal_status IS NULL
""")
def _(m):
    def sides(orders):
        a = _actions(m, orders)
        p = a.select(F.col("action_id").alias("assessment_id"), F.col("recorded_at").alias("predicted_at"), "p_success")
        o = a.filter("terminal_status IS NOT NULL").select(
            F.col("action_id").alias("outcome_assessment_id"), F.expr("recorded_at + make_dt_interval(cast(action_id % 14 as int))").alias("outcome_at"), "terminal_status")
        return p, o

    p, o = sides(_orders(m))
    twice = o.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")  # each outcome arrives twice
    path = scratch(m.spark, "measured")
    _finish(S.measure_stream(p, twice.withColumnRenamed("outcome_assessment_id", "assessment_id"), path, f"{path}-ck"))
    done = m.spark.read.parquet(path).filter(F.col("part").isin(S.JOINED, S.LATE)).select("assessment_id", "p_success", "terminal_status", "part")
    left = S.pending(m.spark, f"{path}-ck").select("assessment_id", "p_success", F.lit(None).cast("string").alias("terminal_status"), F.lit(S.PENDING).alias("part"))
    return done.unionByName(left)


@plan("k04_stream_fact_application", f"""WITH {_MATCHED}, {_APPLIED.replace('@T@', 'action_targets')}
SELECT action_id, target_name, R(CASE WHEN value IS NULL OR held THEN prior ELSE cv END) AS new_value, fact_id FROM aq WHERE target_name IN ('p_success', 'review_cost')""")
def _(m):
    a = _actions(m, _orders(m))
    item = lambda n: F.struct(F.lit(n).alias("target_name"), F.col(n).alias("prior"), F.lit(None).cast("double").alias("prior_variance"))
    targets = a.withColumn("t", F.explode(F.array(item("p_success"), item("review_cost")))).select("action_id", "t.*")
    path = scratch(m.spark, "applied")
    _finish(J.apply_facts_stream(targets, m.action_features, facts(m), path, f"{path}-ck"))
    return m.spark.read.parquet(path).select("action_id", "target_name", "new_value", "fact_id")


@plan("k05_exactly_once_append", "SELECT assessment_id, terminal_status FROM (SELECT o_orderkey AS assessment_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'rejected' ELSE 'skipped' END AS terminal_status FROM orders)")
def _(m):
    path = scratch(m.spark, "once")
    for _ in range(2):  # the second start resumes the checkpoint and finds nothing new
        rows = _orders(m).select(F.col("o_orderkey").alias("assessment_id"), F.col("o_orderdate").alias("recorded_at"),
                                 F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'rejected' ELSE 'skipped' END").alias("terminal_status"))
        copies = rows.withColumn("_c", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("recorded_at", F.expr("recorded_at + make_dt_interval(_c)")).withColumn(
            "terminal_status", F.when(F.col("_c") == 0, F.col("terminal_status")).otherwise("contradiction")).drop("_c")
        _finish(J.append_outcomes(copies, path, f"{path}-ck"))
    return m.spark.read.parquet(path).select("assessment_id", "terminal_status")
