"""Keyed measurement of a prediction stream against an outcome stream.

The state keeps of every assessment the predictions that wait, and its first outcome, in buckets by a hash of its key.  A prediction
leaves the state in the batch that brings its outcome, and a batch reads the buckets that it touches.  Two clocks are kept apart: whether a pair is in time follows from the two times
alone, and an event-time timer reports a prediction as overdue when the watermark passes its
last moment in both streams.  The watermark column is not passed on to the keyed operator, so it moves timers but never
drops a row: an outcome of any age still finds its prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

JOINED, LATE, OVERDUE, PENDING = "joined", "late", "overdue", "pending"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pairing(StatefulProcessor):
    """State of one bucket of assessments; times are microseconds since 1970.

    Every call to the state is a message to the JVM and back, whatever it carries, so the waiting predictions and the first outcomes of a
    bucket are one list each: a batch reads and writes a bucket that it touches in a few calls, not each assessment.
    One timer stands for a bucket, that of its earliest waiting prediction not yet reported.
    """

    def __init__(self, key: T.StructField, prediction: T.StructType, outcome: T.StructType, wait: timedelta):
        self.key, self.prediction, self.outcome = key, prediction, outcome
        self.wait = wait // timedelta(microseconds=1)
        self.result = Row(key.name, "predicted_us", *prediction.names, "outcome_us", *outcome.names, "part")
        self.nothing = (None,) * (1 + len(outcome.names))

    def init(self, handle: StatefulProcessorHandle) -> None:
        own = [self.key, T.StructField("at", T.LongType())]
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([*own, T.StructField("reported", T.BooleanType()), *self.prediction.fields]))
        self.known = handle.getListState("outcomes", T.StructType([*own, *self.outcome.fields]))

    def pair(self, key: object, prediction: tuple, known: tuple) -> Row:
        return self.result(key, *prediction, *known, JOINED if prediction[0] <= known[0] <= prediction[0] + self.wait else LATE)

    def due(self, at: int) -> int:
        """The first millisecond after the last moment of a prediction made at ``at``."""
        return (at + self.wait) // 1000 + 1

    def next_due(self, waiting: list[tuple]) -> int | None:
        return min((self.due(w[1]) for w in waiting if not w[2]), default=None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        predictions, outcomes, end = {}, {}, 4 + len(self.prediction.fields)
        for r in rows:  # bucket, key, whether a prediction, at, both payloads
            side, payload = (predictions, r[4:end]) if r[2] else (outcomes, r[end:])
            side.setdefault(r[1], []).append((r[3], *payload))
        known = {o[0]: o[1:] for o in self.known.get()}
        waiting = list(self.waiting.get())
        timer = self.next_due(waiting)
        first = {k: min(o, key=lambda x: (x[0], repr(x))) for k, o in outcomes.items() if k not in known}
        left = waiting
        if first:
            self.known.appendList([(k, *o) for k, o in first.items()])
            known.update(first)
            left = [w for w in waiting if w[0] not in first]
            for w in waiting:
                if w[0] in first:
                    yield self.pair(w[0], (w[1], *w[3:]), first[w[0]])
        new = []
        for k, made in predictions.items():
            if k in known:
                for p in made:
                    yield self.pair(k, p, known[k])
            else:
                new.extend((k, p[0], False, *p[1:]) for p in made)
        again = {(w[0], self.due(w[1])) for w in new}  # a prediction due with one already reported brings both up
        left = [(*w[:2], False, *w[3:]) if w[2] and (w[0], self.due(w[1])) in again else w for w in left]
        now = left + new
        if left != waiting and now:
            self.waiting.put(now)
        elif left != waiting:
            self.waiting.clear()
        elif new:
            self.waiting.appendList(new)
        self.move_timer(timer, self.next_due(now))

    def move_timer(self, old: int | None, new: int | None) -> None:
        if old != new and old is not None:
            self.handle.deleteTimer(old)
        if old != new and new is not None:
            self.handle.registerTimer(new)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = list(self.waiting.get())
        over = [not w[2] and self.due(w[1]) <= passed for w in waiting]
        for w, is_over in zip(waiting, over):
            if is_over:
                yield self.result(w[0], w[1], *w[3:], *self.nothing, OVERDUE)
        if any(over):
            waiting = [(*w[:2], w[2] or is_over, *w[3:]) for w, is_over in zip(waiting, over)]
            self.waiting.put(waiting)
        self.move_timer(None, self.next_due(waiting))  # the one that went off goes by itself


#: Buckets of assessments, for the life of a checkpoint.  A batch reads what is kept of every bucket it touches: more buckets suit
#: small batches, fewer suit batches that touch most assessments.
BUCKETS = 1 << 15


def _payload(df: DataFrame, key: str, at: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in (key, at)]


def measure_stream(predictions: DataFrame, outcomes: DataFrame, path: str, checkpoint: str, key: str = "assessment_id", predicted_at: str = "predicted_at", outcome_at: str = "outcome_at", wait: timedelta = timedelta(days=10), delay: str = "0 seconds", buckets: int = BUCKETS) -> StreamingQuery:
    """Starts the job; what a batch settles is written under its number, one folder a ``part``.

    Both streams carry ``key`` and a time (``predicted_at``, ``outcome_at``) and any further columns.
    The first outcome of an assessment counts: the one processed first, within a batch the earliest.
    A checkpoint belongs to one number of ``buckets``.
    """
    spark = predictions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # keyed state with timers needs it
    p, o = _payload(predictions, key, predicted_at), _payload(outcomes, key, outcome_at)

    def side(df: DataFrame, name: str, at: str) -> DataFrame:
        own = [(x, f"{s}_{f.name}", f) for s, x, fs in (("p", "prediction", p), ("o", "outcome", o)) for f in fs]
        columns = [(F.col(f.name) if x == name else F.lit(None).cast(f.dataType)).alias(as_) for x, as_, f in own]
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")
        return df.withWatermark(at, delay).select(bucket, F.col(key), F.lit(name == "prediction").alias("is_prediction"), F.unix_micros(at).alias("at"), *columns)

    both = side(predictions, "prediction", predicted_at).unionByName(side(outcomes, "outcome", outcome_at))
    out = T.StructType([predictions.schema[key], T.StructField("predicted_us", T.LongType()), *p, T.StructField("outcome_us", T.LongType()), *o, T.StructField("part", T.StringType())])
    settled = both.groupBy("_bucket").transformWithState(Pairing(predictions.schema[key], T.StructType(p), T.StructType(o), wait), out, "Append", "EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        times = {predicted_at: F.timestamp_micros("predicted_us"), outcome_at: F.timestamp_micros("outcome_us")}
        batch.withColumns(times).drop("predicted_us", "outcome_us").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch_id={batch_id}")

    return settled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The table of joined, late or overdue predictions."""
    return spark.read.parquet(path).filter(F.col("part") == part).drop("batch_id", "part")


def pending(spark: SparkSession, checkpoint: str, key: str = "assessment_id") -> DataFrame:
    """Predictions that still wait, read from the state itself."""
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    return state.select("list_element.*").withColumn("predicted_at", F.timestamp_micros("at")).drop("at", "reported")
