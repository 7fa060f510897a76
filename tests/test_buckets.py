"""The measurement stream's buckets against one state per assessment, and how often a bucket calls the state."""

import random
from collections import Counter
from datetime import datetime as D
from datetime import timedelta

from pyspark.sql import types as T

from oddsmith.streaming import measure as S

DAY = 86_400_000_000


class Kept:
    """A list state that counts its calls."""

    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def get(self):
        self.calls["get"] += 1
        return iter(list(self.rows))

    def put(self, rows):
        assert rows
        self.calls["write"] += 1
        self.rows = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.calls["write"] += 1
        self.rows += rows

    def clear(self):
        self.calls["write"] += 1
        self.rows = []


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def getListState(self, name, schema):  # noqa: N802
        return Kept(self.calls)

    def registerTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.remove(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def bucket():
    field = T.StructField
    pairing = S.Pairing(field("assessment_id", T.LongType()), T.StructType([field("p", T.DoubleType())]), T.StructType([field("status", T.StringType())]), timedelta(days=10))
    handle = Handle()
    pairing.init(handle)
    return pairing, handle


def batch(pairing, handle, rows, watermark):
    out = list(pairing.handleInputRows((0,), iter([(0, *r) for r in rows]), Now(watermark)))
    for at in sorted(t for t in handle.timers if t <= watermark):
        out += pairing.handleExpiredTimer((0,), Now(watermark), Now(at))
        handle.timers.remove(at)
    return sorted(map(tuple, out), key=repr)


class PerAssessment:
    """Every assessment by itself."""

    def __init__(self):
        self.waiting, self.known, self.timers = {}, {}, set()

    def batch(self, rows, watermark):
        out, due = [], lambda at: (at + 10 * DAY) // 1000 + 1
        pair = lambda k, p, o: out.append((k, *p, *o, S.JOINED if p[0] <= o[0] <= p[0] + 10 * DAY else S.LATE))
        for k in {r[0] for r in rows}:
            made = [(r[2], r[3]) for r in rows if r[0] == k and r[1]]
            seen = [(r[2], r[4]) for r in rows if r[0] == k and not r[1]]
            if k not in self.known and seen:
                self.known[k] = min(seen)
                for p in self.waiting.pop(k, []):
                    pair(k, p, self.known[k])
                self.timers = {t for t in self.timers if t[1] != k}
            for p in made:
                if k in self.known:
                    pair(k, p, self.known[k])
                else:
                    self.waiting.setdefault(k, []).append(p)
                    self.timers.add((due(p[0]), k))
        for at, k in sorted(t for t in self.timers if t[0] <= watermark):
            out += [(k, *p, None, None, S.OVERDUE) for p in self.waiting[k] if due(p[0]) == at]
            self.timers.remove((at, k))
        return sorted(out, key=repr)


def test_a_bucket_equals_its_assessments():
    rnd = random.Random(5)
    pairing, handle = bucket()
    plain, parts = PerAssessment(), Counter()
    for i in range(200):
        rows = []
        for _ in range(rnd.randrange(12)):
            made, at = rnd.random() < 0.6, rnd.randrange(max(0, i - 30), i + 5) * DAY
            rows.append((rnd.randrange(150), made, at, i / 1000 if made else None, None if made else rnd.choice("abc")))
        watermark = i * DAY // 1000 + rnd.randrange(2)
        got = batch(pairing, handle, rows, watermark)
        assert got == plain.batch(rows, watermark)
        parts.update(r[-1] for r in got)
    assert min(parts[p] for p in (S.JOINED, S.LATE, S.OVERDUE)) > 20
    assert sorted((w[0], w[1], w[3]) for w in pairing.waiting.rows) == sorted((k, *p) for k, ps in plain.waiting.items() for p in ps)


def test_calls_follow_buckets_and_not_assessments():
    pairing, handle = bucket()
    batch(pairing, handle, [(k, True, k % 7 * DAY, 0.5, None) for k in range(500)], 0)
    batch(pairing, handle, [(k, False, 9 * DAY, None, "done") for k in range(0, 500, 2)], 0)
    assert sum(handle.calls.values()) < 20 and len(pairing.waiting.rows) == 250 and len(handle.timers) == 1


def test_the_stream_in_one_bucket(spark, tmp_path):
    root, day = str(tmp_path), lambda n: D(2024, 1, 1) + timedelta(days=n)
    sides = {"predictions": "assessment_id long, predicted_at timestamp, p double", "outcomes": "assessment_id long, outcome_at timestamp, status string"}

    def run(*rows):
        for (name, schema), new in zip(sides.items(), rows):
            spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{root}/{name}")
        streams = [spark.readStream.schema(s).parquet(f"{root}/{n}") for n, s in sides.items()]
        S.measure_stream(*streams, f"{root}/out", f"{root}/ck", buckets=1).awaitTermination()

    run([(1, day(0), 0.1), (2, day(1), 0.2), (3, day(2), 0.3), (4, day(90), 0.4)], [(1, day(3), "x")])
    run([(5, day(91), 0.5)], [(2, day(4), "y"), (9, day(95), "z")])
    table = lambda part: sorted((r.assessment_id, r.p, r.status) for r in S.settled(spark, f"{root}/out", part).collect())
    assert table(S.JOINED) == [(1, 0.1, "x"), (2, 0.2, "y")] and table(S.OVERDUE) == [(3, 0.3, None)]
    assert sorted((r.assessment_id, r.p) for r in S.pending(spark, f"{root}/ck").collect()) == [(3, 0.3), (4, 0.4), (5, 0.5)]
