"""Nested bins against plain overlap tests."""

import random

from pyspark.sql import functions as F

from oddsmith.operators import callgraph as G


def test_nested_bins_cover_exactly_and_are_few(spark):
    rng = random.Random(2)
    pairs = [(a, a + rng.choice([0, 1, 2, 7, 100, 5000, 70_000])) for a in [rng.randint(0, 100_000) for _ in range(200)]] + [(0, 0), (5, 4), (0, 65_535), (1, 65_534)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", G.nested_bins("a", "b").alias("x")).collect()
    for r in rows:
        spans = sorted((x.bin << x.level, ((x.bin + 1) << x.level) - 1) for x in r.x)
        at = r.a
        for lo, hi in spans:  # no gap, no overlap
            assert lo == at
            at = hi + 1
        assert at == max(r.b + 1, r.a) and len(spans) <= 2 * max(1, (r.b - r.a + 1).bit_length())
    million = spark.createDataFrame([(17, 1_000_017)], "s long, e long").selectExpr("floor(s / 16) AS a", "floor(e / 16) AS b").select(F.size(G.nested_bins("a", "b")).alias("n")).first().n
    assert million <= 24


def test_owners_equal_plain_version(spark):
    rng = random.Random(6)
    span = lambda w: (lambda s: (s, s + rng.choice(w)))(rng.randint(0, 3000))
    nodes = [(f"n{i}", rng.choice("fg"), *span([0, 3, 20, 90, 700, 100_000])) for i in range(300)]
    nodes += [("twin1", "f", 100, 140), ("twin2", "f", 100, 140), ("all", "f", 0, 1_000_000)]
    ranges = [(i, rng.choice("fgh"), *span([0, 5, 40, 2500, 400_000])) for i in range(300)] + [(900, "f", 50, 40), (901, "f", 120, 120), (902, "f", 120, 120), (903, "g", 999_999, 999_999)]
    df = spark.createDataFrame([(*n, "function") for n in nodes], "id string, file_path string, start_line long, end_line long, kind string")
    rs = spark.createDataFrame(ranges, "range_id long, file_path string, lo long, hi long")
    want = set()
    for q, f, lo, hi in ranges:
        hits = [n for n in nodes if n[1] == f and n[2] <= hi and n[3] >= lo and lo <= hi]
        want |= {(q, n[0]) for n in hits if not any(c[2] >= n[2] and c[3] <= n[3] and c[3] - c[2] < n[3] - n[2] for c in hits)}
    got = G.owners_at(rs, df).collect()
    assert len(got) == len(want) and {(r.range_id, r.id) for r in got} == want
    pairs = G.overlapping(rs.filter("lo <= hi"), df.drop("kind"))
    assert pairs.count() == sum(n[1] == f and n[2] <= hi and n[3] >= lo and lo <= hi for _, f, lo, hi in ranges for n in nodes)
