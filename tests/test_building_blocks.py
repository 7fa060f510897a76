"""Distributed building blocks against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oddsmith.functions import columns as Cx
from oddsmith.operators import experiment as X
from oddsmith.operators import imports as I
from oddsmith.operators import priors as P
from oddsmith.sources import tables as S


def test_neighbours_and_positions_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(Cx, "RANGE_ROWS", 60)
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.5 else f"g{rng.randrange(4)}"), i * 3 + rng.randrange(3), rng.randrange(2)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, v int")
    want, seen = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        n, total, prev = seen.get(g, (0, 0, None))
        want[i] = (n + 1, prev, total + v)
        seen[g] = (n + 1, total + v, v)
    pos = {r.id: r.position for r in Cx.running_positions(df, ["g"], "id").collect()}
    prev = {r.id: r.prev.v if r.prev else None for r in Cx.previous_row(df, ["g"], "id", ["v"]).collect()}
    run = {r.id: r.s for r in Cx.running_sum(df, ["g"], "id", "v", "s").collect()}
    assert {i: (pos[i], prev[i], run[i]) for i in want} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycle_files_against_closure(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = {(f"f{rng.randrange(n)}", f"f{rng.randrange(n)}") for _ in range(18)}
    reach = {a: {b for s, b in edges if s == a and b != a} for a in {x for e in edges for x in e}}
    for _ in range(n):
        for a in reach:
            reach[a] = reach[a] | {c for b in reach[a] for c in reach.get(b, ())}
    want = {a for a in reach if any(a in reach[b] for b in reach[a] if b != a)}
    df = spark.createDataFrame(list(edges), "src string, tgt string")
    assert {r.path for r in I.cycle_files(df).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab/*?.", max_size=8), st.text(alphabet="ab/.", max_size=8))
def test_glob_regex_equals_fnmatch(pattern, path):
    import fnmatch
    import re

    assert bool(re.search(Cx.glob_regex(pattern).replace("$", r"\Z"), path)) == fnmatch.fnmatchcase(path, pattern)


def test_path_globs_by_folder(spark):
    paths = ["a/b/c.py", "a/x.py", "top.py", "a/b/d/e.sql"]
    globs = ["a/b/*", "*.py", "a/?.py", "a/b/d/*.sql", "z/*"]
    targets = spark.createDataFrame([(i, "t", p) for i, p in enumerate(paths)], "action_id long, target_name string, file_path string")
    facts = spark.createDataFrame([("t", "path_glob", g) for g in globs], "target_name string, scope_kind string, scope_value string")
    import fnmatch

    got = {(r.action_id, r.scope_value) for r in P.match_globs(targets, facts).collect()}
    assert got == {(i, g) for i, p in enumerate(paths) for g in globs if fnmatch.fnmatchcase(p, g)}


def test_wildcard_first_patterns_meet_only_paths_with_their_rarest_piece(spark):
    paths = [f"pkg{i}/mod{i}.py" for i in range(300)] + ["a.c", "zz", ""]
    globs = ["*mod2?.py", "*/mod1[0-4].py", "?.c", "*", "[!p]*", "pkg7/*", "*.nothing"]
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {}
    for r in P.pattern_pairs(frame(paths, "file_path"), frame(globs, "scope_value"), hot=50).collect():
        got.setdefault(r.scope_value, []).append(r.file_path)
    assert sorted(got["*mod2?.py"]) == sorted(p for p in paths if "od2" in p) and len(got["*mod2?.py"]) < 120
    assert sorted(got["*/mod1[0-4].py"]) == sorted(p for p in paths if "od1" in p) and got["?.c"] == ["a.c"] and got["pkg7/*"] == ["pkg7/mod7.py"]
    assert sorted(got["*"]) == sorted(got["[!p]*"]) == sorted(paths) and "*.nothing" not in got


def test_signed_rank_small_case(spark):
    from math import erf, sqrt

    d = [1.0, 1.0, -1.0, 0.0, 2.0, 1.0]
    r = X.signed_rank(spark.createDataFrame([("k", x) for x in d], "k string, d double"), ["k"], "d").first()
    # ranks of |d|: four ones share 2.5, the two is 5; W- = 2.5
    var = 5 * 6 * 11 / 24 - (4**3 - 4) / 48
    z = (abs(2.5 - 7.5) - 0.5) / sqrt(var)
    assert (r.w, r.tie_term) == (2.5, 60.0)
    assert r.p_value == pytest.approx(2 * (1 - 0.5 * (1 + erf(z / sqrt(2)))), abs=1e-12)


def test_signed_rank_all_zero(spark):
    r = X.signed_rank(spark.createDataFrame([("k", 0.0)] * 3, "k string, d double"), ["k"], "d").first()
    assert (r.n, r.w, r.p_value) == (3, 0.0, 1.0)


def test_bootstrap_interval_holds_the_mean(spark):
    rows = [("k", i, 1, 1 if i % 3 else 0) for i in range(90)]
    ci = X.bootstrap_ci(spark.createDataFrame(rows, "k string, task_id int, seed int, d int"), ["k"], "d").first()
    assert ci.ci_low < 60 / 90 < ci.ci_high and ci.ci_high - ci.ci_low < 0.3


def test_append_once_replay_and_repeat(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, o int")
    S.append_once(one, path, "k", "o", 0)
    S.append_once(one, path, "k", "o", 0)
    S.append_once(spark.createDataFrame([(2, "late", 9), (3, "d", 1)], "k int, v string, o int"), path, "k", "o", 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_append_once_reads_only_partitions_that_may_know_a_key(spark, tmp_path, monkeypatch):
    path, frame = str(tmp_path / "t"), lambda ks: spark.createDataFrame([(k, 1) for k in ks], "k long, o int")
    S.append_once(frame([*range(400), None]), path, "k", "o", 0)
    S.append_once(frame([*range(390, 500), None, None]), path, "k", "o", 1)
    S.append_once(frame(range(1000, 1005)), path, "k", "o", 2)
    S.append_once(frame(range(1000, 1005)), path, "k", "o", 2)  # replayed
    S.append_once(frame([]), path, "k", "o", 3)
    kept = [r.k for r in spark.read.parquet(path).collect()]
    assert sorted(kept, key=repr) == sorted([*range(500), None, *range(1000, 1005)], key=repr)
    members = spark.read.parquet(f"{path}-members").select("bucket", "word", "bits")
    fresh = frame(range(5000, 6000)).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(S.BUCKETS)).cast("int"))
    stored = spark.read.parquet(path).filter("k IS NOT NULL").select("k", "bucket")
    assert S._maybe_known(stored, "k", members).count() == 505 and S._maybe_known(fresh, "k", members).count() <= 5


def test_jsonl_rejects_non_objects(spark, tmp_path):
    from oddsmith.sources.schemas import CASE

    (tmp_path / "x.jsonl").write_text('{"case_id": 1}\n\n[1, 2\n')
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "x.jsonl"), CASE).collect()


def test_leave_one_out_pool_is_bounded(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (-800.0,)], "x double").select(P.sigmoid("x").alias("s"))
    assert [round(r.s, 6) for r in df.collect()] == [0.5, 1.0, 0.0]


def test_weights_per_set(spark):
    from oddsmith.operators.scoring import normalize_weights

    rows = [("a", "x", 2.0), ("a", "y", 2.0), ("b", "x", None), ("b", "y", None), ("c", "x", -1.0), ("d", "x", 0.0)]
    out = {(r.s, r.c): (r.normalized, r.source) for r in normalize_weights(spark.createDataFrame(rows, "s string, c string, w double"), "s", "c", "w").collect()}
    assert out["a", "x"] == (0.5, "provided") and out["b", "y"] == (0.5, "cold_start")
    assert out["c", "x"][1] == "negative_weight" and out["d", "x"] == (None, "zero_sum")
    assert F is not None
