"""Cycles and what leads to them against a plain search, and the number of rounds on long paths."""

import random

from oddsmith.operators import imports as I

EDGES = "src string, tgt string"


def reachable(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    seen = {}
    for n in out:
        todo, found = list(out[n]), set()
        while todo:
            x = todo.pop()
            if x not in found:
                found.add(x)
                todo += out[x]
        seen[n] = found
    return seen


def test_cycles_equal_plain_search(spark):
    for seed, n, m in ((2, 40, 50),):
        rng = random.Random(seed)
        pairs = [(f"f{rng.randint(0, n)}", f"f{rng.randint(0, n)}") for _ in range(m)] + [("loop", "loop"), ("x", "loop")]
        edges = spark.createDataFrame([*pairs, ("f1", None), (None, None)], EDGES)
        proper = reachable([p for p in pairs if p[0] != p[1]])
        want = sorted(v for v, to in proper.items() if v in to)
        got = I.cycle_files(edges)
        assert sorted(r.path for r in got.collect()) == want
        on = set(want) | {a for a, b in pairs if a == b}
        assert sorted(r.path for r in I.leads_to_cycle(edges, got).collect()) == sorted(on | {v for v, to in proper.items() if to & on})


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert I.cycle_files(none).collect() == I.leads_to_cycle(none, spark.createDataFrame([], "path string")).collect() == []


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    states = []
    monkeypatch.setattr(I, "written", lambda df, real=I.written: states.append(1) or real(df))
    n = 256
    ring = spark.createDataFrame([(f"r{i:03d}", f"r{(i + 1) % n:03d}") for i in range(n)], EDGES)
    assert I.cycle_files(ring).count() == n
    assert len(states) <= 60  # a walk would need 256 rounds in either direction
