"""Reverse blast against a plain walk per action, and how many rows it writes."""

import random

import pytest

from oddsmith.operators import imports as I

KINDS = ("static", "relative", "wildcard", "dynamic", "external")


@pytest.fixture(scope="module")
def graph():
    rnd = random.Random(11)
    files = [(f"f{i}", i % 9 == 0) for i in range(50)]
    names = [f for f, _ in files] + ["gone"]
    edges = [(s, t, rnd.choice(KINDS)) for s, t in sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(110)}) if s != t]
    changed = sorted({(a, rnd.choice(names)) for a in range(40) for _ in range(1 + a % 4)})
    return files, edges, changed


def walked(files, edges, changed, depth=3):
    back, entry, out = {}, dict(files), {}
    for s, t, kind in edges:
        back.setdefault(t, []).append((s, {"static": 0.85, "relative": 0.75, "wildcard": 0.35, "dynamic": 0.15}.get(kind, 0.1)))
    for a in {a for a, p in changed if p in entry}:
        now = {p for b, p in changed if b == a and p in entry}
        seen, rounds = set(now), []
        for _ in range(depth):
            found = {}
            for node in sorted(now):
                for s, c in back.get(node, ()):
                    if s not in seen:
                        found.setdefault(s, c)
            rounds.append(found)
            now = set(found)
            seen |= now
        conf = [c for r in rounds for c in r.values()]
        out[a] = (len(rounds[0]), len(conf) - len(rounds[0]), sum(c < 0.5 for c in conf), round(sum(conf) / len(conf), 9) if conf else 0.0,
                  min(conf, default=0.0), any(entry.get(n) for n in seen))
    return out


def frames(spark, graph):
    files, edges, changed = graph
    return (spark.createDataFrame(changed, "action_id int, path string"),
            spark.createDataFrame(edges, "src string, tgt string, kind string"),
            spark.createDataFrame(files, "path string, is_entrypoint boolean"))


@pytest.mark.parametrize("most", [1, 12, 1_000_000])
def test_blast_equals_a_walk(spark, graph, most):
    rows = I.reverse_blast(*frames(spark, graph), most=most).collect()
    got = {r.action_id: (r.direct_count, r.transitive_count, r.low_confidence_edge_count, round(r.edge_confidence_mean, 9), r.edge_confidence_min, r.entrypoint_signal) for r in rows}
    assert len(rows) == len(got) and got == walked(*graph)


def test_a_file_is_walked_once_for_all_its_actions(spark, monkeypatch):
    rows = 0

    def counted(df):
        nonlocal rows
        df = df.localCheckpoint()
        rows += df.count()
        return df

    monkeypatch.setattr(I, "cut_lineage", counted)
    monkeypatch.setattr(I, "written", counted)
    files = spark.createDataFrame([(f"n{i}", i == 7) for i in range(60)], "path string, is_entrypoint boolean")
    edges = spark.createDataFrame([(f"n{i}", "n0", "static") for i in range(1, 51)], "src string, tgt string, kind string")
    changed = spark.range(400).selectExpr("id AS action_id", "explode(array('n0', 'n55')) AS path")
    out = I.reverse_blast(changed, edges, files).collect()
    assert len(out) == 400 and all(r.direct_count == 50 and r.entrypoint_signal for r in out)
    assert rows < 400 * 50


def test_blast_equals_a_walk_if_origins_are_reduced_in_parts(spark, graph, monkeypatch):
    monkeypatch.setattr(I, "FOLD_ENTRIES", 2, raising=False)
    test_blast_equals_a_walk(spark, graph, 1_000_000)


def test_lists_of_dependents_travel_packed(spark):
    back = spark.range(1, 3001).selectExpr("0L AS node", "id * 7 AS importer", "(id % 5) * 32 + 4 AS edge")
    row = I.file_reach(spark.sql("SELECT 0L AS number, 1L AS edge"), back).first()
    assert row.n == 3001 and len(row.packed) < 3 * row.n
    unpacked = I._lists()[1](row.packed)
    assert unpacked.tolist() == [1] + [(i * 7 << I._NUMBER) + (1 << I._DEPTH) + (i % 5) * 32 + 4 for i in range(1, 3001)]
