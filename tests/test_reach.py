"""Reach of sets and owners against a plain walk, and how many rows it writes."""

import random

import pytest

from oddsmith.operators import callgraph as G

NODE = "id string, kind string, file_path string, qualified_name string, start_line int"
EDGE = "source string, target string, kind string, line int, col int"


@pytest.fixture(scope="module")
def graph(spark):
    rnd = random.Random(7)
    names = [f"n{i}" for i in range(40)]
    nodes = [(n, "class" if i % 7 == 0 else "function", f"f{i % 5}", f"q{i % 9}", i) for i, n in enumerate(names)]
    pairs = {(rnd.choice(names), rnd.choice(names)) for _ in range(60)}
    edges = [(s, t, "calls", rnd.randrange(3), 0) for s, t in sorted(pairs)] + [("n7", f"n{i}", "contains", 0, 0) for i in (1, 2, 14)]
    members = sorted({(a, rnd.choice(names)) for a in range(25) for _ in range(1 + a % 4)})
    return nodes, edges, members


def walk(targets, blocked, back, depth=3):
    seen, now = {}, set(targets)
    for d in range(1, depth + 1):
        now = {s for t in now for s in back.get(t, ()) if s not in blocked and s not in seen}
        seen |= dict.fromkeys(now, d)
    return seen


def expected(edges, members):
    back, up = {}, {}
    for s, t, kind, *_ in edges:
        (up if kind == "contains" else back).setdefault(t, set()).add(s)

    def above(n):
        out, now = {n}, {n}
        while now:
            now = {p for x in now for p in up.get(x, ())} - out
            out |= now
        return out

    sets = {}
    for a, n in members:
        sets.setdefault(a, set()).update(above(n))
    return {a: walk(t, t, back) for a, t in sets.items()}, {(a, n): walk(above(n), sets[a], back) for a, n in members}


def frames(spark, graph):
    nodes, edges, members = graph
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), members


@pytest.mark.parametrize("entries", [1, 12, 100_000])
def test_set_reach_equals_a_walk(spark, graph, entries):
    nodes, edges, members = frames(spark, graph)
    out = G.set_reach_summary(spark.createDataFrame(members, "key int, node string"), nodes, edges, entries)
    got = {r.key: (r.transitive_count, r.depth1, r.depth2, r.depth3) for r in out.collect()}
    sets, _ = expected(*graph[1:])
    assert got == {a: (len(w), *[list(w.values()).count(d) for d in (1, 2, 3)]) for a, w in sets.items() if w}


def test_witnesses_equal_a_walk_with_owners_of_one_name(spark, graph):
    nodes, edges, members = frames(spark, graph)
    about = {n: (f, q) for n, _, f, q, _ in graph[0]}
    _, owners = expected(*graph[1:])
    want = {}
    for (a, o), w in owners.items():
        want.setdefault(a, []).extend((d, about[o][1], about[n][1], about[n][0]) for n, d in w.items())
    rows = spark.createDataFrame(members, "action int, key string")
    got = {}
    for r in G.impact_witnesses(rows, nodes, edges).collect():
        assert r.n_witnesses == len(want[r.action]) and not r.truncated
        got.setdefault(r.action, {})[r.position] = (r.depth, r.owner_name, r.dependent_name, r.file_path)
    assert {a: [p[i + 1] for i in range(len(p))] for a, p in got.items()} == {a: sorted(x) for a, x in want.items() if x}


def test_an_owner_is_walked_once_for_all_its_actions(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", "function", "f", f"q{i}", i) for i in range(60)], NODE)
    edges = spark.createDataFrame([(f"n{i}", "n0", "calls", 1, 0) for i in range(1, 51)], EDGE)
    rows = 0

    def counted(df):
        nonlocal rows
        df = df.localCheckpoint()
        rows += df.count()
        return df

    monkeypatch.setattr(G, "cut_lineage", counted)
    monkeypatch.setattr(G, "written", counted, raising=False)
    members = spark.range(400).selectExpr("id AS action", "'n0' AS key")
    out = G.owner_evidence(members, nodes, edges).collect()
    assert len(out) == 400 and all(r.transitive_count == 50 for r in out)
    assert rows < 400 * 50
