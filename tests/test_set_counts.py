"""Neighbours and dependents of node sets against plain sets, and how many rows they write."""

import random

from oddsmith.operators import callgraph as G

EDGE = "source string, target string, kind string"


def data():
    rnd = random.Random(3)
    names = [f"n{i}" for i in range(20)]
    edges = sorted({(rnd.choice(names), rnd.choice(names), rnd.choice(("calls", "references", "instantiates", "contains"))) for _ in range(150)})
    return edges, sorted({(a, rnd.choice(names)) for a in range(30) for _ in range(1 + a % 4)})


def test_counts_equal_sets(spark):
    edges, members = data()
    e, m = spark.createDataFrame(edges + edges[:20], EDGE), spark.createDataFrame(members, "key int, node string")
    inside, near, direct = {}, {}, {}
    for a, n in members:
        inside.setdefault(a, set()).add(n)
    for a, nodes in inside.items():
        for s, t, kind in edges:
            if t in nodes:
                near.setdefault((a, "in", kind), set()).add(s)
                if kind != "contains" and s not in nodes:
                    direct.setdefault((a, kind), set()).add(s)
                    direct.setdefault((a, "*"), set()).add(s)
            if s in nodes:
                near.setdefault((a, "out", kind), set()).add(t)
    assert {(r.key, r.direction, r.kind): r.n for r in G.edge_kind_counts(m, e).collect()} == {k: len(v) for k, v in near.items()}
    assert {(r.key, r.kind): r.n for r in G.direct_impact_counts(m, e).collect()} == {k: len(v) for k, v in direct.items()}


def planned(df):
    """Aggregates in the plan of ``df``."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")


def test_neighbours_are_counted_per_node_and_dependents_once(spark, monkeypatch):
    kept = []

    def counted(df):
        df = df.localCheckpoint()
        kept.append(df.count())
        return df

    monkeypatch.setattr(G, "written", counted)
    edges = spark.createDataFrame([(f"n{i}", "n0", "calls") for i in range(1, 51)], EDGE)
    members = spark.range(400).selectExpr("id AS key", "'n0' AS node")
    out = G.edge_kind_counts(members, edges)
    assert kept == [400, 50, 400] and sorted({(r.direction, r.n) for r in out.collect()}) == [("in", 50)]
    # edges per (node, source), dependents per (set, source), counts per set
    assert planned(G.direct_impact_counts(members, edges)) == 3
