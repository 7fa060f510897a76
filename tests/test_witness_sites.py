"""Where a witness is seen, and that descriptions of witnesses are not kept per owner."""

from oddsmith.operators import callgraph as G


def test_first_sites_and_no_descriptions_in_states(spark, monkeypatch):
    kept, write = [], G.written

    def recorded(df):
        kept.append(set(df.columns))
        return write(df)

    monkeypatch.setattr(G, "written", recorded)
    nodes = spark.createDataFrame([(f"n{i}", "function", f"d\\f{i}", f"q{i}", 10 * i) for i in range(5)], "id string, kind string, file_path string, qualified_name string, start_line int")
    edges = spark.createDataFrame(
        [("n1", "n0", "calls", 0, 0), ("n1", "n0", "references", 5, 1), ("n1", "n0", "calls", 5, 2), ("n2", "n0", "calls", None, 0), ("n3", "n1", "calls", 8, 0), ("n3", "n1", "calls", 8, 0)],
        "source string, target string, kind string, line int, col int")
    members = spark.createDataFrame([(1, "n0"), (2, "n0"), (2, "n3"), (3, "gone")], "action int, key string")
    rows = G.impact_witnesses(members, nodes, edges).collect()
    got = sorted((r.action, r.position, r.owner_name, r.dependent_name, r.file_path, r.depth, r.line, r.edge_kind, r.location_source) for r in rows)
    first = [("q0", "q1", "d/f1", 1, 5, "references", "edge_site"), ("q0", "q2", "d/f2", 1, 20, "calls", "node_definition")]
    assert got == [(1, i + 1, *x) for i, x in enumerate([*first, ("q0", "q3", "d/f3", 2, 30, "", "node_definition")])] + [(2, i + 1, *x) for i, x in enumerate(first)]
    assert not any({"key", "file_path"} <= columns for columns in kept)
