"""Uncertainty lists against plain lists; they are folded per file, not ranked per action."""

from oddsmith.operators import imports as I


def test_lists_are_the_first_lines_of_all_files_without_a_window(spark):
    files = spark.createDataFrame([(f"f{i:02}", i % 5 == 0) for i in range(40)], "path string, parse_error boolean")
    rows = [(f"f{i:02}", None if j < 2 else "f00", "static" if j == 0 else "dynamic", None if j == 1 else f"m{j}") for i in range(1, 40) for j in range(4)]
    edges = spark.createDataFrame(rows, "src string, tgt string, kind string, name string")
    expected = spark.createDataFrame([(1, f"f{i:02}") for i in range(40)] + [(1, "x"), (2, "f01"), (2, "f01"), (2, "y"), (3, "z")], "action_id int, path string")
    out = I.graph_uncertainty(expected, edges, files, keep=3)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.action_id: r for r in out.collect()}
    assert got[1].unresolved_imports == ["f01: m0", "f02: m0", "f03: m0"] and got[1].unresolved_import_count == 39
    assert got[1].dynamic_imports == ["f01: <dynamic>", "f01: m2", "f01: m3"] and got[1].dynamic_import_count == 117
    assert got[1].parse_error_files == ["f00", "f05", "f10"] and got[1].parse_error_count == 8 and got[1].missing_files == ["x"]
    assert got[2].missing_files == ["y"] and got[2].dynamic_import_count == 3 and got[2].wildcard_imports == []
    assert got[3].missing_file_count == 1 and got[3].dynamic_import_count == 0 and got[3].unresolved_imports == []
