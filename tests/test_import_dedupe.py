"""Deduplicated imports: dealt out to tasks that follow the table, and counted once."""

from oddsmith.operators import imports as I


def test_dealt_edges_and_their_counts(spark):
    raw = spark.createDataFrame([("a", "b", "dynamic", "x"), ("a", "b", "static", "y"), ("a", "a", "static", "z"), ("a", None, "static", "m"), ("a", None, "static", "n"), ("b", None, None, "m")],
                                "src string, tgt string, kind string, name string")
    edges = I.dedupe_imports(raw, 37)
    assert {tuple(r) for r in edges.collect()} == {tuple(r) for r in I.dedupe_imports(raw).collect()}
    assert "37" in edges._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")[0].rsplit("hashpartitioning", 1)[1]
    want = {tuple(r) for r in edges.groupBy("src", "tgt", "kind").count().collect()}
    assert {tuple(r) for r in I.edge_counts(edges).select("src", "tgt", "kind", "n").collect()} == want
