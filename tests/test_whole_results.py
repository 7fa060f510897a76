"""Streams over many unordered files, capped views and globs with sets."""

import fnmatch

import duckdb
import pytest
from pyspark.sql import functions as F

from check import norm
from oddsmith.functions import columns as Cx
from oddsmith.operators import callgraph as G
from oddsmith.plans import all_oracles, all_queries
from oddsmith.plans.bindings import TABLES
from oddsmith.streaming import jobs

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The smallest tables, ``orders`` as seven unordered part files."""
    folder = tmp_path_factory.mktemp("parts")
    for t in TABLES:
        if t == "orders":
            spark.read.parquet(f"{SOURCE}/{t}.parquet").repartition(7, F.rand(5)).write.parquet(f"{folder}/{t}.parquet")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{SOURCE}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("key", [k for k in sorted(all_queries()) if k.startswith("k0")])
def test_streams_over_many_batches(spark, parts, key, monkeypatch):
    plain = jobs.table_stream
    monkeypatch.setattr(jobs, "table_stream", lambda *a: plain(*a, files_per_trigger=1))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SOURCE}/{t}.parquet'")
    df = all_queries()[key](spark, parts)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = con.execute(all_oracles()[key])
    order = sorted(range(len(names)), key=lambda i: cur.description[i][0])
    assert got == sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def test_views_around_centres_are_whole_and_capped_ones_say_so(spark):
    links = [("b", "a"), ("a", "b"), ("c", "b"), ("d", "c"), ("a", "c")]
    edges = spark.createDataFrame([(s, t, "calls", 1) for s, t in links], "source string, target string, kind string, line int")
    nodes, among = G.subgraph_around(spark.createDataFrame([("a",), ("a",)], "id string"), edges, depth=3)
    assert {(r.id, r.depth) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)} and among.count() == 5
    shown, inside, about = G.capped_view(nodes, among, ["depth"], 2, 1)
    assert [r.id for r in shown.orderBy("depth").collect()] == ["a", "b"] and [(r.source, r.target) for r in inside.collect()] == [("a", "b")]
    assert about.first().asDict() == {"total_nodes": 4, "total_edges": 5, "shown_nodes": 2, "shown_edges": 1, "truncated": True}
    assert not G.capped_view(nodes, among, ["depth"], 4, 5)[2].first().truncated


def test_globs_with_sets(spark):
    globs = ["pkg/[ab]*.py", "pkg/[!a]?.py", "[x.py", "a[0-9].py", "*.[ch]", "p[&^]q", "no.set"]
    paths = ["pkg/a1.py", "pkg/b.py", "pkg/c1.py", "pkg/a1xpy", "[x.py", "a7.py", "m.c", "m.h", "m.x", "p&q", "p^q", "no.set", "noxset"]
    df = spark.createDataFrame([(g, p) for g in globs for p in paths], "g string, p string")
    got = {(r.g, r.p) for r in df.filter(F.regexp_like("p", Cx.glob_regex_column("g"))).collect()}
    assert got == {(g, p) for g in globs for p in paths if fnmatch.fnmatchcase(p, g)}


def test_hash_tree_finds_changes_and_proves_rows(spark):
    from oddsmith.operators import ledger as L

    rows = [(g, i, f"c{i}" if i % 7 else None) for g, n in (("a", 50), ("b", 3)) for i in range(n)]
    frame = lambda rs: spark.createDataFrame(rs, "g string, id long, content_json string")
    tree = lambda rs, height=None: L.merkle_levels(frame(rs), ["g"], fanout=4, height=height)
    one = tree(rows)
    roots = {r.g: r.digest for r in one[-1].collect()}
    assert len(one) == 4 and len(roots) == 2
    swapped = [(g, i, {3: "c4", 4: "c3"}.get(i, c) if g == "a" else c) for g, i, c in rows]
    empty = [(g, i, "" if c is None else c) for g, i, c in rows]
    for other, where in ((swapped, {("a", 3), ("a", 4)}), (empty, {(g, i) for g, i, c in rows if c is None}), (rows + [("b", 3, "new")], {("b", 3)})):
        two = tree(other)
        assert {r.g for r in two[-1].collect() if r.digest != roots[r.g]} == {g for g, _ in where}
        assert {(r.g, r.node) for r in L.changed_ranges(one, two, ["g"], fanout=4).collect()} == where
    place = spark.createDataFrame([("a", 37), ("b", 2)], "g string, node long")
    proof = L.inclusion_proof(one, place, ["g"], fanout=4)
    assert proof.count() <= 2 * 3 * 4 and all(r.holds for r in L.proof_holds(proof, one[-1], ["g"]).collect())
    forged = proof.withColumn("digest", F.when((F.col("g") == "a") & (F.col("level") == 0) & (F.col("node") == 37), "0" * 64).otherwise(F.col("digest")))
    assert {r.g: r.holds for r in L.proof_holds(forged, one[-1], ["g"]).collect()} == {"a": False, "b": True}


def test_ranges_are_even_whatever_the_ids(spark, monkeypatch):
    ids = [*range(1000), *(10**12 + 7 * i for i in range(1000)), *([5] * 10), -(10**15)]
    df = spark.createDataFrame([(i % 3, x) for i, x in enumerate(dict.fromkeys(ids))], "g int, id long")
    n = {r.b: r.n for r in df.groupBy(Cx.equi_depth(df, "id", 100).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert len(n) >= 18 and max(n.values()) <= 130
    order = [r.id for r in df.withColumn("b", Cx.equi_depth(df, "id", 100)).orderBy("b", "id").collect()]
    assert order == sorted(order)
    monkeypatch.setattr(Cx, "RANGE_ROWS", 100)
    got = {(r.g, r.id): r.position for r in Cx.running_positions(df, ["g"], "id").collect()}
    for g in range(3):
        assert [got[g, x] for x in sorted(x for h, x in got if h == g)] == list(range(1, 1 + sum(h == g for h, _ in got)))
    prev = {(r.g, r.id): r.prev and r.prev.id for r in Cx.previous_row(df, ["g"], "id", ["id"]).collect()}
    mine = sorted(x for h, x in got if h == 1)
    assert [prev[1, x] for x in mine] == [None, *mine[:-1]]
    assert Cx.equi_depth(df.limit(0), "id") is not None and Cx.running_positions(df.limit(0), ["g"], "id").collect() == []
