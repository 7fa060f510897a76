"""Each stage of the pipeline against what it should keep, over a small folder."""

import corpus_pipeline as C
from llm.test_near_copies import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, rows, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, tmp_path):
    text = lambda i: " ".join(f"wort{i}x{j} the of and" for j in range(25))
    item = "this passage of the benchmark is long enough to have many shingles of five words each"
    rows = [(i, text(i), "en", "s", 1) for i in range(10)] + [(20, text(3), "en", "t", 1), (21, None, "en", None, None), (22, "12 34", None, "s", 2), (23, "start " + text(50) + " " + item, "en", "s", 3), (24, text(60) + " mail a.b@c.com now", "en", "s", 4)]
    rows += [rows[0], (None, text(4), "en", "s", 1), (None, text(70), "en", "s", 1)]
    sf = folder(spark, tmp_path / "sf", rows, [(1, item), (2, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = C.language(spark, docs, sf)
    assert {r.doc_id for r in first.collect()} == {*range(10), 20, 23, 24, None} and tuple(first.columns) == C.COLUMNS
    second = C.near_copies(spark, first, sf)
    kept = sorted(([r.doc_id, r.text] for r in second.collect()), key=repr)
    named = [(i, t) for i, t, *_ in rows if t and t != "12 34" and i is not None]
    assert sorted(i for i, _ in kept if i is not None) == sorted({c for _, _, c in brute_components(named)})
    assert [t for i, t in kept if i is None] == [text(70)]
    third = C.leaks(spark, second, sf)
    assert third.count() == second.count() - 1 and 23 not in {r.doc_id for r in third.collect()}
    fourth = C.personal_data(spark, third, sf)
    assert {r.doc_id: r.text for r in fourth.collect()}[24].endswith(" mail [EMAIL] now")
    assert {r.doc_id for r in C.packed(spark, fourth, sf).collect()} == {r.doc_id for r in third.collect()}
    assert C.run(spark, sf).count() == C.packed(spark, fourth, sf).count()


def test_no_rows(spark, tmp_path):
    sf = folder(spark, tmp_path / "sf", [], [(1, "a b c d e f g")])
    assert C.run(spark, sf).count() == 0


def test_documents_that_share_an_id_or_have_none(spark, tmp_path):
    text = lambda i: " ".join(f"wort{i}x{j} the of and" for j in range(25))
    item = "this passage of the benchmark is long enough to have many shingles of five words each"
    rows = [(d, t, "en", "s", 1) for d in (None, 5) for t in (text(80 + (d or 0)), text(90 + (d or 0)), f"start {text(70 + (d or 0))} {item}")]
    sf = folder(spark, tmp_path / "sf", rows, [(1, item)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = lambda rs: sorted(((r.doc_id, r.text) for r in rs), key=repr)
    assert order(C.near_copies(spark, docs, sf).collect()) == sorted((r[:2] for r in rows), key=repr)
    assert order(C.leaks(spark, docs, sf).collect()) == sorted((r[:2] for r in rows if item not in r[1]), key=repr)
    found = C.decontam.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert sorted(((r.doc_id, r.item_id, r.similarity, r.start_word) for r in found), key=repr) == [(5, 1, 1.0, 101), (None, 1, 1.0, 101)]


def test_clashing_columns(spark, tmp_path):
    text = lambda i: " ".join(f"wort{i}x{j} the of and" for j in range(25))
    item = "this passage of the benchmark is long enough to have many shingles of five words each"
    sf = folder(spark, tmp_path / "sf", [(1, text(1), "en", "s", 1), (2, f"{text(2)} {item}", "en", "s", 1)], [(1, item)])
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", *[f"'x' AS {c}" for c in ("leaking", "mark", "row", "id", "t", "lang_pred", "score", "component", "keep", "n")])
    for _, stage in C.STAGES[:3]:
        docs = stage(spark, docs, sf)
    assert [r.doc_id for r in docs.collect()] == [1] and len(docs.columns) == 15
