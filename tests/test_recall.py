"""The inverted index against a plain search, and the capped view on top of it."""

import random
import re
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from oddsmith.operators import recall as R


def plain(queries, lessons):
    docs = [(i, repo, Counter(re.findall("[a-z0-9_]+", (t or "").lower()))) for i, repo, t in lessons]
    avg = sum(sum(d.values()) for *_, d in docs) / len(docs)
    out = {}
    for q, repo, text in queries:
        terms = set(re.findall("[a-z0-9_]+", (text or "").lower()))
        idf = {t: max(1e-6, log((len(docs) - n + 0.5) / (n + 0.5))) for t in terms if (n := sum(t in d for *_, d in docs))}
        hits = [(sum(idf[t] * d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / avg)) for t in terms), i) for i, r, d in docs if terms and r == repo and terms <= d.keys()]
        for k, (score, i) in enumerate(sorted(hits, key=lambda h: (-round(h[0], 9), -h[1]))):
            out[q, i] = (k + 1, pytest.approx(score))
    return out


def test_index_equals_plain_search(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice(["common"] * 6 + [f"w{rng.randint(0, 25)}"])
    lessons = [(rng.choice([i, i, i * 1000 - 5_000]), rng.choice("ab"), " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(400)]
    lessons = list({i: (i, r, t) for i, r, t in lessons}.values()) + [(10**9, "a", None), (10**9 + 1, "a", "Only, HERE! only")]
    queries = [(f"q{k}", rng.choice("abc"), " ".join(word() for _ in range(rng.randint(1, 4)))) for k in range(40)] + [("none", "a", "?!"), ("null", "a", None), ("odd", "a", "here only ONLY"), ("miss", "a", "only nowhere")]
    frame = spark.createDataFrame(lessons, "lesson_id long, repo_id string, text string")
    R.build_index(frame, f"{tmp_path}/x")
    got = R.ranked_recall(spark, spark.createDataFrame(queries, "query_id string, repo_id string, text string"), f"{tmp_path}/x").collect()
    assert {(r.query_id, r.lesson_id): (r.position, r.score) for r in got} == plain(queries, lessons)
    assert max(r.position for r in got) > 64 and ("odd", 10**9 + 1) in {(r.query_id, r.lesson_id) for r in got}
    assert spark.read.parquet(f"{tmp_path}/x/postings").filter(F.size("entries") > 1 << R.BLOCK_BITS).count() == 0


def test_lists_of_asked_terms_alone_give_the_same_scores(spark, tmp_path):
    rng = random.Random(4)
    lessons = [(i, rng.choice("ab"), " ".join(f"w{rng.randint(0, 12)}" for _ in range(rng.randint(0, 20)))) for i in range(300)] + [(900, "a", None)]
    queries = [(f"q{k}", rng.choice("ab"), f"w{k} w{k + 1}") for k in range(5)]
    frame, asked = spark.createDataFrame(lessons, "lesson_id long, repo_id string, text string"), spark.createDataFrame(queries, "query_id string, repo_id string, text string")
    R.build_index(frame, f"{tmp_path}/x", R.asked_terms(asked))
    got = R.ranked_recall(spark, asked, f"{tmp_path}/x").collect()
    assert {(r.query_id, r.lesson_id): (r.position, r.score) for r in got} == plain(queries, lessons) and got
    assert {r.term for r in spark.read.parquet(f"{tmp_path}/x/postings").select("term").distinct().collect()} == {None, *(f"w{k}" for k in range(6))}


def test_texts_are_shuffled_once_and_words_never(spark):
    frame = spark.createDataFrame([(1, "a", "x y"), (2, "a", None)], "lesson_id long, repo_id string, text string")
    lists = R.posting_lists(frame)
    assert lists.count() == 3 and lists._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_budget_pick_reports_what_it_leaves_out(spark):
    files = lambda i: [f"f{i % 2}", "same"]
    rows = [("five", p, p, 10, files(p), []) for p in range(1, 8)] + [("large", 1, 1, 900, files(1), ["s"]), ("large", 2, 2, 10, files(2), ["s", "t"]), ("all", 1, 9, 100, [], [])] + [("many", p, p, 2000, [], []) for p in range(1, 70)]
    ranked = spark.createDataFrame(rows, "query_id string, position int, lesson_id long, size int, files array<string>, symbols array<string>")
    queries = spark.createDataFrame([(q,) for q in ("five", "large", "all", "many", "nothing")], "query_id string")
    got = {r.query_id: r for r in R.budget_pick(queries, ranked, 100).collect()}
    assert (got["five"].picked, got["five"].truncated, got["five"].files) == ([1, 2, 3, 4, 5], True, ["f1", "same", "f0"])
    assert (got["large"].picked, got["large"].used_bytes, got["large"].truncated, got["large"].symbols) == ([2], 10, True, ["s", "t"])
    assert (got["all"].picked, got["all"].truncated, got["all"].matches) == ([9], False, 1)
    assert (got["many"].picked, got["many"].status, got["many"].truncated, got["many"].matches) == ([], "empty", True, 69)
    assert (got["nothing"].picked, got["nothing"].status, got["nothing"].truncated) == ([], "empty", False)
