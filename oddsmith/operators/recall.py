"""Ranked recall of past lessons over a stored inverted index, and the building of lesson rows.

The index has two Parquet tables.  ``postings``: for a term and a block of ``BLOCK`` neighbouring lesson ids, who holds
it, how often, and how long the lesson is; the lists of the term NULL hold every lesson.  ``terms``: how many lessons of a repository
hold a term.  A term in a third of all lessons is spread over its blocks.

A query asks for lessons with all its terms.  Its rarest term names the blocks that can match; a
block in which another term has no posting is left out by the block keys alone, before any list is read.
Only the lists of the blocks that are left are read, cut to the rarest term's lessons and added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddsmith.session import written

WORD = "[A-Za-z0-9_]+"
BLOCK_BITS = 7
K1, B = 1.2, 0.75


def words(c: str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def posting_lists(lessons: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Lists of ``lessons(lesson_id, repo_id, text)`` by block, repository and term; with ``terms(term)`` those of these terms only.

    Texts are shuffled once, by block, and read once: words are counted and lists made where the block is.
    """
    docs = lessons.select(F.shiftright("lesson_id", BLOCK_BITS).alias("block"), "repo_id", "lesson_id", "text").repartition("block")
    docs = docs.withColumn("w", F.coalesce(words("text"), F.array().cast("array<string>"))).drop("text")
    rows = docs.withColumn("len", F.size("w")).withColumn("term", F.explode(F.concat(F.array(F.lit(None).cast("string")), "w"))).drop("w")
    if terms is not None:
        rows = rows.join(terms.select("term").distinct().withColumn("_asked", F.lit(True)), "term", "left").filter("term IS NULL OR _asked")
    counts = rows.groupBy("block", "repo_id", "term", "lesson_id", "len").agg(F.count(F.lit(1)).alias("tf"))
    return counts.groupBy("block", "repo_id", "term").agg(F.sort_array(F.collect_list(F.struct("lesson_id", "tf", "len"))).alias("entries"), F.count(F.lit(1)).alias("n"))


def build_index(lessons: DataFrame, path: str, terms: DataFrame | None = None) -> None:
    """Writes the index of ``lessons(lesson_id, repo_id, text)`` under ``path``; a null text has no term.

    If all that will be asked is known, ``terms`` keeps the lists that nobody asks for out; lengths and counts are those of whole texts.
    """
    posting_lists(lessons, terms).sortWithinPartitions("term", "repo_id", "block").write.parquet(f"{path}/postings")
    postings = lessons.sparkSession.read.parquet(f"{path}/postings").filter("term IS NOT NULL")
    postings.groupBy("repo_id", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).write.parquet(f"{path}/terms")


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "repo_id", F.explode(F.array_distinct(words("text"))).alias("term"))


def ranked_recall(spark: SparkSession, queries: DataFrame, path: str, k1: float = K1, b: float = B) -> DataFrame:
    """Every lesson of the query's repository that holds every term of ``queries(query_id, repo_id, text)``, best BM25 first.

    ``query_id, lesson_id, score, position``.  A query without a term finds nothing.
    """
    index, known = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
    postings = index.filter("term IS NOT NULL")
    every = index.filter("term IS NULL").select(F.explode("entries").alias("e")).agg(
        F.coalesce(F.sum("e.tf"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("e.tf") * F.col("e.len")), F.lit(0)).alias("words")).first()
    total, avg = every["n"], every["words"] / max(1, every["n"])
    terms = written(asked_terms(queries))
    need = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    asked = known.join(terms.select("term").distinct(), "term", "left_semi")
    held = asked.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    found = written(terms.join(asked.select("repo_id", "term", "n"), ["repo_id", "term"]).join(held.select("term", idf.alias("idf")), "term"))
    rarest = found.groupBy("query_id", "repo_id").agg(F.min(F.struct("n", "term"))["term"].alias("term"), F.count(F.lit(1)).alias("got"))
    rarest = written(rarest.join(need, "query_id").filter("got = need").select("query_id", "repo_id", "term", "need"))
    # blocks that hold all terms, from keys alone
    first = written(rarest.join(postings.select("repo_id", "term", "block"), ["repo_id", "term"]).select("query_id", "repo_id", "need", "block"))
    keys = first.join(found.select("query_id", "term"), "query_id").join(postings.select("repo_id", "term", "block"), ["repo_id", "term", "block"])
    full = written(keys.groupBy("query_id", "repo_id", "block", "need").agg(F.count(F.lit(1)).alias("got")).filter("got = need").drop("got"))
    # their lists, cut to the lessons of the rarest term
    start = full.join(rarest.select("query_id", "term"), "query_id").join(postings.select("repo_id", "term", "block", F.col("entries.lesson_id").alias("ids")), ["repo_id", "term", "block"])
    lists = start.drop("term").join(found.select("query_id", "term", "idf"), "query_id").join(postings.select("repo_id", "term", "block", "entries"), ["repo_id", "term", "block"])
    hits = lists.select("query_id", "need", "idf", "ids", F.explode("entries").alias("e")).filter(F.array_contains("ids", F.col("e.lesson_id")))
    weight = F.col("e.tf") * (k1 + 1) / (F.col("e.tf") + k1 * (1 - b + b * F.col("e.len") / avg))
    scored = hits.groupBy("query_id", F.col("e.lesson_id").alias("lesson_id"), "need").agg(F.sum(F.col("idf") * weight).alias("score"), F.count(F.lit(1)).alias("got")).filter("got = need")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("lesson_id"))
    return scored.select("query_id", "lesson_id", "score").withColumn("position", F.row_number().over(order))


def budget_pick(queries: DataFrame, ranked: DataFrame, budget: int, most: int = 5, window: int = 64, hints: int = 16) -> DataFrame:
    """What fits a reader's budget, per query: a capped view of ``ranked(query_id, lesson_id, position, size, files, symbols)``.

    The first ``window`` rows are gone through in order, one too large is skipped, ``most`` picks end
    it.  ``truncated`` tells whether any match was not picked or not looked at; ``status`` is ``available`` or
    ``empty``; file and symbol hints are the first ``hints`` different ones of the picks.
    """
    seen = F.when(F.col("position") <= window, F.struct(F.col("position").alias("p"), F.col("size").cast("bigint").alias("s"), F.col("lesson_id").alias("id"), "files", "symbols"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("inspected"), F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("files"), F.array().cast("array<string>").alias("symbols"))

    def step(acc, r):
        more = F.size(acc["ids"]) < most
        fits = more & (acc["used"] + r["s"] <= budget)
        grown = lambda c: F.when(fits, F.array_distinct(F.concat(acc[c], r[c]))).otherwise(acc[c]).alias(c)
        return F.struct(
            F.when(fits, acc["used"] + r["s"]).otherwise(acc["used"]).alias("used"), F.when(more, acc["inspected"] + 1).otherwise(acc["inspected"]).alias("inspected"),
            F.when(fits, F.array_append(acc["ids"], r["id"])).otherwise(acc["ids"]).alias("ids"), grown("files"), grown("symbols"))

    rows = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(seen)).alias("r"), F.count(F.lit(1)).alias("matches"))
    done = queries.select("query_id").distinct().join(rows, "query_id", "left").withColumn("x", F.aggregate(F.coalesce("r", F.expr("cast(array() as array<struct<p:int,s:bigint,id:bigint,files:array<string>,symbols:array<string>>>)")), start, step))
    picked, n = F.size("x.ids"), F.coalesce("matches", F.lit(0))
    truncated = (n > window) | (F.col("x.inspected") < F.least(n, F.lit(window))) | (picked < F.col("x.inspected"))
    return done.select(
        "query_id", F.when(picked > 0, "available").otherwise("empty").alias("status"), F.col("x.used").alias("used_bytes"), F.col("x.ids").alias("picked"),
        F.slice("x.files", 1, hints).alias("files"), F.slice("x.symbols", 1, hints).alias("symbols"), n.alias("matches"), truncated.alias("truncated"))


SYMBOL = "^[A-Za-z_][A-Za-z0-9_.]{0,127}$"
GATE_NAME = "^[a-z][a-z0-9_]{0,63}$"


def lesson_rows(assessments: DataFrame, outcomes: DataFrame, guardrails: DataFrame) -> DataFrame:
    """Lessons of completed outcomes whose latest verification said proceed, as fields and as a sentence.

    ``guardrails`` holds the latest row per assessment.  Symbols and gate names must match their patterns; lists are
    sorted, distinct and whole, and so is the task.
    """
    kept = lambda c, pattern: F.array_sort(F.array_distinct(F.filter(c, lambda x: x.rlike(pattern))))
    done = (
        assessments.join(outcomes.filter("terminal_status = 'completed'"), "assessment_id")
        .join(guardrails.filter("pre_commit_decision = 'proceed'"), "assessment_id")
        .filter("repo_id <> '' AND task <> '' AND action_id <> ''")
        .filter(F.col("assessment_hash").rlike("^[0-9a-f]{64}$") & F.col("outcome_hash").rlike("^[0-9a-f]{64}$"))
    )
    gates, decision = kept("gate_names", GATE_NAME), F.coalesce("decision", F.lit("unknown"))
    clause = F.when(F.size(gates) > 0, F.concat(F.lit(" Stable gates: "), F.array_join(gates, ", "), F.lit("."))).otherwise("")
    lesson = F.concat(F.lit("Verified completed outcome for "), "task", F.lit("; decision was "), decision, F.lit("."), clause)
    return done.select(
        "assessment_id", "repo_id", "task", "action_id", decision.alias("decision"), "terminal_status",
        kept("symbols", SYMBOL).alias("symbols"), gates.alias("gates"), "measured_benefit", lesson.alias("lesson"))
