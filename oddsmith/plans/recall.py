"""Recall plans: every benchmark text, whole, asked of every repository."""

from pyspark.sql import functions as F

from oddsmith.operators import recall as R
from oddsmith.plans.catalog import plan
from oddsmith.session import written
from oddsmith.sources.tables import scratch

_W = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
_Q = f"""
src AS (SELECT DISTINCT repo_id FROM lessons),
q0 AS (SELECT query_id || '/' || repo_id AS query_id, repo_id, unnest(list_distinct({_W})) AS term FROM recall_queries, src),
nd AS (SELECT query_id, count(*) AS need FROM q0 GROUP BY 1),
dl AS (SELECT lesson_id, repo_id, n_chars, {_W} AS w, len({_W}) AS l FROM lessons),
tk AS (SELECT lesson_id, repo_id, l, unnest(w) AS term FROM dl), tf AS (SELECT lesson_id, repo_id, l, term, count(*) AS f FROM tk WHERE term IN (SELECT term FROM q0) GROUP BY ALL),
dfq AS (SELECT term, count(*) AS d FROM tf GROUP BY 1),
sc AS (SELECT query_id, lesson_id, sum(greatest(1e-6, ln(((SELECT count(*) FROM dl) - d + 0.5) / (d + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / (SELECT avg(l) FROM dl)))) AS s, count(*) AS got
  FROM q0 JOIN dfq USING (term) JOIN tf USING (repo_id, term) GROUP BY 1, 2),
rk AS (SELECT query_id, lesson_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, lesson_id DESC) AS position FROM sc JOIN nd USING (query_id) WHERE got = need)
"""


def _queries(m):
    repos = m.lessons.agg(F.collect_set("repo_id").alias("x")).select("x").scalar()  # a query is a text and a repository
    return m.recall_queries.withColumn("repo_id", F.explode(repos)).select(F.concat_ws("/", F.col("query_id").cast("string"), "repo_id").alias("query_id"), "repo_id", "text")


def _recall(m, queries):
    path = scratch(m.spark, "lesson-index")
    R.build_index(m.lessons, path, written(R.asked_terms(queries).select("term").distinct()))  # as in the SQL, lists nobody asks for are not made
    return R.ranked_recall(m.spark, queries, path)


@plan("j01_ranked_recall", f"WITH {_Q} SELECT query_id, lesson_id, R(s) AS score, cast(position as int) AS position FROM rk")
def _(m):
    return _recall(m, _queries(m))


@plan("j02_budget_pick", f"""WITH RECURSIVE {_Q}, rr AS (SELECT query_id, lesson_id, position, n_chars FROM rk JOIN dl USING (lesson_id)),
g(query_id, position, used, ids, seen) AS (SELECT DISTINCT query_id, 0, 0, []::bigint[], 0 FROM q0
  UNION ALL SELECT g.query_id, g.position + 1, CASE WHEN len(ids) < 5 AND used + n_chars <= 4000 THEN used + n_chars ELSE used END, CASE WHEN len(ids) < 5 AND used + n_chars <= 4000 THEN list_append(ids, lesson_id) ELSE ids END,
    CASE WHEN len(ids) < 5 THEN seen + 1 ELSE seen END
  FROM g JOIN rr ON rr.query_id = g.query_id AND rr.position = g.position + 1 WHERE g.position < 64),
e AS (SELECT query_id, arg_max(used, position) AS used, arg_max(ids, position) AS ids, arg_max(seen, position) AS seen FROM g GROUP BY 1),
c AS (SELECT query_id, count(*) AS n FROM rr GROUP BY 1),
u AS (SELECT e.*, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (query_id))
SELECT query_id, CASE WHEN len(ids) > 0 THEN 'available' ELSE 'empty' END AS status, cast(used as bigint) AS used_bytes, array_to_string(ids, ',') AS picked,
  (SELECT coalesce(string_agg(f, ',' ORDER BY k), '') FROM (SELECT 'file' || (x % 3) AS f, min(k) AS k FROM (SELECT unnest(ids) AS x, unnest(range(len(ids))) AS k) GROUP BY 1)) AS files,
  (SELECT coalesce(string_agg(f, ',' ORDER BY k), '') FROM (SELECT 'sym' || (x % 2) AS f, min(k) AS k FROM (SELECT unnest(ids) AS x, unnest(range(len(ids))) AS k) GROUP BY 1)) AS symbols,
  n AS matches, (n > 64 OR seen < least(n, 64) OR len(ids) < seen) AS truncated FROM u""")
def _(m):
    queries = _queries(m)
    named = lambda kind, n: F.array(F.concat(F.lit(kind), (F.col("lesson_id") % n).cast("string")))
    sized = _recall(m, queries).join(m.lessons.select("lesson_id", F.col("n_chars").alias("size")), "lesson_id").withColumn("files", named("file", 3)).withColumn("symbols", named("sym", 2))
    out = R.budget_pick(queries, sized, 4000)
    return out.withColumn("picked", F.transform("picked", lambda x: x.cast("string"))).withColumns({c: F.array_join(c, ",") for c in ("picked", "files", "symbols")})


@plan("j03_lesson_rows", """
WITH g AS (SELECT assessment_id, arg_max(pre_commit_decision, id) AS d, arg_max(measured_benefit, id) AS mb FROM guardrails GROUP BY 1)
SELECT a.id AS assessment_id, 'task ' || a.id AS task, 'a1' AS action_id, CASE WHEN a.id % 5 = 0 THEN 'unknown' ELSE 'proceed' END AS decision, 'completed' AS terminal_status,
  CASE WHEN a.id % 3 = 0 THEN 'S.a,S_b' ELSE 'S_b' END AS symbols, CASE WHEN a.id % 2 = 0 THEN 'negative_rau' ELSE '' END AS gates, R(mb) AS measured_benefit,
  'Verified completed outcome for task ' || a.id || '; decision was ' || CASE WHEN a.id % 5 = 0 THEN 'unknown' ELSE 'proceed' END || '.' || CASE WHEN a.id % 2 = 0 THEN ' Stable gates: negative_rau.' ELSE '' END AS lesson
FROM assessments a JOIN outcomes o ON o.assessment_id = a.id AND terminal_status = 'completed' JOIN g ON g.assessment_id = a.id AND d = 'proceed' WHERE a.id % 13 <> 0
""")
def _(m):
    k = F.col("id")
    a = m.assessments.select(
        k.alias("assessment_id"), "repo_id", F.concat(F.lit("task "), k.cast("string")).alias("task"), F.lit("a1").alias("action_id"), F.when(k % 5 != 0, "proceed").alias("decision"),
        F.when(k % 3 == 0, F.array(F.lit("S_b"), F.lit("S.a"), F.lit("9x"))).otherwise(F.array(F.lit("S_b"), F.lit("S_b"))).alias("symbols"),
        F.when(k % 2 == 0, F.array(F.lit("negative_rau"), F.lit("Bad Name"))).otherwise(F.array(F.lit("X"))).alias("gate_names"),
        F.when(k % 13 != 0, F.sha2("content_json", 256)).otherwise("bad").alias("assessment_hash"))
    o = m.outcomes.select("assessment_id", "terminal_status", F.sha2("terminal_status", 256).alias("outcome_hash"))
    g = m.guardrails.groupBy("assessment_id").agg(F.max_by("pre_commit_decision", "id").alias("pre_commit_decision"), F.max_by("measured_benefit", "id").alias("measured_benefit"))
    out = R.lesson_rows(a, o, g).drop("repo_id")
    return out.withColumns({c: F.array_join(c, ",") for c in ("symbols", "gates")})
