"""Ledger plans."""

from pyspark.sql import functions as F

from oddsmith.operators import calibration as C
from oddsmith.operators import ledger as L
from oddsmith.operators import lineage as V
from oddsmith.plans.catalog import plan

_AC = """
ac AS (SELECT id, repo_id, recorded_at, CASE WHEN id % 50 = 7 THEN NULL ELSE 'r' || o_custkey % 5 END AS crepo, CASE WHEN id % 50 = 7 THEN NULL ELSE
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'reject' WHEN '2' THEN 'ask_human' WHEN '3' THEN 'revise_safer' WHEN '4' THEN 'test_first' ELSE 'proceed' END END AS decision, o_custkey AS c,
  (10 + id % 90) / 100.0 AS el, (10 + o_custkey % 90) / 100.0 AS be, (10 + (id + o_custkey) % 90) / 100.0 AS eu, CASE WHEN id % 6 <> 0 THEN -(10 + id % 80) / 100.0 END AS rau, (10 + id % 70) / 100.0 AS ec
  FROM assessments JOIN orders ON o_orderkey = id), au AS (SELECT * FROM ac WHERE crepo = repo_id)"""


@plan("a01_authoritative_scan", f"WITH {_AC} SELECT id, repo_id, decision FROM au")
def _(m):
    return L.authoritative(m.assessments).select("id", "repo_id", F.col("content.decision").alias("decision"))


@plan("a04_json_decode", f"WITH {_AC} SELECT id, crepo AS content_repo, decision, R(CASE WHEN decision IS NOT NULL THEN el END) AS expected_loss FROM ac")
def _(m):
    d = L.decode_json(m.assessments, "content_json", L.CONTENT)
    return d.select("id", F.col("content.repo_id").alias("content_repo"), F.col("content.decision").alias("decision"), F.col("content.scores.expected_loss").alias("expected_loss"))


@plan("a08_table_counts", """
SELECT 'assessments' AS table_name, count(*) AS n FROM assessments UNION ALL SELECT 'outcomes', count(*) FROM outcomes UNION ALL SELECT 'post_assessment_guardrails', count(*) FROM guardrails
UNION ALL SELECT 'assessment_predictions', count(*) FROM prediction_provenance UNION ALL SELECT 'prediction_errors', count(*) FROM prediction_errors
UNION ALL SELECT 'sanction_events', count(*) FROM sanctions UNION ALL SELECT 'learning_context', count(*) FROM lessons
""")
def _(m):
    return L.table_counts({"assessments": m.assessments, "outcomes": m.outcomes, "post_assessment_guardrails": m.guardrails,
                           "assessment_predictions": m.prediction_provenance, "prediction_errors": m.prediction_errors, "sanction_events": m.sanctions, "learning_context": m.lessons})


@plan("b16_target_files", """
SELECT h.id, CASE id % 5 WHEN 0 THEN 'f' || o_custkey % 8 || '.py' WHEN 1 THEN 'a/b' || o_custkey % 9 || '.py' WHEN 2 THEN '' WHEN 3 THEN 'g' || o_custkey % 6 || '.py,h.py' ELSE CASE WHEN id % 10 = 4 THEN 'k' || o_custkey % 4 || '.py' ELSE '' END END AS target_files,
  CASE id % 5 WHEN 0 THEN 'candidate_bound' WHEN 1 THEN 'declared' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'legacy_guidance' ELSE CASE WHEN id % 10 = 4 THEN 'legacy_graph' ELSE 'unavailable' END END AS target_provenance
FROM history h JOIN orders ON o_orderkey = h.id
""")
def _(m):
    return L.target_files(m.history, "sha256-file-map-v1").withColumn("target_files", F.array_join("target_files", ","))


@plan("b17_score_series", f"WITH {_AC} SELECT id, decision, R(el) AS expected_loss, R(be) AS benefit, R(eu) AS expected_utility, R(rau) AS rau, R(ec) AS edit_confidence FROM au")
def _(m):
    return L.score_series(m.assessments)


@plan("d03_latest_capture", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY assessment_id, target_type, target_name, CASE WHEN action_id % 3 = 0 THEN NULL ELSE action_id END ORDER BY ledger_id DESC) AS rn FROM prediction_errors WHERE ledger_id % 4 <> 0)
SELECT p.ledger_id, c.symbol_id AS features FROM prediction_errors p LEFT JOIN c ON rn = 1 AND c.assessment_id = p.assessment_id AND c.target_type = p.target_type AND c.target_name = p.target_name
""")
def _(m):
    act = F.when(F.col("action_id") % 3 != 0, F.col("action_id")).alias("action_id")
    rows = m.prediction_errors.select("ledger_id", "assessment_id", "target_type", "target_name", act)
    caps = m.prediction_errors.filter("ledger_id % 4 <> 0").select(
        F.col("ledger_id").alias("id"), "assessment_id", "target_type", "target_name", act, F.col("symbol_id").alias("features"))
    return L.latest_capture(rows, caps).select(F.col("ledger_id").cast("bigint"), "features")


@plan("d04_event_disutility", f"""WITH {_AC}
SELECT ledger_id, R(CASE target_name WHEN 'p_event.public_api_break' THEN (10 + c % 80) / 100.0 WHEN 'p_event.dependency_break' THEN (10 + id % 60) / 100.0 END) AS event_disutility
FROM prediction_errors p LEFT JOIN ac ON ac.id = p.assessment_id AND decision IS NOT NULL""")
def _(m):
    rows = m.prediction_errors.select("ledger_id", "assessment_id", "target_name")
    return L.event_disutility(rows, m.assessments).select(F.col("ledger_id").cast("bigint"), "event_disutility")


@plan("d05_assessment_outcome", f"WITH {_AC} SELECT au.id, decision, terminal_status FROM au LEFT JOIN outcomes o ON o.assessment_id = au.id")
def _(m):
    return L.with_outcome(m.assessments, m.outcomes).select("id", F.col("content.decision").alias("decision"), "terminal_status")


@plan("e08_overview_counts", f"""WITH {_AC}, j AS (SELECT repo_id, decision, coalesce(terminal_status, 'pending') AS status FROM au LEFT JOIN outcomes o ON o.assessment_id = au.id)
SELECT repo_id, decision, NULL AS status, count(*) AS n FROM j GROUP BY 1, 2 UNION ALL SELECT repo_id, NULL, status, count(*) FROM j GROUP BY 1, 3 UNION ALL SELECT repo_id, NULL, NULL, count(*) FROM j GROUP BY 1""")
def _(m):
    return L.overview(m.assessments, m.outcomes)


@plan("e20_prior_summary", """
SELECT assessment_id, CASE WHEN count(snapshot_id) > 0 THEN 'local_learned' WHEN count(warm_tag) > 0 THEN 'shipped' ELSE 'cold_start' END AS source,
  CASE WHEN count(snapshot_id) > 0 AND count(warm_tag) > 0 THEN 'mixed' WHEN count(snapshot_id) > 0 THEN 'local_learned' WHEN count(warm_tag) > 0 THEN 'shipped' ELSE 'cold_start' END AS facet,
  coalesce(string_agg(DISTINCT warm_tag, ',' ORDER BY warm_tag), '') AS calibration_tags, coalesce(string_agg(DISTINCT snapshot_id, ',' ORDER BY snapshot_id), '') AS snapshot_ids,
  count(DISTINCT target_name) FILTER (snapshot_id IS NOT NULL) AS applied_target_count FROM prediction_provenance GROUP BY 1
""")
def _(m):
    p = L.prior_summary(m.prediction_provenance)
    return p.withColumns({c: F.array_join(c, ",") for c in ("calibration_tags", "snapshot_ids")})


@plan("e27_trend_summary", f"""WITH {_AC}
SELECT repo_id, R(arg_max(el, id)) AS expected_loss_now, R(min(el)) AS expected_loss_min, R(max(el)) AS expected_loss_max, R(arg_max(rau, id) FILTER (rau IS NOT NULL)) AS rau_now, R(min(rau)) AS rau_min, R(max(rau)) AS rau_max,
  R(arg_max(be, id)) AS benefit_now, R(min(be)) AS benefit_min, R(max(be)) AS benefit_max FROM au GROUP BY 1""")
def _(m):
    s = L.score_series(m.assessments).join(m.assessments.select("id", "repo_id"), "id")
    return L.trend(s, "repo_id", "id", ("expected_loss", "rau", "benefit"))


@plan("e32_assessment_detail", f"""WITH {_AC},
g AS (SELECT assessment_id AS id, count(*) AS n, string_agg(pre_commit_decision, ',' ORDER BY id) AS l FROM guardrails GROUP BY 1), p AS (SELECT assessment_id AS id, count(snapshot_id) > 0 AS l, count(warm_tag) > 0 AS w FROM prediction_provenance GROUP BY 1)
SELECT id, terminal_status, coalesce(g.n, 0) AS n_guardrails, coalesce(g.l, '') AS guardrail_decisions, CASE WHEN p.l THEN 'local_learned' WHEN p.w THEN 'shipped' ELSE 'cold_start' END AS prior_source
FROM au LEFT JOIN outcomes o ON o.assessment_id = au.id LEFT JOIN g USING (id) LEFT JOIN p USING (id)""")
def _(m):
    d = L.assessment_detail(m.assessments, m.guardrails, m.outcomes, m.prediction_provenance)
    return d.select("id", "terminal_status", F.when(F.col("guardrails").isNull(), 0).otherwise(F.size("guardrails")).cast("bigint").alias("n_guardrails"),
                    F.coalesce(F.array_join("guardrails.pre_commit_decision", ","), F.lit("")).alias("guardrail_decisions"),
                    F.coalesce("source", F.lit("cold_start")).alias("prior_source"))


@plan("f10_latest_guardrail", """
SELECT assessment_id, id, pre_commit_decision, R(measured_benefit) AS measured_benefit FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY id DESC) AS rn FROM guardrails) WHERE rn = 1
""")
def _(m):
    return L.latest_by(m.guardrails, "assessment_id", "id", "pre_commit_decision", "measured_benefit").withColumn("id", F.col("id").cast("bigint"))


@plan("f10_sanction_of_assessment", """
SELECT assessment_id, id, status, sanction_json FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY id DESC) AS rn FROM sanctions WHERE status <> 'revoked') WHERE rn = 1
""")
def _(m):
    return L.sanction_of_assessment(m.sanctions)


@plan("f10_sanction_of_action", """
WITH n AS (SELECT s.*, unnest(CASE o_orderkey % 4 WHEN 1 THEN ['a' || o_custkey % 50, 'a' || (o_custkey % 50 + 50)] WHEN 3 THEN [] ELSE ['a' || o_custkey % 50] END) AS action_id FROM sanctions s JOIN orders ON o_orderkey = id WHERE status <> 'revoked')
SELECT repo_id, action_id, id, assessment_id, sanction_json FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, action_id ORDER BY id DESC) AS rn FROM n) WHERE rn = 1
""")
def _(m):
    return L.sanction_of_action(m.sanctions)


@plan("i05_lessons_by_id", "SELECT lesson_id, n_chars FROM lessons WHERE repo_id = 'src3' AND lesson_id IN (SELECT doc_id FROM labels)")
def _(m):
    return L.lessons_of(m.lessons, "src3", m.labels.select(F.col("doc_id").alias("lesson_id"))).select("lesson_id", "n_chars")


@plan("f11_contiguous_groups", f"""WITH {_AC}, k AS (SELECT id, repo_id, decision, el < 0.9 AS ok FROM au),
l AS (SELECT *, lag(decision) OVER w AS pd, lag(ok) OVER w AS po FROM k WINDOW w AS (PARTITION BY repo_id ORDER BY id)),
i AS (SELECT *, sum(CASE WHEN ok AND po AND pd = decision THEN 0 ELSE 1 END) OVER (PARTITION BY repo_id ORDER BY id) AS island FROM l)
SELECT repo_id, cast(island as bigint) AS island, max(id) AS primary_id, count(*) AS n FROM i GROUP BY 1, 2""")
def _(m):
    rows = L.authoritative(m.assessments).select("id", "repo_id", F.col("content.decision").alias("decision"), F.col("content.scores.expected_loss").alias("el"))
    g = L.group_contiguous(rows, ["repo_id"], "id", ["decision"], F.col("el") < 0.9)
    return g.groupBy("repo_id", "island").agg(F.max("id").alias("primary_id"), F.count(F.lit(1)).alias("n"))


@plan("f15_hash_chain", """
WITH l AS (SELECT *, coalesce(lag(row_hash) OVER (PARTITION BY table_name ORDER BY id), 'GENESIS') = prev_hash AND sha256(prev_hash || content_json) = row_hash AS ok FROM hash_chain)
SELECT table_name, count(*) AS rows, bool_and(ok) AS valid, min(id) FILTER (NOT ok) AS first_bad_id FROM l GROUP BY 1
""")
def _(m):
    return L.verify_chain(m.hash_chain)


@plan("f15_batch_digests", """
SELECT id % 7 AS repo, id // 500 AS batch, count(*) AS rows, sha256(string_agg(sha256(content_json), '' ORDER BY id)) AS digest FROM ledger_content GROUP BY 1, 2
""")
def _(m):
    rows = m.ledger_content.withColumn("repo", F.col("id") % 7)
    return L.batch_digests(rows, ["repo"], F.floor(F.col("id") / 500))


_TREE = """
l0 AS (SELECT id % 7 AS repo, row_number() OVER (PARTITION BY id % 7 ORDER BY id) - 1 AS node, 1 AS rows, id, content_json FROM ledger_content),
l1 AS (SELECT repo, node, rows, sha256(node || ':' || id || ':' || coalesce('=' || content_json, '-')) AS digest FROM l0),
l2 AS (SELECT repo, node // 64 AS node, sum(rows) AS rows, sha256(string_agg(digest, '' ORDER BY l1.node)) AS digest FROM l1 GROUP BY 1, 2),
l3 AS (SELECT repo, node // 64 AS node, sum(rows) AS rows, sha256(string_agg(digest, '' ORDER BY l2.node)) AS digest FROM l2 GROUP BY 1, 2),
l4 AS (SELECT repo, node // 64 AS node, sum(rows) AS rows, sha256(string_agg(digest, '' ORDER BY l3.node)) AS digest FROM l3 GROUP BY 1, 2)"""


@plan("f15_merkle_tree", f"WITH {_TREE} SELECT repo, 1 AS level, node, cast(rows as bigint) AS rows, digest FROM l2 UNION ALL SELECT repo, 2, node, cast(rows as bigint), digest FROM l3 UNION ALL SELECT repo, 3, node, cast(rows as bigint), digest FROM l4")
def _(m):
    levels = L.merkle_levels(m.ledger_content.withColumn("repo", F.col("id") % 7), ["repo"], fanout=64, height=3)
    tables = [t.select("repo", F.lit(i).alias("level"), "node", "rows", "digest") for i, t in enumerate(levels) if i]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@plan("f16_controlling_gate", f"WITH {_AC} SELECT id, CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 9 END AS gate FROM au")
def _(m):
    return L.authoritative(m.assessments).select("id", L.controlling_gate()["gate"].alias("gate"))


@plan("i04_page_newest", f"WITH {_AC} SELECT id, decision FROM au WHERE repo_id = 'r2' ORDER BY id DESC LIMIT 9999 OFFSET 40")
def _(m):
    rows = L.authoritative(m.assessments).filter("repo_id = 'r2'")
    return L.page(rows, 9999, 40).select("id", F.col("content.decision").alias("decision"))


@plan("i05_list_errors", """
SELECT ledger_id, 'production' AS scope, R(predicted_probability) AS predicted_probability FROM prediction_errors WHERE target_type = 'risk_binary' AND shadow_mode = 0 AND hash_version = 2 AND outcome_label_status = 'observed' AND guidance_packet_id IS NULL
UNION ALL SELECT ledger_id, 'all', R(predicted_probability) FROM prediction_errors WHERE target_type = 'risk_binary' AND outcome_label_status = 'observed'
""")
def _(m):
    pick = lambda df, s: df.select(F.col("ledger_id").cast("bigint"), F.lit(s).alias("scope"), "predicted_probability")
    every = m.prediction_errors.filter("target_type = 'risk_binary' AND outcome_label_status = 'observed'")
    return pick(C.production_rows(m.prediction_errors, "risk_binary"), "production").unionByName(pick(every, "all"))


@plan("i05_list_snapshots", """
SELECT id, repo_id FROM (SELECT p_partkey AS id, p_partkey % 3 AS repo_id FROM part) WHERE repo_id = 1 ORDER BY id DESC LIMIT 50
""")
def _(m):
    snaps = m.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("repo_id"))
    return L.page(snaps.filter("repo_id = 1"), 50)


@plan("i06_pending_reviews", f"""WITH {_AC}, q AS (SELECT id, repo_id, decision, CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 9 END AS gate FROM ac
  WHERE c % 7 = 3 AND (decision = 'ask_human' OR (decision = 'proceed' AND id % 3 = 0) OR (decision = 'reject' AND id % 4 IN (0, 1)))),
n AS (SELECT * FROM q) SELECT repo_id, id, decision, gate FROM n""")
def _(m):
    return L.pending_reviews(m.assessments, "commit3")


@plan("i07_array_sets", """
SELECT l.request_id, len(list_distinct(list_concat(l.files, r.files))) AS n_union, len(list_filter(r.files, lambda f: NOT list_contains(l.files, f))) AS n_missing, len(list_filter(r.files, lambda f: NOT list_contains(l.files, f))) = 0 AS is_subset
FROM revision_requests l JOIN revision_records r ON r.row_id = l.request_id - 1
""")
def _(m):
    j = m.revision_requests.join(m.revision_records.select((F.col("row_id") + 1).alias("request_id"), F.col("files").alias("other")), "request_id")
    size = lambda c: F.size(c).cast("bigint")
    missing = F.array_except("other", "files")
    return j.select("request_id", size(F.array_union("files", "other")).alias("n_union"), size(missing).alias("n_missing"), (F.size(missing) == 0).alias("is_subset"))


@plan("i08_row_sets", """
WITH a AS (SELECT DISTINCT source, target FROM edges WHERE kind IN ('calls', 'references')), b AS (SELECT DISTINCT target AS source, source AS target FROM edges WHERE kind = 'references')
SELECT *, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT *, 'difference' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
""")
def _(m):
    a = m.edges.filter(F.col("kind").isin("calls", "references")).select("source", "target").distinct()
    b = m.edges.filter("kind = 'references'").select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    u = a.unionByName(b).distinct().withColumn("op", F.lit("union"))
    return u.unionByName(a.join(b, ["source", "target"], "left_anti").withColumn("op", F.lit("difference")))


@plan("j04_fingerprints", "SELECT id, sha256(content_json) AS fingerprint FROM assessments")
def _(m):
    return m.assessments.select("id", F.sha2("content_json", 256).alias("fingerprint"))


_TS = """CASE event_id % 6 WHEN 0 THEN '2024-01-0' || cast(1 + event_id % 9 as string) || 'T10:20:30+00:00' WHEN 1 THEN '2024-01-05T10:20:30.123456+00:00' WHEN 2 THEN '2024-01-05T10:20:30+02:00'
  WHEN 3 THEN '2024-13-05T10:20:30+00:00' WHEN 4 THEN '2024-01-05 10:20:30+00:00' ELSE 'x' END"""


@plan("j05_utc_timestamp", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN make_timestamp(2024, 1, 1 + event_id % 9, 10, 20, 30) WHEN 1 THEN TIMESTAMP '2024-01-05 10:20:30.123456' END AS parsed FROM events
""")
def _(m):
    return m.events.select("event_id", F.expr(_TS).alias("t")).select("event_id", L.utc_timestamp("t").cast("timestamp_ntz").alias("parsed"))


_CAND = """
rq AS (SELECT * FROM revision_requests), re AS (SELECT * FROM revision_records),
cd AS (SELECT q.request_id, q.baseline AS qb, r.row_id, r.lineage_key, r.is_legacy, r.baseline AS rb, q.repo_id, q.assessed_commit, len(list_filter(r.files, lambda f: NOT list_contains(q.files, f))) = 0 AS inside, len(list_intersect(r.files, q.files)) > 0 AS overlap
  FROM rq q JOIN re r ON r.repo_id = q.repo_id AND r.assessed_commit = q.assessed_commit),
lv AS (SELECT * FROM cd WHERE NOT is_legacy AND (inside OR (qb IS NOT NULL AND overlap))),
lg AS (SELECT DISTINCT request_id FROM cd WHERE is_legacy AND inside)"""


@plan("d16_revision_attempts", f"""WITH {_CAND},
mt AS (SELECT * FROM lv WHERE CASE WHEN qb IS NULL THEN inside ELSE coalesce(rb = qb, false) END AND lineage_key IS NOT NULL),
sp AS (SELECT repo_id, assessed_commit, lineage_key, count(*) FILTER (NOT retryable) + greatest(0, count(*) FILTER (retryable) - 1) AS k FROM re WHERE NOT is_legacy AND lineage_key IS NOT NULL GROUP BY 1, 2, 3),
mx AS (SELECT request_id, max(k) AS k FROM mt JOIN sp USING (repo_id, assessed_commit, lineage_key) GROUP BY 1)
SELECT request_id, coalesce(k, CASE WHEN request_id IN (SELECT request_id FROM lv) OR request_id IN (SELECT request_id FROM lg) THEN 1 END, 0) AS attempts FROM rq LEFT JOIN mx USING (request_id)""")
def _(m):
    return V.revision_attempts(m.revision_requests, m.revision_records)


_ORIG = f"""{_CAND},
gg AS (SELECT request_id, count(*) FILTER (rb = qb) AS k, count(*) FILTER (rb = qb AND lineage_key IS NULL) AS u, count(DISTINCT lineage_key) FILTER (rb = qb) AS n, min(row_id) FILTER (rb = qb) AS o FROM lv GROUP BY 1),
og AS (SELECT request_id, CASE WHEN k IS NULL THEN CASE WHEN request_id IN (SELECT request_id FROM lg) THEN 'predates_lineage' ELSE 'none' END WHEN rq.baseline IS NULL THEN 'baseline_unbound' WHEN k = 0 THEN 'none' WHEN u > 0 THEN 'predates_lineage'
  WHEN n <> 1 THEN 'ambiguous' ELSE 'available' END AS status, o FROM rq LEFT JOIN gg USING (request_id))"""


@plan("d17_revision_origin", f"WITH {_ORIG} SELECT request_id, status, CASE WHEN status = 'available' THEN o END AS origin_row_id FROM og")
def _(m):
    return V.revision_origin(m.revision_requests, m.revision_records)


@plan("d20_revision_completeness", f"""WITH {_ORIG}
SELECT og.request_id, o AS row_id, array_to_string(list_sort(list_filter(re.files, lambda f: NOT list_contains(rq.files, f))), ',') AS missing_files, sha256(lineage_key) AS lineage_digest
FROM og JOIN rq USING (request_id) JOIN re ON re.row_id = o WHERE status = 'available'""")
def _(m):
    origins = V.revision_origin(m.revision_requests, m.revision_records)
    out = V.revision_completeness(m.revision_requests, origins, m.revision_records)
    return out.withColumn("missing_files", F.array_join("missing_files", ","))
