"""Evidence plans."""

from pyspark.sql import functions as F

from oddsmith.functions.columns import last_segment, posix, top_domain
from oddsmith.operators import evidence as E
from oddsmith.plans.catalog import plan
from oddsmith.plans.scoring import _FLOOR, S

RULES = [("src/api/*", "C3"), ("*migrations/*", "C4"), ("tests/*", "C0"), ("src/*", "C2"), ("*.txt", "C1")]
POLICY = [("*migrations/1*.py", "no_migration_1x"), ("src/core/?.go", "core_frozen"), ("*.sql", "schema_locked")]
_TR = "graph_freshness = 'fresh' AND resolution_method IN ('location', 'name_fallback') AND graph_file_error_count = 0"
_EIP = """greatest(CASE WHEN symbol_caller_count > 0 THEN symbol_fan_in_percentile ELSE 0 END, CASE WHEN modify_impact_count > 0 THEN modify_impact_percentile ELSE 0 END,
  CASE WHEN modify_transitive_impact_count > 0 THEN modify_transitive_impact_percentile ELSE 0 END)"""


@plan("b09_graph_trust", f"SELECT action_id FROM evidence WHERE {_TR}")
def _(m):
    return m.evidence.filter(E.trusted()).select("action_id")


@plan("b10_impact_percentile", f"SELECT action_id, R({_EIP}) AS impact_percentile FROM evidence")
def _(m):
    return m.evidence.select("action_id", E.impact_percentile().alias("impact_percentile"))


@plan("b11_future_exposure", f"SELECT action_id, R(CASE WHEN {_TR} THEN least(0.8, {_EIP}) ELSE 0 END) AS exposure FROM evidence")
def _(m):
    return m.evidence.select("action_id", E.future_exposure(0.8).alias("exposure"))


@plan("b12_derived_visibility", """
SELECT id, CASE WHEN visibility <> '' THEN visibility WHEN language IN ('go', 'javascript', 'jsx', 'tsx', 'typescript') AND is_exported = 1 THEN 'exported'
  WHEN language IN ('go', 'javascript', 'jsx', 'tsx', 'typescript') AND is_exported = 0 THEN 'unexported' END AS visibility FROM nodes
""")
def _(m):
    return m.nodes.select("id", E.derived_visibility().alias("visibility"))


@plan("b07_criticality_by_path", """
WITH r AS (SELECT * FROM (VALUES ('src/api/*', 'C3'), ('*migrations/*', 'C4'), ('tests/*', 'C0'), ('src/*', 'C2'), ('*.txt', 'C1')) t(g, s)),
h AS (SELECT action_id, max(s) AS s FROM change_paths JOIN r ON path GLOB g GROUP BY 1)
SELECT a.action_id, CASE WHEN h.s > a.criticality_stage THEN h.s ELSE a.criticality_stage END AS criticality_stage FROM actions a LEFT JOIN h USING (action_id)
""")
def _(m):
    return E.raise_criticality(m.actions, E.criticality_from_paths(m.change_paths, RULES)).select("action_id", "criticality_stage")


@plan("b08_policy_violations", """
WITH r AS (SELECT * FROM (VALUES (1, '*migrations/1*.py', 'no_migration_1x'), (2, 'src/core/?.go', 'core_frozen'), (3, '*.sql', 'schema_locked')) t(n, g, v)),
h AS (SELECT DISTINCT action_id, n, v FROM change_paths JOIN r ON path GLOB g)
SELECT action_id, string_agg(v, ',' ORDER BY n) AS violations FROM h GROUP BY 1
""")
def _(m):
    return E.policy_violations(m.change_paths, POLICY).select("action_id", F.array_join("violations", ",").alias("violations"))


@plan("b14_path_domain", """
SELECT DISTINCT path, replace(path, '\\', '/') AS posix_path, CASE WHEN contains(replace(path, '\\', '/'), '/') THEN split_part(replace(path, '\\', '/'), '/', 1) ELSE '.' END AS domain FROM change_paths
""")
def _(m):
    return m.change_paths.select("path", posix("path").alias("posix_path"), top_domain("path").alias("domain")).distinct()


@plan("b15_display_label", """
SELECT id, CASE WHEN contains(qualified_name, '::') THEN regexp_extract(qualified_name, '([^:]*)$', 1) ELSE regexp_extract(qualified_name, '([^.]*)$', 1) END AS label FROM nodes
""")
def _(m):
    return m.nodes.select("id", last_segment("qualified_name", "name").alias("label"))


@plan("b18_change_signals", """
SELECT action_id, bool_or(regexp_matches(path, '(^|/)[^/]*requirements[^/]*[.]txt$') OR path LIKE '%package.json') AS dependency_changed,
  bool_or(path LIKE '%.sql') AS schema_changed, bool_or(path LIKE '%migrations%') AS migration_changed FROM change_paths GROUP BY 1
""")
def _(m):
    return E.change_signals(m.change_paths)


@plan("j06_glob_match", """
WITH p AS (SELECT DISTINCT path FROM change_paths), g AS (SELECT unnest(['src/*', '*.sql', 'tests/test_?.py', 'db*']) AS pattern)
SELECT path, pattern FROM p JOIN g ON path GLOB pattern
""")
def _(m):
    from oddsmith.functions.columns import matches_glob

    patterns = ["src/*", "*.sql", "tests/test_?.py", "db*"]
    hit = F.array_compact(F.array(*[F.when(matches_glob("path", p), F.lit(p)) for p in patterns]))
    return m.change_paths.select("path").distinct().withColumn("pattern", F.explode(hit))


_SYM = """
sy AS (SELECT l_orderkey AS action_id, cast(l_linenumber as bigint) * 100000000 + l_partkey * 1000 + l_suppkey AS ord, l_partkey AS p, l_suppkey AS s,
  CASE l_suppkey % 4 WHEN 0 THEN 'exported' WHEN 1 THEN 'public_api' WHEN 2 THEN 'internal' END AS vis, cast(l_partkey % 20 as double) / 20 AS cp,
  l_partkey % 29 = 0 AS db, l_partkey % 13 = 0 AS sig, l_partkey % 3 = 0 AS body, l_partkey % 7 = 0 AS dirc, l_partkey % 5 = 0 AS tst FROM lineitem),
sk AS (SELECT *, CASE WHEN db THEN 'SIDE_EFFECT' WHEN sig OR (body AND vis IN ('exported', 'public_api')) THEN 'CONTRACT' WHEN body THEN 'BEHAVIORAL'
  WHEN dirc THEN 'DIRECTIVE' WHEN tst THEN 'TEST_ONLY' ELSE 'COSMETIC' END AS kind FROM sy)
"""


def _symbols(m):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return m.lineitem.select(
        F.col("l_orderkey").alias("action_id"),
        (F.col("l_linenumber").cast("bigint") * 100000000 + p * 1000 + s).alias("ord"),
        F.when(s % 4 == 0, "exported").when(s % 4 == 1, "public_api").when(s % 4 == 2, "internal").alias("visibility"),
        ((p % 20).cast("double") / 20).alias("callers_percentile"), (p % 29 == 0).alias("db_write_changed"),
        (p % 13 == 0).alias("signature_changed"), (p % 3 == 0).alias("body_changed"),
        (p % 7 == 0).alias("directive_comment_changed"), (p % 5 == 0).alias("test_only"))


@plan("c21_change_kind", f"WITH {_SYM} SELECT action_id, ord, kind FROM sk")
def _(m):
    s = _symbols(m)
    return s.select("action_id", "ord", E.change_kind(s.columns).alias("kind"))


@plan("e12_diff_summary", f"""WITH {_SYM},
w AS (SELECT *, CASE kind WHEN 'COSMETIC' THEN 0 WHEN 'TEST_ONLY' THEN 1 WHEN 'DIRECTIVE' THEN 2 WHEN 'BEHAVIORAL' THEN 3 WHEN 'CONTRACT' THEN 5 ELSE 6 END AS sev FROM sk),
f AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY sev DESC, ord) AS rn FROM w),
y AS (SELECT action_id, unnest([CASE WHEN vis IN ('exported', 'public_api') THEN 'visibility=' || vis END, CASE WHEN cp >= 0.9 THEN 'callers_percentile>=0.9' END,
  CASE WHEN db THEN 'db_write_changed=true' END]) AS r FROM w WHERE sev >= 2),
z AS (SELECT action_id, string_agg(DISTINCT r, ',' ORDER BY r) AS why FROM y WHERE r IS NOT NULL GROUP BY 1)
SELECT action_id, kind AS max_change_kind, coalesce(vis, 'unknown') AS visibility, (SELECT count(*) FROM w x WHERE x.action_id = f.action_id) AS changed_symbols,
  why IS NOT NULL AS consequential_symbol_changed, coalesce(why, '') AS consequence_reason FROM f LEFT JOIN z USING (action_id) WHERE rn = 1""")
def _(m):
    out = E.diff_summary(_symbols(m), "action_id", "ord")
    return out.withColumn("consequence_reason", F.array_join("consequence_reason", ","))


_MOD = f"""
mo AS (SELECT *, visibility IN ('public', 'public_api', 'exported') AS pub, is_exported_contract OR is_abstract_contract AS con, {_EIP} AS eip,
  max_change_kind IN ('CONTRACT', 'SIDE_EFFECT') AS ctr, max_change_kind = 'UNKNOWN' OR structure_tier LIKE 'codegraph%' AS unk, is_schema_change OR is_migration AS sto
  FROM evidence WHERE has_fanin AND file_operation_kind = 'NONE' AND {_TR}),
mv AS (SELECT action_id, CASE WHEN sto THEN 'api_contract_break' WHEN pub OR con THEN 'public_api_break' ELSE 'dependency_break' END AS event,
  least(0.45, CASE WHEN sto THEN 0.18 WHEN pub OR con THEN 0.12 ELSE 0.08 END + CASE WHEN domain_entrypoint OR anchor_score > 0 THEN 0.04 ELSE 0 END
    + CASE WHEN max_owner_span_lines >= 120 THEN 0.10 WHEN max_owner_span_lines >= 60 THEN 0.06 ELSE 0 END + CASE WHEN owner_kind IN ('class', 'interface', 'route') THEN 0.03 ELSE 0 END
    + CASE WHEN resolved_symbol_count > 1 THEN least(0.05, 0.02 * (resolved_symbol_count - 1)) ELSE 0 END + least(0.06, 0.01 * outgoing_edge_total) + least(0.28, eip * 28 / 90)) AS p,
  CASE WHEN sto OR pub OR con THEN 0.70 ELSE 0.60 END AS d FROM mo
  WHERE ((eip >= 0.9 OR max_owner_span_lines >= 60 OR resolved_symbol_count > 1) AND (ctr OR unk OR consequential_symbol_changed OR sto))
    OR (pub AND (consequential_symbol_changed OR ctr)) OR (con AND ctr AND eip >= 0.9)),
de AS (SELECT action_id, CASE WHEN file_operation_kind <> 'DELETE' THEN 'path_migration_break' WHEN visibility IN ('public_api', 'exported') THEN 'public_api_break' ELSE 'dependency_break' END AS event,
  least(0.45, greatest(0.03, CASE WHEN domain_entrypoint THEN 0.15 ELSE 0 END, CASE WHEN is_migration OR is_schema_change THEN 0.2 ELSE 0 END, CASE WHEN god_node_score >= 0.75 THEN 0.1 ELSE 0 END,
    CASE WHEN anchor_score > 0 THEN 0.08 ELSE 0 END) + CASE WHEN resolution_method = 'unresolved' THEN 0 ELSE least(0.25, symbol_fan_in_percentile * 25 / 90) END + 0.02) AS p,
  CASE WHEN file_operation_kind <> 'DELETE' THEN 0.55 WHEN visibility IN ('public_api', 'exported') THEN 0.70 ELSE 0.60 END AS d
  FROM evidence WHERE file_operation_kind IN ('DELETE', 'RENAME', 'MOVE'))
"""


def _destructive(m):
    return E.destructive_event(m.evidence.withColumns({
        "rollup_method": F.col("resolution_method"), "rollup_percentile": F.col("symbol_fan_in_percentile"),
        "breadth_bonus": F.lit(0.02)}))


@plan("c22_modify_event", f"WITH {_MOD} SELECT action_id, event, R(p) AS p_event, R(d) AS elicited_disutility FROM mv")
def _(m):
    return E.modify_event(m.evidence).drop("risk_source")


@plan("c23_destructive_event", f"WITH {_MOD} SELECT action_id, event, R(p) AS p_event, R(d) AS elicited_disutility FROM de")
def _(m):
    return _destructive(m).drop("risk_source")


_MERGE = """
ex AS (SELECT action_id, event, max(p_event) AS p, max(elicited_disutility) AS d, min(risk_source) AS s FROM action_events GROUP BY 1, 2),
inj AS (SELECT action_id, event, max(p) AS p, max(d) AS d, min(s) AS s FROM (SELECT *, 'graph_modify_risk' AS s FROM mv UNION ALL SELECT *, 'request' FROM de) GROUP BY 1, 2)
SELECT action_id, event, R(greatest(ex.p, inj.p)) AS p_event, R(greatest(ex.d, inj.d)) AS elicited_disutility,
  CASE WHEN inj.p IS NULL THEN ex.s WHEN ex.p IS NULL THEN inj.s WHEN inj.p >= ex.p AND inj.d >= ex.d AND NOT (inj.p = ex.p AND inj.d = ex.d) THEN inj.s END AS risk_source,
  R(CASE WHEN ex.p IS NOT NULL AND inj.p >= ex.p AND inj.d >= ex.d AND NOT (inj.p = ex.p AND inj.d = ex.d) THEN ex.p END) AS independent_floor
FROM ex FULL JOIN inj USING (action_id, event)
"""


@plan("e31_event_merge", f"WITH {_MOD}, {_MERGE.replace(' UNION ALL SELECT *, ' + chr(39) + 'request' + chr(39) + ' FROM de', '')}")
def _(m):
    return E.merge_events(m.action_events, E.modify_event(m.evidence))


@plan("h14_event_injection", f"WITH {_MOD}, {_MERGE}")
def _(m):
    return E.merge_events(m.action_events, E.modify_event(m.evidence).unionByName(_destructive(m)))


@plan("c24_probability_update", """
WITH e AS (SELECT action_id, event, p_event, risk_source, 'o' || owner_id % 3 AS ok, part_id, cast(part_id % 4 as double) / 10 AS fl FROM action_events),
f AS (SELECT action_id, event, risk_source, 'o' || owner_id % 3 AS ok, part_id FROM action_events WHERE part_id % 2 = 1 OR owner_id % 3 = 0),
j AS (SELECT e.*, (SELECT count(*) FROM e x WHERE x.action_id = e.action_id AND x.event = e.event AND x.risk_source = e.risk_source AND x.ok = e.ok) AS ne,
  (SELECT count(*) FROM f x WHERE x.action_id = e.action_id AND x.event = e.event AND x.risk_source = e.risk_source AND x.ok = e.ok) AS nf,
  (SELECT max(0.85 + cast(part_id % 15 as double) / 100) FROM f x WHERE x.action_id = e.action_id AND x.event = e.event AND x.risk_source = e.risk_source AND x.ok = e.ok) AS c FROM e),
k AS (SELECT *, ne = 1 AND nf = 1 AND c >= 0.9 AND c <= 1 AND event = 'public_api_break' AND risk_source = 'graph_modify_risk' AS fit, p_event * (1 - 0.65 * c) AS sc, greatest(0.05, fl) AS lo FROM j)
SELECT action_id, event, part_id, R(CASE WHEN fit THEN least(p_event, greatest(lo, sc)) ELSE p_event END) AS revised_probability,
  CASE WHEN fit THEN CASE WHEN least(p_event, greatest(lo, sc)) = p_event THEN 'original_probability' WHEN lo >= sc THEN CASE WHEN fl > 0.05 THEN 'independent_probability_floor' ELSE 'structural_probability_floor' END
    ELSE 'probability_multiplier' END END AS binding_term FROM k
""")
def _(m):
    owner = F.concat(F.lit("o"), (F.col("owner_id") % 3).cast("string")).alias("owner_key")
    events = m.action_events.select("action_id", "event", "p_event", "risk_source", owner, "part_id",
                                    ((F.col("part_id") % 4).cast("double") / 10).alias("independent_floor"))
    facts = m.action_events.filter("part_id % 2 = 1 OR owner_id % 3 = 0").select(
        "action_id", "event", "risk_source", owner,
        (0.85 + (F.col("part_id") % 15).cast("double") / 100).alias("confidence"),
        F.lit("exported_binding_continuity").alias("fact_kind"))
    return E.refine_probabilities(events, facts).select("action_id", "event", "part_id", "revised_probability", "binding_term")


@plan("h10_evidence_merge", f"""
WITH {_FLOOR}, r AS (SELECT * FROM (VALUES ('src/api/*', 'C3'), ('*migrations/*', 'C4'), ('tests/*', 'C0'), ('src/*', 'C2'), ('*.txt', 'C1')) t(g, s)),
h AS (SELECT action_id, max(s) AS s FROM change_paths JOIN r ON path GLOB g GROUP BY 1),
se AS (SELECT action_id, 'security_sensitive_change' AS event FROM actions WHERE action_id % 3 = 0 UNION ALL SELECT action_id, 'public_api_break' FROM actions WHERE action_id % 4 = 0),
x AS (SELECT se.* FROM se WHERE NOT EXISTS (SELECT 1 FROM action_events e WHERE e.action_id = se.action_id AND e.event = se.event)),
al AS (SELECT action_id, event FROM action_events UNION ALL SELECT * FROM x), n AS (SELECT action_id, count(*) AS n FROM al GROUP BY 1)
SELECT e.action_id, greatest(criticality_stage, coalesce(h.s, criticality_stage)) AS criticality_stage,
  R(CASE WHEN action_id % 10 = 0 THEN greatest(1e-6, evidence_quality - 0.3) ELSE evidence_quality END) AS evidence_quality, coalesce(n, 0) AS n_events
FROM evidence e LEFT JOIN h USING (action_id) LEFT JOIN n USING (action_id)
""")
def _(m):
    acts = m.evidence.select("action_id", "criticality_stage", "evidence_quality",
                             F.when(F.col("action_id") % 10 == 0, 0.3).otherwise(0.0).alias("quality_penalty"))
    sec = m.actions.filter("action_id % 3 = 0").select("action_id", F.lit("security_sensitive_change").alias("event")).unionByName(
        m.actions.filter("action_id % 4 = 0").select("action_id", F.lit("public_api_break").alias("event")))
    a, e = E.merge_evidence(acts, m.action_events, sec, E.criticality_from_paths(m.change_paths, RULES))
    n = e.groupBy("action_id").agg(F.count(F.lit(1)).alias("n"))
    return a.join(n, "action_id", "left").select("action_id", "criticality_stage", "evidence_quality", F.coalesce("n", F.lit(0)).alias("n_events"))


@plan("c26_feature_payload", """
SELECT action_id, max_change_kind AS change_kind, visibility IN ('public_api', 'exported') AS is_public_api, god_node_score >= 0.9 AS is_high_container_fan_in,
  symbol_fan_in_percentile >= 0.9 AS is_high_symbol_fan_in, 'pkg' || request_id % 4 AS domain FROM evidence
""")
def _(m):
    rows = m.evidence.withColumns({
        "symbol_id": F.concat(F.lit("s"), F.col("action_id").cast("string")),
        "file_path": F.concat(F.lit("pkg"), (F.col("request_id") % 4).cast("string"), F.lit("/x.py"))})
    f = rows.select("action_id", E.feature_payload().alias("f"))
    return f.select("action_id", "f.symbol.change_kind", "f.symbol.is_public_api", "f.structural.is_high_container_fan_in",
                    "f.structural.is_high_symbol_fan_in", F.element_at("f.domain.matched_domains", 1).alias("domain"))


@plan("c28_language_tier", """
WITH c AS (SELECT language, count(*) AS n, avg(CASE WHEN signature <> '' THEN 1 ELSE 0 END) AS s,
  avg(CASE WHEN visibility <> '' OR (language IN ('go', 'typescript') AND is_exported IS NOT NULL) THEN 1 ELSE 0 END) AS v FROM nodes WHERE kind IN ('function', 'class', 'interface') GROUP BY 1)
SELECT language, CASE WHEN v < 0.5 THEN 'risk_only' WHEN s < 0.5 THEN 'partial' ELSE 'full' END AS tier FROM c
""")
def _(m):
    from oddsmith.operators.callgraph import language_coverage

    cap = language_coverage(m.nodes, m.edges).withColumn("probe_status", F.lit("measured"))
    return cap.select("language", E.language_tier().alias("tier"))


@plan("c29_capability_choice", """
WITH c AS (SELECT language, count(*) AS n, avg(CASE WHEN signature <> '' THEN 1 ELSE 0 END) AS s,
  avg(CASE WHEN visibility <> '' OR (language IN ('go', 'typescript') AND is_exported IS NOT NULL) THEN 1 ELSE 0 END) AS v FROM nodes WHERE kind IN ('function', 'class', 'interface') GROUP BY 1),
l AS (SELECT action_id, min(language) AS lo, count(DISTINCT language) AS k FROM touched JOIN nodes USING (id) GROUP BY 1),
x AS (SELECT a.action_id, coalesce(k, 0) AS k, lo FROM actions a LEFT JOIN l USING (action_id))
SELECT action_id, CASE WHEN k = 1 THEN lo WHEN k > 1 THEN 'mixed' ELSE 'unknown' END AS language,
  CASE WHEN k <> 1 THEN 'unknown' WHEN n IS NULL OR v < 0.5 THEN 'risk_only' WHEN s < 0.5 THEN 'partial' ELSE 'full' END AS tier,
  k = 1 AND n > 0 AND v >= 0.5 AS structural_tier_allowed FROM x LEFT JOIN c ON k = 1 AND c.language = lo
""")
def _(m):
    from oddsmith.operators.callgraph import language_coverage

    langs = m.touched.join(m.nodes.select("id", "language"), "id").groupBy("action_id").agg(F.collect_set("language").alias("languages"))
    langs = m.actions.select("action_id").join(langs, "action_id", "left").withColumn(
        "languages", F.coalesce("languages", F.array().cast("array<string>")))
    out = E.choose_capability(langs, language_coverage(m.nodes, m.edges))
    return out.select("action_id", "language", "tier", F.coalesce("structural_tier_allowed", F.lit(False)).alias("structural_tier_allowed"))


_OWN = """
ow AS (SELECT t.action_id, n.id, n.file_path, n.language, n.kind IN ('interface') AS pc, cast(abs(length(n.id) * 7 + start_line) % 21 as double) / 20 AS x FROM touched t JOIN nodes n USING (id)),
rc AS (SELECT o.action_id, o.id AS oid, e.source AS nid FROM ow o JOIN edges e ON e.target = o.id),
sz AS (SELECT action_id, oid AS id, count(DISTINCT nid) AS r FROM rc GROUP BY 1, 2),
oa AS (SELECT action_id, count(DISTINCT id) AS oc, count(DISTINCT language) AS lc, count(*) FILTER (pc) AS pcc, max(x) AS mx, sum(x * coalesce(r, 1)) / sum(coalesce(r, 1)) AS wx
  FROM ow LEFT JOIN sz USING (action_id, id) GROUP BY 1),
fi AS (SELECT action_id, f, max(r) AS r FROM (SELECT action_id, file_path AS f, 1 AS r FROM ow UNION ALL SELECT action_id, path, 0 FROM change_files) GROUP BY 1, 2),
fa AS (SELECT action_id, count(*) AS fc, sum(r) AS rf, count(DISTINCT split_part(f, '/', 1)) AS dc FROM fi GROUP BY 1)
"""


@plan("e09_owner_aggregate", f"""WITH {_OWN}
SELECT action_id, fc AS file_count, cast(rf as bigint) AS resolved_file_count, dc AS domain_count, coalesce(oc, 0) AS owner_count, coalesce(lc, 0) AS language_count,
  coalesce(pcc, 0) AS public_contract_count, (SELECT count(DISTINCT nid) FROM rc WHERE rc.action_id = fa.action_id) AS impacted_node_count, R(coalesce(mx, 0)) AS max_owner_exposure, R(coalesce(wx, 0)) AS weighted_owner_exposure,
  R(least(0.08, 0.025 * log2(greatest(1, coalesce(oc, 0))) + 0.02 * log2(greatest(1, fc)) + 0.01 * (dc - 1) + 0.01 * greatest(0, coalesce(pcc, 0) - 1))) AS breadth_bonus,
  R(rf / cast(fc as double)) AS resolution_coverage FROM fa LEFT JOIN oa USING (action_id)""")
def _(m):
    x = F.abs(F.length("id") * 7 + F.col("start_line")) % 21
    owners = m.touched.join(m.nodes, "id").select(
        "action_id", F.col("id").alias("owner_id"), "file_path", "language", (F.col("kind") == "interface").alias("is_public_contract"),
        (x.cast("double") / 20).alias("fan_in_percentile"), F.lit(0.0).alias("impact_percentile"), F.lit(0.0).alias("transitive_impact_percentile"))
    reached = owners.select("action_id", "owner_id").join(
        m.edges.select(F.col("target").alias("owner_id"), F.col("source").alias("node_id")), "owner_id")
    return E.aggregate_owners(owners, reached, m.change_files.withColumnRenamed("path", "file_path"))


@plan("e10_file_rollup", """
WITH t AS (SELECT action_id, part_id, owner_id % 5 = 0 AS bad, cast(part_id % 20 as double) / 20 AS pct, owner_id % 9 AS dc, owner_id % 6 AS mx, 3 AS sy FROM action_events),
a AS (SELECT action_id, count(*) AS fc, count(*) FILTER (bad) AS ub, max(mx) FILTER (NOT bad) AS mx, max(dc) FILTER (NOT bad) AS known, sum(sy) FILTER (NOT bad) AS sy, max(pct) FILTER (NOT bad) AS pct FROM t GROUP BY 1),
c AS (SELECT action_id, count(DISTINCT owner_id) AS c FROM action_events WHERE owner_id % 5 <> 0 GROUP BY 1)
SELECT action_id, fc AS file_count, coalesce(mx, 0) AS max_caller_count, CASE WHEN fc = ub THEN 0 ELSE greatest(known, coalesce(c, 0)) END AS distinct_caller_count, cast(coalesce(sy, 0) as bigint) AS symbol_count,
  R(coalesce(pct, 0)) AS percentile, CASE WHEN fc = ub THEN 'unresolved' ELSE 'file_location' END AS resolution_method,
  CASE WHEN ub > 0 THEN ub || ' of ' || fc || ' file rollups unresolved' END AS fallback_reason, R(CASE WHEN fc = ub THEN 0 ELSE least(0.08, 0.02 * ln(fc) / ln(2)) END) AS cumulative_breadth_bonus
FROM a LEFT JOIN c USING (action_id)
""")
def _(m):
    o, p = F.col("owner_id"), F.col("part_id")
    roll = m.action_events.select(
        "action_id", F.when(o % 5 == 0, "unresolved").otherwise("file_location").alias("resolution_method"),
        ((p % 20).cast("double") / 20).alias("percentile"), (o % 9).alias("distinct_callers"), (o % 6).alias("max_callers"), F.lit(3).alias("symbol_count"))
    callers = m.action_events.filter("owner_id % 5 <> 0").select("action_id", o.alias("caller_id"))
    return E.rollup_files(roll, callers)


_DIFFROWS = """
df AS (SELECT 'dir' || (p_partkey // 50) % 8 || '/file' || p_partkey // 50 AS file_path,
  CASE WHEN p_partkey % 4 = 0 THEN 'Mod' || p_partkey % 40 || '::fn' || p_partkey WHEN p_partkey % 4 = 1 THEN 'Mod' || p_partkey % 40 || '.fn' || p_partkey ELSE 'fn' || p_partkey END AS qn,
  p_partkey % 2 = 0 AS sg, p_partkey % 6 = 0 AS rt, p_partkey % 9 = 0 AS vi FROM part WHERE p_partkey % 5 <> 0)
"""


@plan("d19_symbol_rows", f"""WITH {_DIFFROWS},
o AS (SELECT t.action_id, n.*, count(*) OVER (PARTITION BY t.action_id) AS k FROM touched t JOIN nodes n USING (id))
SELECT action_id, qualified_name AS symbol_id, true AS body_changed, CASE WHEN o.is_abstract = 1 THEN 'exported' ELSE 'internal' END AS visibility,
  coalesce(k = 1 AND (sg OR rt OR vi) AND sg, false) AS signature_changed, coalesce(k = 1 AND (sg OR rt OR vi) AND rt, false) AS return_shape_changed,
  coalesce(k = 1 AND (sg OR rt OR vi) AND vi, false) AS visibility_changed FROM o LEFT JOIN df ON df.file_path = o.file_path AND df.qn = o.qualified_name""")
def _(m):
    p = F.col("p_partkey")
    diff = m.nodes.filter("kind = 'function'").join(m.part.select(F.concat(F.lit("p"), p.cast("string")).alias("id"), p), "id").filter(
        "p_partkey % 5 <> 0").select("file_path", "qualified_name", F.lit("modified").alias("operation"), (p % 2 == 0).alias("signature_changed"),
        (p % 6 == 0).alias("return_type_changed"), (p % 9 == 0).alias("visibility_changed"), F.lit(None).cast("boolean").alias("is_abstract_changed"))
    owners = m.touched.join(m.nodes, "id").select(
        "action_id", "file_path", "qualified_name", (F.col("is_abstract") == 1).alias("is_contract"), F.lit(0.0).alias("callers_percentile"))
    return E.symbol_rows(owners, diff).drop("callers_percentile", "abstract_member_changed")
