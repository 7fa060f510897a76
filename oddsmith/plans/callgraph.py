"""Dependency-graph plans."""

from pyspark.sql import functions as F

from oddsmith.functions.columns import fractional_rank
from oddsmith.operators import callgraph as G
from oddsmith.plans.catalog import plan

_FAN = "('calls', 'references', 'instantiates')"
_CALL = "('function', 'class', 'interface')"
_EDGES = f"fe AS (SELECT DISTINCT source, target FROM edges WHERE kind IN {_FAN}), cn AS (SELECT * FROM nodes WHERE kind IN {_CALL})"
_CNT = f"{_EDGES}, ct AS (SELECT id, file_path, (SELECT count(*) FROM fe WHERE target = cn.id) AS callers FROM cn)"


def _touched(m):
    return m.touched.select(F.col("action_id").alias("key"), F.col("id").alias("node"))


def _roots(m):
    c = G.callables(m.nodes)
    return c.select(F.col("id").alias("key"), F.col("id").alias("node"))


@plan("a05_graph_scan", f"SELECT kind, count(*) AS n FROM edges WHERE kind IN {_FAN} GROUP BY 1 UNION ALL SELECT kind, count(*) FROM nodes WHERE kind IN {_CALL} GROUP BY 1")
def _(m):
    from oddsmith import constants as K

    e = m.edges.filter(F.col("kind").isin(*K.FANIN_EDGES)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return e.unionByName(G.callables(m.nodes).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


@plan("g01_set_fan_in", f"""WITH {_EDGES}
SELECT t.action_id AS key, count(DISTINCT fe.source) FILTER (WHERE NOT EXISTS (SELECT 1 FROM touched u WHERE u.action_id = t.action_id AND u.id = fe.source)) AS caller_count
FROM touched t LEFT JOIN fe ON fe.target = t.id GROUP BY 1""")
def _(m):
    return G.set_fan_in(_touched(m), m.edges)


@plan("g02_fan_in_percentile", f"WITH {_CNT} SELECT id, callers, R(cume_dist() OVER (ORDER BY callers)) AS percentile FROM ct")
def _(m):
    return G.fan_in_percentiles(m.nodes, m.edges).select("id", "callers", "percentile")


@plan("f01_fractional_rank", """
WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, n, R(cume_dist() OVER (ORDER BY n)) AS percentile FROM c
""")
def _(m):
    n = m.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    counts = m.customer.select("c_custkey").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return fractional_rank(counts, "n")


@plan("g03_file_rollup", f"""WITH {_CNT},
u AS (SELECT file_path, count(DISTINCT source) AS d FROM cn LEFT JOIN fe ON target = id GROUP BY 1), s AS (SELECT file_path, count(*) AS k, max(callers) AS mx FROM ct GROUP BY 1)
SELECT file_path, d AS distinct_callers, mx AS max_callers, k AS symbol_count, R(cume_dist() OVER (ORDER BY d)) AS percentile FROM u JOIN s USING (file_path)""")
def _(m):
    return G.file_fan_in(m.nodes, m.edges)


@plan("g29_hottest_symbol_percentile", f"""WITH {_CNT}, p AS (SELECT *, cume_dist() OVER (ORDER BY callers) AS q FROM ct)
SELECT file_path, R(CASE WHEN max(callers) > 0 THEN max(q) END) AS percentile FROM p GROUP BY 1""")
def _(m):
    return G.hottest_symbol_percentile(m.nodes, m.edges)


@plan("g04_edge_kind_counts", """
SELECT action_id AS key, 'in' AS direction, kind, count(DISTINCT source) AS n FROM touched JOIN edges ON target = id GROUP BY 1, 2, 3
UNION ALL SELECT action_id, 'out', kind, count(DISTINCT target) FROM touched JOIN edges ON source = id GROUP BY 1, 2, 3
""")
def _(m):
    maps = G.edge_kind_maps(_touched(m), m.edges)
    side = lambda d, c: f"transform(map_entries({c}), e -> struct('{d}' AS direction, e.key AS kind, e.value AS n))"
    return maps.selectExpr("key", f"inline(concat({side('in', 'incoming')}, {side('out', 'outgoing')}))")


_UP = """
up AS (SELECT DISTINCT e.target AS node, e.source AS parent FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'contains' AND n.kind IN ('class', 'interface', 'module')),
anc(key, node, d) AS (SELECT b.key, up.parent, 1 FROM base b JOIN up ON up.node = b.node UNION SELECT a.key, up.parent, a.d + 1 FROM anc a JOIN up ON up.node = a.node WHERE a.d < 8),
tg AS (SELECT key, node FROM base UNION SELECT key, node FROM anc)
"""
_ROOT = f"base AS (SELECT id AS key, id AS node FROM nodes WHERE kind IN {_CALL}), {_UP}"
_ACT = f"base AS (SELECT action_id AS key, id AS node FROM touched), {_UP}"
_REACH = f"""
ie AS (SELECT DISTINCT source, target FROM edges WHERE kind IN {_FAN}),
rc(key, id, d) AS (SELECT t.key, e.source, 1 FROM tg t JOIN ie e ON e.target = t.node WHERE NOT EXISTS (SELECT 1 FROM tg b WHERE b.key = t.key AND b.node = e.source)
  UNION SELECT r.key, e.source, r.d + 1 FROM rc r JOIN ie e ON e.target = r.id WHERE r.d < 3 AND NOT EXISTS (SELECT 1 FROM tg b WHERE b.key = r.key AND b.node = e.source)),
rr AS (SELECT key, id, min(d) AS d FROM rc GROUP BY 1, 2)
"""


@plan("g05_container_ancestors", f"WITH RECURSIVE {_ROOT} SELECT DISTINCT key, node FROM anc")
def _(m):
    return G.ancestors(_roots(m), m.nodes, m.edges)


@plan("g06_direct_impact", f"""WITH RECURSIVE {_ACT},
h AS (SELECT DISTINCT t.key, e.kind, e.source FROM tg t JOIN edges e ON e.target = t.node WHERE e.kind IN {_FAN} AND NOT EXISTS (SELECT 1 FROM tg b WHERE b.key = t.key AND b.node = e.source))
SELECT key, kind, count(DISTINCT source) AS n FROM h GROUP BY 1, 2 UNION ALL SELECT key, '*', count(DISTINCT source) FROM h GROUP BY 1""")
def _(m):
    return G.direct_impact_counts(G.impact_targets(_touched(m), m.nodes, m.edges), m.edges)


@plan("g07_transitive_reach", f"""WITH RECURSIVE {_ACT}, {_REACH}
SELECT key, count(*) AS transitive_count, count(*) FILTER (d = 1) AS depth1, count(*) FILTER (d = 2) AS depth2, count(*) FILTER (d = 3) AS depth3,
  R(least(1, count(*) / cast((SELECT count(*) FROM nodes) as double))) AS blast_fraction FROM rr GROUP BY 1""")
def _(m):
    return G.blast_fraction(G.set_reach_summary(_touched(m), m.nodes, m.edges), m.nodes)


@plan("g08_impact_distributions", f"""WITH RECURSIVE {_ROOT}, {_REACH},
dc AS (SELECT key, count(DISTINCT source) AS n FROM tg JOIN ie ON target = node GROUP BY 1), tc AS (SELECT key, count(*) AS n FROM rr GROUP BY 1),
p AS (SELECT id AS key, coalesce(dc.n, 0) AS direct_count, coalesce(tc.n, 0) AS transitive_count FROM nodes LEFT JOIN dc ON dc.key = id LEFT JOIN tc ON tc.key = id WHERE kind IN {_CALL})
SELECT key, direct_count, transitive_count, R(cume_dist() OVER (ORDER BY direct_count)) AS direct_percentile, R(cume_dist() OVER (ORDER BY transitive_count)) AS transitive_percentile FROM p""")
def _(m):
    from oddsmith.session import cut_lineage

    pop = cut_lineage(G.impact_populations(m.nodes, m.edges))
    return fractional_rank(fractional_rank(pop, "direct_count", "direct_percentile"), "transitive_count", "transitive_percentile")


_OWNER = f"""
pr AS (SELECT DISTINCT action_id AS a, id AS o FROM touched),
base AS (SELECT DISTINCT o AS key, o AS node FROM pr), {_UP},
ot AS (SELECT a, o, node FROM pr JOIN tg ON key = o), bl AS (SELECT DISTINCT a, node FROM ot),
ie AS (SELECT DISTINCT source, target FROM edges WHERE kind IN {_FAN}),
rc(a, o, id, d) AS (SELECT t.a, t.o, e.source, 1 FROM ot t JOIN ie e ON e.target = t.node WHERE NOT EXISTS (SELECT 1 FROM bl b WHERE b.a = t.a AND b.node = e.source)
  UNION SELECT r.a, r.o, e.source, r.d + 1 FROM rc r JOIN ie e ON e.target = r.id WHERE r.d < 3 AND NOT EXISTS (SELECT 1 FROM bl b WHERE b.a = r.a AND b.node = e.source)),
rr AS (SELECT a, o, id, min(d) AS d FROM rc GROUP BY 1, 2, 3)
"""


@plan("g09_owner_evidence", f"""WITH RECURSIVE {_OWNER},
cc AS (SELECT a, o, count(*) AS n FROM pr JOIN ie ON target = o WHERE NOT EXISTS (SELECT 1 FROM pr q WHERE q.a = pr.a AND q.o = ie.source) GROUP BY 1, 2),
fp AS (SELECT id, (SELECT count(*) FROM ie WHERE target = nodes.id) AS n FROM nodes WHERE kind IN {_CALL}),
rk AS (SELECT a, o, count(*) FILTER (d = 1) AS dn, count(*) AS tn FROM rr GROUP BY 1, 2)
SELECT pr.a AS action, pr.o AS key, coalesce(cc.n, 0) AS caller_count, coalesce(dn, 0) AS direct_count, coalesce(tn, 0) AS transitive_count,
  R(CASE WHEN cc.n > 0 THEN (SELECT avg(CASE WHEN fp.n <= cc.n THEN 1 ELSE 0 END) FROM fp) ELSE 0 END) AS fan_in_percentile FROM pr LEFT JOIN cc USING (a, o) LEFT JOIN rk USING (a, o)""")
def _(m):
    members = m.touched.select(F.col("action_id").alias("action"), F.col("id").alias("key"))
    return G.owner_evidence(members, m.nodes, m.edges).select(
        "action", "key", "caller_count", "direct_count", "transitive_count", "fan_in_percentile")


_SITE = "cast((cast(substr(source, 2) as bigint) + cast(substr(target, 2) as bigint)) % 50 as int)"


_WITNESS = f"""{_OWNER},
w1 AS (SELECT r.*, n.file_path, n.qualified_name AS qn, n.start_line, row_number() OVER (PARTITION BY a, o ORDER BY d, n.file_path, n.qualified_name, n.id) AS rn FROM rr r JOIN nodes n ON n.id = r.id),
si AS (SELECT t.o, e.source, e.kind, {_SITE} AS line, row_number() OVER (PARTITION BY t.o, e.source ORDER BY CASE WHEN {_SITE} > 0 THEN 0 ELSE 1 END, {_SITE}, e.kind, e.target) AS rn
  FROM (SELECT DISTINCT o, node FROM ot) t JOIN edges e ON e.target = t.node WHERE e.kind IN {_FAN}),
nw AS (SELECT a, count(*) AS n_witnesses FROM w1 GROUP BY 1),
w2 AS (SELECT w1.a, w1.o, w1.id, own.qualified_name AS owner_name, qn AS dependent_name, w1.file_path, d AS depth, CASE WHEN si.line > 0 THEN si.line ELSE w1.start_line END AS line, coalesce(si.kind, '') AS edge_kind,
  CASE WHEN si.line > 0 THEN 'edge_site' ELSE 'node_definition' END AS location_source FROM w1 JOIN nodes own ON own.id = w1.o LEFT JOIN si ON w1.d = 1 AND si.o = w1.o AND si.source = w1.id AND si.rn = 1 WHERE w1.rn <= @OWNER@),
w3 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY depth, owner_name, dependent_name, file_path, line NULLS LAST, edge_kind, o, id) AS position FROM w2),
w4 AS (SELECT * FROM w3 WHERE position <= @ACTION@), sw AS (SELECT a, count(*) AS shown FROM w4 GROUP BY 1)
SELECT a AS action, owner_name, dependent_name, file_path, depth, line, edge_kind, location_source, cast(position as int) AS position, n_witnesses, shown < n_witnesses AS truncated FROM w4 JOIN nw USING (a) JOIN sw USING (a)"""


def _witnesses(m, per_owner=None, per_action=None):
    members = m.touched.select(F.col("action_id").alias("action"), F.col("id").alias("key"))
    edges = m.edges.withColumns({"line": F.expr(_SITE), "col": F.lit(0)})
    return G.impact_witnesses(members, m.nodes, edges, per_owner, per_action)


@plan("g10_impact_witnesses", f"WITH RECURSIVE {_WITNESS.replace('@OWNER@', '3').replace('@ACTION@', '5')}")
def _(m):
    return _witnesses(m, 3, 5)


@plan("g10_every_witness", f"WITH RECURSIVE {_WITNESS.replace('@OWNER@', '1000000000').replace('@ACTION@', '1000000000')}")
def _(m):
    return _witnesses(m)


@plan("g11_edges_among_owners", f"""
WITH x AS (SELECT t.action_id, count(DISTINCT (e.source, e.target, e.kind)) AS n FROM touched t JOIN edges e ON e.source = t.id JOIN touched u ON u.action_id = t.action_id AND u.id = e.target WHERE e.kind <> 'contains' GROUP BY 1)
SELECT a.action_id AS key, coalesce(n, 0) AS edge_count FROM (SELECT DISTINCT action_id FROM touched) a LEFT JOIN x USING (action_id)
""")
def _(m):
    return G.edges_among(_touched(m), m.edges)


@plan("g12_contract_surface", """
WITH o AS (SELECT t.action_id, n.* FROM touched t JOIN nodes n USING (id)),
c AS (SELECT DISTINCT t.action_id, n.* FROM touched t JOIN edges e ON e.target = t.id AND e.kind = 'contains' JOIN nodes n ON n.id = e.source WHERE n.kind IN ('class', 'interface')),
al AS (SELECT * FROM o UNION ALL SELECT * FROM c),
g AS (SELECT action_id, bool_or(kind = 'interface') AS i, bool_or(is_abstract = 1) AS ab, bool_or(coalesce(is_exported = 1, false) OR coalesce(visibility = 'public', false)) AS ex FROM al GROUP BY 1),
ok AS (SELECT action_id, min(kind) AS k, bool_or(coalesce(signature <> '', false) OR coalesce(return_type <> '', false)) AS sg FROM o GROUP BY 1), ck AS (SELECT action_id, min(kind) AS k FROM c GROUP BY 1)
SELECT action_id AS key, CASE WHEN i THEN 'interface' WHEN ck.k IS NOT NULL THEN ck.k || '_' || ok.k ELSE ok.k END AS contract_surface_kind, i OR ab OR ex AS is_exported_contract,
  i OR ab AS is_abstract_or_interface, sg AS has_signature_metadata FROM g JOIN ok USING (action_id) LEFT JOIN ck USING (action_id)
""")
def _(m):
    return G.contract_surface(_touched(m), m.nodes, m.edges)


@plan("g13_file_metadata", """
WITH p AS (SELECT DISTINCT action_id, file_path FROM touched JOIN nodes USING (id))
SELECT action_id AS key, cast(sum(size) as bigint) AS size_bytes, cast(sum(node_count) as bigint) AS node_count,
  cast(sum(CASE errors WHEN '[]' THEN 0 WHEN 'broken' THEN 1 ELSE 2 END) as bigint) AS error_count FROM p JOIN files ON path = file_path GROUP BY 1
""")
def _(m):
    return G.file_metadata(_touched(m), m.nodes, m.files)


@plan("g14_dependent_files", f"""
SELECT DISTINCT t.file_path AS file, s.file_path AS dependent FROM edges e JOIN nodes t ON t.id = e.target JOIN nodes s ON s.id = e.source
WHERE e.kind IN {_FAN} AND t.kind IN {_CALL} AND s.file_path <> t.file_path
""")
def _(m):
    return G.dependent_files(m.nodes, m.edges)


@plan("g14_caller_files", f"""
SELECT DISTINCT t.action_id AS key, s.file_path AS file FROM touched t JOIN edges e ON e.target = t.id JOIN nodes s ON s.id = e.source
WHERE e.kind IN {_FAN} AND NOT EXISTS (SELECT 1 FROM touched u WHERE u.action_id = t.action_id AND u.id = e.source)
""")
def _(m):
    return G.caller_files(_touched(m), m.nodes, m.edges)


@plan("d21_covering_tests", f"""
SELECT DISTINCT t.file_path AS file, s.file_path AS test_file FROM edges e JOIN nodes t ON t.id = e.target JOIN nodes s ON s.id = e.source
WHERE e.kind IN {_FAN} AND t.kind IN {_CALL} AND s.file_path LIKE '%/test%'
""")
def _(m):
    return G.covering_tests(m.nodes, m.edges)


@plan("g16_hottest_files", f"""WITH {_EDGES}
SELECT file_path, count(DISTINCT source) AS distinct_callers FROM cn JOIN fe ON target = id GROUP BY 1""")
def _(m):
    return G.hottest_files(m.nodes, m.edges)


_DEG = f"""fe AS (SELECT DISTINCT source, target FROM edges WHERE kind IN {_FAN}),
dg AS (SELECT id, file_path, qualified_name, (SELECT count(*) FROM fe WHERE target = n.id) AS inbound, (SELECT count(*) FROM fe WHERE source = n.id) AS outbound FROM nodes n),
ts AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY inbound DESC, outbound DESC, qualified_name, id) AS rk FROM dg)"""


@plan("g17_top_symbols", f"WITH {_DEG} SELECT file_path, id, inbound, outbound, cast(rk as int) AS symbol_rank FROM ts")
def _(m):
    return G.top_symbols(m.nodes, m.edges).select("file_path", "id", "inbound", "outbound", "symbol_rank")


_CENTRE = f"""c0 AS (SELECT id FROM ts WHERE rk = 1 AND inbound > 0),
s1 AS (SELECT DISTINCT source AS id FROM fe WHERE target IN (SELECT id FROM c0)), s2 AS (SELECT DISTINCT source AS id FROM fe WHERE target IN (SELECT id FROM s1)),
sn AS (SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM c0 UNION ALL SELECT id, 1 FROM s1 UNION ALL SELECT id, 2 FROM s2) GROUP BY 1),
se AS (SELECT DISTINCT source, target, kind FROM edges WHERE kind IN {_FAN} AND source IN (SELECT id FROM sn) AND target IN (SELECT id FROM sn))"""


def _around(m):
    centres = G.top_symbols(m.nodes, m.edges, 1).filter("inbound > 0")
    return G.subgraph_around(centres, m.edges)


def _rows(nodes, edges):
    return nodes.select(F.col("id").alias("a"), F.lit("").alias("b"), F.lit("node").alias("kind"), "depth").unionByName(
        edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "kind", F.lit(None).cast("int").alias("depth")))


@plan("g15_hot_subgraph", f"WITH {_DEG}, {_CENTRE} SELECT id AS a, '' AS b, 'node' AS kind, depth FROM sn UNION ALL SELECT source, target, kind, NULL FROM se")
def _(m):
    return _rows(*_around(m))


_CAPPED = """SELECT (SELECT count(*) FROM {n}) AS total_nodes, (SELECT count(*) FROM {e}) AS total_edges, (SELECT count(*) FROM vn) AS shown_nodes, (SELECT count(*) FROM ve) AS shown_edges,
  (SELECT count(*) FROM vn) < (SELECT count(*) FROM {n}) OR (SELECT count(*) FROM ve) < (SELECT count(*) FROM {e}) AS truncated"""


@plan("g15_capped_view", f"""WITH {_DEG}, {_CENTRE}, vn AS (SELECT * FROM sn ORDER BY depth, id LIMIT 300),
ve AS (SELECT * FROM se WHERE source IN (SELECT id FROM vn) AND target IN (SELECT id FROM vn) ORDER BY source, target, kind LIMIT 1200), {_CAPPED.replace('{n}', 'sn').replace('{e}', 'se').join(('t AS (', ')'))}
SELECT a, b, kind, depth, total_nodes, total_edges, shown_nodes, shown_edges, truncated FROM (SELECT id AS a, '' AS b, 'node' AS kind, depth FROM vn UNION ALL SELECT source, target, kind, NULL FROM ve), t""")
def _(m):
    nodes, edges, about = G.capped_view(*_around(m), ["depth"], 300, 1200)
    return _rows(nodes, edges).join(F.broadcast(about))  # one row


_HUB = f"""{_DEG},
hf AS (SELECT file_path, count(DISTINCT source) AS c FROM nodes JOIN fe ON target = id WHERE kind IN {_CALL} GROUP BY 1),
sh AS (SELECT id, file_path, c, rk, inbound FROM ts JOIN hf USING (file_path)),
hn AS (SELECT 'file:' || file_path AS id, 'hub' AS role, file_path, c AS distinct_callers, 0 AS symbol_rank, c AS inbound FROM hf UNION ALL SELECT id, 'symbol', file_path, c, cast(rk as int), inbound FROM sh),
he AS (SELECT 'file:' || file_path AS source, id AS target, 'contains' AS kind, 'spoke' AS edge_type FROM sh
  UNION ALL SELECT DISTINCT source, target, kind, 'cross_symbol' FROM edges WHERE kind IN {_FAN} AND source IN (SELECT id FROM sh) AND target IN (SELECT id FROM sh))"""


@plan("g18_hub_map", f"WITH {_HUB} SELECT source, target, kind, edge_type FROM he")
def _(m):
    return G.hub_map(m.nodes, m.edges)[1]


@plan("g18_hub_nodes", f"WITH {_HUB} SELECT * FROM hn")
def _(m):
    return G.hub_map(m.nodes, m.edges)[0]


@plan("g18_capped_view", f"""WITH {_HUB}, vn AS (SELECT * FROM hn ORDER BY distinct_callers DESC, file_path, symbol_rank, id LIMIT 250),
ve AS (SELECT * FROM he WHERE source IN (SELECT id FROM vn) AND target IN (SELECT id FROM vn) ORDER BY source, target, kind, edge_type LIMIT 800), {_CAPPED.replace('{n}', 'hn').replace('{e}', 'he').join(('t AS (', ')'))}
SELECT a, b, kind, total_nodes, total_edges, shown_nodes, shown_edges, truncated FROM (SELECT id AS a, '' AS b, role AS kind FROM vn UNION ALL SELECT source, target, edge_type FROM ve), t""")
def _(m):
    nodes, edges, about = G.capped_view(*G.hub_map(m.nodes, m.edges), [F.desc("distinct_callers"), "file_path", "symbol_rank"], 250, 800)
    rows = nodes.select(F.col("id").alias("a"), F.lit("").alias("b"), F.col("role").alias("kind")).unionByName(
        edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("edge_type").alias("kind")))
    return rows.join(F.broadcast(about))  # one row


_FILES = f"""ke AS (SELECT DISTINCT source, target, kind FROM edges WHERE kind IN {_FAN}),
en AS (SELECT ke.*, s.file_path AS src, t.file_path AS dst FROM ke JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target)"""


@plan("g19_full_graph", f"WITH {_FILES} SELECT src AS source, dst AS target, count(*) AS weight FROM en WHERE src <> dst GROUP BY 1, 2")
def _(m):
    return G.file_graph(m.nodes, m.edges)[1]


@plan("g19_files", f"""WITH {_FILES}, ib AS (SELECT dst AS id, count(DISTINCT source) AS n FROM en GROUP BY 1)
SELECT f.id, symbol_count, coalesce(n, 0) AS inbound_count FROM (SELECT file_path AS id, count(*) AS symbol_count FROM nodes GROUP BY 1) f LEFT JOIN ib USING (id)""")
def _(m):
    return G.file_graph(m.nodes, m.edges)[0]


@plan("g19_symbol_graph", f"SELECT id AS a, '' AS b, kind, file_path FROM nodes UNION ALL SELECT DISTINCT source, target, kind, NULL FROM edges WHERE kind IN {_FAN} AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)")
def _(m):
    nodes, edges = G.symbol_graph(m.nodes, m.edges)
    return nodes.select(F.col("id").alias("a"), F.lit("").alias("b"), "kind", "file_path").unionByName(
        edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "kind", F.lit(None).cast("string").alias("file_path")))


@plan("g20_node_counts", """
SELECT kind, language, count(*) AS n FROM nodes GROUP BY 1, 2 UNION ALL SELECT '*callable', NULL, count(*) FROM nodes WHERE kind <> 'module' UNION ALL SELECT '*total', NULL, count(*) FROM nodes
""")
def _(m):
    t = G.node_counts(m.nodes)
    row = lambda k, c: t.select(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("language"), F.col(c).alias("n"))
    return G.kind_counts(m.nodes).unionByName(row("*callable", "callable")).unionByName(row("*total", "total"))


@plan("e13_language_coverage", f"""
WITH c AS (SELECT language, count(*) AS n, avg(CASE WHEN signature <> '' THEN 1 ELSE 0 END) AS s,
  avg(CASE WHEN visibility <> '' OR (language IN ('go', 'typescript') AND is_exported IS NOT NULL) THEN 1 ELSE 0 END) AS v FROM nodes WHERE kind IN {_CALL} GROUP BY 1)
SELECT language, n AS node_count, R(s) AS signature_ratio, R(v) AS visibility_ratio,
  (SELECT string_agg(DISTINCT e.kind, ',' ORDER BY e.kind) FROM edges e JOIN nodes x ON x.id = e.source WHERE x.kind IN {_CALL} AND x.language = c.language) AS edge_kinds FROM c
""")
def _(m):
    return G.language_coverage(m.nodes, m.edges).withColumn("edge_kinds", F.array_join("edge_kinds", ","))


_RANGES = """SELECT l_orderkey * 10 + l_linenumber AS range_id, 'dir' || cast(cast(floor(l_partkey / 50) as bigint) % 8 as string) || '/file' || cast(cast(floor(l_partkey / 50) as bigint) as string) AS file_path,
  min(cast(l_quantity * 18 as int)) AS lo, min(cast(l_quantity * 18 as int)) + 12 AS hi FROM {lineitem} GROUP BY 1, 2"""


@plan("d09_interval_owners", f"""WITH r0 AS ({_RANGES.replace('{lineitem}', 'lineitem')}), r AS (SELECT *, row_number() OVER () AS q FROM r0),
h AS (SELECT q, range_id, r.file_path, n.id, start_line AS s, end_line AS e FROM r JOIN nodes n ON n.file_path = r.file_path AND start_line <= hi AND end_line >= lo)
SELECT range_id, file_path, id FROM h WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.q = h.q AND c.s >= h.s AND c.e <= h.e AND c.e - c.s < h.e - h.s)""")
def _(m):
    r = m.spark.sql(_RANGES, lineitem=m.lineitem)
    keyed = r.withColumn("range_id", F.struct(F.col("range_id").alias("r"), F.col("file_path").alias("f")))
    return G.owners_at(keyed, m.nodes).select(F.col("range_id.r").alias("range_id"), F.col("range_id.f").alias("file_path"), "id")


_REQ = """SELECT p_partkey AS request, 'dir' || cast(cast(floor(p_partkey / 50) as bigint) % 8 as string) || '/file' || cast(cast(floor(p_partkey / 50) as bigint) as string) AS file_path,
  CASE p_partkey % 3 WHEN 0 THEN 'Mod' || cast(p_partkey % 40 as string) || '.fn' || cast(p_partkey as string) WHEN 1 THEN 'X.' || p_name ELSE 'fn' || cast(p_partkey as string) END AS qualified FROM {part}"""


@plan("d10_name_resolution", f"""WITH r AS ({_REQ.replace('{part}', 'part')}),
x AS (SELECT request, count(DISTINCT id) AS n, min(id) AS f FROM r JOIN nodes n ON n.file_path = r.file_path AND qualified_name IN (qualified, replace(qualified, '.', '::')) GROUP BY 1),
l AS (SELECT request, count(DISTINCT id) AS n, min(id) AS f FROM r JOIN nodes n ON n.file_path = r.file_path AND n.name = regexp_extract(qualified, '([^.:]*)$', 1) WHERE request NOT IN (SELECT request FROM x) GROUP BY 1)
SELECT request, coalesce(x.n, l.n, 0) AS matches, coalesce(x.f, l.f) AS first_id, CASE WHEN x.n > 0 THEN 'qualified' WHEN l.n > 0 THEN 'leaf' END AS by, coalesce(x.n, l.n, 0) > 1 AS ambiguous
FROM r LEFT JOIN x USING (request) LEFT JOIN l USING (request)""")
def _(m):
    return G.resolve_names(m.spark.sql(_REQ, part=m.part), m.nodes)


@plan("d11_graph_diff", """
WITH b AS (SELECT * FROM nodes WHERE kind = 'function' AND start_line % 70 <> 0),
a AS (SELECT id, file_path, qualified_name, CASE WHEN start_line % 90 = 0 THEN 'changed' ELSE signature END AS signature, return_type, CASE WHEN start_line % 110 = 0 THEN 'public' ELSE visibility END AS visibility, is_abstract FROM nodes WHERE kind = 'function' AND start_line % 130 <> 0)
SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.qualified_name, b.qualified_name) AS qualified_name,
  CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'modified' END AS operation,
  a.signature <> b.signature AS signature_changed, a.return_type <> b.return_type AS return_type_changed, a.visibility <> b.visibility AS visibility_changed, a.is_abstract <> b.is_abstract AS is_abstract_changed
FROM b FULL JOIN a ON a.file_path = b.file_path AND a.qualified_name = b.qualified_name
""")
def _(m):
    fn = m.nodes.filter("kind = 'function'")
    after = fn.filter("start_line % 130 <> 0").withColumns({
        "signature": F.when(F.col("start_line") % 90 == 0, "changed").otherwise(F.col("signature")),
        "visibility": F.when(F.col("start_line") % 110 == 0, "public").otherwise(F.col("visibility"))})
    return G.diff_nodes(fn.filter("start_line % 70 <> 0"), after)
