"""Import-graph plans."""

from pyspark.sql import functions as F

from oddsmith.operators import imports as I
from oddsmith.plans.catalog import plan
from oddsmith.session import cut_lineage

_IMP = """
im AS (SELECT src, tgt, arg_max(kind, CASE kind WHEN 'static' THEN 4 WHEN 'relative' THEN 3 WHEN 'wildcard' THEN 2 ELSE 1 END) AS kind, NULL AS name
  FROM raw_imports WHERE tgt IS NOT NULL AND src <> tgt GROUP BY 1, 2 UNION ALL SELECT src, tgt, kind, name FROM raw_imports WHERE tgt IS NULL),
dg AS (SELECT path, (SELECT count(*) FROM im WHERE tgt = path) AS i, (SELECT count(*) FROM im WHERE src = path AND tgt IS NOT NULL) AS o FROM import_files),
hb AS (SELECT path, i, q FROM (SELECT *, cume_dist() OVER (ORDER BY i) AS q FROM dg) WHERE i >= 3)
"""
_CYC = """
pr(a, b) AS (SELECT src, tgt FROM im WHERE tgt IS NOT NULL UNION SELECT pr.a, im.tgt FROM pr JOIN im ON im.src = pr.b WHERE im.tgt IS NOT NULL),
cy AS (SELECT DISTINCT a AS path FROM pr WHERE a = b)
"""


def _edges(m):
    return I.dedupe_imports(m.raw_imports)


def _kept(m):
    return cut_lineage(_edges(m))


@plan("g21_import_dedupe", f"WITH {_IMP} SELECT src, tgt, kind, count(*) AS n FROM im GROUP BY 1, 2, 3")
def _(m):
    tasks = max(int(m.spark.conf.get("spark.sql.shuffle.partitions")), m.lineitem.count() // 1_000_000)
    return I.edge_counts(I.dedupe_imports(m.raw_imports, tasks))


@plan("g22_file_degrees", f"WITH {_IMP} SELECT path, i AS in_degree, o AS out_degree FROM dg")
def _(m):
    return I.file_degrees(_edges(m), m.import_files)


@plan("g22_cross_domain_share", f"""WITH {_IMP}
SELECT count(*) AS total_edges, count(*) FILTER (split_part(src, '/', 1) <> split_part(tgt, '/', 1)) AS cross_domain_edges,
  R(avg(CASE WHEN split_part(src, '/', 1) <> split_part(tgt, '/', 1) THEN 1 ELSE 0 END)) AS bridge_centrality FROM im WHERE tgt IS NOT NULL""")
def _(m):
    return I.cross_domain_share(_edges(m))


@plan("g23_hub_scores", f"WITH {_IMP} SELECT path, i AS in_degree, R(q) AS hub_score, q >= 0.9 AS is_anchor FROM hb")
def _(m):
    return I.hub_scores(I.file_degrees(_edges(m), m.import_files))


@plan("g24_cycle_files", f"WITH RECURSIVE {_IMP}, {_CYC} SELECT path FROM cy")
def _(m):
    return I.cycle_files(_edges(m))


@plan("g25_reverse_blast", f"""WITH RECURSIVE {_IMP},
ch AS (SELECT DISTINCT action_id, path FROM change_files),
be AS (SELECT tgt AS node, src AS imp, CASE kind WHEN 'static' THEN 0.85 WHEN 'relative' THEN 0.75 WHEN 'wildcard' THEN 0.35 WHEN 'dynamic' THEN 0.15 ELSE 0.10 END AS c FROM im WHERE tgt IS NOT NULL),
r1 AS (SELECT action_id, imp AS node, arg_min(c, be.node) AS c FROM ch JOIN be ON be.node = ch.path WHERE NOT EXISTS (SELECT 1 FROM ch x WHERE x.action_id = ch.action_id AND x.path = imp) GROUP BY 1, 2),
r2 AS (SELECT action_id, imp AS node, arg_min(be.c, be.node) AS c FROM r1 JOIN be ON be.node = r1.node WHERE NOT EXISTS (SELECT 1 FROM ch x WHERE x.action_id = r1.action_id AND x.path = imp)
  AND NOT EXISTS (SELECT 1 FROM r1 x WHERE x.action_id = r1.action_id AND x.node = imp) GROUP BY 1, 2),
r3 AS (SELECT action_id, imp AS node, arg_min(be.c, be.node) AS c FROM r2 JOIN be ON be.node = r2.node WHERE NOT EXISTS (SELECT 1 FROM ch x WHERE x.action_id = r2.action_id AND x.path = imp)
  AND NOT EXISTS (SELECT 1 FROM r1 x WHERE x.action_id = r2.action_id AND x.node = imp) AND NOT EXISTS (SELECT 1 FROM r2 x WHERE x.action_id = r2.action_id AND x.node = imp) GROUP BY 1, 2),
al AS (SELECT *, 1 AS d FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3),
en AS (SELECT DISTINCT action_id FROM (SELECT action_id, path FROM ch UNION ALL SELECT action_id, node FROM al) JOIN import_files USING (path) WHERE is_entrypoint),
st AS (SELECT action_id, count(*) FILTER (d = 1) AS dc, count(*) FILTER (d > 1) AS tc, avg(c) AS m, min(c) AS lo, count(*) FILTER (c < 0.5) AS lc FROM al GROUP BY 1)
SELECT k.action_id, coalesce(dc, 0) AS direct_count, coalesce(tc, 0) AS transitive_count, coalesce(lc, 0) AS low_confidence_edge_count, R(coalesce(m, 0)) AS edge_confidence_mean,
  R(coalesce(lo, 0)) AS edge_confidence_min, k.action_id IN (SELECT action_id FROM en) AS entrypoint_signal FROM (SELECT DISTINCT action_id FROM ch) k LEFT JOIN st USING (action_id)""")
def _(m):
    return I.reverse_blast(m.change_files, _kept(m), m.import_files)


@plan("g26_reachable_cycle", f"""WITH RECURSIVE {_IMP}, {_CYC}, rc AS (SELECT path FROM cy UNION SELECT a FROM pr WHERE b IN (SELECT path FROM cy))
SELECT action_id, bool_or(path IN (SELECT path FROM rc)) AS import_cycle_detected FROM change_files GROUP BY 1""")
def _(m):
    e = _kept(m)
    return I.cycle_from_changes(m.change_files, I.leads_to_cycle(e, I.cycle_files(e)))


_EXP = "SELECT action_id, CASE WHEN action_id % 17 = 0 THEN 'ghost/' || path ELSE path END AS path FROM {change_files}"


_UNSURE = f"""{_IMP}, ex AS (SELECT DISTINCT * FROM ({_EXP.replace('{change_files}', 'change_files')})),
pl AS (SELECT ex.*, f.path IS NULL AS miss, coalesce(parse_error, false) AS pe FROM ex LEFT JOIN import_files f USING (path)),
lo AS (SELECT pl.action_id, im.* FROM pl JOIN im ON im.src = pl.path WHERE NOT miss),
pv AS (SELECT DISTINCT action_id, 'unresolved_imports' AS list, src || ': ' || coalesce(nullif(name, ''), '<unknown>') AS line FROM lo WHERE tgt IS NULL AND kind IN ('static', 'relative')
  UNION ALL SELECT DISTINCT action_id, 'dynamic_imports', src || ': ' || coalesce(nullif(name, ''), '<dynamic>') FROM lo WHERE kind = 'dynamic'
  UNION ALL SELECT DISTINCT action_id, 'wildcard_imports', src || ': ' || coalesce(nullif(name, ''), '*') FROM lo WHERE kind = 'wildcard'
  UNION ALL SELECT action_id, 'missing_files', path FROM pl WHERE miss UNION ALL SELECT action_id, 'parse_error_files', path FROM pl WHERE pe)"""
_LISTS = ", ".join(f"coalesce((SELECT string_agg(line, ',' ORDER BY line) FROM (SELECT line FROM pv WHERE pv.action_id = b.action_id AND list = '{c}' ORDER BY line LIMIT 25)), '') AS {c}" for c in I.PROVENANCE)


@plan("g27_provenance", f"WITH {_UNSURE} SELECT * FROM pv")
def _(m):
    return I.uncertainty_provenance(m.spark.sql(_EXP, change_files=m.change_files), _edges(m), m.import_files)


@plan("g27_graph_uncertainty", f"""WITH {_UNSURE},
b AS (SELECT action_id, count(*) FILTER (miss) AS mi, count(*) FILTER (pe) AS pe, count(*) FILTER (NOT miss) AS ch FROM pl GROUP BY 1),
c AS (SELECT action_id, count(*) FILTER (tgt IS NULL AND kind IN ('static', 'relative')) AS u, count(*) FILTER (kind = 'dynamic') AS d, count(*) FILTER (kind = 'wildcard') AS w, count(*) FILTER (kind = 'external') AS x FROM lo GROUP BY 1),
t AS (SELECT count(*) FILTER (kind = 'dynamic') AS d, count(*) FILTER (kind = 'wildcard') AS w FROM im),
r AS (SELECT b.action_id, mi, pe, ch, coalesce(u, 0) AS u, coalesce(c.d, 0) AS d, coalesce(c.w, 0) AS w, coalesce(x, 0) AS x,
  CASE WHEN ch > 0 THEN t.d - coalesce(c.d, 0) ELSE 0 END AS rd, CASE WHEN ch > 0 THEN t.w - coalesce(c.w, 0) ELSE 0 END AS rw FROM b LEFT JOIN c USING (action_id), t)
SELECT action_id, mi AS missing_file_count, pe AS parse_error_count, u AS unresolved_import_count, d AS dynamic_import_count, w AS wildcard_import_count, x AS external_import_count,
  R(least(0.25, 0.05 * mi + 0.08 * pe + 0.03 * u + 0.02 * d + 0.01 * w + 0.01 * rd + 0.005 * rw)) AS graph_uncertainty_score,
  concat_ws(',', CASE WHEN mi > 0 THEN 'missing_files:' || mi END, CASE WHEN pe > 0 THEN 'parse_errors:' || pe END, CASE WHEN u > 0 THEN 'unresolved:' || u END, CASE WHEN d > 0 THEN 'dynamic:' || d END,
    CASE WHEN w > 0 THEN 'wildcard:' || w END, CASE WHEN rd + rw > 0 THEN 'elsewhere:' || (rd + rw) END) AS uncertainty_codes, {_LISTS} FROM r b""")
def _(m):
    expected = m.spark.sql(_EXP, change_files=m.change_files)
    out = I.graph_uncertainty(expected, _edges(m), m.import_files)
    return out.withColumns({c: F.array_join(c, ",") for c in (*I.PROVENANCE, "uncertainty_codes")})


@plan("g28_architecture_evidence", f"""WITH RECURSIVE {_IMP}, {_CYC}
SELECT c.action_id, count(*) FILTER (q >= 0.9) AS matched_anchors, string_agg(DISTINCT split_part(c.path, '/', 1), ',' ORDER BY split_part(c.path, '/', 1)) AS matched_domains, R(coalesce(max(q), 0)) AS god_node_score, max(o) AS fan_out,
  bool_or(c.path IN (SELECT path FROM cy)) AS cycle_participation, bool_or(f.is_entrypoint) AS domain_entrypoint,
  R(count(*) FILTER (q >= 0.9) / cast((SELECT count(*) FROM hb WHERE q >= 0.9) as double)) AS architecture_anchor_score,
  R((SELECT avg(CASE WHEN split_part(src, '/', 1) <> split_part(tgt, '/', 1) THEN 1 ELSE 0 END) FROM im WHERE tgt IS NOT NULL)) AS bridge_centrality
FROM change_files c JOIN dg ON dg.path = c.path JOIN import_files f ON f.path = c.path LEFT JOIN hb ON hb.path = c.path GROUP BY 1""")
def _(m):
    e = _kept(m)
    deg = cut_lineage(I.file_degrees(e, m.import_files))
    out = I.architecture_evidence(m.change_files, deg, I.hub_scores(deg), I.cycle_files(e), m.import_files, e)
    return out.withColumn("matched_domains", F.array_join("matched_domains", ","))


_OLD = """SELECT path, CASE WHEN length(path) % 3 = 0 THEN old_content_hash ELSE content_hash END AS content_hash FROM import_files"""


def _previous(m):
    h = F.when(F.length("path") % 3 == 0, F.col("old_content_hash")).otherwise(F.col("content_hash"))
    return m.import_files.select("path", h.alias("content_hash"))


@plan("d12_file_changes", f"""
WITH o AS (SELECT * FROM ({_OLD}) WHERE NOT path LIKE 'dir1/%'), n AS (SELECT path, content_hash FROM import_files WHERE NOT path LIKE 'dir2/%')
SELECT path, CASE WHEN o.content_hash IS NULL THEN 'added' WHEN n.content_hash IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'modified' ELSE 'unchanged' END AS status FROM o FULL JOIN n USING (path)
""")
def _(m):
    return I.file_changes(_previous(m).filter("path NOT LIKE 'dir1/%'"), m.import_files.filter("path NOT LIKE 'dir2/%'"))


@plan("d12_edge_refresh", f"""WITH {_IMP}, mo AS (SELECT path FROM ({_OLD}) o JOIN import_files n USING (path) WHERE o.content_hash <> n.content_hash),
pe AS (SELECT src, tgt, 'static' AS kind FROM im WHERE tgt IS NOT NULL), ne AS (SELECT src, tgt, kind FROM im WHERE tgt IS NOT NULL)
SELECT *, 'carried' AS origin FROM pe WHERE src NOT IN (SELECT path FROM mo) UNION ALL SELECT *, 'parsed' FROM ne WHERE src IN (SELECT path FROM mo)""")
def _(m):
    e = _edges(m).filter("tgt IS NOT NULL").select("src", "tgt", "kind")
    return I.refresh_edges(I.file_changes(_previous(m), m.import_files), e.withColumn("kind", F.lit("static")), e)
