"""Ranking plans."""

from pyspark.sql import functions as F

from oddsmith.operators import decisions as D
from oddsmith.operators import ranking as R
from oddsmith.plans.catalog import plan
from oddsmith.plans.decisions import _EV
from oddsmith.plans.scoring import _SCORED, scored

_RK = """
rc AS (SELECT action_id, request_id, rau, loss, benefit, god_node_score AS ce, 1 + action_id % 2 AS fc, resolved_symbol_count AS oc, action_id % 3 AS dc, bridge_centrality AS cov, sha256(coalesce(proposed_patch, '')) AS h,
  action_id % 4 <> 0 AS has_scope, CASE WHEN action_id % 5 < 2 THEN 'proceed' ELSE 'ask_human' END AS rd FROM sc WHERE NOT policy_violation AND action_id % 6 <> 1),
rr AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rau DESC, loss, benefit DESC, ce, fc, oc, dc, cov DESC, h, action_id) AS rank FROM rc)
"""


def _ranked(m):
    k = F.col("action_id")
    rows = scored(m).select(
        "action_id", "request_id", "rau", "expected_loss", "benefit", F.col("god_node_score").alias("cumulative_exposure"), (1 + k % 2).alias("file_count"),
        F.col("resolved_symbol_count").alias("owner_count"), (k % 3).alias("domain_count"), F.col("bridge_centrality").alias("resolution_coverage"),
        F.sha2(F.coalesce("proposed_patch", F.lit("")), 256).alias("patch_hash"), (~F.col("policy_violation")).alias("eligible"), (k % 6 != 1).alias("needs_refinement"),
        (k % 4 != 0).alias("has_scope"), F.when(k % 5 < 2, "proceed").otherwise("ask_human").alias("refined_decision"))
    return R.rank_candidates(rows)


@plan("i01_candidate_rank", f"WITH {_SCORED}, {_RK} SELECT request_id, action_id, rank FROM rr")
def _(m):
    return _ranked(m).select("request_id", "action_id", "rank")


@plan("i02_refinement_budget", f"""WITH {_SCORED}, {_RK}, s AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS t FROM rr WHERE has_scope),
h AS (SELECT request_id, bool_or(t = 1 AND rd = 'proceed') AS p1, bool_or(t = 2 AND rd = 'proceed') AS p2 FROM s GROUP BY 1),
x AS (SELECT rr.*, coalesce(s.t = 1 OR (s.t = 2 AND NOT p1), false) AS sel, coalesce(p1 OR p2, false) AS stop FROM rr LEFT JOIN s USING (request_id, action_id) LEFT JOIN h USING (request_id))
SELECT request_id, action_id, rank, sel AS selected, CASE WHEN sel THEN 'evaluated' WHEN stop THEN 'not_evaluated_after_proceed' ELSE 'budget_exhausted' END AS status FROM x""")
def _(m):
    return R.refinement_status(_ranked(m), 2)


@plan("i03_recommended_action", f"""WITH {_SCORED}, {_EV},
d AS (SELECT *, CASE WHEN san AND fg <> 11 AND obligations_missing THEN 'revise_safer' WHEN san THEN 'proceed' ELSE dec END AS fd FROM g4),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE fd WHEN 'proceed' THEN 0 WHEN 'reject' THEN 2 ELSE 1 END, rau DESC, loss, benefit DESC, sha256(coalesce(proposed_patch, '')), action_id) AS k, count(*) OVER (PARTITION BY request_id) AS n FROM d)
SELECT request_id, action_id AS recommended_action, fd AS decision, n AS candidates FROM r WHERE k = 1""")
def _(m):
    return R.recommended(D.decide(scored(m)))
