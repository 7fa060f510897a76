"""Injected probabilities as exact decimals where they meet given ones."""

from oddsmith.operators import evidence as E
from oddsmith.plans.bindings import Model


def test_equal_probability_takes_no_ownership(spark):
    m = Model(spark, "/root/testdata/sf0.1")
    ids = (106052, 126131, 133436, 48637)
    mine = lambda df: df.filter(df.action_id.isin(*ids))
    injected = E.modify_event(mine(m.evidence))
    own = {(r.action_id, r.event) for r in injected.collect()}
    rows = [r for r in E.merge_events(mine(m.action_events), injected).collect() if (r.action_id, r.event) in own]
    assert len(rows) == 4 and all(r.risk_source is None and r.independent_floor is None for r in rows)
