"""The policy probe multiplies rows after its joins, not inside a broadcast."""

from oddsmith.operators import scoring as S
from oddsmith.plans.bindings import Model


def test_no_multiplied_side_is_broadcast(spark):
    m = Model(spark, "/root/testdata/sf0.01")
    lines = S.policy_probe(m.evidence, m.action_events)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [x for x in lines[i + 1:] if depth(x) > depth(line)]
            assert not any("explode" in x for x in below)
