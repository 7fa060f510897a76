"""Fan-in, reach and map operators over ``nodes``/``edges`` tables.

Set-valued questions take a ``members(key, node)`` table, so one job answers them for every
action, owner or root at once.  Nothing is collected; loops only count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddsmith import constants as K
from oddsmith.functions.columns import last_segment, posix, rank_table, rank_values
from oddsmith.session import cut_lineage, written


def callables(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*K.CALLABLE_KINDS))


def structural(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*K.OWNER_KINDS))


def links(edges: DataFrame, kinds=K.FANIN_EDGES) -> DataFrame:
    """Distinct (source, target) pairs of the given edge kinds."""
    return edges.filter(F.col("kind").isin(*kinds)).select("source", "target").distinct()


def node_counts(nodes: DataFrame) -> DataFrame:
    call = F.col("kind").isin(*K.CALLABLE_KINDS)
    return nodes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(call).alias("callable"),
        F.count_if(call & F.endswith(F.lower("file_path"), F.lit(".cs"))).alias("csharp_callable"),
    )


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind", "language").agg(F.count(F.lit(1)).alias("n"))


def language_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Measured signature/visibility coverage and edge kinds per language."""
    text = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    seen = text("visibility") | (F.col("language").isin(*K.EXPORT_LANGUAGES) & F.col("is_exported").isNotNull())
    base = callables(nodes).filter(F.coalesce(F.col("language") != "", F.lit(False)))
    cover = base.groupBy("language").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.avg(text("signature").cast("int")).alias("signature_ratio"),
        F.avg(seen.cast("int")).alias("visibility_ratio"),
    )
    kinds = (
        edges.join(base.select(F.col("id").alias("source"), "language"), "source")
        .groupBy("language")
        .agg(F.array_sort(F.collect_set("kind")).alias("edge_kinds"))
    )
    return cover.join(kinds, "language", "left")


# --- fan-in -------------------------------------------------------------------------------------------


def set_fan_in(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct outside callers of each node set."""
    calls = links(edges).withColumnsRenamed({"target": "node", "source": "caller"})
    inside = members.select("key", F.col("node").alias("caller"))
    hits = members.join(calls, "node").select("key", "caller").distinct().join(inside, ["key", "caller"], "left_anti")
    counts = hits.groupBy("key").agg(F.count(F.lit(1)).alias("caller_count"))
    return members.select("key").distinct().join(counts, "key", "left").select(
        "key", F.coalesce("caller_count", F.lit(0)).alias("caller_count")
    )


def fan_in(nodes: DataFrame, edges: DataFrame, kinds=K.FANIN_EDGES) -> DataFrame:
    """Distinct callers of every callable, zeros included."""
    per = links(edges, kinds).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    return callables(nodes).join(per, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))


def fan_in_percentiles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = fan_in(nodes, edges).select("id", "file_path", "callers")
    return counts.join(rank_table(counts.select("callers"), "callers"), "callers").withColumnRenamed("fraction", "percentile")


def file_fan_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Whole-file roll-up: union of callers, hottest symbol, symbol count, percentile over files."""
    placed = callables(nodes).filter(F.col("file_path").isNotNull()).select("id", "file_path")
    joined = placed.join(links(edges).withColumnRenamed("target", "id"), "id")
    union = joined.select("file_path", "source").distinct().groupBy("file_path").agg(F.count(F.lit(1)).alias("distinct_callers"))
    per = (
        placed.join(joined.groupBy("id").agg(F.count(F.lit(1)).alias("c")), "id", "left")
        .groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("symbol_count"), F.coalesce(F.max("c"), F.lit(0)).alias("max_callers"))
    )
    out = per.join(union, "file_path", "left").withColumn("distinct_callers", F.coalesce("distinct_callers", F.lit(0)))
    table = rank_table(out.select("distinct_callers"), "distinct_callers").withColumnRenamed("fraction", "percentile")
    return out.join(table, "distinct_callers")


def hottest_symbol_percentile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Percentile of each file's hottest symbol among all symbols; NULL if nothing calls it."""
    ranked = fan_in_percentiles(nodes, edges).filter(F.col("file_path").isNotNull())
    top = ranked.groupBy("file_path").agg(F.max("callers").alias("callers"), F.max("percentile").alias("p"))
    return top.select("file_path", F.when(F.col("callers") > 0, F.col("p")).alias("percentile"))


#: Set members whose neighbours one task counts.
TASK_MEMBERS = 50_000


def edge_kind_counts(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node set by direction and edge kind.

    Neighbours are counted per node first.  Where only one node of a set has neighbours of a direction and
    kind, its count is the set's; only where several have, their neighbours are written out and told apart.
    """
    m = written(members.select("key", "node").distinct())
    e = written(edges.select("source", "target", "kind").distinct())
    end = lambda node, other, d: e.select(F.col(node).alias("node"), F.lit(d).alias("direction"), "kind", F.col(other).alias("other"))
    ends = end("target", "source", "in").unionByName(end("source", "target", "out"))
    per = ends.groupBy("node", "direction", "kind").agg(F.count(F.lit(1)).alias("n"))
    group = ["key", "direction", "kind"]
    tasks = 1 + m.count() // TASK_MEMBERS
    met = written(m.join(per, "node").repartition(tasks, *group).groupBy(*group).agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("n")))
    several = m.join(met.filter("nodes > 1").select(*group), "key").join(ends, ["node", "direction", "kind"]).select(*group, "other").distinct()
    return met.filter("nodes = 1").select(*group, "n").unionByName(several.groupBy(*group).agg(F.count(F.lit(1)).alias("n")))


def edge_kind_maps(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The same as one map per direction; a map holds at most one entry per edge kind."""
    entry = lambda d: F.map_from_entries(
        F.sort_array(F.collect_list(F.when(F.col("direction") == d, F.struct("kind", "n")))))
    return edge_kind_counts(members, edges).groupBy("key").agg(entry("in").alias("incoming"), entry("out").alias("outgoing"))


# --- containment and reach -------------------------------------------------------------------------------


def ancestors(members: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = K.CONTAINER_DEPTH) -> DataFrame:
    """(key, node) for every container above a member, up to ``depth`` levels."""
    up = (
        edges.filter(F.col("kind") == "contains")
        .join(nodes.filter(F.col("kind").isin(*K.CONTAINER_KINDS)).select(F.col("id").alias("source")), "source")
        .select(F.col("target").alias("node"), F.col("source").alias("parent"))
        .distinct()
    )
    up = written(up)
    frontier = members.select("key", "node")
    found = None
    for _ in range(depth):
        step = frontier.join(up, "node").select("key", F.col("parent").alias("node")).distinct()
        if found is not None:
            step = step.join(found, ["key", "node"], "left_anti")
        step = cut_lineage(step)
        found = step if found is None else found.unionByName(step)
        if step.isEmpty():
            break
        frontier = step
    return found.distinct()


def impact_targets(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Members plus their containers: what a modification is taken to change."""
    return members.select("key", "node").unionByName(ancestors(members, nodes, edges)).distinct()


def direct_impact(targets: DataFrame, edges: DataFrame, exclude_inside: bool = True) -> DataFrame:
    """(key, kind, source) of impact edges into each target set."""
    e = edges.filter(F.col("kind").isin(*K.IMPACT_EDGES)).select(F.col("target").alias("node"), "source", "kind").distinct()
    hits = targets.join(e, "node").select("key", "kind", "source").distinct()
    if exclude_inside:
        hits = hits.join(targets.withColumnRenamed("node", "source"), ["key", "source"], "left_anti")
    return hits


def direct_impact_counts(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct dependents per set, overall (kind ``*``) and by edge kind.

    A dependent is one row of its set with a bit per edge kind, from the edges on; tasks follow the number of targets.
    """
    targets = written(targets.select("key", "node"))
    bit = reduce(lambda c, k: c.when(F.col("kind") == k, 1 << K.IMPACT_EDGES.index(k)), K.IMPACT_EDGES[1:], F.when(F.col("kind") == K.IMPACT_EDGES[0], 1))
    e = edges.filter(F.col("kind").isin(*K.IMPACT_EDGES)).groupBy(F.col("target").alias("node"), "source").agg(F.bit_or(bit).alias("kinds"))
    tasks = 1 + targets.count() // TASK_MEMBERS
    hits = targets.join(e, "node").select("key", "source", "kinds").repartition(tasks, "key", "source").groupBy("key", "source").agg(F.bit_or("kinds").alias("kinds"))
    hits = hits.join(targets.withColumnRenamed("node", "source"), ["key", "source"], "left_anti")
    counts = [F.count(F.lit(1)).alias("*"), *[F.count_if(F.col("kinds").bitwiseAND(1 << i) > 0).alias(k) for i, k in enumerate(K.IMPACT_EDGES)]]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("n")) for k in ("*", *K.IMPACT_EDGES)]))
    return hits.groupBy("key").agg(*counts).select("key", rows.alias("x")).filter("x.n > 0").select("key", "x.kind", "x.n")


def reach(targets: DataFrame, edges: DataFrame, blocked: DataFrame | None = None, depth: int = K.REACH_DEPTH,
          keys: tuple[str, ...] = ("key",), blocked_keys: tuple[str, ...] | None = None, mark: Column | None = None) -> DataFrame:
    """Reverse reach with the nearest depth of each node.

    With ``mark``, made of an edge's columns, also the least mark of the edges from a node at depth 1 into the targets.

    A shortest way never comes back to a target, so walks of 1 to ``depth`` edges are followed and the
    least length per (key, node) counts, the targets themselves at 0.  The longest walks are shuffled once,
    by that aggregate.  A hub target is a skewed join key, which adaptive execution
    splits; the pairs of one key are never gathered in one task.
    """
    keys = list(keys)
    marks, unmarked = [], []
    if mark is None:
        back = written(links(edges, K.IMPACT_EDGES).withColumnsRenamed({"target": "node", "source": "next"}))
    else:
        impact = edges.filter(F.col("kind").isin(*K.IMPACT_EDGES))
        back = written(impact.groupBy(F.col("target").alias("node"), F.col("source").alias("next")).agg(F.min(mark).alias("mark")))
        marks, unmarked = [F.min("mark").alias("mark")], [F.lit(None).cast(back.schema["mark"].dataType).alias("mark")]
    bkeys = list(blocked_keys or keys)
    stop = None if blocked is None else written(blocked.select(*bkeys, "node").distinct())
    frontier = written(targets.select(*keys, "node").distinct())
    walks = [frontier.select(*keys, "node", *unmarked, F.lit(0).alias("depth"))]
    for d in range(1, depth + 1):
        step = frontier.select(*keys, "node").join(back, "node").select(*keys, F.col("next").alias("node"), *(["mark"] if marks and d == 1 else unmarked))
        if stop is not None:
            step = step.join(stop, [*bkeys, "node"], "left_anti")
        if d < depth:
            step = frontier = written(step.groupBy(*keys, "node").agg(*marks) if marks else step.distinct())
        walks.append(step.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, walks).groupBy(*keys, "node").agg(F.min("depth").alias("depth"), *marks).filter("depth > 0")


def reach_summary(reached: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    at = lambda d: F.count_if(F.col("depth") == d).alias(f"depth{d}")
    return reached.groupBy(*keys).agg(F.count(F.lit(1)).alias("transitive_count"), at(1), at(2), at(3))


#: Entries of all owners' reach up to which a set is settled from lists; a larger one is settled row by row.
SET_ENTRIES = 100_000


def set_reach_summary(members: DataFrame, nodes: DataFrame, edges: DataFrame, entries: int = SET_ENTRIES) -> DataFrame:
    """Reach of each node set, counted by depth; sets that reach nothing have no row.

    The reach of a set is that of its owners, each node at its least depth, without what the set itself holds.  So each owner is
    walked once, however many sets name it.  A set of one owner takes that owner's counts; larger ones
    unite their owners' lists of node numbers, or the rows themselves if the lists would be long.
    """
    pairs = written(members.select("key", F.col("node").alias("owner")).distinct())
    own = pairs.select(F.col("owner").alias("key")).distinct().withColumn("node", F.col("key"))
    targets = written(impact_targets(own, nodes, edges))
    numbers = written(targets.select("node").unionByName(links(edges, K.IMPACT_EDGES).select(F.col("source").alias("node"))).distinct().withColumn("number", F.monotonically_increasing_id()))
    ball = written(
        targets.withColumn("depth", F.lit(0)).unionByName(reach(targets, edges)).join(numbers, "node")
        .select(F.col("key").alias("owner"), "number", "depth"))
    sizes = written(ball.groupBy("owner").agg(F.count(F.lit(1)).alias("entries"), *[F.count_if(F.col("depth") == d).alias(f"depth{d}") for d in (1, 2, 3)]))
    sets = pairs.join(sizes.select("owner", "entries"), "owner").groupBy("key").agg(F.count(F.lit(1)).alias("owners"), F.sum("entries").alias("entries"), F.max("owner").alias("owner"))
    sets = written(sets)
    counts = ["depth1", "depth2", "depth3"]
    single = sets.filter("owners = 1").join(sizes.drop("entries"), "owner").select("key", *counts)
    small = pairs.join(sets.filter((F.col("owners") > 1) & (F.col("entries") <= entries)).select("key"), "key")
    large = pairs.join(sets.filter((F.col("owners") > 1) & (F.col("entries") > entries)).select("key"), "key")
    lists = ball.join(sizes.filter(F.col("entries") <= entries).select("owner"), "owner", "left_semi").groupBy("owner").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("depth") == d, F.col("number")))).alias(f"at{d}") for d in range(4)])
    united = small.join(lists, "owner").groupBy("key").agg(*[F.array_distinct(F.flatten(F.collect_list(f"at{d}"))).alias(f"at{d}") for d in range(4)])
    # what is new at a depth: the union up to it, less the union up to the one before
    upto = [F.size(F.array_distinct(F.concat(*[F.col(f"at{k}") for k in range(d + 1)]))) for d in range(4)]
    united = united.select("key", *[(upto[d] - upto[d - 1]).cast("bigint").alias(f"depth{d}") for d in (1, 2, 3)])
    rows = large.join(ball, "owner").groupBy("key", "number").agg(F.min("depth").alias("depth"))
    rows = rows.groupBy("key").agg(*[F.count_if(F.col("depth") == d).alias(f"depth{d}") for d in (1, 2, 3)])
    out = single.unionByName(united).unionByName(rows).withColumn("transitive_count", F.col("depth1") + F.col("depth2") + F.col("depth3"))
    return out.filter("transitive_count > 0").select("key", "transitive_count", *counts)


def blast_fraction(summary: DataFrame, nodes: DataFrame) -> DataFrame:
    total = structural(nodes).agg(F.count(F.lit(1)).alias("n")).scalar()
    return summary.withColumn(
        "blast_fraction", F.when(total > 0, F.least(F.lit(1.0), F.col("transitive_count") / total)).otherwise(0.0))


def impact_populations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct and transitive impact counts of every callable, zeros included."""
    roots = callables(nodes).select(F.col("id").alias("key"), F.col("id").alias("node"))
    targets = written(impact_targets(roots, nodes, edges))
    direct = (
        direct_impact(targets, edges, exclude_inside=False).select("key", "source").distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("direct_count"))
    )
    far = reach_summary(reach(targets, edges)).select("key", "transitive_count")
    return roots.select("key").join(direct, "key", "left").join(far, "key", "left").select(
        "key", F.coalesce("direct_count", F.lit(0)).alias("direct_count"),
        F.coalesce("transitive_count", F.lit(0)).alias("transitive_count"))


def _percentile_or_zero(df: DataFrame, population: DataFrame, pop_col: str, col: str, out: str) -> DataFrame:
    """Rank a count in a population; a zero count ranks 0.0 rather than the share of zeros."""
    pop = population.select(F.col(pop_col).alias(col))
    return rank_values(df, pop, col, out).withColumn(out, F.when(F.col(col) > 0, F.col(out)).otherwise(0.0))


def owner_evidence(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per (action, owner): callers, direct and transitive counts, each with its percentile."""
    plain, ball, own_reach, callers = owner_reach(members, nodes, edges)
    per = [F.count_if(F.col("depth") == 1).alias("direct_count"), F.count(F.lit(1)).alias("transitive_count")]
    counts = plain.join(ball.groupBy("key").agg(*per), "key").select("action", "key", "direct_count", "transitive_count").unionByName(
        own_reach.groupBy("action", "key").agg(*per))
    base = members.select("action", "key").distinct().join(callers, ["action", "key"], "left").join(counts, ["action", "key"], "left")
    base = base.select("action", "key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("caller_count", "direct_count", "transitive_count")])
    base = cut_lineage(base)
    pops = cut_lineage(impact_populations(nodes, edges))
    base = _percentile_or_zero(base, fan_in(nodes, edges), "callers", "caller_count", "fan_in_percentile")
    base = _percentile_or_zero(base, pops, "direct_count", "direct_count", "impact_percentile")
    return _percentile_or_zero(base, pops, "transitive_count", "transitive_count", "transitive_percentile")


def owner_reach(members: DataFrame, nodes: DataFrame, edges: DataFrame, mark: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reach of each owner that stops at anything the same action changes, and its callers.

    An owner is walked once for all its actions: ``ball(key, node, depth)``.  That is its reach in every action of
    ``plain(action, key)``.  Only where the walk meets something else that the action changes does the result depend on
    the action; those pairs are walked anew with what stops them: ``own_reach(action, key, node, depth)``.
    """
    pairs = written(members.select("action", "key").distinct())
    per_owner = pairs.select("key").distinct().withColumn("node", F.col("key"))
    own = written(impact_targets(per_owner, nodes, edges))
    ball = written(reach(own, edges, mark=mark))
    targets = written(pairs.join(own, "key").select("action", "key", "node"))
    several = pairs.join(pairs.groupBy("action").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("action"), "action")
    others = several.join(targets.select("action", F.col("key").alias("other"), "node"), "action").filter("other <> key").select("action", "key", "node")
    apart = written(others.join(ball.select("key", "node"), ["key", "node"]).select("action", "key").distinct())
    plain = written(pairs.join(apart, ["action", "key"], "left_anti"))
    blocked = targets.join(apart.select("action").distinct(), "action", "left_semi").select("action", "node").distinct()
    own_reach = written(reach(targets.join(apart, ["action", "key"], "left_semi"), edges, blocked, keys=("action", "key"), blocked_keys=("action",), mark=mark))
    calls = links(edges).select(F.col("target").alias("key"), F.col("source").alias("caller"))
    inside = pairs.select("action", F.col("key").alias("caller"))
    callers = (
        pairs.join(calls, "key").join(inside, ["action", "caller"], "left_anti")
        .groupBy("action", "key").agg(F.count(F.lit(1)).alias("caller_count"))
    )
    return plain, ball, own_reach, callers


def impact_witnesses(members: DataFrame, nodes: DataFrame, edges: DataFrame, per_owner: int | None = None, per_action: int | None = None) -> DataFrame:
    """Dependents of each owner, nearest first: all of them, or the first few of each owner and action.

    With limits, ``n_witnesses`` still counts all of the action and ``truncated`` tells whether any is left out.
    A depth-1 witness shows the first edge site that has a line.

    An owner's witnesses are described, cut and ranked once.  The order goes by depth, then owner's name, so
    where names differ a witness's position is its rank inside (owner, depth) plus the numbers of the blocks
    before it: rows of all actions are never sorted.  Actions with two owners of one name are ranked whole.

    Nodes are numbers in the order of their ids until the end.  Descriptions are shuffled once, by owner, and meet there
    the actions, one row an owner, for which blocks are counted beforehand from the walks alone.
    """
    ids = nodes.select("id").unionByName(edges.select(F.explode(F.array("source", "target")).alias("id"))).unionByName(members.select(F.col("key").alias("id")))
    numbers = written(written(ids.filter("id IS NOT NULL").distinct()).orderBy("id").withColumn("number", F.monotonically_increasing_id()))
    number = lambda df, c: df.join(numbers.select(F.col("id").alias(c), F.col("number").alias("_n")), c).drop(c).withColumnRenamed("_n", c)
    members = number(members.select("action", "key").distinct(), "key")
    nodes = written(number(nodes.select("id", "kind", "file_path", "qualified_name", "start_line"), "id"))
    used = edges.filter(F.col("kind").isin("contains", *K.IMPACT_EDGES)).select("source", "target", "kind", "line", "col")
    edges = written(number(number(used, "source"), "target"))
    site = F.struct(F.when(F.col("line") > 0, 0).otherwise(1).alias("place"), "line", "col", F.col("kind").alias("edge_kind"), "target")  # the first comes first
    plain, ball, own_reach, _ = owner_reach(members, nodes, edges, site)
    info = nodes.select(F.col("id").alias("node"), "file_path", "qualified_name", "start_line")
    names = nodes.select(F.col("id").alias("key"), F.col("qualified_name").alias("owner_name"))
    depths = range(1, K.REACH_DEPTH + 1)

    def described(reached: DataFrame, by: list[str]) -> DataFrame:
        """Witnesses of each ``by`` with their place inside it at their depth, ``rank``, and how many the whole ``by`` has."""
        at_edge = F.coalesce(F.col("mark.line") > 0, F.lit(False))
        picked = reached.join(info, "node").select(
            *by, "node", "depth", "file_path", "qualified_name", F.when(at_edge, F.col("mark.line")).otherwise(F.col("start_line")).alias("line"),
            F.coalesce("mark.edge_kind", F.lit("")).alias("edge_kind"), at_edge.alias("at_edge")).repartition(*by)
        if per_owner is not None:
            near = W.partitionBy(*by).orderBy("depth", "file_path", "qualified_name", "node")
            picked = picked.withColumns({"rn": F.row_number().over(near), "whole": F.count(F.lit(1)).over(W.partitionBy(*by))}).filter(F.col("rn") <= per_owner).drop("rn")
        rows = picked.join(names, "key").withColumns({"file_path": posix("file_path"), "location_source": F.when(F.col("at_edge"), "edge_site").otherwise("node_definition")})
        level = W.partitionBy(*by, "depth").orderBy("dependent_name", "file_path", F.col("line").asc_nulls_last(), "edge_kind", "node")
        return rows.withColumnRenamed("qualified_name", "dependent_name").withColumn("rank", F.row_number().over(level))

    def levels(reached: DataFrame, by: list[str]) -> DataFrame:
        """One row per ``by`` and owner's name: how many are shown at each depth, before any limit on the action."""
        at = lambda n: [F.sum(F.when(F.col("depth") == d, n).otherwise(0)).alias(f"n{d}") for d in depths]
        if per_owner is not None:
            return reached.groupBy(*by, "owner_name", "whole").agg(*at(F.lit(1)))
        counted = reached.join(info.groupBy("node").agg(F.count(F.lit(1)).alias("c")), "node").groupBy(*by).agg(F.sum("c").alias("whole"), *at(F.col("c")))
        named = names.groupBy("key", "owner_name").agg(F.count(F.lit(1)).alias("same"))
        return counted.join(named, "key").select(*by, "owner_name", "whole", *[(F.col(f"n{d}") * F.col("same")).alias(f"n{d}") for d in depths])

    shared, special = described(ball, ["key"]), described(own_reach, ["action", "key"])
    if per_owner is not None:
        shared, special = written(shared), written(special)
        ball, own_reach = shared, special
    blocks = plain.join(levels(ball, ["key"]), "key").withColumn("own", F.lit(False)).unionByName(levels(own_reach, ["action", "key"]).withColumn("own", F.lit(True)))
    action, named = W.partitionBy("action"), W.partitionBy("action", "owner_name")
    earlier = action.orderBy("owner_name", "key").rowsBetween(W.unboundedPreceding, -1)
    holder = lambda f, d: f(F.when(F.col(f"n{d}") > 0, F.col("key"))).over(named)
    twice = reduce(Column.__or__, [F.coalesce(holder(F.min, d) != holder(F.max, d), F.lit(False)) for d in depths])
    placed = blocks.filter("action IS NOT NULL").repartition("action").withColumns({
        "twice": twice, "head": F.row_number().over(W.partitionBy("action", "key").orderBy("owner_name")) == 1,
        **{f"t{d}": F.sum(f"n{d}").over(action) for d in depths}, **{f"e{d}": F.coalesce(F.sum(f"n{d}").over(earlier), F.lit(0)) for d in depths}})
    upto = lambda d: reduce(Column.__add__, [F.col(f"t{k}") for k in range(1, d)], F.lit(0))
    placed = placed.withColumns({
        "mixed": F.max("twice").over(action), "n_witnesses": F.sum(F.when(F.col("head"), F.col("whole"))).over(action),
        "lines": upto(K.REACH_DEPTH + 1), **{f"before{d}": upto(d) + F.col(f"e{d}") for d in depths}})
    shown = F.col("lines") if per_action is None else F.least(F.col("lines"), F.lit(per_action))
    placed = placed.withColumn("truncated", shown < F.col("n_witnesses"))
    if per_action is not None:
        first = F.coalesce(*[F.when(F.col(f"n{d}") > 0, F.col(f"before{d}")) for d in depths])
        placed = placed.filter((first < per_action) | F.col("mixed"))
    placed = written(placed.select("action", "key", "own", "n_witnesses", "truncated", "mixed", *[f"before{d}" for d in depths]))
    shared, special = (df.drop("whole", "at_edge") for df in (shared, special))
    rows = placed.filter("NOT own").join(shared, "key").unionByName(placed.filter("own").join(special, ["action", "key"]))
    order = W.partitionBy("action").orderBy("depth", "owner_name", "dependent_name", "file_path",
                                            F.col("line").asc_nulls_last(), "edge_kind", "key", "node")
    before = reduce(lambda c, d: c.when(F.col("depth") == d, F.col(f"before{d}")), depths[1:], F.when(F.col("depth") == 1, F.col("before1")))
    easy = rows.filter("NOT mixed").withColumn("position", (before + F.col("rank")).cast("int"))
    out = easy.unionByName(rows.filter("mixed").withColumn("position", F.row_number().over(order)))
    out = out if per_action is None else out.filter(F.col("position") <= per_action)
    return out.select("action", "owner_name", "dependent_name", "file_path", "depth", "line", "edge_kind", "location_source", "position", "n_witnesses", "truncated")


def edges_among(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct non-containment edges whose two ends are both in the set."""
    e = edges.filter((F.col("kind") != "contains") & (F.col("source") != F.col("target"))).select("source", "target", "kind").distinct()
    a = members.select("key", F.col("node").alias("source"))
    b = members.select("key", F.col("node").alias("target"))
    counts = a.join(e, "source").join(b, ["key", "target"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return members.select("key").distinct().join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("edge_count"))


def contract_surface(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Surface kind, exported and abstract flags from owner and container kinds."""
    cols = ["kind", "is_exported", "is_abstract", "visibility", "signature", "return_type"]
    own = members.join(nodes.select(F.col("id").alias("node"), *cols), "node").select("key", F.lit("o").alias("role"), *cols)
    parents = edges.filter("kind = 'contains'").select(F.col("target").alias("node"), F.col("source").alias("id")).distinct()
    boxes = (
        members.join(parents, "node").select("key", "id").distinct()
        .join(nodes.filter(F.col("kind").isin(*K.CONTRACT_CONTAINERS)).select("id", *cols), "id")
        .select("key", F.lit("c").alias("role"), *cols)
    )
    rows = own.unionByName(boxes)
    is_own = F.col("role") == "o"
    has = lambda k, r=None: F.bool_or((F.col("kind") == k) & (F.lit(True) if r is None else F.col("role") == r))
    nonempty = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    g = rows.groupBy("key").agg(
        F.min(F.when(is_own, F.col("kind"))).alias("own_kind"),
        F.min(F.when(~is_own, F.col("kind"))).alias("box_kind"),
        has("interface").alias("i"), has("protocol").alias("p"), has("trait").alias("t"),
        (has("interface", "c") & has("method", "o")).alias("im"),
        F.bool_or(F.coalesce(F.col("is_abstract") != 0, F.lit(False))).alias("ab"),
        F.bool_or(F.coalesce(F.col("is_exported") != 0, F.lit(False))
                  | F.coalesce(F.lower("visibility").isin("public", "public_api", "exported"), F.lit(False))).alias("ex"),
        F.bool_or(is_own & (nonempty("signature") | nonempty("return_type"))).alias("has_signature_metadata"),
    )
    abstract = F.col("i") | F.col("p") | F.col("t") | F.col("ab")
    surface = (
        F.when(F.col("im"), "interface_method").when(F.col("i"), "interface").when(F.col("p"), "protocol")
        .when(F.col("t"), "trait")
        .when(F.col("box_kind").isNotNull(), F.concat_ws("_", "box_kind", "own_kind"))
        .otherwise(F.coalesce("own_kind", F.lit("unknown")))
    )
    return g.select("key", surface.alias("contract_surface_kind"), (abstract | F.col("ex")).alias("is_exported_contract"),
                    abstract.alias("is_abstract_or_interface"), "has_signature_metadata")


def error_count(errors: str = "errors") -> Column:
    """Entries of a JSON error list; anything unreadable counts as one."""
    raw = F.trim(F.col(errors))
    v = F.try_parse_json(raw)
    items = F.coalesce(F.json_array_length(raw), F.size(F.json_object_keys(raw)), F.lit(1))
    return F.when(F.col(errors).isNull() | raw.isin("", "[]", "{}"), 0).when(v.isNull(), 1).otherwise(items)


def file_metadata(members: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    paths = members.join(nodes.select(F.col("id").alias("node"), F.col("file_path").alias("path")), "node").select("key", "path").distinct()
    return paths.join(files.withColumn("n_errors", error_count()), "path").groupBy("key").agg(
        F.sum("size").alias("size_bytes"), F.sum("node_count").alias("node_count"), F.sum("n_errors").alias("error_count"))


def dependent_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, dependent file) pairs over impact edges into callables."""
    tgt = callables(nodes).select(F.col("id").alias("target"), F.col("file_path").alias("file"))
    src = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("dependent"))
    return (
        links(edges, K.IMPACT_EDGES).join(tgt, "target").join(src, "source")
        .filter("dependent IS NOT NULL AND dependent <> file").select("file", "dependent").distinct()
    )


def caller_files(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct files of the outside callers of each node set."""
    calls = links(edges).withColumnsRenamed({"target": "node", "source": "caller"})
    inside = members.select("key", F.col("node").alias("caller"))
    src = nodes.select(F.col("id").alias("caller"), posix("file_path").alias("file"))
    return (
        members.join(calls, "node").select("key", "caller").distinct().join(inside, ["key", "caller"], "left_anti")
        .join(src, "caller").select("key", "file").distinct()
    )


def covering_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Caller files of a file's callables that look like tests."""
    tgt = callables(nodes).select(F.col("id").alias("target"), F.col("file_path").alias("file"))
    src = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("test_file"))
    p = F.lower(posix("test_file"))
    looks = F.contains(F.substring_index(p, "/", -1), F.lit("test")) | F.contains(p, F.lit("/tests/")) | F.contains(p, F.lit("/test/"))
    return links(edges).join(tgt, "target").join(src, "source").filter(looks).select("file", "test_file").distinct()


# --- lookups --------------------------------------------------------------------------------------------------


LINES = 16  #: lines of the smallest bin


def nested_bins(first: str, last: str) -> Column:
    """The fewest aligned bins, each twice as wide as the level below, that make up bins ``first`` to ``last``: ``struct(level, bin)``.

    At each level at most one bin at either end is left over, so there are at most two a level.
    """
    lo, hi = f"shiftright({first} + shiftleft(1L, k) - 1, k)", f"shiftright({last} + 1, k)"
    left = f"CASE WHEN {lo} < {hi} AND {lo} % 2 = 1 THEN struct(k AS level, {lo} AS bin) END"
    right = f"CASE WHEN {lo} < {hi} AND {hi} % 2 = 1 THEN struct(k AS level, {hi} - 1 AS bin) END"
    levels = f"sequence(0, cast(ceil(log2({last} - {first} + 2)) as int))"
    return F.expr(f"CASE WHEN {last} >= {first} THEN filter(flatten(transform({levels}, k -> array({left}, {right}))), x -> x IS NOT NULL) ELSE array() END")


def bins_around(df: DataFrame, bin: str, top: Column) -> DataFrame:
    """``df`` with a row for its bin and each one that lies around it, up to level ``top``: columns ``level``, ``bin``."""
    return df.withColumn("level", F.explode(F.sequence(F.lit(0), top))).withColumn("bin", F.call_function("shiftright", F.col(bin), F.col("level")))


def overlapping(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each of ``ranges`` (file_path, lo, hi) with each of ``nodes`` (id, file_path, start_line, end_line) that overlaps it, once.

    Either the node covers the range's first bin, or it starts in a later bin of the range.  The
    interval is made up of nested bins, the single bin looks up all it lies in, and both meet on
    an equal (file, level, bin): a node of a million lines has about 20 rows, and so has a range.
    """
    bin = lambda c: F.floor(F.col(c) / LINES).cast("bigint")
    r = ranges.withColumns({"b_lo": bin("lo"), "b_next": bin("lo") + 1, "b_hi": bin("hi")})
    n = nodes.select("id", "file_path", "start_line", "end_line", bin("start_line").alias("b_from"), bin("end_line").alias("b_to"))
    # levels in use, by the widest interval of either side
    top = lambda df, a, b: F.coalesce(df.agg(F.ceil(F.log2(F.max(F.greatest(F.col(b) - F.col(a), F.lit(0))) / LINES + 3)).cast("int").alias("t")).select("t").scalar(), F.lit(0))
    keyed = lambda df, bins: df.withColumn("x", F.explode(bins)).select("*", "x.level", "x.bin").drop("x")
    key = ["file_path", "level", "bin"]
    covers = bins_around(r, "b_lo", top(nodes, "start_line", "end_line")).join(keyed(n, nested_bins("b_from", "b_to")), key)
    begins = keyed(r, nested_bins("b_next", "b_hi")).join(bins_around(n, "b_from", top(ranges, "lo", "hi")), key)
    both = covers.unionByName(begins).filter("start_line <= hi AND end_line >= lo")
    return both.drop("level", "bin", "b_lo", "b_next", "b_hi", "b_from", "b_to")


def owners_at(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tightest owner nodes overlapping each (file, lo, hi) range.

    A place is looked up once, however many ranges name it.  A node is dropped when a strictly
    smaller matched node lies inside it; that is one ordered window per place over distinct
    intervals, not a comparison of all pairs.  A range that ends before it begins meets nothing.
    """
    place = ["file_path", "lo", "hi"]
    places = ranges.select(*place).filter("lo <= hi").distinct()
    hits = overlapping(places, structural(nodes)).repartition(*place)
    later = W.partitionBy(*place).orderBy(F.col("start_line"), F.col("end_line").desc()).rowsBetween(1, W.unboundedFollowing)
    leaves = (
        hits.groupBy(*place, "start_line", "end_line").agg(F.collect_set("id").alias("ids"))
        .withColumn("inner_end", F.min("end_line").over(later))
        .filter("inner_end IS NULL OR inner_end > end_line")
    )
    return ranges.select("range_id", *place).join(leaves.select(*place, "ids"), place).select("range_id", F.explode("ids").alias("id"))


def resolve_names(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exact qualified name in either separator, else the leaf name inside the file."""
    colon = F.replace("qualified", F.lit("."), F.lit("::"))
    tried = requests.withColumn("q", F.explode(F.array_distinct(F.array(F.col("qualified"), colon))))
    exact = tried.join(nodes.select("id", "file_path", F.col("qualified_name").alias("q")), ["file_path", "q"])
    exact = exact.groupBy("request").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first_id"))
    leaf = F.substring_index(F.replace("qualified", F.lit("::"), F.lit(".")), ".", -1)
    rest = requests.join(exact, "request", "left_anti").withColumn("name", leaf)
    loose = rest.join(nodes.select("id", "file_path", "name"), ["file_path", "name"]).groupBy("request").agg(
        F.countDistinct("id").alias("n"), F.min("id").alias("first_id"))
    found = exact.withColumn("by", F.lit("qualified")).unionByName(loose.withColumn("by", F.lit("leaf")))
    return requests.join(found, "request", "left").select(
        "request", F.coalesce("n", F.lit(0)).alias("matches"), "first_id", "by", (F.coalesce("n", F.lit(0)) > 1).alias("ambiguous"))


def diff_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added / removed / modified owners; a field is NULL where either side lacks it.

    A (file, qualified name) that repeats on one side cannot be compared and is reported as
    ambiguous instead.
    """
    fields = ("signature", "return_type", "visibility", "is_abstract")
    truth = F.when(F.col("is_abstract").isNotNull(), F.col("is_abstract") != 0)

    def side(df, tag):
        keyed = callables(df).filter("file_path IS NOT NULL AND qualified_name IS NOT NULL").withColumn("is_abstract", truth)
        return keyed.groupBy(posix("file_path").alias("file_path"), "qualified_name").agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), *[F.max(c).alias(f"{c}_{tag}") for c in fields])

    j = side(before, "b").join(side(after, "a"), ["file_path", "qualified_name"], "full_outer")
    comparable = reduce(lambda a, b: a | b, [F.col(f"{c}_b").isNotNull() & F.col(f"{c}_a").isNotNull() for c in fields])
    op = (
        F.when((F.col("n_b") > 1) | (F.col("n_a") > 1), "ambiguous")
        .when(F.col("n_b").isNull(), "added").when(F.col("n_a").isNull(), "removed").otherwise("modified")
    )
    out = j.withColumn("operation", op).filter((F.col("operation") != "modified") | comparable)
    mod = F.col("operation") == "modified"
    return out.select("file_path", "qualified_name", "operation",
                      *[F.when(mod, F.col(f"{c}_b") != F.col(f"{c}_a")).alias(f"{c}_changed") for c in fields])


# --- maps and bounded views --------------------------------------------------------------------------------------


def hottest_files(nodes: DataFrame, edges: DataFrame, top: int | None = None) -> DataFrame:
    """Every called file, hottest first; only the first ``top`` if asked for."""
    rolled = file_fan_in(nodes, edges).filter("distinct_callers > 0")
    ranked = rolled.select("file_path", "distinct_callers").orderBy(F.desc("distinct_callers"), "file_path")
    return ranked if top is None else ranked.limit(top)


def degrees(nodes: DataFrame, edges: DataFrame, kinds=K.FANIN_EDGES) -> DataFrame:
    """In/out degree of structural nodes, counting structural neighbours only."""
    base = structural(nodes)
    ids = base.select("id")
    e = links(edges, kinds).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi")
    inn = e.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("inbound"))
    out = e.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("outbound"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return base.join(inn, "id", "left").join(out, "id", "left").select(
        "id", "kind", "name", "qualified_name", posix("file_path").alias("file_path"), zero("inbound"), zero("outbound"))


def top_symbols(nodes: DataFrame, edges: DataFrame, per_file: int | None = None) -> DataFrame:
    """Symbols ranked inside their file; only the first ``per_file`` if asked for."""
    order = W.partitionBy("file_path").orderBy(F.desc("inbound"), F.desc("outbound"), "qualified_name", "id")
    d = degrees(nodes, edges).withColumn("symbol_rank", F.row_number().over(order))
    d = d if per_file is None else d.filter(F.col("symbol_rank") <= per_file)
    return d.withColumn("label", last_segment("qualified_name", "name"))


def _inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct impact edges (source, target, kind) between nodes of ``ids(id)``."""
    e = edges.filter(F.col("kind").isin(*K.IMPACT_EDGES)).select("source", "target", "kind").distinct()
    return e.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi").join(
        ids.select(F.col("id").alias("target")).distinct(), "target", "left_semi")


def hub_map(nodes: DataFrame, edges: DataFrame, per_file: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Hub-and-spoke map of every called file, as (nodes, edges).

    A file is a hub, its symbols (all, or the first ``per_file``) hang on it by spokes, and symbols of
    different or equal files are linked by cross edges.
    """
    hubs = file_fan_in(nodes, edges).filter("distinct_callers > 0").select("file_path", "distinct_callers")
    symbols = top_symbols(nodes, edges, per_file).join(hubs, "file_path")
    hub = F.concat(F.lit("file:"), "file_path")
    shown = hubs.select(hub.alias("id"), F.lit("hub").alias("role"), "file_path", "distinct_callers", F.lit(0).alias("symbol_rank"), F.col("distinct_callers").alias("inbound")).unionByName(
        symbols.select("id", F.lit("symbol").alias("role"), "file_path", "distinct_callers", "symbol_rank", "inbound"))
    spokes = symbols.select(hub.alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit("spoke").alias("edge_type"))
    return shown, spokes.unionByName(_inside(edges, symbols).withColumn("edge_type", F.lit("cross_symbol")))


def symbol_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every structural symbol with its file, and the impact edges between them."""
    shown = structural(nodes).select("id", "kind", posix("file_path").alias("file_path"))
    return shown, _inside(edges, shown)


def file_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every file with its symbols and outside callers counted, and weighted edges between different files."""
    at = structural(nodes).filter("file_path IS NOT NULL").select("id", posix("file_path").alias("f"))
    kinds = edges.filter(F.col("kind").isin(*K.IMPACT_EDGES)).select("source", "target", "kind").distinct()
    ends = kinds.join(at.select(F.col("id").alias("source"), F.col("f").alias("src")), "source").join(
        at.select(F.col("id").alias("target"), F.col("f").alias("dst")), "target")
    inbound = ends.select("dst", "source").distinct().groupBy(F.col("dst").alias("f")).agg(F.count(F.lit(1)).alias("inbound_count"))
    files = at.groupBy("f").agg(F.count(F.lit(1)).alias("symbol_count")).join(inbound, "f", "left")
    files = files.select(F.col("f").alias("id"), "symbol_count", F.coalesce("inbound_count", F.lit(0)).alias("inbound_count"))
    weighted = ends.filter("src <> dst").groupBy(F.col("src").alias("source"), F.col("dst").alias("target")).agg(F.count(F.lit(1)).alias("weight"))
    return files, weighted


def subgraph_around(centers: DataFrame, edges: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Reverse neighbourhood of any number of centres: nodes at their least depth, and the impact edges among them."""
    back = links(edges, K.IMPACT_EDGES)
    frontier = cut_lineage(centers.select("id").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for d in range(1, depth + 1):
        near = frontier.select(F.col("id").alias("target")).join(back, "target").select(F.col("source").alias("id")).distinct()
        frontier = cut_lineage(near.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen, _inside(edges, seen)


def capped_view(shown: DataFrame, edges: DataFrame, order: list, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a display of so many nodes and edges gets of a whole graph, and what it leaves out.

    The first nodes by ``order``, then id; edges between those, by source and target.  The third table has one row:
    totals of the whole graph, what is shown, and ``truncated``.
    """
    nodes = cut_lineage(shown.orderBy(*order, "id").limit(max_nodes))
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    links_ = cut_lineage(inside.orderBy("source", "target", *[c for c in edges.columns if c not in ("source", "target")]).limit(max_edges))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = n(shown, "total_nodes").join(n(edges, "total_edges")).join(n(nodes, "shown_nodes")).join(n(links_, "shown_edges"))  # one row each
    return nodes, links_, counts.withColumn("truncated", (F.col("shown_nodes") < F.col("total_nodes")) | (F.col("shown_edges") < F.col("total_edges")))
