"""Import-graph operators: dedupe, degrees, hubs, cycles, reverse blast, incompleteness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddsmith import constants as K
from oddsmith.functions.columns import lookup, rank_table, top_domain
from oddsmith.session import cut_lineage, written


def edge_confidence(kind: str = "kind") -> Column:
    return F.coalesce(lookup(K.IMPORT_CONFIDENCE, kind), F.lit(K.IMPORT_CONFIDENCE_DEFAULT))


def dedupe_imports(raw: DataFrame, tasks: int | None = None) -> DataFrame:
    """Best-confidence kind per resolved (src, tgt); unresolved imports are all kept.

    ``tasks`` deals the resolved ones out to so many tasks, as a session's number of partitions does not follow its tables.
    """
    resolved = raw.filter("tgt IS NOT NULL AND tgt <> src")
    if tasks is not None:
        resolved = resolved.select("src", "tgt", "kind").repartition(tasks, "src", "tgt")
    order = F.struct(edge_confidence().alias("c"), F.col("kind"))
    best = resolved.groupBy("src", "tgt").agg(F.max_by("kind", order).alias("kind"))
    return best.select("src", "tgt", "kind", F.lit(None).cast("string").alias("name")).unionByName(
        raw.filter("tgt IS NULL").select("src", "tgt", "kind", "name"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """``src, tgt, kind, n`` of :func:`dedupe_imports`: a resolved edge is one row already, only the others are counted."""
    one = edges.filter("tgt IS NOT NULL").select("src", "tgt", "kind", F.lit(1).cast("bigint").alias("n"))
    none = edges.filter("tgt IS NULL").groupBy("src", "kind").agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(none.withColumn("tgt", F.lit(None).cast("string")))


def file_degrees(edges: DataFrame, files: DataFrame) -> DataFrame:
    real = edges.filter("tgt IS NOT NULL")
    i = real.groupBy(F.col("tgt").alias("path")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = real.groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("out_degree"))
    return files.select("path").join(i, "path", "left").join(o, "path", "left").select(
        "path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree")])


def cross_domain_share(edges: DataFrame) -> DataFrame:
    cross = (top_domain("src") != top_domain("tgt")).cast("int")
    return edges.filter("tgt IS NOT NULL").agg(
        F.count(F.lit(1)).alias("total_edges"), F.sum(cross).alias("cross_domain_edges"),
        F.coalesce(F.avg(cross), F.lit(0.0)).alias("bridge_centrality"))


def hub_scores(degrees: DataFrame) -> DataFrame:
    """Percentile of files with at least three importers, ranked over all files."""
    table = rank_table(degrees.select("in_degree"), "in_degree")
    return (
        degrees.filter(F.col("in_degree") >= K.ANCHOR_MIN_IN_DEGREE).join(table, "in_degree")
        .select("path", "in_degree", F.col("fraction").alias("hub_score"), (F.col("fraction") >= K.HIGH_PERCENTILE).alias("is_anchor"))
    )


# --- cycles ---------------------------------------------------------------------------------------------


def _trim(e: DataFrame) -> DataFrame:
    """Drop edges at nodes without both an incoming and an outgoing edge, while that drops a tenth of them."""
    n = e.count()
    while n:
        e = written(
            e.join(e.select(F.col("tgt").alias("src")).distinct(), "src", "left_semi")
            .join(e.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi"))
        left = e.count()
        if left > 0.9 * n:
            break
        n = left
    return e


def strongest_above(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, best``: the strongest of all nodes from which each node can be reached along ``e(src, tgt)``, itself included.

    ``nodes(node, power)`` holds every node once; strength is (power, node).  Whatever reaches
    the best node known so far reaches the node too, so besides taking its neighbours' best a node
    jumps to the best of its best.  With powers in random order the stretch that a node has seen
    grows by a factor a round, so rounds follow the logarithm of the longest path, not the path.
    """
    now = written(nodes.select("node", F.struct("power", "node").alias("best"), F.lit(True).alias("grew")))
    while True:
        offers = e.join(now.filter("grew").select(F.col("node").alias("src"), F.col("best").alias("offer")), "src").select(F.col("tgt").alias("node"), "offer")
        via = now.filter("best.node <> node").select(F.col("node").alias("via"), F.col("best").alias("offer"))
        jumps = now.select("node", F.col("best.node").alias("via")).join(via, "via").select("node", "offer")
        best = offers.unionByName(jumps).groupBy("node").agg(F.max("offer").alias("offer"))
        joined = now.join(best, "node", "left")
        now = written(joined.select("node", F.greatest("best", F.coalesce("offer", "best")).alias("best"), F.coalesce(F.col("offer") > F.col("best"), F.lit(False)).alias("grew")))
        if now.filter("grew").isEmpty():
            return now.select("node", "best")


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()


def cycle_files(edges: DataFrame) -> DataFrame:
    """Files in a strongly connected component of more than one file.

    Acyclic fringes are trimmed first.  Then each node takes the strongest node upstream as its
    colour, in a random order of strength; inside a colour, the nodes whose strongest node downstream is the
    colour's own lead back to it and form its component.  Edges between colours cannot lie on
    a cycle and are dropped before the next round, so the work shrinks every round.  Every
    state is a distributed table; the driver only sees counts.
    """
    e = written(edges.filter("tgt IS NOT NULL AND src <> tgt").select("src", "tgt").distinct())
    parts = [e.select(F.col("src").alias("path")).limit(0)]
    rounds = 0
    while True:
        e = _trim(e)
        if e.isEmpty():
            break
        ranked = _nodes(e).withColumn("power", F.xxhash64("node", F.lit(rounds)))
        above = strongest_above(e, ranked).select("node", F.col("best.node").alias("root"))
        a, b = above.toDF("src", "sr"), above.toDF("tgt", "tr")
        inner = written(e.join(a, "src").join(b, "tgt").filter("sr = tr").select("src", "tgt"))
        below = strongest_above(inner.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")), ranked).select("node", F.col("best.node").alias("back"))
        found = written(above.join(below, "node").filter("root = back").select("node", "root"))
        others = found.filter("node <> root")
        parts.append(others.select(F.explode(F.array("node", "root")).alias("path")).distinct())
        gone = found.select("node")
        e = written(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "tgt"), "tgt", "left_anti"))
        rounds += 1
    return reduce(DataFrame.unionByName, parts)


def leads_to_cycle(edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """Files from which a cycle can be reached: the strongest node downstream, cyclic ones being stronger than all others."""
    real = edges.filter("tgt IS NOT NULL")
    on = real.filter("src = tgt").select(F.col("src").alias("node")).unionByName(cyclic.select(F.col("path").alias("node"))).distinct()
    back = real.filter("src <> tgt").select(F.col("tgt").alias("src"), F.col("src").alias("tgt")).distinct()
    marked = _nodes(back).unionByName(on).distinct().join(on.withColumn("on", F.lit(True)), "node", "left")
    ranked = marked.select("node", F.struct(F.coalesce("on", F.lit(False)).alias("on"), F.xxhash64("node").alias("mark")).alias("power"))
    return strongest_above(back, ranked).filter("best.power.on").select(F.col("node").alias("path"))


def cycle_from_changes(changed: DataFrame, reaching: DataFrame) -> DataFrame:
    hit = changed.join(reaching.select("path", F.lit(True).alias("hit")), "path", "left")
    return hit.groupBy("action_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("import_cycle_detected"))


# --- blast and incompleteness -----------------------------------------------------------------------------


#: Entries of all files' reach up to which an action is settled from lists; a larger one is settled row by row.
BLAST_ENTRIES = 1_000_000

# An entry of a file's reach is one long: node number (32 bits), depth (6), rank of the edge among the importer's (20), confidence (4),
# entrypoint (1).  The least entry of a node is the one of its nearest depth, found by the edge to the first path.
_NUMBER, _DEPTH, _RANK = 31, 25, 5
_CONFIDENCES = sorted({*K.IMPORT_CONFIDENCE.values(), K.IMPORT_CONFIDENCE_DEFAULT})


def _numbered(nodes: DataFrame) -> DataFrame:
    """``nodes(node)``, distinct, with gapless numbers from 0 in the order of ``node``: what lies near each other has near numbers, which pack well."""
    rows = written(written(nodes).orderBy("node").withColumn("id", F.monotonically_increasing_id()))
    part = F.call_function("shiftright", "id", F.lit(33)).alias("part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.col("id").bitwiseAND((1 << 33) - 1)
    return rows.select("node", part, inside.alias("inside")).join(offsets, "part").select("node", (F.col("inside") + F.col("offset")).alias("number"))


def _lists() -> tuple:
    """``pack``, ``unpack`` and ``settle`` of one sorted array of entries; closures, so tasks need no package.

    Packed are the gaps between numbers and the lower bits, byte by byte of all entries, deflated: about two bytes an entry instead of eight.
    ``settle`` counts, each node by its least entry; depth 0 only counts as an entrypoint.
    """
    conf, node, depth = _CONFIDENCES, _NUMBER, _DEPTH

    def pack(x):
        import zlib

        import numpy as np

        both = np.empty((len(x), 2), "<u4")
        both[:, 0] = np.diff(x >> node, prepend=0)
        both[:, 1] = x & ((1 << node) - 1)
        plain = both.view(np.uint8).T.tobytes()
        small = zlib.compress(plain, 6, -15)
        return b"z" + small if len(small) < len(plain) else b"p" + plain

    def unpack(data):
        import zlib

        import numpy as np

        plain = zlib.decompress(data[1:], -15) if data[:1] == b"z" else data[1:]
        both = np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(8, -1).T).view("<u4").astype(np.int64)
        return (np.cumsum(both[:, 0]) << node) | both[:, 1]

    def settle(x):
        import numpy as np

        confs = np.array(conf + [0.0] * (16 - len(conf)))
        number = x >> node
        x = x[np.concatenate(([True], number[1:] != number[:-1]))]
        kind = np.minimum((x >> depth) & 63, 2) * 16 + ((x >> 1) & 15)
        counts = np.bincount(kind, minlength=48).reshape(3, 16)
        found = counts[1:].sum(axis=0)
        return int(counts[1].sum()), int(found.sum()), int(found[confs < 0.5].sum()), float(found @ confs), float(np.where(found > 0, confs, 1.0).min()), bool((x & 1).any())

    return pack, unpack, settle


#: Entries of one origin that a task holds before it reduces them to the least of each node.
FOLD_ENTRIES = 1 << 22

_STATS = "struct<direct: bigint, n: bigint, low: bigint, total: double, least: double, entry: boolean>"


def _in_batches(df: DataFrame, schema: str, each) -> DataFrame:
    """``df`` row by row through ``each``, which takes a row's values and yields rows of ``schema``, in Arrow batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for b in batches:
            rows = []
            for i in range(b.num_rows):
                for row in each(*[c[i].as_py() for c in b.columns]):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    return df.mapInArrow(run, schema)


def file_reach(origins: DataFrame, back: DataFrame, depth: int = K.REACH_DEPTH) -> DataFrame:
    """``origin, n, packed, s``: what depends on each file, as one packed array of entries, the file itself at depth 0, and its counts.

    ``back(node, importer, edge)`` holds numbers and the low bits of an entry.  A walk that comes back to
    a node is longer than the first one to it, so the least entry per node is the right one and nothing needs to be kept out.
    A node's importers travel as one packed list, once for every walk that comes to it, and are only taken apart where the walks of
    an origin meet: sorted by origin, one at a time, and reduced to the least entries whenever many have come together.
    """
    pack, unpack, settle = _lists()
    entry = lambda node: F.shiftleft(node, _NUMBER).bitwiseOR(F.col("edge"))
    number, depth_bit, held_most = _NUMBER, _DEPTH, FOLD_ENTRIES

    def packed(batches):
        import pyarrow as pa

        for b in batches:
            at, values = b.column("xs").offsets.to_numpy(), b.column("xs").values.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([pack(values[i:j]) for i, j in zip(at, at[1:])], pa.binary())], ["node", "packed"])

    importers = written(back.groupBy("node").agg(F.sort_array(F.collect_list(entry("importer"))).alias("xs")).mapInArrow(packed, "node bigint, packed binary"))
    walk = lambda step, d, x, xs: step.select("origin", F.lit(d).alias("d"), x.cast("bigint").alias("x"), xs.cast("binary").alias("packed"))
    walks = [walk(origins.withColumn("origin", F.col("number")), 0, entry("number"), F.lit(None))]
    frontier = written(origins.select(F.col("number").alias("origin"), F.col("number").alias("node")))
    for d in range(1, depth + 1):
        walks.append(walk(frontier.join(importers, "node"), d, F.lit(None), F.col("packed")))
        if d < depth:
            frontier = written(frontier.join(back, "node").select("origin", F.col("importer").alias("node")).distinct())

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        of = pa.struct([("direct", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("total", pa.float64()), ("least", pa.float64()), ("entry", pa.bool_())])

        def least(pieces):
            x = np.concatenate(pieces)
            x.sort(kind="stable")  # sorted pieces are merged
            n = x >> number
            return x[np.concatenate(([True], n[1:] != n[:-1]))]

        def batch(rows):
            origins, lists = zip(*rows)
            stats = [dict(zip(of.names, settle(x))) for x in lists]
            return pa.RecordBatch.from_arrays(
                [pa.array(origins, pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array([pack(x) for x in lists], pa.binary()), pa.array(stats, of)],
                ["origin", "n", "packed", "s"])

        def reduced():
            at, held, size, most = None, [], 0, held_most
            for b in batches:
                for origin, d, x, xs in zip(*[c.to_pylist() for c in b.columns]):
                    if origin != at:
                        if held:
                            yield at, least(held)
                        at, held, size, most = origin, [], 0, held_most
                    held.append(np.array([x]) if xs is None else unpack(xs) | (d << depth_bit))
                    size += len(held[-1])
                    if size > most:
                        held = [least(held)]
                        size, most = len(held[0]), max(held_most, 2 * len(held[0]))
            if held:
                yield at, least(held)

        rows, size = [], 0
        for row in reduced():
            rows.append(row)
            size += len(row[1])
            if len(rows) == 1000 or size > 1 << 20:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    met = reduce(DataFrame.unionByName, walks).repartition("origin").sortWithinPartitions("origin")
    return met.mapInArrow(fold, f"origin bigint, n bigint, packed binary, s {_STATS}")


def _united(lists: DataFrame) -> DataFrame:
    """``action_id, s`` of ``action_id, own, more``: one packed list and an array of others."""
    _, unpack, settle = _lists()

    def each(action, own, more):
        import numpy as np

        x = np.concatenate([unpack(own), *map(unpack, more)])
        x.sort(kind="stable")  # sorted pieces are merged
        yield action, dict(zip(("direct", "n", "low", "total", "least", "entry"), settle(x)))

    action = lists.schema["action_id"].dataType.simpleString()
    return _in_batches(lists.select("action_id", "own", "more"), f"action_id {action}, s {_STATS}", each)


def _entries(lists: DataFrame) -> DataFrame:
    """``action_id, x`` of ``action_id, packed``: a row an entry."""
    _, unpack, _ = _lists()

    def each(action, packed):
        for x in unpack(packed).tolist():
            yield action, x

    action = lists.schema["action_id"].dataType.simpleString()
    return _in_batches(lists.select("action_id", "packed"), f"action_id {action}, x bigint", each)


def reverse_blast(changed: DataFrame, edges: DataFrame, files: DataFrame, depth: int = K.REACH_DEPTH, most: int = BLAST_ENTRIES) -> DataFrame:
    """Dependents of each action's files with the confidence of the edge that found them.

    A node found by several edges of one round takes the one to the first path, so counts
    equal a breadth-first walk and the confidence statistics are deterministic.

    Each file is walked once, for all actions.  An action's reach is that of its files, each node by its least entry:
    a path that reaches a node first is a first path for the file it started from.  An action of one
    file takes the file's counts.  Others are brought to the largest of their files' lists, so only the shorter lists travel; where the lists
    would be long, nodes are counted row by row.
    """
    real = edges.filter("tgt IS NOT NULL")
    names = files.select(F.col("path").alias("node")).unionByName(real.select(F.explode(F.array("src", "tgt")).alias("node"))).distinct()
    entry = files.groupBy(F.col("path").alias("node")).agg(F.bool_or("is_entrypoint").alias("entry"), F.lit(True).alias("known"))
    flags = F.coalesce(F.col("entry").cast("long"), F.lit(0))
    nodes = written(_numbered(names).join(entry, "node", "left").select("node", "number", flags.alias("entry"), F.coalesce("known", F.lit(False)).alias("known")))
    code = lookup({k: _CONFIDENCES.index(v) for k, v in K.IMPORT_CONFIDENCE.items()}, "kind", _CONFIDENCES.index(K.IMPORT_CONFIDENCE_DEFAULT))
    ranked = real.select("src", "tgt", code.cast("long").alias("code")).withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("tgt", F.desc("code"))))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < 1 << 20, F.col("rank").cast("long")).otherwise(F.raise_error(F.lit("a file imports more than 2^20 files"))))
    edge = F.shiftleft("rank", _RANK).bitwiseOR(F.shiftleft("code", 1)).bitwiseOR(F.col("entry")).alias("edge")
    back = written(
        ranked.join(nodes.select(F.col("node").alias("src"), F.col("number").alias("importer"), "entry"), "src")
        .join(nodes.select(F.col("node").alias("tgt"), F.col("number").alias("node")), "tgt").select("node", "importer", edge))
    pairs = written(changed.select("action_id", "path").distinct().join(nodes.filter("known").select(F.col("node").alias("path"), "number"), "path").select("action_id", F.col("number").alias("origin")))
    used = pairs.select(F.col("origin").alias("number")).distinct()
    lists = written(file_reach(nodes.join(used, "number", "left_semi").select("number", F.col("entry").alias("edge")), back, depth))

    home = F.max_by("origin", F.struct("n", "origin")).alias("home")
    actions = written(pairs.join(lists.select("origin", "n"), "origin").groupBy("action_id").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("entries"), home))
    at_home = lists.select(F.col("origin").alias("home"), F.col("packed").alias("own"))
    single = actions.filter("files = 1").select("action_id", F.col("home").alias("origin")).join(lists.select("origin", "s"), "origin").select("action_id", "s")
    few = actions.filter((F.col("files") > 1) & (F.col("entries") <= most)).select("action_id", "home")
    others = pairs.join(few, "action_id").filter("origin <> home").join(lists.select("origin", "packed"), "origin")
    shorter = others.select("home", "action_id", "packed").repartition("home").groupBy("home", "action_id").agg(F.collect_list("packed").alias("more"))
    merged = shorter.join(at_home, "home").select("action_id", "own", "more")
    long = actions.filter((F.col("files") > 1) & (F.col("entries") > most)).select("action_id")
    rows = _entries(pairs.join(long, "action_id").join(lists.select("origin", "packed"), "origin"))
    rows = rows.groupBy("action_id", F.call_function("shiftright", "x", F.lit(_NUMBER)).alias("node")).agg(F.min("x").alias("x"))
    depth_of, conf = F.call_function("shiftright", "x", F.lit(_DEPTH)).bitwiseAND(63), F.element_at(F.array(*map(F.lit, _CONFIDENCES)), F.call_function("shiftright", "x", F.lit(1)).bitwiseAND(15).cast("int") + 1)
    found = rows.select("action_id", depth_of.alias("d"), F.when(depth_of > 0, conf).alias("c"), (F.col("x").bitwiseAND(1) == 1).alias("e"))
    counted = found.groupBy("action_id").agg(F.struct(
        F.count_if(F.expr("d = 1")).alias("direct"), F.count("c").alias("n"), F.count_if(F.expr("c < 0.5")).alias("low"),
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("total"), F.coalesce(F.min("c"), F.lit(1.0)).alias("least"), F.bool_or("e").alias("entry")).alias("s"))
    stats = single.unionByName(_united(merged)).unionByName(counted)
    some = F.col("s.n") > 0
    return stats.select(
        "action_id", F.col("s.direct").alias("direct_count"), (F.col("s.n") - F.col("s.direct")).alias("transitive_count"), F.col("s.low").alias("low_confidence_edge_count"),
        F.when(some, F.col("s.total") / F.col("s.n")).otherwise(0.0).alias("edge_confidence_mean"),
        F.when(some, F.col("s.least")).otherwise(0.0).alias("edge_confidence_min"), F.col("s.entry").alias("entrypoint_signal"))


PROVENANCE = ("unresolved_imports", "dynamic_imports", "wildcard_imports", "missing_files", "parse_error_files")


def _import_lines(edges: DataFrame) -> DataFrame:
    """``edges`` with the list that an import belongs to (NULL: none) and its line there."""
    known = F.col("kind").isin("static", "relative") & F.col("tgt").isNull()
    kind = F.when(known, "unresolved_imports").when(F.col("kind") == "dynamic", "dynamic_imports").when(F.col("kind") == "wildcard", "wildcard_imports")
    unnamed = F.when(known, "<unknown>").when(F.col("kind") == "dynamic", "<dynamic>").otherwise("*")
    return edges.withColumns({"list": kind, "line": F.concat("src", F.lit(": "), F.coalesce(F.nullif("name", F.lit("")), unnamed))})


def uncertainty_provenance(expected: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Every file and import behind an action's uncertainty: ``action_id, list, line``, all of them."""
    placed = expected.select("action_id", "path").distinct().join(files.select("path", "parse_error"), "path", "left")
    lines = _import_lines(edges).select(F.col("src").alias("path"), "list", "line").filter("list IS NOT NULL").distinct()
    imports = placed.filter("parse_error IS NOT NULL").join(lines, "path").select("action_id", "list", "line")
    state = F.when(F.col("parse_error").isNull(), "missing_files").when(F.col("parse_error"), "parse_error_files")
    return imports.unionByName(placed.select("action_id", state.alias("list"), F.col("path").alias("line")).filter("list IS NOT NULL"))


def graph_uncertainty(expected: DataFrame, edges: DataFrame, files: DataFrame, keep: int = 25) -> DataFrame:
    """Bounded penalty for what the import graph could not resolve around each action.

    Each list shows its first ``keep`` lines next to the count of all; ``uncertainty_provenance`` has them whole.
    ``uncertainty_codes`` names what raised the score, with its number.
    """
    w = K.UNCERTAINTY_WEIGHT
    # a file's edges are folded before they meet the actions: counts, and the first lines of each list, as no action shows more
    unresolved = F.col("tgt").isNull() & F.col("kind").isin("static", "relative")
    per_file = written(_import_lines(edges).groupBy(F.col("src").alias("path")).agg(
        F.count_if(unresolved).alias("u"), F.count_if(F.col("kind") == "dynamic").alias("d"),
        F.count_if(F.col("kind") == "wildcard").alias("w"), F.count_if(F.col("kind") == "external").alias("x"),
        *[F.slice(F.array_sort(F.collect_set(F.when(F.col("list") == c, F.col("line")))), 1, keep).alias(c) for c in PROVENANCE[:3]]))
    total = per_file.agg(F.sum("d").alias("d"), F.sum("w").alias("w"))
    known = files.select("path", "parse_error", F.lit(True).alias("known")).join(per_file, "path", "left")
    placed = expected.select("action_id", "path").distinct().join(known, "path", "left")
    own = {"missing_files": F.col("known").isNull(), "parse_error_files": F.col("parse_error")}
    placed = placed.withColumns({c: F.when(state, F.array("path")) for c, state in own.items()})
    # all rows of an action meet in one task; its lists are cut per part of its files first, so one of many files is not gathered whole
    first = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, keep).alias(c)
    n = {"missing_file_count": F.col("known").isNull(), "parse_error_count": F.col("parse_error"), "n_changed": F.col("known").isNotNull()}
    sums = {"unresolved_import_count": "u", "dynamic_import_count": "d", "wildcard_import_count": "w", "external_import_count": "x"}
    parts = placed.repartition("action_id").groupBy("action_id", F.pmod(F.xxhash64("path"), F.lit(256)).alias("part")).agg(
        *[F.count_if(c).alias(k) for k, c in n.items()], *[F.sum(c).alias(k) for k, c in sums.items()], *map(first, PROVENANCE))
    out = parts.groupBy("action_id").agg(*[F.sum(k).alias(k) for k in (*n, *sums)], *map(first, PROVENANCE))
    counts = ("unresolved_import_count", "dynamic_import_count", "wildcard_import_count", "external_import_count")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    rd = F.when(F.col("n_changed") > 0, total.select("d").scalar() - F.col("dynamic_import_count")).otherwise(0)
    rw = F.when(F.col("n_changed") > 0, total.select("w").scalar() - F.col("wildcard_import_count")).otherwise(0)
    score = (
        w["missing_file"] * F.col("missing_file_count") + w["parse_error_file"] * F.col("parse_error_count")
        + w["unresolved_import"] * F.col("unresolved_import_count") + w["dynamic_import"] * F.col("dynamic_import_count")
        + w["wildcard_import"] * F.col("wildcard_import_count") + w["repo_dynamic_import"] * rd + w["repo_wildcard_import"] * rw
    )
    found = {"missing_files": F.col("missing_file_count"), "parse_errors": F.col("parse_error_count"), "unresolved": F.col("unresolved_import_count"),
             "dynamic": F.col("dynamic_import_count"), "wildcard": F.col("wildcard_import_count"), "elsewhere": rd + rw}
    codes = [F.when(n > 0, F.concat(F.lit(f"{c}:"), n.cast("string"))) for c, n in found.items()]
    return out.withColumns({"graph_uncertainty_score": F.least(F.lit(K.UNCERTAINTY_CAP), score), "uncertainty_codes": F.array_compact(F.array(*codes))}).drop("n_changed")


def architecture_evidence(changed: DataFrame, degrees: DataFrame, hubs: DataFrame, cyclic: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural context of each action's files."""
    facts = (
        degrees.select("path", "out_degree")
        .join(hubs.select("path", "hub_score", "is_anchor"), "path", "left")
        .join(cyclic.select("path", F.lit(True).alias("in_cycle")), "path", "left")
        .join(files.select("path", "is_entrypoint"), "path", "left")
    )
    anchors = hubs.agg(F.count_if("is_anchor").alias("n")).scalar()
    bridge = cross_domain_share(edges).select("bridge_centrality").scalar()
    g = changed.join(facts, "path", "left").groupBy("action_id").agg(
        F.count_if("is_anchor").alias("matched_anchors"),
        F.array_sort(F.collect_set(top_domain("path"))).alias("matched_domains"),
        F.coalesce(F.max("hub_score"), F.lit(0.0)).alias("god_node_score"),
        F.coalesce(F.max("out_degree"), F.lit(0)).alias("fan_out"),
        F.coalesce(F.bool_or("in_cycle"), F.lit(False)).alias("cycle_participation"),
        F.coalesce(F.bool_or("is_entrypoint"), F.lit(False)).alias("domain_entrypoint"))
    return g.withColumns({
        "architecture_anchor_score": F.when(anchors > 0, F.col("matched_anchors") / anchors).otherwise(0.0),
        "bridge_centrality": bridge})


# --- incremental refresh -----------------------------------------------------------------------------------------


def file_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """added / removed / modified / unchanged per path by content hash."""
    p = previous.select("path", F.col("content_hash").alias("old"))
    c = current.select("path", F.col("content_hash").alias("new"))
    status = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    )
    return p.join(c, "path", "full_outer").select("path", status.alias("status"))


def refresh_edges(changes: DataFrame, previous_edges: DataFrame, parsed_edges: DataFrame) -> DataFrame:
    """Carry edges of unchanged files and take the rest from the new parse.

    If any file came or went, resolution elsewhere may differ, so everything is taken anew;
    that switch is a scalar inside the plan, not a branch on the driver.
    """
    moved = changes.agg(F.coalesce(F.bool_or(F.col("status").isin("added", "removed")), F.lit(False)).alias("x")).scalar()
    modified = changes.filter("status = 'modified'").select(F.col("path").alias("src"))
    carried = previous_edges.filter(~moved).join(modified, "src", "left_anti").withColumn("origin", F.lit("carried"))
    marked = parsed_edges.join(modified.withColumn("m", F.lit(True)), "src", "left")
    fresh = marked.filter(moved | F.coalesce(F.col("m"), F.lit(False))).drop("m").withColumn("origin", F.lit("parsed"))
    return carried.unionByName(fresh)
