"""Prefix trie of rebuilt conversations (operator 12).

A turn is known by the first 128 bits of a SHA-256 over the lengths and bytes of role and text and by its
number of code points, so texts are hashed where they are read and never shuffled.  Every
conversation becomes one row of turn digests (20 bytes a turn): the first ``crc32(id) % shared`` turns of
the first conversation of its hundred, then its own turns after as many.  The rows are dealt
into ranges of (digests, id): whoever shares a prefix is adjacent, and the id splits copies of one
conversation over as many shards as they need.

A shard numbers its digests and sorts a padded matrix of turn numbers with ``lexsort``.  The
matrix has ``BLOCK`` columns; rows that are longer go on in a next one, sorted inside the class
they have reached, so one long conversation pads nobody else.  OR-accumulated masks of changed columns mark where nodes
start; ``reduceat`` gives every depth's members and, from the deepest up, sums over subtrees.

Only nodes on the path of a shard's first or last row can go on in another shard.  Their partial
counts (at most two paths a shard) are added up by path digest in one small task; ids that
end in such a node travel in lots of text and are hashed in order, one lot in memory.

Cases: null role or text is empty; null turns come first, turns of one number follow
their digest; repeated rows are turns of their own; rows without ``conv_id`` belong to no conversation and are left out; a
conversation may be rebuilt to no turn at all and then ends in the root; no rows give no nodes;
texts of any length are hashed whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import store

HUNDRED, SHARED, BLOCK, TURNS_PER_SHARD, LOT, SALTS = 100, 6, 64, 200_000, 1 << 16, 16
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.sha256(b"root").digest()[:16]

#: One row per node (partial where ``open``) or, with ``lot``, a piece of the ids that end in an open node.
PART = "open boolean, id binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, length long, ends string, lot string, lot_from long"


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def conversations(turns: DataFrame) -> DataFrame:
    """``id, turns`` (in order: digest ``k``, code points ``n``) of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    read = turns.filter(F.col("conv_id").isNotNull())
    read = read.select(F.col("conv_id").cast("long").alias("id"), F.struct(F.col("turn").cast("long").alias("at"), turn_digest(role, text).alias("k"), F.char_length(text).alias("n")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["k"].alias("k"), t["n"].alias("n")))
    return read.groupBy("id").agg(ordered.alias("turns"))


def rebuilt(own: DataFrame, hundred: int = HUNDRED, shared: int = SHARED) -> DataFrame:
    """Each conversation with the first turns of the first one of its hundred (at most ``hundred`` rows meet one of them)."""
    heads = own.filter(F.col("id") % hundred == 0).select(F.col("id").alias("base"), F.slice("turns", 1, max(shared - 1, 1)).alias("head"))
    h = (F.crc32(F.col("id").cast("string")) % shared).cast("int")
    joined = own.withColumn("base", F.col("id") - F.col("id") % hundred).join(heads, "base", "left").withColumn("h", h)
    none = F.expr("cast(array() as array<struct<k:binary,n:int>>)")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    return joined.select("id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


class Level:
    """The nodes of one depth, in order of their path."""

    def __init__(self, parent, conv, count, length, ends_from, ends_to):
        self.parent, self.conv, self.count, self.length, self.ends_from, self.ends_to = parent, conv, count, length, ends_from, ends_to


def levels(ids: np.ndarray, sizes: np.ndarray, number: np.ndarray, lengths: np.ndarray) -> tuple[list[Level], list[np.ndarray], list[np.ndarray]]:
    """Nodes by depth; the ids that end at each depth, node after node; a turn's place for each node."""
    start = np.cumsum(sizes) - sizes
    rows = np.argsort(ids, kind="stable")
    cls = np.zeros(len(rows), np.int64)
    ended = [ids[rows[sizes[rows] == 0]]]
    out = [Level(np.zeros(1, np.int64), ids.min(keepdims=True), np.array([len(ids)]), np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(ended[0])]))]
    places = [np.zeros(1, np.int64)]
    node = np.zeros(len(ids), np.int64)  # of each row, at the depth before
    depth = 0
    while len(rows):
        rows, cls = (x[sizes[rows] > depth] for x in (rows, cls))
        if not len(rows):
            break
        width = int(min(BLOCK, (sizes[rows] - depth).max()))
        column = np.arange(width)
        inside = column < (sizes[rows] - depth)[:, None]
        cells = np.where(inside, number[np.where(inside, start[rows][:, None] + depth + column, 0)], 0)  # 0: no turn here, sorts first
        order = np.lexsort((ids[rows], *cells.T[::-1], cls))
        rows, cls, cells = rows[order], cls[order], cells[order]
        fresh = np.ones((len(rows), width + 1), bool)
        fresh[1:, 0] = cls[1:] != cls[:-1]
        fresh[1:, 1:] = cells[1:] != cells[:-1]
        fresh = np.logical_or.accumulate(fresh, axis=1)
        for j in range(width):
            here = np.flatnonzero(cells[:, j])
            first = np.flatnonzero(fresh[here, j + 1])
            members = rows[here]
            count = np.diff(first, append=len(here))
            place = start[members[first]] + depth + j
            ends = sizes[members] == depth + j + 1
            n_ends = np.add.reduceat(ends.astype(np.int64), first)
            upto = np.cumsum(n_ends)
            out.append(Level(node[members[first]], np.minimum.reduceat(ids[members], first), count, lengths[place], upto - n_ends, upto))
            ended.append(ids[members[ends]])
            places.append(place)
            node[members] = np.repeat(np.arange(len(first)), count)
        cls = np.cumsum(fresh[:, width])
        depth += width
    return out, ended, places


def boundary(found: list[Level], last: bool) -> list[int]:
    """Node numbers, by depth, of the path of the shard's first (or last) row."""
    path = [0]
    for depth, level in enumerate(found[1:]):
        here = found[depth]
        if not last and here.ends_to[path[-1]] > here.ends_from[path[-1]]:
            break
        lo, hi = np.searchsorted(level.parent, path[-1], "left"), np.searchsorted(level.parent, path[-1], "right")
        if lo == hi:
            break
        path.append(int(hi - 1 if last else lo))
    return path


def shard_nodes(ids: np.ndarray, sizes: np.ndarray, digests: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``PART`` rows of one shard; ``digests``: one row of two big-endian numbers a turn."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    number = np.zeros(len(digests), np.int64)
    if len(order):
        new = np.ones(len(order), bool)
        new[1:] = (digests[order[1:]] != digests[order[:-1]]).any(1)
        number[order] = np.cumsum(new)
    found, ended, places = levels(ids, sizes, number, lengths)
    open_ids: list[dict[int, bytes]] = [{} for _ in found]  # node -> digest of its path
    for path in (boundary(found, False), boundary(found, True)):
        mark = ROOT
        for depth, no in enumerate(path):
            if depth:
                mark = hashlib.sha256(mark + digests[places[depth][no]].tobytes()).digest()[:16]
            open_ids[depth][no] = mark
    children = leaves = saved = np.zeros(0, np.int64)  # sums over the depth below, by node of this depth
    for depth in range(len(found) - 1, -1, -1):
        at = found[depth]
        n = len(at.count)
        is_open = np.zeros(n, bool)
        is_open[list(open_ids[depth])] = True
        children, leaves, saved = (np.concatenate([x, np.zeros(n - len(x), np.int64)]) for x in (children, leaves, saved))
        leaves = leaves + (~is_open & (children == 0))
        saved = saved + np.where(is_open, 0, (at.count - 1) * at.length)
        above = open_ids[depth - 1] if depth else {}
        parent = at.parent
        ends = [None] * n
        for no in np.flatnonzero((at.ends_to > at.ends_from) & ~is_open).tolist():
            ends[no] = hashlib.sha256(",".join(map(str, ended[depth][at.ends_from[no] : at.ends_to[no]].tolist())).encode()).hexdigest()
        parent_conv = found[depth - 1].conv[parent] if depth else np.zeros(n, np.int64)
        under = np.isin(parent, list(above)) if depth else np.ones(n, bool)
        columns = [
            pa.array(is_open),
            pa.array([open_ids[depth].get(i) for i in range(n)], pa.binary()),
            pa.array([above.get(i) for i in parent.tolist()] if depth else [None] * n, pa.binary()),
            pa.array(at.conv),
            pa.array(np.full(n, depth)),
            pa.array(parent_conv, mask=under),
            *(pa.array(x) for x in (at.count, children, leaves, saved, at.length.astype(np.int64))),
            pa.array(ends, pa.string()),
            pa.nulls(n, pa.string()),
            pa.nulls(n, pa.int64()),
        ]
        batch = pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PART.split(", ")])
        schema = batch.schema
        yield batch
        for no, mark in open_ids[depth].items():
            own = ended[depth][at.ends_from[no] : at.ends_to[no]]
            for i in range(0, len(own), LOT // 16):
                some = own[i : i + LOT // 16].tolist()
                lot = {"open": True, "id": mark, "lot": ",".join(map(str, some)), "lot_from": some[0]}
                yield pa.RecordBatch.from_pylist([lot], schema=schema)
        if depth:
            size = len(found[depth - 1].count)
            children, leaves, saved = (summed(parent, np.where(is_open, 0, x), size) for x in (1, leaves, saved))  # open nodes are added up later


def summed(parent: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums by parent; nodes of one parent stand together."""
    out = np.zeros(size, np.int64)
    if len(parent):
        first = np.flatnonzero(np.diff(parent, prepend=-1))
        out[parent[first]] = np.add.reduceat(values.astype(np.int64), first)
    return out


def combined(rows: list[dict]) -> list[dict]:
    """The open nodes, deepest first, with what lies in open nodes below them."""
    below: dict[bytes | None, list[int]] = {}
    conv = {r["id"]: r["conv_id"] for r in rows}
    out = []
    for r in sorted(rows, key=lambda r: -r["depth"]):
        children, leaves, saved = (a + b for a, b in zip((r["n_children"], r["n_leaves"], r["saved"]), below.get(r["id"], (0, 0, 0))))
        leaves += children == 0
        saved += (r["n_convs"] - 1) * r["length"]
        up = below.setdefault(r["parent"], [0, 0, 0])
        for i, x in enumerate((1, leaves, saved)):
            up[i] += x
        out.append({"id": r["id"], "conv_id": r["conv_id"], "depth": r["depth"], "parent_conv_id": conv.get(r["parent"]), "n_convs": r["n_convs"], "n_children": children, "n_leaves": leaves, "saved_tokens": saved})
    return out


def shards_of(conversations: DataFrame, spark_partitions: int) -> int:
    turns = conversations.agg(F.sum(F.size("turns"))).first()[0] or 0
    return max(spark_partitions, -(-turns // TURNS_PER_SHARD))


def partial_nodes(conversations: DataFrame, shards: int) -> DataFrame:
    """``PART`` rows of every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        sizes = rows.column("n_turns").to_numpy().astype(np.int64)
        digests = np.frombuffer(b"".join(rows.column("k").to_pylist()), ">u8").reshape(-1, 2)
        lengths = rows.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        yield from shard_nodes(rows.column("id").to_numpy(), sizes, digests, lengths)

    dealt = conversations.repartitionByRange(shards, F.col("turns.k"), F.col("id"))
    flat = dealt.select("id", F.size("turns").alias("n_turns"), F.unhex(F.array_join(F.transform("turns.k", F.hex), "")).alias("k"), F.col("turns.n").alias("n"))
    return flat.mapInArrow(run, PART)


def hashed_ends(lots: DataFrame) -> DataFrame:
    """``id, ends``: SHA-256 over the lots of each open node in order; a task holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for mark, lot in zip(batch.column("id").to_pylist(), batch.column("lot").to_pylist()):
                if mark != now:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"id": [now], "ends": [state.hexdigest()]}, schema=pa.schema([("id", pa.binary()), ("ends", pa.string())]))
                    now, state = mark, hashlib.sha256(lot.encode())
                else:
                    state.update(b"," + lot.encode())
        if state is not None:
            yield pa.RecordBatch.from_pydict({"id": [now], "ends": [state.hexdigest()]}, schema=pa.schema([("id", pa.binary()), ("ends", pa.string())]))

    return lots.select("id", "lot", "lot_from").repartition("id").sortWithinPartitions("id", "lot_from").select("id", "lot").mapInArrow(run, "id binary, ends string")


def trie(turns: DataFrame, hundred: int = HUNDRED, shared: int = SHARED, shards: int | None = None) -> DataFrame:
    """One row per node of ``turns(conv_id, turn, role, text)``, see the contract of the query."""
    spark = turns.sparkSession
    own = store(conversations(turns), "conversations")
    shards = shards or shards_of(own, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = store(partial_nodes(rebuilt(own, hundred, shared), shards), "nodes")
    pieces = parts.filter("open AND lot IS NULL").groupBy("id", "parent", "depth", "length")
    pieces = pieces.agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_pylist(combined(rows))

    named = "id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    opened = store(pieces.coalesce(1).mapInArrow(run, named), "open-nodes")  # at most two paths a shard
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = opened.join(hashed_ends(parts.filter("lot IS NOT NULL")), "id", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY)))
    closed = parts.filter("NOT open").withColumn("saved_tokens", F.col("saved")).withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY)))
    inner = closed.filter("parent IS NULL")
    spread = opened.select(F.col("id").alias("parent"), F.col("conv_id").alias("upper"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    under = closed.filter("parent IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")).join(spread, ["parent", "salt"]).withColumn("parent_conv_id", F.col("upper"))
    return top.select(columns).unionByName(inner.select(columns)).unionByName(under.select(columns))


#: A turn in SQL; CRC-32 is computed with its table, bit by bit.
TRIE_SQL = f"""
WITH RECURSIVE bits(i, c, step) AS (
    SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
marked AS (SELECT conv_id AS id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    substr(sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT id, list({{'r': role, 'x': text}} ORDER BY turn NULLS FIRST, k) AS turns FROM marked GROUP BY id),
hs AS (SELECT id, turns, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), CAST(4294967295 AS BIGINT)) % {SHARED} AS h FROM own, crc),
conv AS (SELECT hs.id, CASE WHEN h = 0 THEN hs.turns ELSE list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(hs.turns, h + 1, len(hs.turns))) END AS turns
    FROM hs LEFT JOIN own b ON b.id = hs.id - hs.id % {HUNDRED}),
steps AS (SELECT id, turns, len(turns) AS size, d, CASE WHEN d = 0 THEN [] ELSE list_slice(turns, 1, d) END AS path FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM conv)),
nodes AS (SELECT d, path, min(id) AS conv_id, count(*) AS n, any_value(CASE WHEN d = 0 THEN 0 ELSE length(path[d].x) END) AS size,
    sha256(coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE size = d), '')) AS ends FROM steps GROUP BY d, path),
kids AS (SELECT d - 1 AS d, CASE WHEN d = 1 THEN [] ELSE list_slice(path, 1, d - 1) END AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, path)),
sums AS (SELECT u AS d, CASE WHEN u = 0 THEN [] ELSE list_slice(path, 1, u) END AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * size) AS saved
    FROM (SELECT *, unnest(range(d + 1)) AS u FROM full_nodes) GROUP BY 1, 2)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM full_nodes a JOIN sums s USING (d, path) LEFT JOIN nodes p ON p.d = a.d - 1 AND p.path = CASE WHEN a.d = 1 THEN [] ELSE list_slice(a.path, 1, a.d - 1) END"""
