"""Exact substring dedup on bytes with suffix arrays of shards (operator 7).

Every ``window``-byte string is filed under its smallest ``k``-gram hash, so strings that
could be equal meet in one shard whichever documents they come from.  Equal stretches are
settled by a running comparison (see ``anchors``).  The different stretches of a key that
has several become part of a shard, whose suffix array is built by induced sorting: suffixes
move through one first-in-first-out queue per first character (the buckets of a priority
queue), which spill to disk beyond ``QUEUED`` bytes.  Neighbours in the array are compared
byte for byte up to ``window`` bytes.  A key whose different stretches have more than
``SHARD`` bytes (a short footer of many documents) gets no shard: each of its windows is a row,
and windows meet by 128 hashed bits in joins that skew handling can split.

The reduced string of an induction level is ordered by prefix doubling, up to ``window``
bytes only, instead of by another induction, and common prefixes are compared rather than
carried: one queue per name and a range minimum per step cost far more in Python.

Rule: a byte goes if some ``window``-byte string over it also starts anywhere else, in the
same document too.  Cases: null text is empty; null ids are kept as null; repeated rows are
told apart by their text only (copies of a whole row cover each other); short texts stay.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.anchors import SHIFT, Rolling, cut, merged, mixed, opened, pack, settle, shipped, unpack
from oddsmith.llm.common import per_batch, store, texts

WINDOW, GRAM, SHARD, QUEUED, JOINED = 400, 32, 4 << 20, 64 << 20, 1 << 18
VALUES = mixed(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# ---- suffix array of one shard ---------------------------------------------------------------------------------------


class Spool:
    """First-in-first-out queues of positions; the larger ones move to disk together."""

    def __init__(self, limit: int):
        self.limit, self.held, self.queues, self.files = limit, 0, defaultdict(list), {}

    def put(self, c: int, a: np.ndarray) -> None:
        if len(a):
            self.queues[c].append(a)
            self.held += a.nbytes
            if self.held > self.limit:
                self._spill()

    def _spill(self) -> None:
        for c, parts in self.queues.items():
            for i, a in enumerate(parts):
                if isinstance(a, np.ndarray) and a.nbytes > 4096:
                    f = tempfile.TemporaryFile()
                    a.tofile(f)
                    self.held -= a.nbytes
                    parts[i] = (f, a.dtype)

    @staticmethod
    def _load(x) -> np.ndarray:
        if isinstance(x, np.ndarray):
            return x
        x[0].seek(0)
        return np.fromfile(x[0], x[1])

    def drain(self, c: int) -> Iterator[np.ndarray]:
        """In blocks of about ``JOINED`` positions; also what is put while draining."""
        while parts := self.queues.pop(c, None):
            at = 0
            while at < len(parts):
                block, size = [], 0
                while at < len(parts) and size < JOINED:
                    x, parts[at] = parts[at], None
                    self.held -= x.nbytes if isinstance(x, np.ndarray) else 0
                    block.append(self._load(x))
                    size += len(block[-1])
                    at += 1
                yield np.concatenate(block)

    def reversed(self, c: int) -> Iterator[np.ndarray]:
        for x in reversed(self.queues.get(c, [])):
            yield self._load(x)[::-1]

    def forward(self, c: int) -> Iterator[np.ndarray]:
        for x in self.queues.get(c, []):
            yield self._load(x)


def deal(spool: Spool, text: np.ndarray, at: np.ndarray) -> None:
    """Append positions to the queues of their characters, keeping their order."""
    if len(at):
        chars = text[at]
        order = np.argsort(chars, kind="stable")
        at, chars = at[order], chars[order]
        cuts = [0, *(np.flatnonzero(chars[1:] != chars[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            spool.put(int(chars[a]), at[a:b])


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, limit: int) -> np.ndarray:
    """Order of all suffixes induced from that of the seeds (starts of ascending stretches)."""
    chars = np.unique(text).tolist()
    todo, large, todo_s, small = Spool(limit), Spool(limit), Spool(limit), Spool(limit)
    seed_chars = text[seeds]
    order = np.argsort(seed_chars, kind="stable")
    seeds, seed_chars = seeds[order], seed_chars[order]
    todo.put(int(text[-1]), np.array([len(text) - 1], seeds.dtype))
    for c in chars:  # descending suffixes, smallest first
        for at in todo.drain(c):
            large.put(c, at)
            before = at[at > 0] - 1
            deal(todo, text, before[~smaller[before]])
        deal(todo, text, seeds[np.searchsorted(seed_chars, c) : np.searchsorted(seed_chars, c, "right")] - 1)
    for c in reversed(chars):  # ascending suffixes, largest first
        for at in todo_s.drain(c):
            small.put(c, at)
            before = at[at > 0] - 1
            deal(todo_s, text, before[smaller[before]])
        for at in large.reversed(c):
            before = at[at > 0] - 1
            deal(todo_s, text, before[smaller[before]])
    parts = []
    for c in chars:
        parts += [*large.forward(c), *small.reversed(c)]
    return np.concatenate(parts)


def doubled(names: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of ``names``, exact up to ``reach`` names.

    A rank is the place of the first suffix of its group; only groups of several are sorted on.
    """
    n, step = len(names), 1
    place = np.argsort(names, kind="stable")
    first = np.concatenate([[True], names[place[1:]] != names[place[:-1]]])
    rank = np.empty(n + 1, np.int64)
    rank[place] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[n] = -1  # what follows the end
    open_ = place[~(first & np.append(first[1:], True))]
    while len(open_) and step < reach:
        own = rank[open_]
        key = own * (n + 2) + rank[np.minimum(open_ + step, n)] + 1
        order = np.argsort(key, kind="stable")
        open_, own, key = open_[order], own[order], key[order]
        at = np.arange(len(open_))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], own[1:] != own[:-1]])
        rank[open_] = own + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    return np.argsort(rank[:n], kind="stable")


def suffix_array(text: np.ndarray, window: int, limit: int = QUEUED) -> np.ndarray:
    """Suffixes of ``text`` (small integers) in order, exact on their first ``window`` characters."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32), append=-1))
    place = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(place[::-1])[::-1]] > 0
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32 if n < 1 << 31 else np.int64) + 1
    if len(seeds) > 1:
        found = induce(text, smaller, seeds, limit)
        is_seed = np.zeros(n, bool)
        is_seed[seeds] = True
        found = found[is_seed[found]]  # seeds in the order of their stretches
        ends = np.full(n, n, np.int64)
        ends[seeds[:-1]] = seeds[1:].astype(np.int64) + 1
        stretch = Rolling(VALUES[text]).ranges(found, ends[found])
        length = ends[found] - found
        new = np.ones(len(found), bool)
        new[1:] = (stretch[1:] != stretch[:-1]) | (length[1:] != length[:-1])
        if not new.all():
            names = np.zeros(n, np.int64)
            names[found] = np.cumsum(new)
            found = seeds[doubled(names[seeds], window // 2 + 2)]
        seeds = found
    return induce(text, smaller, seeds, limit)


def repeated_windows(parts: list[bytes], window: int, limit: int = QUEUED) -> list[np.ndarray]:
    """Per part, whether the window at each place also starts at another place of any part."""
    sizes = np.array([len(x) for x in parts])
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    text = data.astype(np.int16) + 1
    text[ends] = 0
    valid = np.zeros(len(text) + 1, np.int32)
    np.add.at(valid, ends - sizes, 1)
    np.add.at(valid, np.maximum(ends - window + 1, ends - sizes), -1)
    valid = np.cumsum(valid[:-1]) > 0
    order = suffix_array(text, window, limit)
    a, b = order[:-1], order[1:]
    keep = valid[a] & valid[b]
    a, b = a[keep], b[keep]
    eight = data.astype(np.uint64)
    for half in (1, 2, 4):
        eight = (eight[:-half] << np.uint64(8 * half)) | eight[half:]
    offsets = list(range(0, window - 7, 8)) + ([window - 8] if window % 8 else []) if window >= 8 else []
    for j in offsets:
        same = eight[a + j] == eight[b + j]
        a, b = a[same], b[same]
    for j in range(window if window < 8 else 0):
        same = data[a + j] == data[b + j]
        a, b = a[same], b[same]
    twice = np.zeros(len(text), bool)
    twice[a] = twice[b] = True
    return [twice[e - s : e] for e, s in zip(ends, sizes)]


# ---- from documents to spans -----------------------------------------------------------------------------------------


def byte_pieces(docs: DataFrame, window: int, k: int) -> DataFrame:
    """``key, content, id, at, again``; ``again``: the key's k-gram occurs in the piece more than once."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64, bool)]
        for own, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist()):
            values = VALUES[np.frombuffer(data, np.uint8)]
            for key, content, first, count in cut(values, window, k):
                lo = int(first[0])
                grams = mixed(Rolling(values[lo : int(first[-1] + count[-1]) + window - 1]).all(k))
                again = [np.count_nonzero(grams[s - lo : s - lo + c + window - k] == m) > 1 for m, s, c in zip(key, first.tolist(), count.tolist())]
                for column, x in zip(out, (key, content, np.full(len(key), own, np.int64), pack(first, count), np.array(again, bool))):
                    column.append(x)
        columns = [np.concatenate(x) for x in out]
        columns[0], columns[1] = columns[0].view(np.int64), columns[1].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "content", "id", "at", "again"])

    return docs.mapInArrow(per_batch(make), "key long, content long, id long, at long, again boolean")


class Elsewhere:
    """``gone``: the same content occurs twice.  ``open``: first of a content, if the key has several or the piece may repeat itself.

    The last row waits for the next batch, and so does the first row of a key until a second content shows up.
    """

    FIELDS = ("key", "content", "id", "at", "again")

    def __init__(self):
        self.last, self.before, self.several, self.first = None, (None, None), False, None

    def __call__(self, c: dict[str, np.ndarray] | None) -> pa.RecordBatch:
        rows = [self.last[f] if c is None else c[f] if self.last is None else np.concatenate([self.last[f], c[f]]) for f in self.FIELDS]
        key, content, ids, at, again = rows
        group, cls = np.ones(len(key) + 1, bool), np.ones(len(key) + 1, bool)
        group[1:-1] = key[1:] != key[:-1]
        cls[1:-1] = group[1:-1] | (content[1:] != content[:-1])
        group[0] = self.before[0] is None or key[0] != self.before[0]
        cls[0] = group[0] or content[0] != self.before[1]
        n = len(key) if c is None else len(key) - 1
        self.last = None if c is None else {f: x[n:] for f, x in zip(self.FIELDS, rows)}
        gone, first = ~cls[:n] | ~cls[1 : n + 1], cls[:n]
        number = np.cumsum(group[:n])
        out = []
        if n:
            classes = np.bincount(number, weights=first, minlength=number[-1] + 1)
            several = classes > 1
            if not group[0]:
                several[0] = self.several or classes[0] > 0
                if several[0] and self.first is not None:
                    out.append(self.first)
                    self.first = None
            opened_ = first & (several[number] | again[:n])
            use = gone | opened_
            out.append(tuple(x[use] for x in (key[:n], ids[:n], at[:n], gone, opened_)))
            if number[-1] or group[0]:
                self.first = None
            self.several = bool(several[-1])
            alone = np.flatnonzero((number == number[-1]) & first & ~opened_) if not self.several else []
            if len(alone):
                i = alone[:1]
                self.first = (key[:n][i], ids[:n][i], at[:n][i], np.zeros(1, bool), np.ones(1, bool))
            self.before = (key[n - 1], content[n - 1])
        out = out or [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool, bool))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["key", "id", "at", "gone", "open"])


def hot_windows(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """``id, at``: the windows of the pieces ``asked(id, ats)`` that occur at several places of such pieces."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for own, data, ats in zip(batch.column("id").to_pylist(), opened(batch), batch.column("ats").to_pylist()):
            first, count = unpack(np.array(ats, np.int64))
            pos = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            values = VALUES[np.frombuffer(data, np.uint8)]
            for column, x in zip(out, (Rolling(values).ranges(pos, pos + window), Rolling(mixed(values)).ranges(pos, pos + window), np.full(len(pos), own, np.int64), pack(pos, np.ones(len(pos), np.int64)))):
                column.append(x.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["h", "check", "id", "at"])

    found = store(shipped(docs).join(asked, "id").mapInArrow(per_batch(make), "h long, check long, id long, at long"), "hot_windows")
    several = found.groupBy("h", "check").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return found.join(several, ["h", "check"]).select("id", "at").distinct()


def shard_spans(pieces: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of pieces sorted by key; keys are gathered up to ``size`` bytes."""
    held, total, key = [], 0, None

    def flush() -> pa.RecordBatch:
        ids, ats = [], []
        for (own, at, _), twice in zip(held, repeated_windows([x[2] for x in held], window)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], twice.view(np.int8), [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                ids.append(own)
                ats.append((((at >> SHIFT) + a) << SHIFT) | (b - a))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int64())], ["id", "at"])

    for batch in pieces:
        for k, own, at, part in zip(*[batch.column(c).to_pylist() for c in ("key", "id", "at", "part")]):
            if k != key and total >= size:
                yield flush()
                held, total = [], 0
            key = k
            held.append((own, at, part))
            total += len(part)
    if held:
        yield flush()


def removed_spans(docs: DataFrame, window: int = WINDOW, k: int = GRAM, shard: int = SHARD) -> DataFrame:
    """``id, at``: packed runs of repeated windows of ``docs(id, data)``."""
    settled = store(settle(byte_pieces(docs, window, k), Elsewhere, "key long, id long, at long, gone boolean, open boolean"), "stretches")
    bytes_ = F.col("at").bitwiseAND(F.lit((1 << SHIFT) - 1)) + (window - 1)
    hot = store(settled.filter("open").groupBy("key").agg(F.sum(bytes_).alias("bytes")).filter(F.col("bytes") > shard).select("key"), "hot_keys")
    some, waiting = not hot.isEmpty(), settled.filter("open")
    usual = waiting.join(hot, "key", "left_anti") if some else waiting
    asked = usual.groupBy("id").agg(F.collect_list(F.struct("key", "at")).alias("ats"))

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = ([], [], [], [])
        for own, data, ats in zip(batch.column("id").to_pylist(), opened(batch), batch.column("ats").to_pylist()):
            for x in ats:
                first, count = unpack(x["at"])
                for column, value in zip(out, (x["key"], own, x["at"], data[first : first + count + window - 1])):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["key", "id", "at", "part"])

    parts = shipped(docs).join(asked, "id").mapInArrow(per_batch(fetch), "key long, id long, at long, part binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded = parts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda it: shard_spans(it, window, shard), "id long, at long")
    spans = settled.filter("gone").select("id", "at").unionByName(sharded)
    if not some:
        return spans
    return spans.unionByName(hot_windows(docs, waiting.join(hot, "key", "left_semi").groupBy("id").agg(F.collect_list("at").alias("ats")), window))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = GRAM, shard: int = SHARD) -> DataFrame:
    """Every row's ``id``, ``n_bytes``, ``spans`` (removed runs, packed) and ``kept`` bytes."""
    known = texts(docs, id_col, text_col).withColumn("doc_id", F.col("id")).withColumn("id", F.xxhash64("id", "data"))
    spans = removed_spans(known.select("id", "data"), window, k, shard).groupBy("id").agg(F.collect_list("at").alias("ats"))

    def strike(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = ([], [], [], [])
        for data, ats in zip(opened(batch), batch.column("ats").to_pylist()):
            kept, at, runs = [], 0, []
            if ats:
                first, count = unpack(np.array(ats, np.int64))
                runs = merged(list(zip(first.tolist(), (first + count + window - 1).tolist())))
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            for column, value in zip(out, (len(data), len(runs), sum(b - a for a, b in runs), b"".join(kept))):
                column.append(value)
        columns = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["id", "n_bytes", "n_spans", "n_removed", "kept"])

    return shipped(known).join(spans, "id", "left").mapInArrow(per_batch(strike), "id long, n_bytes long, n_spans long, n_removed long, kept binary")


def dedup_report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
