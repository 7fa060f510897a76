"""Substring dedup on word windows by De Bruijn compaction (operator 8).

A window of ``window`` words is an edge between its first and its last ``window - 1`` words.
Edges are filed under their smallest ``k``-gram and travel as pieces (stretches of edges
with one key).  Where all pieces of a key are equal, the smallest document keeps its words
and the others lose theirs at once.  Pieces of keys with several contents are opened: their
edges are counted, repeated edges are joined to the degrees of their end nodes, and
stretches over unbranched nodes are compacted into paths, as long as the coordinates in the
document and in the source (the smallest document with the edge) advance together.

Rule: a word goes if some window that covers it also starts in a document with a smaller id.
Cases: null text has no words; null ids count as larger than any id; rows of one id (or none)
do not take words from each other, nor do copies inside one document; texts shorter than a
window stay.  Places belong to a row (hash of id and text), ids only decide which is smaller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.anchors import NO_ID, SHIFT, Rolling, Runs, by_document, cut, merged, mixed, opened, pack, settle, shipped, unpack
from oddsmith.llm.common import per_batch, store, texts

WINDOW, GRAM, CACHED = 13, 5, 1 << 19


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = Hashes()


def word_values(data: bytes) -> np.ndarray:
    found = data.split()  # ASCII white space
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def super_kmers(docs: DataFrame, window: int, k: int) -> DataFrame:
    """``key, content, id, row, at`` of every piece of ``docs(id, row, data)``."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, contents = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        ids, rows, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, row, data in zip(*[batch.column(c).to_pylist() for c in ("id", "row", "data")]):
            for key, content, first, count in cut(word_values(data), window, k):
                keys.append(key)
                contents.append(content)
                ids.append(np.full(len(key), own, np.int64))
                rows.append(np.full(len(key), row, np.int64))
                ats.append(pack(first, count))
        columns = [np.concatenate(keys).view(np.int64), np.concatenate(contents).view(np.int64), np.concatenate(ids), np.concatenate(rows), np.concatenate(ats)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "content", "id", "row", "at"])

    return docs.mapInArrow(per_batch(make), "key long, content long, id long, row long, at long")


class SmallerDocument:
    """Marks pieces whose content is in a smaller document; the rest of a key with several contents stays open.

    Rows arrive by (key, content, id, row, at): the first of a class has its smallest id, and a
    place that repeats the one before is dropped.  Open rows of a key with one content so far
    wait until a second content shows up.
    """

    def __init__(self):
        self.runs, self.low, self.waiting, self.mixed, self.before = Runs(), None, [], False, None

    def __call__(self, c: dict[str, np.ndarray]) -> pa.RecordBatch:
        group, cls = self.runs.starts(c["key"], c["content"])
        n, ids, rows, ats = len(group), c["id"], c["row"], c["at"]
        held = np.maximum.accumulate(np.where(cls, np.arange(n), -1))
        low = np.where(held >= 0, ids[held], self.low if self.low is not None else 0)
        new = cls.copy()
        new[1:] |= (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]) | (ats[1:] != ats[:-1])
        new[0] |= self.before != (ids[0], rows[0], ats[0])
        self.before = (ids[-1], rows[-1], ats[-1])
        gone = ids > low
        number = np.cumsum(group)  # 0: the group that began earlier
        classes = np.bincount(number, weights=cls, minlength=number[-1] + 1)
        several = classes > 1
        if not group[0]:
            several[0] = self.mixed or classes[0] > 0
        out = [(rows[gone & new], ats[gone & new], True)]
        stay = ~gone & new & several[number]
        if not group[0] and several[0]:
            out += [(a, b, False) for a, b in self.waiting]
            self.waiting = []
        out.append((rows[stay], ats[stay], False))
        last = number == number[-1]
        if number[-1] or group[0]:
            self.waiting = []
        self.mixed = bool(several[-1])
        if not self.mixed:
            rest = last & ~gone & new
            self.waiting.append((rows[rest], ats[rest]))
        self.low = low[-1]
        columns = [np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.repeat([x[2] for x in out], [len(x[0]) for x in out])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "at", "gone"])


def edges(docs: DataFrame, open_pieces: DataFrame, window: int) -> DataFrame:
    """``edge, check, left, right, id, row, pos`` of every window in an open piece."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], [], [], [], [], []]
        for own, row, data, ats in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), opened(batch), batch.column("ats").to_pylist()):
            first, count = unpack(np.unique(np.array(ats, np.int64)))
            values = word_values(data)
            keep = first + count + window - 1 <= len(values)  # false only if hashes of rows collide
            first, count = first[keep], count[keep]
            pos = np.unique(np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            a, b = Rolling(values), Rolling(mixed(values))
            for column, x in zip(out, (a.ranges(pos, pos + window), b.ranges(pos, pos + window), a.ranges(pos, pos + window - 1), a.ranges(pos + 1, pos + window))):
                column.append(x.view(np.int64))
            out[4].append(np.full(len(pos), own, np.int64))
            out[5].append(np.full(len(pos), row, np.int64))
            out[6].append(pos.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["edge", "check", "left", "right", "id", "row", "pos"])

    return shipped(docs).join(by_document(open_pieces), "row").mapInArrow(per_batch(make), "edge long, check long, left long, right long, id long, row long, pos long")


def repeated_paths(found: DataFrame) -> DataFrame:
    """Compacted stretches ``row, at`` of the edges that a smaller document has too."""
    unit, found = ["edge", "check"], store(found, "edges")
    sourced = found.groupBy(*unit, "left", "right").agg(F.min(F.struct("id", "row", "pos")).alias("source"), F.max("id").alias("most")).filter(F.col("source.id") < F.col("most"))
    repeated = store(sourced.drop("most"), "repeated")
    into = repeated.groupBy(F.col("right").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    out = repeated.groupBy(F.col("left").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    plain = into.join(out, "node").filter("n_in = 1 AND n_out = 1").select(F.col("node").alias("left"), F.lit(True).alias("plain"))
    placed = repeated.join(plain, "left", "left").select(*unit, "source", F.coalesce("plain", F.lit(False)).alias("plain"))
    rows = found.select(*unit, "id", "row", "pos").join(placed, unit).filter(F.col("id") > F.col("source.id"))
    before = Window.partitionBy("row").orderBy("pos")
    goes_on = F.col("plain") & (F.lag("pos").over(before) == F.col("pos") - 1) & (F.lag("source.row").over(before) == F.col("source.row")) & (F.lag("source.pos").over(before) == F.col("source.pos") - 1)
    path = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, 0))
    spans = rows.withColumn("path", path).groupBy("row", "path").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    return spans.select("row", (F.shiftleft(F.col("first"), SHIFT) + F.col("n")).alias("at"))


def removed_spans(docs: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``row, at``: packed runs of windows of ``docs(id, row, data)`` that a smaller document has too."""
    settled = store(settle(super_kmers(docs, window, k), SmallerDocument, "row long, at long, gone boolean"), "pieces")
    paths = repeated_paths(edges(docs, settled.filter("NOT gone").select("row", "at"), window))
    return settled.filter("gone").select("row", "at").unionByName(paths)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Every row's ``id``, ``n_words``, ``n_removed`` and ``kept`` (the kept words, joined by one space, as bytes)."""
    known = texts(docs, id_col, text_col).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.xxhash64("id", "data").alias("row"), "data")

    def strike(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = ([], [], [], [])
        for own, data, ats in zip(batch.column("id").to_pylist(), opened(batch), batch.column("ats").to_pylist()):
            found, left, at = data.split(), [], 0
            if ats:
                first, count = unpack(np.array(ats, np.int64))
                for a, b in merged(list(zip(first.tolist(), (first + count + window - 1).tolist()))):
                    left += found[at:a]
                    at = b
            left += found[at:]
            for column, value in zip(out, (None if own == NO_ID else own, len(found), len(found) - len(left), b" ".join(left))):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "n_words", "n_removed", "kept"])

    return shipped(known).join(by_document(removed_spans(known, window, k)), "row", "left").mapInArrow(per_batch(strike), "id long, n_words long, n_removed long, kept binary")


def dedup_report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
