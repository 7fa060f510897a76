"""Best-fit decreasing packing of token ids into fixed windows (operator 9).

Tokens: every whole text (null: empty) is tokenised and closed by ``end_id``; documents
longer than the window are first cut into full windows, the rest is one piece.

Packing needs lengths only, and there are at most ``window`` of them.  The driver gets the
histogram of piece lengths, places whole runs of equal pieces into runs of equal windows
(a segment tree over the remaining capacity names the tightest open one) and returns a
table of slots: "the n-th piece of this length goes to that window at that offset".  Spark
numbers the pieces of each length and joins them to the slots.  The result is exactly that
of placing piece after piece, longest first.

Cases: null or empty text is the single id ``end_id``; repeated rows are packed separately;
no rows gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from math import ceil
from struct import pack as packed_ids

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.common import per_batch, store, texts

WINDOW, END_ID, REMEMBERED = 2048, 1, 72 << 20
_ENCODERS: dict[str, Encoder] = {}


class Encoder(dict):
    """White-space separated chunk -> its ids as little-endian 32-bit bytes.

    The vocabulary drops white space before merging, so a text's ids are those of its chunks
    in order.  A worker keeps the memory of chunks from task to task (one costs about 120 bytes, its text and its ids);
    it is emptied at ``REMEMBERED`` bytes.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.held = Tokenizer.from_file(path), 0

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def __missing__(self, chunk: bytes) -> bytes:
        if self.held >= REMEMBERED:
            self.forget()
        if (word := stem(chunk)) != chunk:
            ids = self[word] + self[chunk[-1:]]
            if len(chunk) <= 64:
                self.keep(chunk, ids)
            return ids
        ids = np.array(self.model.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= 64:
            self.keep(chunk, ids)
        return ids

    def keep(self, chunk: bytes, ids: bytes) -> None:
        self[chunk] = ids
        self.held += len(chunk) + len(ids) + 120

    def ids(self, data: bytes) -> bytes:
        if b"<|" not in data:  # special tokens are written in one case; everything else is lower-cased anyway
            data = data.lower()
        chunks = data.split()
        new = [c for c in {stem(c) for c in set(chunks) if c not in self} if c not in self and len(c) <= 64]
        if self.held >= REMEMBERED:
            self.forget()
        elif new:  # together, and without offsets
            found = self.model.encode_batch_fast([c.decode() for c in new], add_special_tokens=False)
            self.update((c, packed_ids(f"<{len(x.ids)}I", *x.ids)) for c, x in zip(new, found))
            self.held += sum(map(len, new)) + sum(4 * len(x.ids) for x in found) + 120 * len(new)
        return b"".join(map(self.__getitem__, chunks))


def stem(chunk: bytes) -> bytes:
    """Without a final full stop or comma after an ASCII letter or digit: that mark is a token of its own."""
    return chunk[:-1] if chunk[-1:] in (b".", b",") and chunk[-2:-1].isalnum() else chunk


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, ids`` (little-endian 32-bit) per piece."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, out = encoder(tokenizer), ([], [], [], [], [], [])
        for key, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist()):
            ids = enc.ids(data) + end
            for at in range(0, len(ids), 4 * window):
                part = ids[at : at + 4 * window]
                for column, value in zip(out, (key, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(per_batch(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


class Tightest:
    """Segment tree over capacities: the smallest marked one that is at least some value."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.marked = [False] * (2 * self.size)

    def mark(self, at: int, on: bool) -> None:
        at += self.size
        self.marked[at] = on
        while at > 1:
            at //= 2
            self.marked[at] = self.marked[2 * at] or self.marked[2 * at + 1]

    def first(self, least: int) -> int | None:
        at = least + self.size
        while not self.marked[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.marked[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``(length, first, windows, each, lo, offset)``.

    Pieces ``first .. first + windows * each - 1`` of that length go, ``each`` in a row, to
    the windows from ``lo`` on, at ``offset``.  After a piece went into the tightest window,
    that window stays the tightest for the next piece of this length as long as it fits.
    """
    tree, open_, new, slots = Tightest(window), defaultdict(deque), 0, []
    for length in sorted(histogram, reverse=True):
        left, first = histogram[length], 0
        while left:
            room = tree.first(length)
            if room is None:
                room, lo, hi = window, new, new + left
                new += min(left, ceil(left / (window // length)))
            else:
                lo, hi = open_[room].popleft()
            each = min(room // length, left)
            n = min(hi - lo, left // each)
            slots.append((length, first, n, each, lo, window - room))
            first, left = first + n * each, left - n * each
            if room < window and lo + n < hi:
                open_[room].appendleft((lo + n, hi))
            elif room == window and left:  # the last, partly filled new window takes the rest
                slots.append((length, first, 1, left, lo + n, 0))
                open_[window - left * length].append((lo + n, lo + n + 1))
                tree.mark(window - left * length, True)
                left = 0
            rest = room - each * length
            if rest:
                open_[rest].append((lo, lo + n))
                tree.mark(rest, True)
            if room < window:
                tree.mark(room, bool(open_[room]))
    return slots


def pack(parts: DataFrame, window: int = WINDOW, per_bucket: int = 200_000) -> DataFrame:
    """``parts`` (with ``doc_id, start, length``; stable on recomputation) plus ``sequence_id``, ``offset``."""
    spark = parts.sparkSession
    counted = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per length
    buckets = max(1, ceil(sum(counted.values()) / per_bucket))
    by_length = defaultdict(list)
    for slot in best_fit(counted, window):
        by_length[slot[0]].append(slot)
    rows = []
    for length, slots in by_length.items():
        step = ceil(counted[length] / len(slots))  # the slots of a length are looked up by block of this many pieces
        rows += [(length, step, block, *slot[1:]) for slot in slots for block in range(slot[1] // step, (slot[1] + slot[2] * slot[3] - 1) // step + 1)]
    slots = spark.createDataFrame(rows, "length long, step long, block long, first long, windows long, each long, lo long, at long")
    steps = spark.createDataFrame([(length, ceil(counted[length] / len(s))) for length, s in by_length.items()], "length long, step long")
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(steps, "length").select("length", "bucket", "base", "step")
    ranked = keyed.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start")) - 1)
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / F.col("step"))).drop("step", "bucket", "base")
    inside = F.col("rank") - F.col("first")
    fits = (ranked["length"] == slots["length"]) & (ranked["block"] == slots["block"]) & (F.col("rank") >= F.col("first")) & (inside < F.col("windows") * F.col("each"))
    return ranked.join(slots, fits).select(*[ranked[c] for c in parts.columns], (F.col("lo") + F.floor(inside / F.col("each"))).alias("sequence_id"), (F.col("at") + inside % F.col("each") * ranked["length"]).alias("offset"))


def packed_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of ``documents`` with their place; the ids themselves are reduced to their checksum."""
    found = pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json")).drop("ids")
    return pack(store(found, "pieces"))
