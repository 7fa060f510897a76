"""Content-defined pieces: every window of a fixed length is filed under its smallest k-gram hash.

Equal windows have equal smallest hashes, so all windows that could be equal meet under one
key, and neighbouring windows with the same key travel as one row (a piece).  Rows of
a key that have the same content are settled by a running comparison over sorted rows;
only pieces of keys with several contents are looked at window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import per_batch

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Windows per block of a long text; a piece packs its first window and its number of windows in one integer.
BLOCK, SHIFT = 1 << 20, 21
NO_ID = (1 << 63) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of ranges of a sequence of 64-bit values, in constant time each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(INVERSE, n), dtype=np.uint64)])
        self.scale = powers(BASE, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.scale[start]

    def all(self, k: int) -> np.ndarray:
        """Of every range of ``k`` values."""
        return (self.sums[k:] - self.sums[:-k]) * self.scale[: len(self.sums) - k]


def sliding_min(a: np.ndarray, span: int) -> np.ndarray:
    p = 1
    while 2 * p <= span:
        a = np.minimum(a[:-p], a[p:])
        p *= 2
    return np.minimum(a[: len(a) - (span - p)], a[span - p :]) if span > p else a


def cut(values: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``key, content, first window, windows`` of the pieces, block by block."""
    for at in range(0, max(0, len(values) - window + 1), BLOCK):
        block = values[at : at + BLOCK + window - 1]
        rolling = Rolling(block)
        least = sliding_min(mixed(rolling.all(k)), window - k + 1)
        start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        count = np.diff(np.append(start, len(least)))
        content = mixed(rolling.ranges(start, start + count + window - 1) ^ count.astype(np.uint64))
        yield least[start], content, start + at, count


def pack(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << SHIFT) | count.astype(np.int64)


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> SHIFT, at & ((1 << SHIFT) - 1)


def shipped(docs: DataFrame) -> DataFrame:
    """``docs`` with ``data`` compressed as ``z``, for a shuffle."""
    rest = [c for c in docs.columns if c != "data"]

    def press(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays([*[batch.column(x) for x in rest], pa.array([c.compress(x) for x in batch.column("data").to_pylist()], pa.binary())], [*rest, "z"])

    return docs.mapInArrow(per_batch(press), docs.select(*rest).schema.add("z", "binary"))


def opened(batch: pa.RecordBatch) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in batch.column("z").to_pylist()]


def settle(pieces: DataFrame, rule: Callable[[], Callable[[dict[str, np.ndarray]], pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``rule`` over the rows of each key in the order of (key, content, id, row if there is one, at), batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = rule()
        for batch in batches:
            if batch.num_rows:
                yield step({n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names})
        if getattr(step, "last", None) is not None:  # a rule that looks one row ahead
            yield step(None)

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in ("key", "content", "id", "row", "at") if c in pieces.columns]
    return pieces.repartition(n, "key").sortWithinPartitions(*order).mapInArrow(run, schema)


class Runs:
    """Groups (same key) and classes (same key and content) over consecutive batches."""

    def __init__(self):
        self.key = self.content = None

    def starts(self, key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group, cls = np.ones(len(key), bool), np.ones(len(key), bool)
        group[1:] = key[1:] != key[:-1]
        cls[1:] = group[1:] | (content[1:] != content[:-1])
        if self.key is not None:
            group[0] = key[0] != self.key
            cls[0] = group[0] or content[0] != self.content
        self.key, self.content = key[-1], content[-1]
        return group, cls


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def by_document(spans: DataFrame) -> DataFrame:
    """``row, ats``: all packed spans of a row, at most one per window of it."""
    return spans.groupBy("row").agg(F.collect_list("at").alias("ats"))
