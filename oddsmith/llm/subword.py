"""Quality classifier on supervised subword embeddings (operator 4).

A document is the mean of the vectors of its words, of their character n-grams and of its
pairs of equal neighbouring words (one row for all such pairs), hashed to ``BUCKETS`` rows;
a softmax layer gives the two classes.  Vectors and layer are
trained together by numpy stochastic gradient descent on at most about ``MAX_DOCS`` labelled
documents whose crc32 of the id is not 0 modulo 5 (a hash of the id decides; all of them
below that).  Scoring covers every whole text: as the model is linear up to the softmax, each
word's share is computed once and remembered.

Cases: null and empty texts get the score of the bias alone; without labels, or with one
class only, the bias is the smoothed share of label 1; of several labels of one id the
smallest counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BUCKETS, DIM, SHORTEST, LONGEST, MAX_DOCS, EPOCHS, BATCH, RATE, CACHED = 1 << 16, 8, 3, 5, 2_000, 6, 32, 0.5, 1 << 18


def buckets(word: bytes) -> list[int]:
    """Rows of a word and of its character n-grams (bytes of the padded word)."""
    w = b"<" + word + b">"
    return [zlib.crc32(word) % BUCKETS] + [zlib.crc32(w[i : i + n], n) % BUCKETS for n in range(SHORTEST, LONGEST + 1) for i in range(len(w) - n + 1)]


SAME = zlib.crc32(b"", 1) % BUCKETS


def pairs(found: list[bytes]) -> int:
    """Neighbouring words that are equal."""
    return sum(map(eq, found, islice(found, 1, None)))


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and their shares in the document."""
    total: Counter = Counter()
    found = data.split()
    for word, n in Counter(found).items():
        for b in buckets(word):
            total[b] += n
    if same := pairs(found):
        total[SAME] += same
    ids = np.fromiter(total.keys(), np.int32, len(total))
    counts = np.fromiter(total.values(), np.float32, len(total))
    return ids, counts / max(counts.sum(), 1)


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Per bucket the difference of the two class scores, and the bias."""
    labels = np.array([y for _, y in rows], np.int64)
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    docs = [features(x) for x, _ in rows]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.array([np.log(1 - share), np.log(share)], np.float32)
    steps, done = epochs * -(-len(rows) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            ids = np.concatenate([docs[i][0] for i in picked])
            weight = np.concatenate([docs[i][1] for i in picked])
            doc = np.repeat(np.arange(len(picked)), [len(docs[i][0]) for i in picked])
            mean = np.stack([np.bincount(doc, weight * vectors[ids, d], len(picked)) for d in range(DIM)], 1)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(picked)), labels[picked]] -= 1.0
            rate = RATE * (1 - done / steps)
            back = (p @ layer.T)[doc] * weight[:, None]
            for d in range(DIM):  # each document moves the vectors of its own rows
                vectors[:, d] -= BATCH * rate * np.bincount(ids, back[:, d], BUCKETS)
            layer -= rate * (mean.T @ p).astype(np.float32)
            bias -= rate * p.mean(0).astype(np.float32)
            done += 1
    return vectors @ (layer[:, 1] - layer[:, 0]).astype(np.float64), float(bias[1] - bias[0])


class Shares(dict):
    """Word -> (sum of its buckets' scores, number of its buckets)."""

    def __init__(self, scores: np.ndarray):
        self.scores = scores

    def __missing__(self, word: bytes) -> tuple[float, int]:
        if len(self) >= CACHED:
            self.clear()
        rows = buckets(word)
        share = (float(self.scores[rows].sum()), len(rows))
        if len(word) <= 64:
            self[word] = share
        return share


def fifth(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[np.ndarray, float]:
    """The model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; at most about ``max_docs`` texts reach the driver."""
    wanted = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fifth(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = wanted.count()
    if n > max_docs:
        wanted = wanted.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < int(max_docs / n * (1 << 20)))
    rows = docs.join(F.broadcast(wanted), "doc_id").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"), "quality").collect()
    return train([(bytes(r["data"]), r["quality"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["data"]))]) if rows else (np.zeros(BUCKETS), 0.0)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score`` of every row."""
    weights, bias = model[0].astype(np.float32), model[1]

    def run(batches):
        shares = Shares(weights)

        def one(data: bytes) -> float:
            found = data.split()
            n = pairs(found)
            total = n * float(weights[SAME])
            for word, times in Counter(found).items():
                s, k = shares[word]
                total += times * s
                n += times * k
            return float(1 / (1 + np.exp(-np.clip(bias + (total / n if n else 0.0), -500, 500))))

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([one(x) for x in batch.column("data").to_pylist()], pa.float64())], ["id", "score"])

    data = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    return data.mapInArrow(run, "id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    got = scored(docs, fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality")))
    return got.select(F.col("id").alias("doc_id"), (fifth(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


