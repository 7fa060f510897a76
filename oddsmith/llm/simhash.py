"""SimHash near-duplicates by pigeonhole blocks (operator 1).

A fingerprint has 64 bits, one per bit position of the shingle hashes that is set in more
than half of them.  Two fingerprints within ``radius`` bits agree in at least
``blocks - radius`` of ``blocks`` bit blocks, so every choice of that many blocks is a join
key: no close pair is missed, whatever ``blocks`` is.  ``blocks`` only decides how
selective the keys are and follows the number of different fingerprints.

Equal fingerprints are one node, so exact copies cost nothing.  In a bucket of up to
``SMALL`` members every pair is verified in place.  A larger one is cut into chunks whose
pairs are separate tasks; each returns a spanning forest of its verified links, so dense
groups of near copies give a linear number of links and the components stay exact.

Cases: null text counts as empty; no words gives fingerprint zero, linked like any other;
a null id keeps its row, its component is the smallest id reachable (null if none).
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmith.llm.common import components, per_batch, store, texts

SMALL, CHUNK, SEED = 16, 4096, 42


def simhash(data: bytes, shingle: int = 4) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text, A-Z lower-cased."""
    found = data.lower().split()  # bytes.lower and bytes.split know ASCII only
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    k = min(shingle, n)
    first = [0, *(ends[: n - k] + 1).tolist()]
    last = ends[k - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(first), 1 << 16):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)])])
        octets = np.frombuffer(raw, np.uint8).reshape(-1, 8)
        if len(octets) < 512:
            ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
        else:  # per byte: how often each value occurs, then the bits of the values
            for j in range(8):
                ones[8 * j : 8 * j + 8] += np.bincount(octets[:, j], minlength=256) @ BITS
    return int(np.packbits(2 * ones > len(first)).view(">i8")[0])


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id``, ``fp`` for every row."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [simhash(x, shingle) for x in batch.column("data").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], ["id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(per_batch(make), "id long, fp long")


def block_count(n: int, radius: int) -> int:
    """Fewest blocks for which a random key is expected to hold at most about one of ``n`` fingerprints."""
    for m in range(radius + 1, 33):
        if (m - radius) * (64 // m) >= log2(max(n, 2)):
            return m
    return 33


def block_keys(fp: Column, blocks: int, radius: int) -> Column:
    """One key per choice of ``blocks - radius`` blocks: its number and the fingerprint masked to it."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    keys = []
    for no, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        keys.append(F.struct(F.lit(no).alias("no"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("v")))
    return F.array(*keys)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what ``radius`` connects: breadth first, each member leaves the pool once reached."""
    pool, links = np.unique(fps), []
    while len(pool):
        todo, pool = [pool[0]], pool[1:]
        while todo and len(pool):
            x = todo.pop()
            near = np.bitwise_count((pool ^ x).view(np.uint64)) <= radius
            if near.any():
                links += [(int(x), int(y)) for y in pool[near]]
                todo += list(pool[near])
                pool = pool[~near]
    return links


def links(fps: DataFrame, radius: int = 4, blocks: int | None = None, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """Verified links ``u``, ``v`` between different fingerprints of ``fps(fp)`` that connect all pairs within ``radius``."""
    blocks = blocks or block_count(fps.count(), radius)
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), blocks, radius)).alias("k")).select("fp", "k.no", "k.v")
    sizes = keyed.groupBy("no", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keyed.join(sizes, ["no", "v"])
    pairs = members.filter(F.col("n") <= small).groupBy("no", "v").agg(F.collect_list("fp").alias("all"))
    pairs = pairs.select(F.explode("all").alias("u"), "all").select("u", F.explode(F.filter("all", lambda x: (x > F.col("u")) & (F.bit_count(x.bitwiseXOR(F.col("u"))) <= radius))).alias("v"))
    large = members.filter(F.col("n") > small).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    large = large.withColumn("own", own).select("no", "v", "fp", F.explode(units).alias("unit"))
    out = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def spanning(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(pdf["fp"].to_numpy(np.int64), radius), columns=["u", "v"], dtype="int64")

    return pairs.unionByName(large.groupBy("no", "v", "unit").applyInPandas(spanning, out))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Every row's ``id``, ``fp`` and ``component`` (smallest id reachable over links, itself included)."""
    fps = store(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("root").agg(F.min("low").alias("least"))
    linked = named.join(least, "root").select("fp", "least")
    single = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("least"))
    return fps.join(linked.unionByName(single), "fp").select("id", "fp", F.col("least").alias("component"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
