"""Benchmark decontamination by SimHash of item-sized windows (operator 5, DataFrame functions only).

A benchmark item of n five-word shingles is compared with the n-shingle windows of a
document, a document of fewer shingles as a whole.  Windows are cut where a shingle of the
document is one of an item's: an item and a window without common shingle have similarity 0.
They begin at a shared shingle, or so that one has the same place in window and item, moved
inside the document; no other window has more in common.  A document needs as many shared
shingles as the similarity asks for before its windows are fingerprinted.

Window and item fingerprints (64 bits) meet through ``BLOCKS`` bit blocks: within
``radius`` bits in all, one block differs in at most ``radius // BLOCKS`` bits, and the index
holds every block value of every item within that distance, so no pair within the radius is
lost.  At radius 19 a pair of similarity 0.8 is missed about once in 3,000; exact copies never.
Candidates are verified by weighted Jaccard similarity, a shingle's weight being its count.

The block index is joined by shuffle: its size is that of the benchmark times the values
within reach of a block.  The shingle table is broadcast only up to ``BROADCAST`` rows; beyond that the shingles are
joined by shuffle.  The same holds for the table of window places that goes back to the
documents: usually few documents have any, so their texts are not shuffled.

Cases: null texts have no words; items with fewer than five words have no shingle and match
nothing; equal items are reported separately.  A document is what has one id and text (see
``row_key``): texts that share an id, or have none, are found and reported on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import store, words

GRAM, SIMILARITY, RADIUS, BLOCKS, BROADCAST = 5, 0.8, 19, 4, 1_000_000


def shingles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``g``: hashes of all five-word shingles, in order, A-Z and the like lower-cased."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), words(F.lower(F.col(text_col).cast("string"))).alias("w"))
    hashes = F.transform("w", lambda x, i: F.xxhash64(x, *[F.get("w", i + j) for j in range(1, GRAM)]))
    return df.filter(F.size("w") >= GRAM).select("id", F.slice(hashes, 1, F.size("w") - (GRAM - 1)).alias("g"))


def row_key() -> Column:
    """Tells documents apart also if they share ``doc_id`` or have none."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fingerprint(g: Column) -> Column:
    """Bit b is set if it is set in more than half of the hashes."""
    bit = lambda h, b: F.call_function("bit_get", h, b).cast("int")
    ones = lambda b: F.aggregate(g, F.lit(0), lambda a, h: a + bit(h, b))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: F.when(2 * ones(b) > F.size(g), a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(a))


def block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two bags of hashes."""
    count = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h)))
    return both / (F.size(a) + F.size(b) - both)


def need(n: Column, size: Column, least: float) -> Column:
    """Common shingles that bags of ``n`` and ``size`` have at least at that similarity."""
    return F.ceil(least * (n + size) / (1 + least) - F.lit(1e-9))


def windows(docs: DataFrame, items: DataFrame, least: float, broadcast: int) -> DataFrame:
    """``id, start, n, win``: windows of ``docs(id, g)`` for items of ``n`` shingles, placed by shared shingles of ``items(item, n, g)``."""
    table = items.select("item", "n", F.posexplode("g").alias("at", "h"))
    table = F.broadcast(table) if table.count() <= broadcast else table
    # the outer form: the inner one adds a filter on the shingles, which would compute them once more for every word
    hits = docs.select("id", F.size("g").alias("size"), "g").select("id", "size", F.posexplode_outer("g").alias("pos", "h")).join(table, "h")
    last = F.greatest(F.col("size") - F.col("n"), F.lit(0))
    aligned = F.greatest(F.least(F.col("pos") - F.col("at"), last), F.lit(0))
    placed = hits.groupBy("id", "item", "n", "size").agg(F.collect_set("pos").alias("shared"), F.collect_set(aligned).alias("aligned"))
    common = need(F.col("n"), F.least("n", "size"), least).cast("int")
    placed = placed.filter(F.size("shared") >= common).withColumns({"shared": F.sort_array("shared"), "common": common, "last": last})
    # a window that begins between shared shingles has no more of them than the next one that begins at one, or the last
    full = F.filter(placed["shared"], lambda p, i: (p <= F.col("last")) & (F.get("shared", i + F.col("common") - 1) < p + F.col("n")))
    starts = F.array_union(F.array_union("aligned", full), F.array("last"))
    good = placed.select("id", "n", F.explode(starts).alias("start"))
    good = store(good.groupBy(F.col("id").alias("of")).agg(F.collect_set(F.struct("start", "n")).alias("wins")), "starts")
    few = F.broadcast(good) if (good.select(F.sum(F.size("wins") + 1)).first()[0] or 0) <= broadcast else good
    cut = docs.join(few, F.col("id") == F.col("of")).select("id", "g", F.explode("wins").alias("x"))
    return cut.select("id", "x.start", "x.n", F.slice("g", F.col("x.start") + 1, F.col("x.n")).alias("win")).dropDuplicates(["id", "start", "n"])


def leaking(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, broadcast: int = BROADCAST) -> DataFrame:
    """``row, item_id, similarity, start_word, distance``: the best window of each pair at or above ``least``."""
    docs = docs.select(row_key().alias("row"), "text")
    items = store(shingles(benchmark, "item_id", "text").select(F.col("id").alias("item"), F.size("g").alias("n"), "g", fingerprint(F.col("g")).alias("fp")), "items")
    cut = store(windows(shingles(docs, "row", "text"), items.select("item", "n", "g"), least, broadcast).withColumn("wfp", fingerprint(F.col("win"))), "windows")
    near = F.filter(F.sequence(F.lit(0), F.lit(0xFFFF)), lambda x: F.bit_count(x) <= radius // BLOCKS)
    index = items.select("item", "n", "g", "fp", F.posexplode(F.array(*[block(F.col("fp"), i) for i in range(BLOCKS)])).alias("no", "v"))
    index = index.select("item", F.col("n").alias("size"), "fp", "no", "v", F.explode(near).alias("flip")).select("item", "size", "fp", "no", F.col("v").bitwiseXOR(F.col("flip")).alias("value"))
    keyed = cut.select("id", "start", "n", "wfp", F.posexplode(F.array(*[block(F.col("wfp"), i) for i in range(BLOCKS)])).alias("wno", "wv"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("wfp")))
    pairs = keyed.join(index.hint("merge"), (F.col("n") == F.col("size")) & (F.col("wno") == F.col("no")) & (F.col("wv") == F.col("value")) & (apart <= radius))
    pairs = pairs.select("id", "start", "n", "item", apart.alias("distance")).distinct().withColumnsRenamed({"id": "of", "start": "from", "n": "size"})
    both = pairs.join(cut, (F.col("id") == F.col("of")) & (F.col("start") == F.col("from")) & (F.col("n") == F.col("size"))).drop("n")
    scored = both.join(items.select("item", "g"), "item").select("id", "item", "start", "distance", similarity(F.col("win"), F.col("g")).alias("similarity")).filter(F.col("similarity") >= least)
    best = scored.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "distance")).alias("b"))
    return best.select(F.col("id").alias("row"), F.col("item").alias("item_id"), F.round("b.similarity", 6).alias("similarity"), (-F.col("b.s")).alias("start_word"), F.col("b.distance").alias("distance"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, broadcast: int = BROADCAST) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, distance`` of every document and item in ``leaking``."""
    found = store(leaking(docs, benchmark, least, radius, broadcast), "leaking")
    named = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id")).join(found, "row")
    return named.distinct().drop("row")
