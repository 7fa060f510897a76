"""Language identification by rank-order n-gram profiles (operator 6).

A profile is the list of a language's most frequent character n-grams (1 to ``LONGEST``, over
lower-cased words of letters, Unicode category L, padded by ``_``).  A document's own list is compared with each by
the out-of-place distance: the sum of rank differences, ``PROFILE`` for an absent n-gram.

Profiles are fitted on at most about ``MAX_DOCS`` documents per language (a hash of the id
decides; all of them below that) of those whose crc32 of the id leaves 0 or 2 modulo 3.

The driver holds ``PROFILE`` n-grams and one sampling rate a language; so small a table of rates is broadcast, and
only the sample is shuffled.  A task remembers at most ``REMEMBERED`` bytes of numbered words.

Cases: very long texts are read whole, no rows give no rows; null texts and texts without a letter are ``und`` with score 0, as is everything if
nothing can be learned; ties between languages go to the first by name, ties between
n-grams of a document to the smaller crc32.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmith.llm.common import per_batch

LONGEST, PROFILE, MAX_DOCS, REMEMBERED, KNOWN = 3, 300, 1_000, 40 << 20, 1 << 18
LETTERS = re.compile(r"[^\W\d_]+")  # and some numerals, which ``letter_words`` takes out
UNKNOWN = "und"


def letter_words(text: str) -> Counter:
    """How often each lower-cased word of letters occurs."""
    found = Counter(LETTERS.findall(text.lower()))
    if found and not "".join(found).isalpha():  # isalpha: category L only
        out: Counter = Counter()
        for word, n in found.items():
            for part in [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split():
                out[part] += n
        return out
    return found


def grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


def gram_counts(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    get = out.get
    for word, n in letter_words(text).items():
        for g in grams(word):
            out[g] = get(g, 0) + n
    return out


def third(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3


def profiles(docs: DataFrame, size: int = PROFILE, max_docs: int = MAX_DOCS) -> dict[str, dict[str, int]]:
    """Language -> n-gram -> rank, from ``docs(doc_id, lang, text)``; the result has ``size`` rows a language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (third(F.col("doc_id")) != 1))
    rates = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(max_docs)) / F.count(F.lit(1))).alias("rate"))
    told = F.broadcast(docs.sparkSession.createDataFrame(rates.collect(), rates.schema))
    sample = known.join(told, "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            total.setdefault(lang, Counter()).update(gram_counts(text))
        rows = [(lang, g, n) for lang, c in total.items() for g, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "g", "n"])

    counts = sample.mapInArrow(per_batch(count), "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g")) - 1).filter(F.col("rank") < size)
    out: dict[str, dict[str, int]] = {}
    for r in best.collect():
        out.setdefault(r["lang"], {})[r["g"]] = r["rank"]
    return out


class Ranker:
    """Predicts one text after another; remembers the numbered n-grams of words (all is forgotten at ``REMEMBERED`` bytes or ``KNOWN`` n-grams)."""

    def __init__(self, table: dict[str, dict[str, int]], size: int = PROFILE):
        self.langs, self.size = sorted(table), size
        self.table, self.numbers, self.words, self.held = table, {}, {}, 0
        self.ranks = np.full((len(self.langs), KNOWN), -1, np.int32)
        self.marks = np.zeros(KNOWN, np.int64)

    def number(self, g: str) -> int:
        no = self.numbers.setdefault(g, len(self.numbers))
        self.marks[no] = zlib.crc32(g.encode())
        for i, lang in enumerate(self.langs):
            self.ranks[i, no] = self.table[lang].get(g, -1)
        return no

    def numbered(self, word: str) -> bytes:
        """The numbers of a word's n-grams, 32 bits each."""
        known, found = self.numbers, grams(word)
        out = array("i", [known[g] if g in known else self.number(g) for g in found]).tobytes()
        if len(word) <= 64:
            self.words[word] = out
            self.held += len(out) + len(word) + 200  # with the two objects and the entry
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / largest possible distance."""
        counts = letter_words(text or "")
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        most = LONGEST * (sum(map(len, counts)) + 2 * len(counts))
        if self.held >= REMEMBERED or len(self.numbers) + most >= KNOWN:
            self.words.clear()
            self.numbers.clear()
            self.held = 0
        if most >= KNOWN:
            return slow_predict(text, self.table, self.size)
        get = self.words.get
        parts = [get(w) or self.numbered(w) for w in counts]
        weight = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), [len(x) // 4 for x in parts])
        total = np.bincount(np.frombuffer(b"".join(parts), np.int32), weight)
        seen = np.flatnonzero(total)
        order = (total[seen].astype(np.int64) << 32) - self.marks[seen]  # larger counts first, then smaller marks
        if len(seen) > self.size:
            top = np.argpartition(-order, self.size)[: self.size]
            seen, order = seen[top], order[top]
        own = seen[np.argsort(-order)]
        ranks = self.ranks[:, own]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(1)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - int(far[best]) / (self.size * len(own))


def slow_predict(text: str, table: dict[str, dict[str, int]], size: int) -> tuple[str, float]:
    """The same for a text with more different words than a ``Ranker`` remembers."""
    counts = gram_counts(text)
    own = sorted(counts, key=lambda g: (-counts[g], zlib.crc32(g.encode())))[:size]
    far, best = min((sum(abs(i - ranks[g]) if g in ranks else size for i, g in enumerate(own)), lang) for lang, ranks in sorted(table.items()))
    return best, 1.0 - far / (size * len(own))


def identified(docs: DataFrame, table: dict[str, dict[str, int]], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) as column ``row`` with ``lang_pred`` and ``score``; a text that is kept is sent to Python once."""
    columns = docs.columns if keep is None else keep
    own = dict(docs.dtypes)[text_col] == "string" and text_col in columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(table)
        for batch in batches:
            row = batch.column("row")
            read = row.field(columns.index(text_col)) if own else batch.column("t")
            got = [ranker.predict(x.as_py()) for x in read]
            yield pa.RecordBatch.from_arrays([row, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["row", "lang_pred", "score"])
            del batch, row, read, got
        pa.default_memory_pool().release_unused()  # the worker lives on

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), *([] if own else [F.col(text_col).cast("string").alias("t")]))
    return packed.mapInArrow(score, packed.select("row").schema.add("lang_pred", "string").add("score", "double"))


def report(docs: DataFrame) -> DataFrame:
    table = profiles(docs.select("doc_id", "lang", "text"))
    done = identified(docs.select("doc_id", "text"), table, keep=["doc_id"])
    own = F.col("row.doc_id").cast("long")
    return done.select(own.alias("doc_id"), (third(own) == 1).alias("held_out"), "lang_pred", "score")
