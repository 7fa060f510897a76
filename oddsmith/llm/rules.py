"""Quality statistics and a learned decision list over them (operator 3, DataFrame functions only).

``statistics`` computes whole-text counts inside each row.  ``learn`` runs sequential
covering on labelled statistics: a rule grows one threshold at a time by information gain on
two thirds of the labelled rows, loses trailing conditions that do not pay on the other
third, and is kept if it is precise enough there; covered rows then leave.  Each step is one
aggregation to a histogram of bins; only histograms reach the driver.  The list is applied
as one ordered conditional expression.

Fitting reads at most about ``MAX_LABELS`` labelled rows (a hash of the id decides), all of
them below that; statistics and verdicts cover every row.

Cases: null text has no words and fails the base rule; without labels, or with labels of one
kind only, no rule is learned and the verdict is "keep"; of several labels of one id the
smallest counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import store, words

MAX_LABELS, BINS, MAX_RULES, MAX_TERMS, MIN_COVER, MIN_PRECISION = 200_000, 64, 10, 3, 3, 0.85
GRAM = 5


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts.

    Repeated five-word windows are first looked for by hash; only texts that seem to have
    some compare the windows themselves.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("long")
    df = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).select("id", "t", words(F.col("t")).alias("w"))
    hashes = F.transform("w", lambda x, i: F.xxhash64(x, *[F.get("w", i + j) for j in range(1, GRAM)]))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    df = df.select(
        "id", "w", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        kept("[^#*$%&|<>]+").alias("n_symbols"), kept("[^\\p{Lu}]+").alias("n_upper"), kept("[^!-/:-@\\[-`{-~]+").alias("n_marks"), lines.alias("lines"),
        F.when(F.size("w") >= GRAM, F.slice(hashes, 1, F.greatest(F.size("w") - (GRAM - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    seems = F.size(F.array_distinct("g")) < F.size("g")
    df = df.select("id", "n_words", "word_chars", "n_symbols", "n_upper", "n_marks", F.size("lines").cast("long").alias("n_lines"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                   F.size(F.array_distinct("w")).cast("long").alias("n_different"), F.when(seems, F.col("w")).alias("w"))
    grams = F.transform("w", lambda x, i: F.struct(F.concat_ws(" ", x, *[F.get("w", i + j) for j in range(1, GRAM)]).alias("g"), i.alias("i")))
    df = df.withColumn("s", F.when(F.col("w").isNotNull(), F.array_sort(F.slice(grams, 1, F.greatest(F.size("w") - (GRAM - 1), F.lit(0)))))).drop("w")
    same = lambda x, j: F.coalesce(F.get("s", j)["g"] == x["g"], F.lit(False))
    df = df.withColumn("p", F.array_sort(F.transform(F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))).drop("s")
    cover = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(GRAM), F.coalesce(F.get("p", i + 1) - x, F.lit(GRAM)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).drop("p")


def features() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": share("word_chars", "n_words"), "symbols": share("n_symbols", "word_chars"), "upper": share("n_upper", "word_chars"),
        "marks": share("n_marks", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "different": share("n_different", "n_words"),
    }


@dataclass(frozen=True)
class Term:
    """``feature <= limit`` or ``feature > limit``; ``bin`` is the limit's place among the feature's bins."""

    feature: str
    above: bool
    bin: int
    limit: float

    def holds(self) -> Column:
        x = features()[self.feature]
        return x > self.limit if self.above else x <= self.limit

    def holds_bin(self, at: int) -> Column:
        x = F.col("bins")[at]
        return x > self.bin if self.above else x <= self.bin


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def learn(stats: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> list[list[Term]]:
    """Ordered rules whose rows look like label 0; ``labels`` has ``id``, ``quality``."""
    wanted = labels.filter("id IS NOT NULL AND quality IS NOT NULL").groupBy("id").agg(F.min("quality").alias("quality"))
    n = wanted.count()
    if n > max_labels:
        wanted = wanted.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(max_labels / n * (1 << 20)))
    names = list(features())
    rows = stats.join(wanted, "id").select("id", (F.col("quality") == 0).cast("int").alias("bad"), *[x.alias(c) for c, x in features().items()])
    rows = store(rows, "labelled")
    cuts = [i / BINS for i in range(1, BINS)]
    limits = rows.agg(*[F.percentile_approx(c, cuts, 10_000).alias(c) for c in names]).first()
    if limits[0] is None:
        return []
    limits = {c: sorted(set(limits[c])) for c in names}
    bins = F.array(*[reduce(lambda a, t: a + t, [(F.col(c) > x).cast("int") for x in limits[c]], F.lit(0)) for c in names])
    rows = store(rows.select("bad", (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(3)) > 0).alias("grow"), bins.alias("bins")).coalesce(4), "binned")
    rules: list[list[Term]] = []
    for _ in range(MAX_RULES):
        left = rows
        for rule in rules:
            left = left.filter(~every([t.holds_bin(names.index(t.feature)) for t in rule]))
        rule = grow(left.filter("grow"), names, limits)
        rule = prune(left.filter("NOT grow"), rule, names) if rule else None
        if not rule:
            break
        rules.append(rule)
    return rules


def grow(rows: DataFrame, names: list[str], limits: dict[str, list[float]]) -> list[Term]:
    rule: list[Term] = []
    for _ in range(MAX_TERMS):
        now = rows.filter(every([t.holds_bin(names.index(t.feature)) for t in rule]))
        seen = now.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n")).collect()
        p_all, n_all = (sum(r[k] for r in seen if r["f"] == 0) for k in ("p", "n"))
        if not p_all or p_all == n_all:
            break
        best = (0.0, None)
        for f, name in enumerate(names):
            hist = {r["b"]: (r["p"], r["n"]) for r in seen if r["f"] == f}
            p = n = 0
            for b, limit in enumerate(limits[name]):
                p, n = p + hist.get(b, (0, 0))[0], n + hist.get(b, (0, 0))[1]
                for above, (q, m) in ((False, (p, n)), (True, (p_all - p, n_all - n))):
                    if q >= MIN_COVER:
                        gain = q * (log2(q / m) - log2(p_all / n_all))
                        if gain > best[0] + 1e-9:
                            best = (gain, Term(name, above, b, limit))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def prune(rows: DataFrame, rule: list[Term], names: list[str]) -> list[Term] | None:
    """The prefix of the rule that is best on unseen rows, if it is precise enough there."""
    prefixes = [every([t.holds_bin(names.index(t.feature)) for t in rule[: i + 1]]) for i in range(len(rule))]
    got = rows.agg(*[F.sum(F.when(c, F.col("bad"))) for c in prefixes], *[F.sum(F.when(c, 1)) for c in prefixes]).first()
    worth = [((2 * (p or 0) - n) / n if n else -1.0, -i, i) for i, (p, n) in enumerate(zip(got[: len(rule)], got[len(rule) :]))]
    value, _, i = max(worth)
    return rule[: i + 1] if (value + 1) / 2 >= MIN_PRECISION else None


def verdict(rules: list[list[Term]]) -> Column:
    """The number of the first rule that holds (null: none), as one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules):
        holds = every([t.holds() for t in rule])
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(None).cast("int") if out is None else out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every document, the base rule, and the decision list's verdict on the rest."""
    stats = store(statistics(docs), "statistics")
    rules = learn(stats, labels.select(F.col("doc_id").cast("long").alias("id"), "quality"))
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
