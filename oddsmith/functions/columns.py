"""Small Column builders used everywhere."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: str | Column, lo: float, hi: float) -> Column:
    """Bound a value; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def finite(c: str | Column) -> Column:
    """True only for a present, non-NaN, bounded double."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def lookup(mapping: Mapping[str, object], key: str | Column, default=None) -> Column:
    """CASE chain over a fixed driver-side mapping (no join, stays inside codegen)."""
    key = col(key)
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def round6(c: str | Column) -> Column:
    """Round to six decimals, nudged off exact ties so summation order cannot flip a digit."""
    return F.floor(col(c).cast("double") * 1000000 + F.lit(0.50001)) / F.lit(1000000)


def rounded(df: DataFrame) -> DataFrame:
    """Apply :func:`round6` to every double column of a result."""
    return df.select(
        *[
            round6(f"`{f.name}`").alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# --- paths and patterns ----------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """Shell glob as an anchored regex; ``*`` also crosses directory separators."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(ch))
    return "^(?s:" + "".join(out) + ")$"


def matches_glob(path: str | Column, pattern: str) -> Column:
    return col(path).rlike(glob_regex(pattern))


def matches_any_glob(path: str | Column, patterns: Iterable[str]) -> Column:
    return col(path).rlike("|".join(glob_regex(p) for p in patterns))


def glob_regex_column(pattern: str | Column) -> Column:
    """Column form of :func:`glob_regex` for patterns stored in a table."""
    pieces = F.regexp_extract_all(col(pattern), F.lit(r"\[!?\]?[^\]]*\]|[^\[]+|\["), F.lit(0))

    def one(piece: Column) -> Column:
        body = F.regexp_replace(F.substr(piece, F.lit(2), F.length(piece) - 2), r"([\\\[\]^&])", r"\\$1")
        chosen = F.when(F.startswith(body, F.lit("!")), F.concat(F.lit("[^"), F.substr(body, F.lit(2)), F.lit("]"))).otherwise(F.concat(F.lit("["), body, F.lit("]")))
        quoted = F.regexp_replace(piece, r"([.\\+^$(){}|\[\]])", r"\\$1")
        plain = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
        return F.when(F.startswith(piece, F.lit("[")) & F.endswith(piece, F.lit("]")) & (F.length(piece) > 2), chosen).otherwise(plain)

    return F.concat(F.lit("^(?s:"), F.array_join(F.transform(pieces, one), ""), F.lit(")$"))


def posix(path: str | Column) -> Column:
    return F.replace(col(path), F.lit("\\"), F.lit("/"))


def top_domain(path: str | Column) -> Column:
    """First path segment, or ``.`` for a file at the root."""
    p = F.regexp_replace(posix(path), "^/+|/+$", "")
    return F.when(F.contains(p, F.lit("/")), F.substring_index(p, "/", 1)).otherwise(F.lit("."))


def last_segment(qualified: str | Column, name: str | Column) -> Column:
    """Last identifier segment: split on ``::`` first, else on ``.``, else the name itself."""
    q = col(qualified)
    colon = F.substring_index(q, "::", -1)
    dot = F.substring_index(q, ".", -1)
    return (
        F.when(q.isNull() | (q == ""), F.coalesce(col(name), F.lit("")))
        .when(F.contains(q, F.lit("::")) & (colon != ""), colon)
        .when(F.contains(q, F.lit(".")) & (dot != ""), dot)
        .otherwise(q)
    )


# --- distributed positions and ranks ---------------------------------------------------------


#: Rows of one range, and the most ranges that are made.
RANGE_ROWS, MOST_RANGES = 50_000, 512


def _cuts(df: DataFrame, value: str, rows: int | None) -> list:
    """Split points of ``value`` for ranges of about ``rows`` rows: quantiles of all rows, found in one pass (a sketch; the driver gets at most ``MOST_RANGES``)."""
    wanted = [(i + 1) / MOST_RANGES for i in range(MOST_RANGES - 1)]
    found = df.agg(F.count(value).alias("n"), F.percentile_approx(value, wanted, 10_000).alias("q")).first()
    ranges = min(MOST_RANGES, -(-found["n"] // (rows or RANGE_ROWS)))
    exact = lambda q: Decimal(int(q)) if isinstance(q, Decimal) else q  # noqa: E731  (a sketched decimal comes with an exponent, which no literal may have)
    return sorted({exact(found["q"][i * MOST_RANGES // ranges - 1]) for i in range(1, ranges)}) if ranges > 1 else []


def _further(cuts: Column, many: int, value: str, at: Column, step: Column) -> Column:
    """One step of halving: on by ``step`` if that split point is still below the value."""
    return F.when((at + step <= many) & (F.get(cuts, at + step - 1) < F.col(value)), at + step).otherwise(at)


def equi_depth(df: DataFrame, value: str, rows: int | None = None) -> Column:
    """Number, in order, of the range that ``value`` falls in; ranges hold about ``rows`` rows each whatever the values' spread.

    That is the number of split points below the value.  Equal values share a range.
    """
    cuts = _cuts(df, value, rows)
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: _further(F.array(*[F.lit(c) for c in cuts]), len(cuts), value, at, step))


def with_ranges(df: DataFrame, value: str, name: str, rows: int | None = None) -> DataFrame:
    """``df`` with :func:`equi_depth` of ``value`` as column ``name``.

    The halving is one projection a step over an array of split points, which compiles to a few comparisons a row.  As one nested
    CASE of hundreds of branches it is a method too long for the JVM to compile, and runs interpreted.
    """
    cuts = _cuts(df, value, rows)
    points = F.array(*[F.lit(c) for c in cuts])
    df = df.withColumn(name, F.lit(0))
    for i in reversed(range(len(cuts).bit_length())):
        df = df.withColumn(name, _further(points, len(cuts), value, F.col(name), F.lit(1 << i)))
    return df


def running_positions(df: DataFrame, group: list[str], order: str, name: str = "position") -> DataFrame:
    """1-based row position inside each group without one task per group.

    ``order`` is a ledger id, unique inside a group.  Rows are numbered inside (group, range of ids) and
    shifted by the row counts of the earlier ranges, so a group holding most rows is spread over all ranges.
    """
    from pyspark.sql import Window as W

    tagged = with_ranges(df, order, "_bucket")
    sizes = tagged.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(*group, "_bucket").orderBy(order)
    return (
        tagged.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [*group, "_bucket"])
        .withColumn(name, F.col("_row") + F.col("_offset"))
        .drop("_bucket", "_row", "_offset")
    )


def rank_table(counts: DataFrame, value: str) -> DataFrame:
    """(value, fraction): share of the population at or below each distinct count.

    The population is first folded to one row per distinct count, so the ordered running
    sum sees a few thousand rows whatever the population size.
    """
    from pyspark.sql import Window as W

    hist = counts.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    upto = W.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.orderBy(value).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return hist.select(
        F.col(value), (F.sum("_n").over(upto) / F.sum("_n").over(whole)).alias("fraction")
    )


def fractional_rank(counts: DataFrame, value: str, out: str = "percentile") -> DataFrame:
    """Rank every row of a population inside that same population."""
    table = rank_table(counts.select(value), value).withColumnRenamed("fraction", out)
    return counts.join(table, value, "left")


def rank_values(values: DataFrame, population: DataFrame, value: str, out: str) -> DataFrame:
    """Rank ``values`` in another population; values outside it take the last step below.

    Both sides are folded to distinct counts first; the step function is filled forward
    over their union, so no range join is needed.
    """
    from pyspark.sql import Window as W

    table = rank_table(population.select(value), value)
    asked = values.select(value).distinct()
    upto = W.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = (
        table.join(asked, value, "full_outer")
        .select(
            value,
            F.coalesce(F.last("fraction", ignorenulls=True).over(upto), F.lit(0.0)).alias(out),
        )
    )
    return values.join(filled, value, "left")


# --- ordered neighbours without one task per group -------------------------------------------


def previous_row(df: DataFrame, group: list[str], order: str, cols: list[str]) -> DataFrame:
    """Adds ``prev``, a struct of ``cols`` of the row before in the group (NULL for the first).

    ``lag`` runs inside (group, range of ids); the first row of a range takes the last row of
    the nearest earlier range from a small table.
    """
    from pyspark.sql import Window as W

    tagged = with_ranges(df, order, "_bucket")
    item = F.struct(*cols)
    ends = tagged.groupBy(*group, "_bucket").agg(F.max_by(item, order).alias("_end"))
    carry = W.partitionBy(*group).orderBy("_bucket")
    ends = ends.select(*group, "_bucket", F.lag("_end").over(carry).alias("_carry"))
    inside = W.partitionBy(*group, "_bucket").orderBy(order)
    return (
        tagged.withColumn("_prev", F.lag(item).over(inside)).join(ends, [*group, "_bucket"])
        .withColumn("prev", F.coalesce("_prev", "_carry")).drop("_prev", "_carry", "_bucket")
    )


def running_sum(df: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """Running sum in ``order`` inside each group, spread over ranges of ids."""
    from pyspark.sql import Window as W

    tagged = with_ranges(df, order, "_bucket")
    sums = tagged.groupBy(*group, "_bucket").agg(F.sum(value).alias("_v"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*group, "_bucket", F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        tagged.withColumn("_run", F.sum(value).over(inside)).join(sums, [*group, "_bucket"])
        .withColumn(out, F.col("_run") + F.col("_off")).drop("_run", "_off", "_bucket")
    )
