"""Personal data by weak supervision (operator 2, DataFrame functions only).

Candidates are the matches of four base kinds and of looser kinds.  Four labelers vote on
each (-1, 0, 1): a validator, a gazetteer, the context before the span, and its shape.
Expectation-maximisation over the counted vote patterns estimates how reliable each labeler
is and how likely each pattern is personal; with these soft labels a naive Bayes span
classifier is fitted on features of kind, length, digits and surroundings.  It decides which
loose candidates are added.  Base spans that pass their own checks always stay.

Only counts of vote patterns and feature values reach the driver; both are bounded by the
number of kinds, votes and feature buckets.  A text's spans are placed inside its row.

Patterns start at the first character of a run only and never give back what they took, so
that long runs cost time in proportion; the matches are those of the plain patterns.

Cases: null text is empty; added spans that overlap a base span or an earlier added one go.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmith.llm.common import store

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "national_id", "iban", "local_phone", "name")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "name": r"(?<!\p{L})\p{Lu}\p{Ll}{1,20} \p{Lu}\p{Ll}{1,20}(?!\p{L})",
}
#: What a text must contain before a pattern is tried at all.
NEEDS = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": "[0-9]", "national_id": "[0-9]-[0-9]", "iban": "[A-Z][0-9]", "local_phone": "[0-9]", "name": r"\p{Ll} \p{Lu}"}

FIRST_NAMES = (
    "Adam Alice Andrew Anna Anne Anthony Barbara Brian Carlos Carol Charles Christine Daniel David Deborah Diana Edward Elena Elizabeth Emily Emma Eric Frank "
    "George Hans Helen Henry James Jane Jean Jennifer Jessica John Jorge José Juan Julia Karen Karl Kevin Klaus Laura Linda Lisa Luis Manuel Margaret Maria María "
    "Mark Martin Mary Michael Michel Nancy Oliver Patricia Paul Peter Philippe Pierre Richard Robert Sandra Sarah Sophie Stefan Stephen Susan Thomas Wolfgang William"
).split()
DOMAINS = "com org net edu gov io co uk de fr es it nl eu ch at info".split()
CALLING_CODES = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92".split()
IBAN_LANDS = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
SECRET_HEADS = "sk pk ghp gho AKIA ASIA xoxb xoxp eyJ".split()
CUES = {
    "email": "mail|contact|write|reach", "ip": r"\bip\b|host|server|address", "card": "card|visa|credit|payment|carte|karte|tarjeta", "phone": "phone|tel|call|fax|mobile|cell",
    "secret": "token|secret|passw|api|key|auth|credential", "national_id": r"ssn|social|security|\bid\b", "iban": "iban|account|bank|konto|compte|cuenta",
    "local_phone": "phone|tel|call|fax|mobile|cell", "name": r"\b(mr|mrs|ms|dr|herr|frau|monsieur|madame|señor|señora|name|by)\b",
}
BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
FEATURES = ("kind", "size", "digits", "cue", "opens")
VOTES = ("valid", "listed", "context", "shape")


def passes(kind: str, s: Column) -> Column:
    """The base kinds' own checks."""
    digits = F.regexp_replace(s, "[^0-9]+", "")
    return {"ip": lambda: s.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"), "card": lambda: F.call_function("luhn_check", digits), "phone": lambda: F.length(digits).between(9, 15)}.get(kind, lambda: F.lit(True))()


def vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def votes(kind: str, s: Column, before: Column, after: Column) -> list[Column]:
    one_of = lambda words: "(?:" + "|".join(words) + ")"
    ok = passes(kind, s)
    valid = {
        "secret": lambda: vote(s.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), s.rlike("^[0-9_-]+$")),
        "national_id": lambda: vote(~s.rlike("^(?:000|666|9)|-00-|-0000$"), s.rlike("^(?:000|666|9)|-00-|-0000$")),
        "local_phone": lambda: vote(s.rlike(r"^\(?[2-9]"), s.rlike(r"^\(?[01]")),
        "name": lambda: F.lit(0), "iban": lambda: vote(F.length(F.regexp_replace(s, " ", "")).between(15, 34)),
    }.get(kind, lambda: vote(ok, ~ok))()
    listed = {
        "email": lambda: vote(s.rlike(rf"\.{one_of(DOMAINS)}$")), "ip": lambda: vote(s.rlike("^(?:10|127|192|172)\\."), s.rlike("^0")), "card": lambda: vote(s.rlike("^[3-6]")),
        "phone": lambda: vote(s.rlike(rf"^\+{one_of(CALLING_CODES)}(?![0-9]{{4,}})"), s.rlike(r"^\+0")), "secret": lambda: vote(s.rlike(f"^{one_of(SECRET_HEADS)}[_-]?")),
        "iban": lambda: vote(s.rlike(f"^{one_of(IBAN_LANDS)}"), ~s.rlike(f"^{one_of(IBAN_LANDS)}")), "name": lambda: vote(s.rlike(f"^{one_of(FIRST_NAMES)} "), ~s.rlike(f"^{one_of(FIRST_NAMES)} ")),
    }.get(kind, lambda: F.lit(0))()
    shape = vote(F.lit(False), s.rlike(r"([0-9])(?:[ .-]?\1){6}|1234567") | after.rlike(r"^[\p{L}0-9]"))
    return [x.cast("int") for x in (valid, listed, vote(F.lower(before).rlike(CUES[kind])), shape)]


def located(df: DataFrame) -> DataFrame:
    """Adds ``found``: every match of ``t`` with kind, place, votes and features, kind after kind."""
    tried = df.select("*", *[F.when(F.col("t").rlike(NEEDS[k]), F.regexp_extract_all("t", F.lit(PATTERNS[k]), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"m_{k}") for k in KINDS])
    cut = tried.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("t", PATTERNS[k], -1)).alias(f"g_{k}") for k in KINDS])
    # each match with the gap before it; then places by a running total inside the row
    start = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def starts(k: str) -> Column:
        steps = F.transform(f"m_{k}", lambda s, i: F.struct(F.length(F.get(f"g_{k}", i)).alias("gap"), F.length(s).alias("len")))
        return F.aggregate(steps, start(), lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts")), lambda a: a["starts"])

    placed = cut.select("*", *[F.when(F.size(f"m_{k}") > 0, starts(k)).alias(f"s_{k}") for k in KINDS])

    def spans(no: int, k: str) -> Column:
        def one(s: Column, i: Column) -> Column:
            before, after, begin = F.right(F.get(f"g_{k}", i), F.lit(24)), F.left(F.get(f"g_{k}", i + 1), F.lit(1)), F.get(f"s_{k}", i)
            digits = F.length(F.regexp_replace(s, "[^0-9]+", ""))
            v = votes(k, s, before, after)
            return F.struct(
                begin.alias("start"), (begin + F.length(s)).alias("end"), F.lit(no).alias("kind"), (passes(k, s) if k in BASE else F.lit(False)).alias("base"),
                *[x.alias(n) for x, n in zip(v, VOTES)],
                F.least(F.floor(F.log2(F.length(s))).cast("int"), F.lit(7)).alias("size"), F.floor(4 * digits / F.length(s)).cast("int").alias("digits"), v[2].alias("cue"), before.rlike("[\"'=:(\\[<]\\s?$").cast("int").alias("opens"))

        return F.coalesce(F.transform(f"m_{k}", one), F.array())

    out = placed.withColumn("found", F.concat(*[spans(no, k) for no, k in enumerate(KINDS)]))
    return out.drop(*[f"{p}_{k}" for p in "mgs" for k in KINDS])


@dataclass
class Model:
    """``reliability[labeler][vote]``: (if not personal, if personal); ``weights[feature][value]``: log odds; ``prior``: log odds."""

    reliability: dict[str, dict[int, tuple[float, float]]] = field(default_factory=dict)
    weights: dict[str, dict[int, float]] = field(default_factory=dict)
    prior: float = -1.0

    def odds(self, c: Column) -> Column:
        def term(name: str) -> Column:
            table = sorted(self.weights.get(name, {}).items())
            return reduce(lambda out, kv: out.when(c[name] == kv[0], kv[1]), table[1:], F.when(c[name] == table[0][0], table[0][1])).otherwise(0.0) if table else F.lit(0.0)

        return reduce(lambda a, b: a + b, [term(n) for n in FEATURES], F.lit(self.prior))


def fit(found: DataFrame, rounds: int = 40) -> Model:
    """EM over vote patterns, then naive Bayes on the soft labels, from ``found`` arrays."""
    c = found.select(F.explode("found").alias("c"))
    cells = c.groupBy(*[F.col(f"c.{n}").alias(n) for n in (*VOTES, *FEATURES)]).agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the buckets
    if not cells:
        return Model()
    patterns: dict[tuple, int] = {}
    for r in cells:
        key = (r["kind"], *[r[v] for v in VOTES])
        patterns[key] = patterns.get(key, 0) + r["n"]
    belief = {k: 0.95 if sum(k[1:]) > 0 else 0.05 if sum(k[1:]) < 0 else 0.3 for k in patterns}
    for _ in range(rounds):
        share, seen = {}, {}
        for i, name in enumerate(VOTES):
            table = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for k, n in patterns.items():
                table[k[1 + i]][0] += n * (1 - belief[k])
                table[k[1 + i]][1] += n * belief[k]
            totals = [sum(t[y] for t in table.values()) for y in (0, 1)]
            seen[name] = {v: (t[0] / totals[0], t[1] / totals[1]) for v, t in table.items()}
        for kind in {k[0] for k in patterns}:
            rows = [(n, belief[k]) for k, n in patterns.items() if k[0] == kind]
            share[kind] = (1 + sum(n * b for n, b in rows)) / (2 + sum(n for n, _ in rows))
        for k in patterns:
            no, yes = 1 - share[k[0]], share[k[0]]
            for i, name in enumerate(VOTES):
                p = seen[name][k[1 + i]]
                no, yes = no * p[0], yes * p[1]
            belief[k] = yes / (no + yes)
    model, mass = Model(reliability=seen), [1.0, 1.0]
    counts: dict[str, dict[int, list[float]]] = {f: {} for f in FEATURES}
    for r in cells:
        b = belief[(r["kind"], *[r[v] for v in VOTES])]
        for y, w in ((0, r["n"] * (1 - b)), (1, r["n"] * b)):
            mass[y] += w
            for f in FEATURES:
                counts[f].setdefault(r[f], [0.5, 0.5])[y] += w
    model.prior = log(mass[1] / mass[0])
    model.weights = {f: {v: log(t[1] / (mass[1] + 0.5 * len(table)) * (mass[0] + 0.5 * len(table)) / t[0]) for v, t in table.items()} for f, table in counts.items()}
    return model


def decided(df: DataFrame, model: Model) -> DataFrame:
    """Replaces ``found`` by ``base`` and ``spans`` (base and added ones, by start, then kind)."""
    place = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("found", lambda c: c["base"]), place))
    added = F.array_sort(F.transform(F.filter("found", lambda c: (c["kind"] >= len(BASE)) & (model.odds(c) > 0)), place))
    df = df.withColumn("base", base).withColumn("added", added).drop("found")
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    df = df.withColumn("added", F.when(F.size("added") > 0, F.filter("added", lambda c: ~F.exists("base", lambda b: meets(b, c)))).otherwise(F.col("added")))
    apart = F.filter("added", lambda c, i: ~F.exists(F.slice("added", 1, i), lambda b: meets(b, c)))
    df = df.withColumn("added", F.when(F.size("added") > 1, apart).otherwise(F.col("added")))
    return df.withColumn("spans", F.when(F.size("added") > 0, F.array_sort(F.concat("base", "added"))).otherwise(F.col("base"))).drop("added")


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def with_text(docs: DataFrame, text_col: str) -> DataFrame:
    """The whole row as ``row`` and its text as ``t``, so that no input column can clash."""
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; rows without spans are unchanged."""
    model = fit(store(located(with_text(docs, text_col).select("t")).select("found"), "pii"))
    df = decided(located(with_text(docs, text_col)), model)
    # base spans of different kinds may overlap: what overlaps is masked once, under the first kind
    fresh = F.filter("spans", lambda c, i: ~F.exists(F.slice("spans", 1, i), lambda b: b["end"] > c["start"]))
    reach = F.transform("clear", lambda c, i: F.array_max(F.transform(F.filter("spans", lambda b: (b["start"] >= c["start"]) & (b["start"] < F.coalesce(F.get("clear", i + 1)["start"], F.lit(2147483647)))), lambda b: b["end"])))
    df = df.withColumn("clear", fresh).withColumn("reach", reach)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    parts = F.transform("clear", lambda c, i: F.concat(F.substring(F.col("t"), F.coalesce(F.get("reach", i - 1), F.lit(0)) + 1, c["start"] - F.coalesce(F.get("reach", i - 1), F.lit(0))), F.get(names, c["kind"])))
    tail = F.substring(F.col("t"), F.element_at("reach", -1) + 1, F.length("t"))
    text = F.when(F.size("clear") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col(f"row.{text_col}"))
    return df.withColumn("new", text).select(*[(F.col("new") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests per document; the spans themselves are in ``spans``."""
    found = store(located(with_text(docs, "text").select(F.col("row.doc_id").cast("long").alias("id"), "t")).select("id", "found"), "pii")
    df = decided(found, fit(found))
    count = lambda no: F.size(F.filter("base", lambda c: c["kind"] == no)).cast("long")
    return df.select(F.col("id").alias("doc_id"), *[count(no).alias(f"n_{k}") for no, k in enumerate(BASE)], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
