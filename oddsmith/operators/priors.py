"""Learned and shipped priors: usability, matching, decay, pooling and application.

Scope matching is an equi-join on (target, scope kind, scope value): a row lists the scopes
it satisfies and meets the facts of exactly those.  No fact table is broadcast by hint;
adaptive execution broadcasts it at run time if its measured size allows, and otherwise
splits the skewed ``global`` key of the shuffled join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmith import constants as K
from oddsmith.functions.columns import clamp, col, finite, glob_regex_column, lookup
from oddsmith.operators.promotion import FEATURES, explode_scopes, scope_features, teaches
from oddsmith.session import written

FACT_JSON = T.StructType([
    T.StructField("value", T.DoubleType()), T.StructField("sample_size", T.IntegerType()),
    T.StructField("calibration_method", T.StringType()), T.StructField("weight", T.DoubleType()),
    T.StructField("calibration_quality", T.DoubleType()), T.StructField("scope_change_count", T.IntegerType()),
    T.StructField("variance", T.DoubleType()), T.StructField("aleatoric_variance", T.DoubleType()),
])


def decode_facts(rows: DataFrame) -> DataFrame:
    """Typed fact columns from the stored JSON; unreadable JSON leaves them NULL."""
    f = F.from_json("fact_json", FACT_JSON, {"mode": "PERMISSIVE"})
    out = rows.withColumn("_f", f)
    default = {"weight": 1.0, "calibration_quality": 1.0, "scope_change_count": 0, "sample_size": 0}
    return out.select(*rows.columns, *[
        F.coalesce(F.col(f"_f.{n.name}"), F.lit(default.get(n.name)).cast(n.dataType)).alias(n.name) for n in FACT_JSON
    ])


def usable(min_samples: int = K.MIN_CALIBRATION_SAMPLES) -> Column:
    """Read-side gate: enough samples, a method, finite and non-negative reliability inputs."""
    good = lambda c: finite(c) & (F.col(c) >= 0)
    opt = lambda c: F.col(c).isNull() | good(c)
    return F.coalesce(
        (F.col("sample_size") >= min_samples) & (F.trim("calibration_method") != "") & finite("value")
        & good("weight") & good("calibration_quality") & (F.col("scope_change_count") >= 0)
        & opt("variance") & opt("aleatoric_variance"),
        F.lit(False),
    )


def applicable() -> Column:
    """Apply-side gate: known target, ratified, sampled, finite."""
    opt = lambda c: F.col(c).isNull() | (finite(c) & (F.col(c) >= 0))
    return F.coalesce(
        F.col("target_type").isin(*K.TARGET_TYPES) & ~F.col("requires_ratification") & (F.col("sample_size") > 0)
        & (F.col("calibration_method") != "") & finite("value") & opt("variance") & opt("aleatoric_variance"),
        F.lit(False),
    )


def effective_weight(strength: float = K.DECAY_STRENGTH) -> Column:
    """Weight times quality, fading with the number of later changes in the fact's scope."""
    base = F.col("weight") * F.col("calibration_quality")
    ok = (F.col("weight") >= 0) & (F.col("calibration_quality") >= 0) & (F.col("scope_change_count") >= 0)
    return F.when(ok, base * F.exp(-F.col("scope_change_count") / strength))


def auto_applies() -> Column:
    return F.coalesce(effective_weight() >= K.MIN_EFFECTIVE_WEIGHT, F.lit(False))


FAMILY = {"risk_binary": "risk", "benefit_binary": "benefit", "benefit_continuous": "benefit", "cost_continuous": "cost"}


def active_facts(facts: DataFrame) -> DataFrame:
    """Per repository and family, the usable facts of the newest snapshot that has any.

    The newest id is an aggregate joined back, so a repository holding most facts is never
    sorted in one task.
    """
    ok = facts.filter(usable()).withColumn("family", lookup(FAMILY, "target_type"))
    newest = ok.groupBy("repo_id", "family").agg(F.max("snapshot_id").alias("snapshot_id"))
    return ok.join(newest, ["repo_id", "family", "snapshot_id"], "left_semi")


# --- matching --------------------------------------------------------------------------------------------


def _dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


GRAM = 3  #: characters of a literal key


def _grams(text: Column, n: Column) -> Column:
    """The different pieces of ``n`` characters of a text; none if it is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, n)))


def _literals(pattern: str) -> Column:
    """The parts of a pattern that stand for themselves."""
    return F.split(pattern, r"\[!?\]?[^\]]*\]|[*?]")


def pattern_pairs(paths: DataFrame, patterns: DataFrame, hot: int = 10_000) -> DataFrame:
    """(file_path, scope_value) of every distinct path that a distinct pattern may match, by equal keys; still to be checked.

    A pattern with a literal folder meets the paths in that folder.  Any other is keyed by the
    rarest of its literal pieces of ``GRAM`` characters (of its longest literal, if that is shorter) and meets only paths that hold it; without
    a literal it meets all.  Paths of a key that over ``hot`` paths hold are dealt over several tasks.
    """
    folder = F.regexp_extract(F.regexp_extract("scope_value", r"^([^*?\[]*)", 1), r"^(.*)/[^/]*$", 1)
    keyed = patterns.select("scope_value", folder.alias("_dir"))
    anchored = paths.withColumn("_dir", F.explode(_dirs(F.col("file_path")))).join(keyed.filter("_dir <> ''"), "_dir").select("file_path", "scope_value")

    floating = keyed.filter("_dir = ''").select("scope_value", _literals("scope_value").alias("_runs"))
    n = F.least(F.lit(GRAM), F.array_max(F.transform("_runs", lambda r: F.length(r))))
    wanted = floating.withColumn("_n", n).select("scope_value", F.explode(F.when(F.col("_n") > 0, F.flatten(F.transform("_runs", lambda r: _grams(r, F.col("_n"))))).otherwise(F.array(F.lit("")))).alias("_gram")).distinct()
    own = F.concat(F.array(F.lit("")), *[_grams(F.col("file_path"), F.lit(k)) for k in range(1, GRAM + 1)])
    held = paths.withColumn("_gram", F.explode(own)).join(wanted.select("_gram").distinct(), "_gram", "left_semi")
    often = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_often"))
    rarest = wanted.join(often, "_gram", "left").groupBy("scope_value").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("_often"), F.col("_gram").alias("_gram"))).alias("k"))
    rarest = rarest.select("scope_value", "k.*").filter("_often > 0").withColumn("_tasks", F.ceil(F.col("_often") / hot).cast("int"))
    tasks = rarest.groupBy("_gram").agg(F.max("_tasks").alias("_tasks"))
    dealt = held.join(tasks, "_gram").withColumn("_task", F.pmod(F.xxhash64("file_path"), F.col("_tasks")).cast("int")).select("file_path", "_gram", "_task")
    met = dealt.join(rarest.withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1))), ["_gram", "_task"])
    return anchored.unionByName(met.select("file_path", "scope_value"))


def glob_pairs(rows: DataFrame, globs: DataFrame) -> DataFrame:
    """(file_path, scope_value) of every distinct path of ``rows`` that a distinct pattern matches."""
    pairs = pattern_pairs(rows.select("file_path").filter("file_path IS NOT NULL").distinct(), globs.select("scope_value").distinct())
    return pairs.filter(F.regexp_like("file_path", glob_regex_column("scope_value")))


def match_globs(targets: DataFrame, facts: DataFrame) -> DataFrame:
    """Path-glob facts of each target: distinct paths meet distinct patterns by literal keys, and each pair is checked once."""
    globs = facts.filter("scope_kind = 'path_glob'")
    pairs = glob_pairs(targets, globs)
    placed = targets.select("action_id", "target_name", "file_path").join(pairs, "file_path")
    return placed.join(globs, ["target_name", "scope_value"]).drop("file_path")


def match_facts(targets: DataFrame, features: DataFrame, facts: DataFrame) -> DataFrame:
    """(action, target) × every fact whose scope the action's features satisfy.

    ``targets(action_id, target_name, …)``; columns of the fact come along.
    """
    keyed = targets.select("action_id", "target_name").join(features, "action_id")
    scopes = explode_scopes(keyed.withColumn("target_type", F.lit(None).cast("string")), "action_id").drop("target_type")
    equi = scopes.join(facts, ["target_name", "scope_kind", "scope_value"])
    globbed = match_globs(keyed, facts)
    return equi.unionByName(globbed)


def churn_counts(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Later verified completed changes in each fact's scope.

    Changes are first counted per (scope, time), so a fact joins times instead of rows and
    the ``global`` scope costs one row per distinct time.
    """
    done = changes.filter("verified").withColumns({"target_type": F.lit(None).cast("string"), "target_name": F.lit(None).cast("string")})
    hist = explode_scopes(done, "action_id", "recorded_at").groupBy("scope_kind", "scope_value", "recorded_at").agg(
        F.count(F.lit(1)).alias("c"))
    later = facts.select("fact_id", "scope_kind", "scope_value", "created_at").join(hist, ["scope_kind", "scope_value"]).filter(
        F.col("recorded_at") > F.col("created_at")).groupBy("fact_id").agg(F.sum("c").alias("scope_change_count"))
    paths = done.select("action_id", F.lit("").alias("target_name"), "file_path", "recorded_at")
    globs = facts.filter("scope_kind = 'path_glob'").select("fact_id", "scope_kind", "scope_value", "created_at", F.lit("").alias("target_name"))
    aged = match_globs(paths, globs).select("fact_id", "created_at", "action_id").distinct().join(paths.select("action_id", "recorded_at"), "action_id")
    aged = aged.filter(F.col("recorded_at") > F.col("created_at")).groupBy("fact_id").agg(F.count(F.lit(1)).alias("scope_change_count"))
    return facts.select("fact_id").join(later.unionByName(aged), "fact_id", "left").select(
        "fact_id", F.coalesce("scope_change_count", F.lit(0)).alias("scope_change_count"))


# --- resolution ---------------------------------------------------------------------------------------------


def _order(*extra: str) -> Column:
    return F.struct(*[F.col(c) for c in (*extra, "specificity_rank", "sample_size", "created_at", "fact_id")])


def eligible(facts: DataFrame) -> DataFrame:
    return facts.filter(applicable() & auto_applies())


def winners(matched: DataFrame) -> DataFrame:
    """Most specific fact per (action, target); an event target takes the highest value instead."""
    event = F.startswith("target_name", F.lit("p_event."))
    item = F.struct("fact_id", "value", "variance", "aleatoric_variance")
    # two running maxima per group: a plain partial aggregate, no sort
    return (
        matched.groupBy("action_id", "target_name")
        .agg(F.max_by(item, _order()).alias("specific"), F.max_by(item, _order("value")).alias("highest"), F.count(F.lit(1)).alias("candidates"))
        .withColumn("w", F.when(event, F.col("highest")).otherwise(F.col("specific")))
        .select("action_id", "target_name", "candidates", "w.*")
    )


def _best(matched: DataFrame, key: str) -> DataFrame:
    """The winning fact per (key, target) as one struct, the greater the better."""
    event = F.startswith("target_name", F.lit("p_event."))
    names = ("specificity_rank", "sample_size", "created_at", "fact_id", "value", "variance", "aleatoric_variance")
    return matched.groupBy(key, "target_name").agg(F.max(F.struct(F.when(event, F.col("value")).alias("first"), *names)).alias("w"))


def resolved(targets: DataFrame, features: DataFrame, facts: DataFrame) -> DataFrame:
    """``targets`` with the fact that :func:`winners` finds for them (NULL without one): ``fact_id, value, variance, aleatoric_variance``.

    ``features`` holds one row per action.  Actions with equal features satisfy equal scopes, so each set of features and each path
    is resolved once; an action looks both up by key, and no row is multiplied by its scopes or facts.
    """
    facts = written(facts)
    by = [*FEATURES[2:], "_teaches"]
    known = scope_features(features.withColumn("_teaches", teaches(features)))
    sets = written(known.select(*by).distinct().withColumn("_set", F.monotonically_increasing_id()))
    unnamed = {c: F.lit(None).cast("string") for c in ("target_type", "target_name")}
    scopes = explode_scopes(sets.filter("_teaches").withColumns(unnamed), "_set").drop(*unnamed)
    of_set = written(_best(scopes.join(facts, ["scope_kind", "scope_value"]), "_set"))
    globs = facts.filter("scope_kind = 'path_glob'")
    of_path = written(_best(glob_pairs(features, globs).join(globs, "scope_value"), "file_path"))
    same = [known[c].eqNullSafe(sets[c]) for c in by]
    keys = known.join(sets, reduce(Column.__and__, same)).select("action_id", "_set", F.col("file_path").alias("_path"))
    rows = targets.join(keys, "action_id", "left").join(of_set.withColumnRenamed("w", "_ws"), ["_set", "target_name"], "left")
    rows = rows.join(of_path.select(F.col("file_path").alias("_path"), "target_name", F.col("w").alias("_wp")), ["_path", "target_name"], "left")
    w = rows.withColumn("w", F.greatest("_ws", "_wp"))
    return w.select(*targets.columns, *[F.col(f"w.{c}").alias(c) for c in ("fact_id", "value", "variance", "aleatoric_variance")])


PROBABILITY = ("p_success", "immediate_benefit_realized")


def is_probability() -> Column:
    return F.col("target_name").isin(*PROBABILITY) | F.startswith("target_name", F.lit("p_event."))


def clamp_probability(c) -> Column:
    return clamp(c, *K.PROBABILITY_CLAMP)


def logit(c) -> Column:
    p = clamp_probability(c)
    return F.log(p / (1.0 - p))


def sigmoid(c) -> Column:
    """Stable on both sides: never exponentiates a large positive number."""
    x = col(c)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def pooled(matched: DataFrame, targets: DataFrame, top_k: int = 3, max_shift: float = 2.0) -> DataFrame:
    """Weighted mean logit of the top-k facts, held within ``max_shift`` of the prior."""
    order = W.partitionBy("action_id", "target_name").orderBy(
        F.desc("specificity_rank"), F.desc("sample_size"), F.desc("created_at"), F.desc("fact_id"))
    w = effective_weight()
    top = matched.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top_k)
    g = top.groupBy("action_id", "target_name").agg(
        (F.sum(w * logit("value")) / F.sum(w)).alias("l"), F.count(F.lit(1)).alias("contributors"),
        F.max("variance").alias("variance"), F.max("aleatoric_variance").alias("aleatoric_variance"))
    a = logit("prior")
    bounded = F.greatest(a - max_shift, F.least(a + max_shift, F.col("l")))
    return targets.join(g, ["action_id", "target_name"]).withColumn("pooled_value", clamp_probability(sigmoid(bounded))).drop("l")


def bounded_variance(component: str | Column, epistemic, aleatoric, floor_ratio: float = K.LEARNED_VARIANCE_FLOOR_RATIO) -> Column:
    """epistemic + aleatoric inside [cap·ratio, cap]; no aleatoric evidence keeps the cap."""
    cap = lookup(K.COLD_START_VARIANCE, component) if not isinstance(component, str) else F.lit(K.COLD_START_VARIANCE[component])
    e, a = col(epistemic), col(aleatoric)
    inside = F.greatest(cap * floor_ratio, F.least(cap, e + a))
    return F.when(e.isNull(), None).when(a.isNull(), cap).otherwise(inside)


def variance_component() -> Column:
    t = F.col("target_name")
    return (
        F.when(t == "p_success", "p_success").when(F.startswith(t, F.lit("p_event.")), "p_event")
        .when(t == "review_cost", "review_cost").otherwise("benefit")
    )


def apply_facts(targets: DataFrame, features: DataFrame, facts: DataFrame, *keep: str) -> DataFrame:
    """New value and variance of every target of every action; columns ``keep`` of the targets come along.

    A consequence event is never lowered by a repository rate, and a rejected estimate does
    not narrow its uncertainty either.  A learned benefit without a variance keeps the cap.
    """
    j = resolved(targets, features, eligible(facts))
    t, v, prior, was = F.col("target_name"), F.col("value"), F.col("prior"), F.col("prior_variance")
    raw = F.when(is_probability(), clamp_probability(v)).when(t == "review_cost", F.greatest(F.lit(0.0), v)).otherwise(v)
    name = F.when(F.startswith(t, F.lit("p_event.")), F.substr(t, F.lit(9)))
    held = F.coalesce(name.isin(*K.CONSEQUENCE_EVENTS) & (raw < prior), F.lit(False))
    learned = bounded_variance(variance_component(), "variance", "aleatoric_variance")
    cap = F.lit(K.COLD_START_VARIANCE["benefit"])
    benefit = F.coalesce(learned, cap)
    new_var = (
        F.when(v.isNull() | held, was)
        .when(variance_component() == "benefit", F.when(was.isNull(), benefit).otherwise(F.least(cap, was + benefit)))
        .otherwise(F.coalesce(learned, was))
    )
    return j.select(
        "action_id", "target_name", "prior", F.when(v.isNull() | held, prior).otherwise(raw).alias("new_value"),
        new_var.alias("new_variance"), F.col("fact_id"), F.col("variance").isNotNull().alias("has_variance"),
        F.when(held, "consequence_event_non_decreasing").alias("safety_constraint"), *keep)


# --- shipped priors ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PriorCell:
    """A reviewed population prior; ``None`` in a match column matches anything."""

    calibration_tag: str
    sample_size: int
    action_type: str | None = None
    language: str | None = None
    language_tier: str | None = None
    graph_fact_kind: str | None = None
    min_graph_confidence: float | None = None
    p_success: float | None = None
    p_success_variance: float | None = None
    p_success_aleatoric_variance: float | None = None
    review_cost: float | None = None
    review_cost_variance: float | None = None
    review_cost_aleatoric_variance: float | None = None


MATCH = ("action_type", "language", "language_tier", "graph_fact_kind")
_TYPES = {"str": T.StringType(), "int": T.IntegerType(), "float": T.DoubleType()}
_CELL = T.StructType([T.StructField(f.name, _TYPES[str(f.type).split(" ")[0]]) for f in fields(PriorCell)])


def _valid(c: PriorCell) -> bool:
    numbers = [v for v in (c.p_success_variance, c.p_success_aleatoric_variance, c.review_cost, c.review_cost_variance,
                           c.review_cost_aleatoric_variance) if v is not None]
    return (
        c.sample_size > 0 and bool(c.calibration_tag) and any(getattr(c, m) for m in MATCH)
        and all(0 <= v < float("inf") for v in numbers) and (c.p_success is None or 0 <= c.p_success <= 1)
        and (c.min_graph_confidence is None or 0 <= c.min_graph_confidence <= 1)
    )


def match_cells(actions: DataFrame, cells: Sequence[PriorCell]) -> DataFrame:
    """Wildcard join without a nested loop: one equi-join key per used combination of columns.

    Cells are configuration, so the combinations in use are known here.
    """
    good = [c for c in cells if _valid(c)]
    masks = sorted({tuple(m for m in MATCH if getattr(c, m) is not None) for c in good})
    key = lambda mask, get: "|".join([",".join(mask), *[str(get(m)).strip().lower() for m in mask]])
    rows = [(key(tuple(m for m in MATCH if getattr(c, m) is not None), lambda m, c=c: getattr(c, m)),
             sum(getattr(c, m) is not None for m in (*MATCH, "min_graph_confidence")), *asdict(c).values()) for c in good]
    head = [T.StructField("_key", T.StringType()), T.StructField("specificity", T.IntegerType())]
    table = actions.sparkSession.createDataFrame(rows, T.StructType(head + _CELL.fields))
    table = table.withColumnsRenamed({m: f"cell_{m}" for m in MATCH})
    keys = F.array(*[F.concat_ws("|", F.lit(",".join(mask)), *[F.lower(F.trim(F.coalesce(m, F.lit("\0")))) for m in mask]) for mask in masks])
    hit = actions.withColumn("_key", F.explode(keys)).join(table, "_key")
    floor = F.coalesce("min_graph_confidence", F.lit(0.0))
    graph_ok = F.col("cell_graph_fact_kind").isNull() | (finite("graph_confidence") & F.col("graph_confidence").between(floor, F.lit(1.0)))
    return hit.filter(graph_ok)


def warm_priors(actions: DataFrame, cells: Sequence[PriorCell]) -> DataFrame:
    """Most specific value per omitted field, each field resolved on its own.

    Once per kind of action: its match columns and the highest floor of a cell that its graph confidence reaches.
    """
    rank = F.struct("specificity", "sample_size", "calibration_tag")
    best = lambda c, v: F.max_by(v, F.when(F.col(c).isNotNull(), rank))
    floors = F.array(*[F.lit(float(x)) for x in sorted({0.0, *(c.min_graph_confidence for c in cells if c.min_graph_confidence is not None)})])
    reached = F.array_max(F.filter(floors, lambda x: x <= F.col("graph_confidence")))
    kinds = actions.withColumn("graph_confidence", F.when(finite("graph_confidence") & (F.col("graph_confidence") <= 1), reached))
    by = [*MATCH, "graph_confidence"]
    m = written(match_cells(kinds.select(*by).distinct(), cells).groupBy(*by).agg(
        best("p_success", F.struct("p_success", "calibration_tag")).alias("p"),
        best("review_cost", F.struct("review_cost", "calibration_tag")).alias("c"),
        best("p_success_variance", bounded_variance("p_success", "p_success_variance", "p_success_aleatoric_variance", K.WARM_VARIANCE_FLOOR_RATIO)).alias("pv"),
        best("review_cost_variance", bounded_variance("review_cost", "review_cost_variance", "review_cost_aleatoric_variance", K.WARM_VARIANCE_FLOOR_RATIO)).alias("cv")))
    same = reduce(Column.__and__, [kinds[c].eqNullSafe(m[c]) for c in by])
    omitted = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return kinds.join(m, same, "left").select(
        "action_id",
        F.when(omitted("p_success_given"), F.col("p.p_success")).alias("warm_p_success"),
        F.when(omitted("p_success_given"), F.col("p.calibration_tag")).alias("p_success_tag"),
        F.when(omitted("review_cost_given"), F.col("c.review_cost")).alias("warm_review_cost"),
        F.when(omitted("review_cost_given"), F.col("c.calibration_tag")).alias("review_cost_tag"),
        F.col("pv").alias("warm_p_success_variance"), F.col("cv").alias("warm_review_cost_variance"))


def layer_priors(targets: DataFrame, warm: DataFrame, features: DataFrame, facts: DataFrame) -> DataFrame:
    """Request ← shipped ← local.  A local fact without variance keeps the request's own variance."""
    t = F.col("target_name")
    pick = lambda a, b: F.when(t == "p_success", F.col(a)).when(t == "review_cost", F.col(b))
    shipped = targets.join(warm, "action_id", "left").select(
        "action_id", "target_name", F.col("prior_variance").alias("request_variance"),
        F.coalesce(pick("warm_p_success", "warm_review_cost"), F.col("prior")).alias("prior"),
        F.coalesce(pick("warm_p_success_variance", "warm_review_cost_variance"), F.col("prior_variance")).alias("prior_variance"),
        pick("warm_p_success", "warm_review_cost").isNotNull().alias("shipped_used"))
    local = apply_facts(shipped, features, facts, "request_variance", "shipped_used")
    legacy = F.col("fact_id").isNotNull() & ~F.col("has_variance") & t.isin("p_success", "review_cost")
    return local.select(
        "action_id", "target_name", F.col("new_value").alias("value"),
        F.when(legacy, F.col("request_variance")).otherwise(F.col("new_variance")).alias("variance"),
        F.when(F.col("fact_id").isNotNull(), "local_learned").when(F.col("shipped_used"), "shipped").otherwise("request").alias("source"))
