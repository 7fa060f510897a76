"""Ledger reads: content decoding, listings, lineage, grouping and hash links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmith import constants as K
from oddsmith.functions.columns import finite, previous_row, running_positions, running_sum
from oddsmith.session import cut_lineage

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()


def _struct(**kw):
    return T.StructType([T.StructField(k, v) for k, v in kw.items()])


GATE = _struct(gate=T.IntegerType(), name=_S, advisory=_B, expected_loss=_D, threshold=_D, rau=_D, benefit=_D)
CONTENT = _struct(
    repo_id=_S, decision=_S, assessed_commit=_S, requires_confirmation=_B, risk_mode=_S,
    scores=_struct(expected_loss=_D, benefit=_D, expected_utility=_D, rau=_D, edit_confidence=_D,
                   loss_components=T.ArrayType(_struct(event=_S, disutility=_D))),
    gates_fired=T.ArrayType(GATE),
)
SERIES = ("expected_loss", "benefit", "expected_utility", "rau", "edit_confidence")


def decode_json(df: DataFrame, column: str, schema: T.StructType, out: str = "content") -> DataFrame:
    """Fail-soft decode: a bad or non-object payload keeps the row with every field NULL."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return df.withColumn(out, F.coalesce(parsed, empty))


def authoritative(assessments: DataFrame) -> DataFrame:
    """Rows whose hash-covered content agrees with the duplicated repository column."""
    return decode_json(assessments, "content_json", CONTENT).filter(F.col("content.repo_id") == F.col("repo_id"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def score_series(assessments: DataFrame) -> DataFrame:
    """The five score series; a missing score is NULL, never zero."""
    return authoritative(assessments).select("id", F.col("content.decision").alias("decision"),
                                             *[F.col(f"content.scores.{k}").alias(k) for k in SERIES])


def event_disutility(rows: DataFrame, assessments: DataFrame) -> DataFrame:
    """Stored disutility of the event a target names; NULL for other targets or bad content."""
    content = decode_json(assessments, "content_json", CONTENT).select(
        F.col("id").alias("assessment_id"), F.col("content.scores.loss_components").alias("parts"))
    event = F.when(F.startswith("target_name", F.lit("p_event.")), F.substr("target_name", F.lit(9)))
    hit = F.try_element_at(F.filter("parts", lambda c: c["event"] == event), F.lit(1))
    return rows.join(content, "assessment_id", "left").withColumn("event_disutility", hit["disutility"]).drop("parts")


def latest_capture(rows: DataFrame, captures: DataFrame) -> DataFrame:
    """Newest feature capture per (assessment, type, name, action), NULL-safe on the action.

    The newest row is an aggregate, so the join cannot fan out.
    """
    key = ["assessment_id", "target_type", "target_name"]
    newest = captures.groupBy(*key, F.col("action_id").alias("_a")).agg(F.max_by("features", "id").alias("features"))
    n = newest.withColumnsRenamed({k: f"_{k}" for k in key})
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("action_id").eqNullSafe(F.col("_a"))]
    return rows.join(n, on, "left").drop(*[f"_{k}" for k in key], "_a")


def with_outcome(assessments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Assessment with its terminal outcome; NULL means pending."""
    o = outcomes.select(F.col("assessment_id").alias("id"), "terminal_status", F.col("recorded_at").alias("outcome_recorded_at"))
    return authoritative(assessments).join(o, "id", "left")


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; a negative limit or offset counts as zero."""
    return df.orderBy(F.desc("id")).offset(max(0, offset)).limit(max(0, limit))


def overview(assessments: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts by decision, by status (pending when none) and in total, per repository."""
    rows = with_outcome(assessments, outcomes).select(
        "repo_id", F.col("content.decision").alias("decision"), F.coalesce("terminal_status", F.lit("pending")).alias("status"))
    return rows.groupingSets([["repo_id", "decision"], ["repo_id", "status"], ["repo_id"]], "repo_id", "decision", "status").agg(
        F.count(F.lit(1)).alias("n"))


def latest_by(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """Newest row per key as a partial aggregate instead of a sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(order, *cols), order).alias("r")).select(key, "r.*")


_NAMED = "action_id string, action_ids array<string>"


def sanctions_in_force(sanctions: DataFrame) -> DataFrame:
    return sanctions.filter(F.col("status").isin("active", "consumed"))


def sanction_of_assessment(sanctions: DataFrame) -> DataFrame:
    """Newest sanction in force of each assessment."""
    return latest_by(sanctions_in_force(sanctions), "assessment_id", "id", "status", "sanction_json")


def sanction_of_action(sanctions: DataFrame) -> DataFrame:
    """Newest sanction in force that names an action, per repository and action.

    The action is named at the top or in the risk profile, singly or in a list; a profile that is mere text names none.
    """
    top = F.from_json("sanction_json", f"{_NAMED}, risk_profile string")
    read = sanctions_in_force(sanctions).withColumn("t", top).withColumn("p", F.from_json("t.risk_profile", _NAMED))
    none = F.array().cast("array<string>")
    named = F.concat(F.array("t.action_id", "p.action_id"), F.coalesce("t.action_ids", none), F.coalesce("p.action_ids", none))
    each = read.withColumn("action_id", F.explode(F.array_distinct(F.array_compact(named))))
    return each.groupBy("repo_id", "action_id").agg(F.max_by(F.struct("id", "assessment_id", "sanction_json"), "id").alias("r")).select("repo_id", "action_id", "r.*")


def lessons_of(lessons: DataFrame, repo_id: str, ids: DataFrame | None = None) -> DataFrame:
    """Lessons of a repository, all or those whose ``lesson_id`` is in ``ids``."""
    own = lessons.filter(F.col("repo_id") == repo_id)
    return own if ids is None else own.join(ids.select("lesson_id").distinct(), "lesson_id", "left_semi")


def controlling_gate(gates: str | Column = "content.gates_fired") -> Column:
    """First valid non-advisory gate of the ordered array."""
    gates = F.col(gates) if isinstance(gates, str) else gates
    return F.try_element_at(
        F.filter(gates, lambda g: ~F.coalesce(g["advisory"], F.lit(False)) & F.coalesce(g["gate"] > 0, F.lit(False))), F.lit(1))


def reject_override(gates: Column) -> Column:
    """True when a reject came from a convertible risk gate with its numbers recorded."""
    g = controlling_gate(gates)
    valid = F.forall(gates, lambda x: (x["gate"] > 0) & (x["name"] != ""))
    fits = (
        ((g["gate"] == 3) & (g["name"] == K.REJECT_GATE_NAME[3]) & finite(g["expected_loss"]) & finite(g["threshold"]))
        | ((g["gate"] == 4) & (g["name"] == K.REJECT_GATE_NAME[4]) & finite(g["rau"]))
        | ((g["gate"] == 9) & (g["name"] == K.REJECT_GATE_NAME[9]) & finite(g["benefit"]))
    )
    return F.coalesce(valid & fits, F.lit(False))


def pending_reviews(assessments: DataFrame, commit: str) -> DataFrame:
    """Assessments of a commit that still want a person; all of them, order by repository and descending id to show them."""
    c = F.col("content")
    want = (
        (c["decision"] == "ask_human")
        | ((c["decision"] == "proceed") & F.coalesce(c["requires_confirmation"], F.lit(False)))
        | ((c["decision"] == "reject") & reject_override(c["gates_fired"]))
    )
    rows = decode_json(assessments, "content_json", CONTENT).filter((c["assessed_commit"] == commit) & want)
    return rows.select(
        "repo_id", "id", c["decision"].alias("decision"), controlling_gate()["gate"].alias("gate"))


def trend(df: DataFrame, key: str, order: str, values: tuple[str, ...]) -> DataFrame:
    """Latest, lowest and highest finite value of each series."""
    aggs = []
    for v in values:
        ok = F.when(finite(v), F.col(v))
        aggs += [F.max_by(ok, F.when(ok.isNotNull(), F.col(order))).alias(f"{v}_now"), F.min(ok).alias(f"{v}_min"), F.max(ok).alias(f"{v}_max")]
    return df.groupBy(key).agg(*aggs)


def prior_summary(provenance: DataFrame) -> DataFrame:
    """Which priors shaped an assessment: local over shipped over cold start, with tag sets.

    The sets hold the few distinct snapshots and tags of one assessment.
    """
    local, warm = F.col("snapshot_id").isNotNull(), F.col("warm_tag").isNotNull()
    g = provenance.groupBy("assessment_id").agg(
        F.bool_or(local).alias("l"), F.bool_or(warm).alias("w"),
        F.array_sort(F.collect_set("warm_tag")).alias("calibration_tags"),
        F.array_sort(F.collect_set("snapshot_id")).alias("snapshot_ids"),
        F.countDistinct(F.when(local, F.col("target_name"))).alias("applied_target_count"))
    source = F.when(F.col("l"), "local_learned").when(F.col("w"), "shipped").otherwise("cold_start")
    facet = F.when(F.col("l") & F.col("w"), "mixed").otherwise(source)
    return g.select("assessment_id", source.alias("source"), facet.alias("facet"), "calibration_tags", "snapshot_ids", "applied_target_count")


def assessment_detail(assessments: DataFrame, guardrails: DataFrame, outcomes: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row per assessment with its ordered guardrails, outcome and prior summary nested."""
    g = guardrails.groupBy(F.col("assessment_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("id").alias("guardrail_id"), "pre_commit_decision", "measured_benefit"))).alias("guardrails"))
    p = prior_summary(provenance).withColumnRenamed("assessment_id", "id")
    return with_outcome(assessments, outcomes).join(g, "id", "left").join(p, "id", "left")


def group_contiguous(rows: DataFrame, group: list[str], order: str, key: list[str], valid: Column) -> DataFrame:
    """Collapse neighbouring rows with one identical valid key; an invalid key stands alone."""
    tagged = rows.withColumns({"_ok": valid, "_k": F.struct(*key)})
    lagged = previous_row(tagged, group, order, ["_ok", "_k"])
    same = F.col("_ok") & F.coalesce(F.col("prev._ok") & F.col("prev._k").eqNullSafe(F.col("_k")), F.lit(False))
    starts = lagged.withColumn("_start", (~same).cast("int")).drop("prev", "_ok", "_k")
    return running_sum(starts, group, order, "_start", "island").drop("_start")


def verify_chain(rows: DataFrame, table: str = "table_name", genesis: str = "GENESIS") -> DataFrame:
    """Per table: does every row follow its predecessor and hash to what is stored?"""
    linked = previous_row(rows, [table], "id", ["row_hash"])
    follows = F.col("prev_hash") == F.coalesce("prev.row_hash", F.lit(genesis))
    hashes = F.sha2(F.concat("prev_hash", "content_json"), 256) == F.col("row_hash")
    ok = F.coalesce(follows & hashes, F.lit(False))
    return linked.groupBy(table).agg(
        F.count(F.lit(1)).alias("rows"), F.every(ok).alias("valid"), F.min(F.when(~ok, F.col("id"))).alias("first_bad_id"))


def _in_order(node: str, digest: str) -> Column:
    """SHA-256 over the digests of a bounded group, by ``node``."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(node).alias("n"), F.col(digest).alias("d")))), lambda c: c["d"]), ""), 256)


def batch_digests(rows: DataFrame, group: list[str], batch: Column, order: str = "id", content: str = "content_json") -> DataFrame:
    """One digest per batch over its row hashes in ledger order, so new chains link batches, not rows.

    A batch is what its writer closed at once; its hashes, 64 characters a row, are put in order in one row.
    """
    hashed = rows.select(*group, batch.alias("batch"), order, F.sha2(F.coalesce(content, F.lit("")), 256).alias("hash"))
    return hashed.groupBy(*group, "batch").agg(F.count(F.lit(1)).alias("rows"), _in_order(order, "hash").alias("digest"))


def merkle_levels(rows: DataFrame, group: list[str], order: str = "id", content: str = "content_json", fanout: int = 256, height: int | None = None) -> list[DataFrame]:
    """An ordered hash tree per group: tables of (group, node, rows, digest), leaves first, one root per group last.

    A leaf hashes a row's place and content; a node hashes its children's digests in order, ``fanout`` at
    a time.  Two swapped rows, a changed, missing or added one change every digest up to the root.  A null
    content is told apart from an empty one.  ``height`` levels are put on the leaves, by default as many as the largest group needs.
    """
    placed = running_positions(rows, group, order)
    place = F.col("position") - 1
    told = F.concat(place.cast("string"), F.lit(":"), F.col(order).cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit("="), content), F.lit("-")))
    level = placed.select(*group, place.cast("bigint").alias("node"), F.lit(1).cast("bigint").alias("rows"), F.sha2(told, 256).alias("digest"))
    levels = [level]
    if height is None:
        width, height = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0, 0
        while width > 1:
            width, height = -(-width // fanout), height + 1
    for _ in range(height):
        up = level.withColumn("up", F.floor(F.col("node") / fanout).cast("bigint")).groupBy(*group, "up")
        level = cut_lineage(up.agg(F.sum("rows").alias("rows"), _in_order("node", "digest").alias("digest")).withColumnRenamed("up", "node"))
        levels.append(level)
    return levels


def inclusion_proof(levels: list[DataFrame], place: DataFrame, group: list[str], fanout: int = 256) -> DataFrame:
    """What shows that the row at ``place(group, node)`` is under the root: per level the digests of its node and siblings, in order."""
    out = []
    for i, level in enumerate(levels[:-1]):
        up = F.floor(F.col("node") / fanout).cast("bigint")
        wanted = place.select(*group, F.col("node").alias("own"), up.alias("parent"))
        out.append(level.withColumn("parent", up).join(wanted, [*group, "parent"]).select(*group, F.lit(i).alias("level"), "own", "node", "digest"))
        place = place.select(*group, up.alias("node"))
    return reduce(DataFrame.unionByName, out)


def proof_holds(proof: DataFrame, roots: DataFrame, group: list[str]) -> DataFrame:
    """Per group: do the digests of each level hash to the node above, up to the stored root?"""
    made = proof.groupBy(*group, "level", "own").agg(_in_order("node", "digest").alias("made"))
    above = proof.filter(F.col("node") == F.col("own")).select(*group, (F.col("level") - 1).alias("level"), F.col("digest").alias("stored"))
    top = made.groupBy(*group).agg(F.max("level").alias("level")).join(roots.select(*group, F.col("digest").alias("stored")), group)
    told = above.filter("level >= 0").unionByName(top.select(*above.columns))
    return made.join(told, [*group, "level"], "left").groupBy(*group).agg(F.every(F.coalesce(F.col("made") == F.col("stored"), F.lit(False))).alias("holds"))


def changed_ranges(before: list[DataFrame], after: list[DataFrame], group: list[str], fanout: int = 256) -> DataFrame:
    """(group, node) of the leaves that differ, found from the roots down: below equal digests nothing is read."""
    open_ = None
    for i in range(len(before) - 1 if len(before) == len(after) else 0, -1, -1):  # trees of two heights are compared by their leaves
        here = [t.withColumn("parent", F.floor(F.col("node") / fanout).cast("bigint")) for t in (before[i], after[i])]
        if open_ is not None:
            here = [t.join(open_.select(*group, F.col("node").alias("parent")), [*group, "parent"], "left_semi") for t in here]
        b, a = (t.select(*group, "node", F.col("digest").alias(c)) for t, c in zip(here, "ba"))
        open_ = cut_lineage(b.join(a, [*group, "node"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*group, "node"))
    return open_


# --- identity --------------------------------------------------------------------------------------------------

HISTORY = _struct(
    request=_struct(revision_envelope=_struct(expected_files=T.ArrayType(_S))),
    model_guidance_packet=_struct(binding=_struct(
        candidate=_struct(algorithm=_S, files=T.MapType(_S, _S)),
        safe_scope=_struct(files=T.ArrayType(_S), symbols=T.ArrayType(_struct(file_path=_S))))),
    scores=_struct(symbol_scope_evidence=_struct(symbol_fanin=_struct(resolved_file_paths=T.ArrayType(_S)))),
)


def _paths(c: Column) -> Column:
    ok = F.filter(c, lambda p: p.isNotNull() & (p != "") & ~F.contains(p, F.lit("::")))
    return F.coalesce(F.array_distinct(F.transform(ok, lambda p: F.replace(p, F.lit("\\"), F.lit("/")))), F.array().cast("array<string>"))


def target_files(df: DataFrame, algorithm: str) -> DataFrame:
    """Files of an assessment by precedence: bound, declared, guidance, graph, unavailable."""
    d = decode_json(df, "content_json", HISTORY, "h")
    b = F.col("h.model_guidance_packet.binding")
    files = b["candidate"]["files"]
    sound = (b["candidate"]["algorithm"] == algorithm) & (F.size(files) > 0) & F.forall(
        F.map_entries(files), lambda e: (e["key"] != "") & ~F.contains(e["key"], F.lit("::")) & e["value"].rlike("^[0-9a-f]{64}$"))
    bound = F.when(F.coalesce(sound, F.lit(False)), _paths(F.map_keys(files))).otherwise(F.array().cast("array<string>"))
    keys = F.json_object_keys(F.get_json_object("content_json", "$.request.revision_envelope"))
    declared_here = F.coalesce(F.array_contains(keys, "expected_files"), F.lit(False))
    declared = _paths(F.col("h.request.revision_envelope.expected_files"))
    symbols = F.transform(b["safe_scope"]["symbols"], lambda s: s["file_path"])
    guidance = F.array_union(_paths(b["safe_scope"]["files"]), _paths(symbols))
    graph = _paths(F.col("h.scores.symbol_scope_evidence.symbol_fanin.resolved_file_paths"))
    has = lambda c: F.size(c) > 0
    return d.select(
        "id",
        F.when(has(bound), bound).when(declared_here, declared).when(has(guidance), guidance).otherwise(graph).alias("target_files"),
        F.when(has(bound), "candidate_bound")
        .when(declared_here, F.when(has(declared), "declared").otherwise("unavailable"))
        .when(has(guidance), "legacy_guidance").when(has(graph), "legacy_graph").otherwise("unavailable").alias("target_provenance"))


def utc_timestamp(c: str) -> Column:
    """Strict ISO-8601 UTC text, else NULL."""
    shape = F.col(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{6})?\+00:00$")
    return F.when(shape, F.try_to_timestamp(F.regexp_replace(c, r"\+00:00$", "Z")))
