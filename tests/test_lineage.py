"""Set containment and lineage against plain comparisons of every pair."""

import random

from oddsmith.operators import lineage as V

SETS = "row_id long, repo_id int, assessed_commit string, files array<string>, baseline string, lineage_key string, is_legacy boolean, retryable boolean"
REQUESTS = "request_id long, repo_id int, assessed_commit string, files array<string>, baseline string"


def made(seed, n=160):
    rng = random.Random(seed)
    some = lambda k: rng.sample(["a", "b", "c", "d", "./e", "f\\g"], rng.randint(0, k)) + ["common"] * rng.choice([1, 1, 2])
    place = lambda: (rng.choice([1, 1, 2, None]), rng.choice(["x", "x", "y"]))
    records = [(i, *place(), rng.choice([some(2), some(2), [], ["common"]]), rng.choice([None, "p", "q"]), rng.choice([None, "", "l1", "l2"]), rng.random() < 0.2, rng.random() < 0.4) for i in range(n)]
    requests = [(i, *place(), rng.choice([some(4), some(4), [], None]), rng.choice([None, "p", "q", "r"])) for i in range(n)]
    return records, requests


def clean(files):
    return {f.replace("\\", "/").removeprefix("./") for f in files or []}


def plain(records, requests):
    spent = {}
    for _, repo, commit, _, _, key, legacy, retry in records:
        if key and not legacy and repo is not None:
            free, full = spent.get((repo, commit, key), (0, 0))
            spent[repo, commit, key] = (free + retry, full + (not retry))
    spent = {k: full + max(0, free - 1) for k, (free, full) in spent.items()}
    attempts, origins = {}, {}
    for q, repo, commit, files, base in requests:
        here = [r for r in records if repo is not None and (r[1], r[2]) == (repo, commit)]
        inside = [r for r in here if clean(r[3]) <= clean(files)]
        live = [r for r in (inside if base is None else [r for r in here if clean(r[3]) & clean(files)]) if not r[6]]
        old = any(r[6] for r in inside)
        count = [r for r in live if base is None or r[4] == base]
        named = [spent[repo, commit, r[5]] for r in count if r[5]]
        attempts[q] = max(named) if named else 1 if live or old else 0
        status = ("predates_lineage" if old else "none") if not live else "baseline_unbound" if base is None else "none" if not count else (
            "predates_lineage" if any(not r[5] for r in count) else "ambiguous" if len({r[5] for r in count}) > 1 else "available")
        origins[q] = (status, min(r[0] for r in count) if status == "available" else None)
    return attempts, origins


def test_lineage_equals_plain_comparison(spark):
    seen = set()
    for seed, n in ((1, 160), (2, 24), (3, 12)):
        records, requests = made(seed, n)
        a, b = spark.createDataFrame(records, SETS), spark.createDataFrame(requests, REQUESTS)
        attempts, origins = plain(records, requests)
        assert {r.request_id: r.attempts for r in V.revision_attempts(b, a).collect()} == attempts
        assert {r.request_id: (r.status, r.origin_row_id) for r in V.revision_origin(b, a).collect()} == origins
        seen |= {s for s, _ in origins.values()}
    assert seen == {"none", "predates_lineage", "baseline_unbound", "ambiguous", "available"}


def test_a_common_file_multiplies_nothing(spark):
    sets = [(1, "x", sorted({"common", f"own{i}"})) for i in range(300)]
    requests = [(i, 1, "x", ["common", f"own{i}"], None) for i in range(300)]
    a = spark.createDataFrame(sets, "repo_id int, assessed_commit string, own_files array<string>")
    keyed = V.by_rarest_file(a)
    assert keyed.filter("file = 'common'").count() == 0
    met = V.contained(spark.createDataFrame(requests, REQUESTS), a)
    assert met.count() == 300
    # before the set test, too, a request meets only sets whose rarest file it holds
    asked = spark.createDataFrame(requests, REQUESTS).selectExpr("request_id", "explode(files) AS file")
    assert asked.join(keyed, "file").count() == 300


def test_lineage_of_nothing(spark):
    none, some = spark.createDataFrame([], SETS), spark.createDataFrame([(1, 1, "x", ["a"], None)], REQUESTS)
    assert [tuple(r) for r in V.revision_attempts(some, none).collect()] == [(1, 0)]
    assert [tuple(r) for r in V.revision_origin(some, none).collect()] == [(1, "none", None)]
    assert V.revision_origin(spark.createDataFrame([], REQUESTS), none).collect() == []
