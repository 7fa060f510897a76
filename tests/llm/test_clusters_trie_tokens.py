"""Integer k-means, prefix trie and token counts against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict
from math import floor

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm.conftest import ODD, ODD_SCHEMA
from oddsmith.llm import centroids, prefixtrie, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def plain_clusters(rows, k, rounds, dimensions, scale):
    kept = [(i, [floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and abs(x) < float("inf") for x in v)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    mark = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=mark)[:k]]
    near = lambda v: min((far(v, c), no) for no, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for no, vs in groups.items():
            centres[no] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = lambda no: sum(d for _, c, d in out if no in (c, None))
    return [(i, c, d, inertia(c), inertia(None), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in out]


def clusters(spark, rows, k=4, rounds=3, dimensions=6, scale=64, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS id", "'x' AS v", "'y' AS cluster")
    return sorted(map(tuple, centroids.clusters(df, k, rounds, dimensions=dimensions, scale=scale, **more).collect()), key=repr)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    float32 = lambda a: [float(x) for x in a.astype(np.float32)]
    rows = [(i, float32(rng.normal(size=6) * (1 + i % 3))) for i in range(150)]
    rows += [rows[0], rows[0], (None, rows[3][1]), (200, None), (201, []), (202, [1.0] * 5), (203, [None] + [0.0] * 5), (204, [float("nan")] + [0.0] * 5), (205, [float("-inf")] + [0.0] * 5), (206, [0.0] * 6), (207, [-0.0078125] * 6)]
    rows += [(300 + i, rows[7][1]) for i in range(80)]  # one very common vector
    for pivots in (1, 3, 4):
        assert clusters(spark, rows, pivots=pivots) == sorted(plain_clusters(rows, 4, 3, 6, 64), key=repr)
    assert clusters(spark, rows, k=9, rounds=1) == sorted(plain_clusters(rows, 9, 1, 6, 64), key=repr)


def test_clusters_of_few_equal_or_no_vectors(spark):
    same = [(i, [1.0] * 6) for i in range(20)]
    assert clusters(spark, same) == sorted(plain_clusters(same, 4, 3, 6, 64), key=repr)  # ties: all in cluster 0
    line = [(i, [float(i)] * 6) for i in range(3)]
    assert clusters(spark, line, k=8) == sorted(plain_clusters(line, 8, 3, 6, 64), key=repr)
    assert clusters(spark, []) == clusters(spark, [(1, None)]) == []


def test_simplex_bounds_hold():
    rng = np.random.default_rng(5)
    points = rng.integers(-200, 200, (12, 20))
    points[3] = points[2]  # a repeated one is no pivot
    simplex = centroids.Simplex(points, 8)
    assert len(simplex.pivots) == 8 and len(np.unique(simplex.pivots, axis=0)) == 8
    rows = np.concatenate([rng.integers(-200, 200, (300, 20)), points])
    a, b = (simplex.apex(centroids.squares(x, simplex.pivots)) for x in (rows, points))
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(2)
    low, high = flat + (a[:, -1:] - b[:, -1]) ** 2, flat + (a[:, -1:] + b[:, -1]) ** 2
    true = centroids.squares(rows, points)
    assert (low <= true * (1 + 1e-9) + 1e-3).all() and (high >= true * (1 - 1e-9) - 1e-3).all()
    assert (low > high.min(1, keepdims=True)).any()  # the filter does leave some out


def test_clusters_equal_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    got = centroids.clusters(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(centroids.CLUSTERS_SQL).fetchall())


def plain_trie(rows, hundred=100, shared=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (abs(c) % hundred) * (1 if c >= 0 else -1)
        made = own.get(base, [])[:h] + turns[h:]
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append((c, len(made) == d))
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    sums = defaultdict(lambda: [0, 0])
    for path, ms in members.items():
        for d in range(len(path) + 1):
            sums[path[:d]][0] += path not in children
            sums[path[:d]][1] += (len(ms) - 1) * (len(path[-1][1]) if path else 0)
    least = {path: min(c for c, _ in ms) for path, ms in members.items()}
    ends = {path: hashlib.sha256(",".join(str(c) for c, end in sorted(ms) if end).encode()).hexdigest() for path, ms in members.items()}
    return sorted(((least[p], len(p), least[p[:-1]] if p else None, len(ms), children.get(p, 0), *sums[p], ends[p]) for p, ms in members.items()), key=repr)


def trie(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "conv_id AS id", "'x' AS turns", "'y' AS k", "0 AS open")
    return sorted(map(tuple, prefixtrie.trie(df, **more).collect()), key=repr)


def test_trie_equals_plain_version(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "bot"]), f"turn {rng.randint(0, 2)} é😀") for c in range(-120, 260, 3) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", "again") for c in range(1000, 1040) for t in range(12)]  # copies
    rows += [(c, t, "user", f"long {t}") for c in (2000, 2001, 2002, 2003) for t in range(140 + 30 * (c % 2))]  # over two blocks
    rows += [rows[5], (7, None, "user", "first"), (7, None, None, "first"), (7, 0, "user", None), (7, 0, "user", ""), (None, 1, "user", "nobody's"), (8, 1, "a", "bc"), (9, 1, "ab", "c")]
    rng.shuffle(rows)
    want = plain_trie(rows)
    for shards in (1, 7, 40):
        assert trie(spark, rows, shards=shards) == want


def test_ends_of_a_common_conversation_travel_in_lots(spark):
    rows = [(c, 0, "user", "same") for c in range(9_000)] + [(9_001, 0, "user", "other")]
    assert trie(spark, rows, shards=5, shared=1) == plain_trie(rows, shared=1)


def test_trie_of_nothing(spark):
    assert trie(spark, []) == trie(spark, [(None, 1, "a", "b")]) == []
    turnless = [(c, 0, "user", "only") for c in range(401, 420)]  # no conversation 400: some are rebuilt to nothing
    assert trie(spark, turnless) == plain_trie(turnless)


def test_trie_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    got = prefixtrie.trie(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(prefixtrie.TRIE_SQL).fetchall(), key=repr)


def test_token_counts_equal_the_library(frame):
    model = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    some = ["a", "aa", "b", "é", " ", "  ", "\n", "1", "!", "'s", "<|endoftext|>", " ", " ", "漢", "\x1c", "\x85", "՘", "\U00010940", "\x00"]
    made = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += ["a" * 10_001, " " * 1001, "\n\n \t x", "<|endoftext", "".join(rng.choice("abcdefghij") for _ in range(20_000)), "'S's'LL'll", "word " * 30_000]
    rows = [(i, t) for i, t in enumerate(made)]
    want = [(i, len(t.encode()), n := len(model.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert sorted(map(tuple, tokens.report(frame(rows)).collect())) == want
    odd = sorted(map(tuple, tokens.report(frame(ODD, ODD_SCHEMA)).collect()), key=repr)
    assert odd == sorted(((i, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, _ in ODD), key=repr)
    assert tokens.report(frame([])).collect() == []


def test_every_code_point_is_cut_as_the_library_cuts_it():
    known = tokens.Vocabulary(VOCABULARY)
    splitter = Tokenizer.from_file(VOCABULARY).pre_tokenizer
    for c in [*range(0x800), *range(0x2000, 0x2100), *range(0x3000, 0x3040), *range(0xE000, 0x110000, 997)] + [0x558, 0x88F, 0x10EC5, 0x323B0]:
        text = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}a"
        assert known.cut(text) == [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)], hex(c)


def test_memory_of_pre_tokens_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 1_000)
    model, counts = Tokenizer.from_file(VOCABULARY), tokens.Counts(tokens.Vocabulary(VOCABULARY))
    for i in range(30):
        batch = [f"some words of batch {i} and {j}" for j in range(10)]
        assert counts.of(batch) == [len(model.encode(t, add_special_tokens=False).ids) for t in batch]
        assert counts.held < 10_000
