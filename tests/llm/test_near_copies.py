"""SimHash components and benchmark leaks against brute force."""

import collections
import random
import re

import numpy as np
import xxhash

from llm.conftest import ODD, ODD_SCHEMA
from oddsmith.llm import decontam, simhash


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return sorted(((i, "%016x" % f, low.get(g)) for (i, _), f, g in zip(rows, fps, group)), key=repr)


def test_components_equal_brute_force(frame):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    rows += [(i, t) for i, t, _ in ODD]
    got = sorted((tuple(r) for r in simhash.near_duplicate_report(frame(rows)).collect()), key=repr)
    assert got == brute_components(rows)


def test_large_buckets_are_cut_and_stay_exact(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 62))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False) if b < 63) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")

    def roots(pairs):
        at = {x: x for x in fps}
        for u, v in pairs:
            a, b = at[u], at[v]
            at = {k: min(a, b) if g in (a, b) else g for k, g in at.items()}
        return at

    want = roots([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    for small, chunk, blocks in ((16, 4096, None), (3, 10, 6), (200, 8, 5)):
        got = [(r.u, r.v) for r in simhash.links(df, 4, blocks, small, chunk).collect()]
        assert all((u ^ v).bit_count() <= 4 for u, v in got)
        assert roots(got) == want


def test_no_rows(frame):
    assert simhash.near_duplicate_report(frame([])).collect() == []
    assert decontam.contaminated(frame([]), frame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_leaks_equal_brute_force_on_both_join_paths(frame):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(15, 45)))) for i in range(20)] + [(99, "too few"), (98, None)]
    docs = []
    for i in range(150):
        it = rng.choice(items[:20])[1].split()
        for _ in range(rng.randrange(3)):
            it[rng.randrange(len(it))] = f"zz{rng.randrange(9)}"
        docs.append((i, " ".join([f"pad{rng.randrange(99)}" for _ in range(rng.randrange(30))] + it + ["tail"] * rng.randrange(20))))
    docs += [(500, None), (501, ""), (502, items[0][1].upper()), (None, items[1][1])]
    want = {}
    for d, t in docs:
        g = grams(t)
        for i, x in ((i, grams(x)) for i, x in items):
            for s in range(len(g) - len(x) + 1 if x else 0):
                both = sum((collections.Counter(g[s : s + len(x)]) & collections.Counter(x)).values())
                if both / (2 * len(x) - both) >= 0.8:
                    want[d, i] = max(want.get((d, i), 0), round(both / (2 * len(x) - both), 6))
    for limit in (1_000_000, 0):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(frame(docs), frame(items, "item_id long, text string"), broadcast=limit).collect()}
        assert got == want


def test_odd_rows(frame):
    assert len(simhash.near_duplicate_report(frame(ODD, ODD_SCHEMA)).collect()) == len(ODD)
    assert decontam.contaminated(frame(ODD, ODD_SCHEMA), frame([(7, "one two three four five six")], "item_id long, text string")).count() == 2


def test_cut_short_and_moved_passages_equal_brute_force(frame):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((45, 45, 64, 30))]
    pad = lambda n: " ".join(f"p{rng.randrange(5000)}" for _ in range(n))
    docs = []
    for _, text in items:
        w = text.split()
        docs += [pad(30) + " " + " ".join(w[:-4]), " ".join(w[4:]) + " " + pad(30), " ".join(w[:-2]), " ".join(w[2:]), " ".join(w[:20] + w[21:])]
        docs += [" ".join(w[:-12]), pad(9) + " " + " ".join(w[12:]), pad(30) + " " + " ".join(w[:10] + w[11:]), " ".join(w[1:20] + w[21:]) + " " + pad(5)]
        docs += [pad(7) + " zz " + " ".join(w[1:20]) + " a b " + " ".join(w[20:-1]) + " zz " + pad(9), pad(7) + " zz zz " + " ".join(w[2:]) + " " + pad(9)]
    docs = list(enumerate(docs))
    want = {}
    for d, t in docs:
        g = grams(t)
        for i, x in ((i, grams(x)) for i, x in items):
            for s in range(max(len(g) - len(x), 0) + 1):
                win = g[s : s + len(x)]
                both = sum((collections.Counter(win) & collections.Counter(x)).values())
                if both / (len(win) + len(x) - both) >= 0.8:
                    want[d, i] = max(want.get((d, i), 0), round(both / (len(win) + len(x) - both), 6))
    assert len(want) >= 25
    for limit in (1_000_000, 0):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(frame(docs), frame(items, "item_id long, text string"), broadcast=limit).collect()}
        assert got == want
