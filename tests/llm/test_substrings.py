"""Byte and word substring dedup against brute force."""

import collections
import random
import re
from hashlib import sha256

import numpy as np
import pytest

from llm.conftest import ODD, ODD_SCHEMA
from oddsmith.llm import anchors, debruijn, suffixes


def test_suffix_arrays_also_from_disk():
    for seed in range(150):
        rng = random.Random(seed)
        letters, n = rng.choice([1, 2, 3, 26]), rng.randrange(1, 120)
        text = [rng.choice([0, *range(1, letters + 1)]) if rng.random() < 0.1 else rng.randrange(letters) + 1 for _ in range(n)] + [0]
        got = suffixes.suffix_array(np.array(text, np.int16), 400, rng.choice([50, 1 << 20])).tolist()
        assert got == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_windows():
    for seed in range(100):
        rng = random.Random(seed)
        w = rng.choice([3, 8, 12, 20])
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 6))]
        seen = collections.Counter(p[i : i + w] for p in parts for i in range(len(p) - w + 1))
        assert [x.tolist() for x in suffixes.repeated_windows(parts, w)] == [[i + w <= len(p) and seen[p[i : i + w]] > 1 for i in range(len(p))] for p in parts]


def mutated(seed, letters, n=50):
    rng = random.Random(seed)
    docs = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(200)))) for i in range(n)]
    for _ in range(n):
        i, j = rng.randrange(n), rng.randrange(n)
        x, y = docs[i][1], docs[j][1]
        a, p = rng.randrange(len(y) + 1), rng.randrange(len(x) + 1)
        docs[i] = (i, x[:p] + y[a : a + rng.randrange(10, 90)] + x[p:])
    return docs + [(n, None), (n + 1, "é" * 70), (n + 2, "a" * 300), (n + 3, docs[7][1]), (None, docs[8][1]), (n + 4, "")]


@pytest.mark.parametrize("seed,letters,window", [(0, "abcdefgh ", 24), (1, "ab", 24), (2, "abcdefgh ", 40)])
def test_bytes(frame, seed, letters, window):
    docs = mutated(seed, letters)
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(b[k : k + window] for _, b in data for k in range(len(b) - window + 1))
    want = []
    for i, b in data:
        bad = set()
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                bad |= set(range(k, k + window))
        want.append((i, len(b), len(bad), sum(1 for x in bad if x - 1 not in bad), bytes(x for j, x in enumerate(b) if j not in bad)))
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup(frame(docs), window=window, k=6).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_shard_holds_more_than_its_size(frame, monkeypatch, tmp_path):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    footer, turns = text(18), [text(6) for _ in range(5)]
    docs = [(i, text(rng.randrange(40)) + rng.choice(turns) + footer + rng.choice(turns) + text(rng.randrange(40))) for i in range(80)]
    docs += [docs[3], (None, docs[4][1]), (None, None), (90, footer + text(9) + footer)]
    log, run = tmp_path / "shards", suffixes.shard_spans

    def logged(batches, window, size):
        held, each = list(batches), collections.Counter()
        for batch in held:
            for key, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()):
                each[key] += len(part)
        with log.open("a") as f:
            f.write("".join(f"{size} {n}\n" for n in each.values()))
        return run(iter(held), window, size)

    monkeypatch.setattr(suffixes, "shard_spans", logged)
    order = lambda rs: sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rs), key=repr)
    data = [(t or "").encode() for _, t in docs]
    seen = collections.Counter(b[k : k + 24] for b in data for k in range(len(b) - 24 + 1))
    want = []
    for (i, _), b in zip(docs, data):
        bad = {x for k in range(len(b) - 24 + 1) if seen[b[k : k + 24]] > 1 for x in range(k, k + 24)}
        want.append((i, len(b), len(bad), sum(1 for x in bad if x - 1 not in bad), bytes(x for j, x in enumerate(b) if j not in bad)))
    for shard in (200, 1, 1 << 20):
        assert order(suffixes.dedup(frame(docs), window=24, k=6, shard=shard).collect()) == sorted(want, key=repr)
    assert sum(n for _, _, n, _, _ in want) > 1000
    held = [tuple(map(int, line.split())) for line in log.read_text().splitlines()]
    assert all(n <= size for size, n in held) and max(n for _, n in held) > 200


def brute_words(docs, window=13):
    first, out = {}, []
    big = (1 << 63) - 1
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for i, t in sorted(docs, key=lambda d: big if d[0] is None else d[0]):
        w = split(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), big if i is None else i)
    for i, t in docs:
        w, bad = split(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big if i is None else i):
                bad |= set(range(k, k + window))
        out.append((i, len(w), len(bad), sha256(" ".join(x for j, x in enumerate(w) if j not in bad).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,size", [(0, 400), (1, 6), (2, 2)])
def test_words(frame, seed, size):
    rng = random.Random(seed)
    docs = [(i, " ".join(f"w{rng.randrange(size)}" for _ in range(rng.randrange(60)))) for i in range(60)]
    for _ in range(60):
        i, j = rng.randrange(60), rng.randrange(60)
        w, x = docs[j][1].split(), docs[i][1].split()
        a, p = rng.randrange(max(1, len(w))), rng.randrange(len(x) + 1)
        docs[i] = (i, " ".join(x[:p] + w[a : a + rng.randrange(8, 40)] + x[p:]))
    docs += [(70, None), (71, ""), (72, docs[3][1]), (None, docs[4][1])]
    assert sorted((tuple(r) for r in debruijn.dedup_report(frame(docs)).collect()), key=repr) == brute_words(docs)


@pytest.mark.parametrize("size", [400, 4])
def test_words_of_rows_that_share_an_id_or_have_none(frame, size):
    rng = random.Random(size)
    words = lambda n: " ".join(f"w{rng.randrange(size)}" for _ in range(n))
    shared = [words(30) for _ in range(3)]
    docs = [(i, words(5) + " " + shared[i] + " " + words(20)) for i in range(3)]
    for i in [None] * 12 + [7] * 6:
        docs.append((i, words(rng.randrange(60)) + " " + rng.choice(shared)[: rng.randrange(150)] + " " + words(rng.randrange(60))))
    docs += [docs[-1]] * 3 + [(None, docs[5][1])] * 2
    assert sorted((tuple(r) for r in debruijn.dedup_report(frame(docs)).collect()), key=repr) == brute_words(docs)


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK", 50)
    values = anchors.mixed(np.arange(400, dtype=np.uint64) % np.uint64(37))
    covered = np.concatenate([np.arange(f, f + c) for _, _, first, count in anchors.cut(values, 13, 5) for f, c in zip(first, count)])
    assert sorted(covered.tolist()) == list(range(388))


def test_odd_and_no_rows(frame):
    for report in (suffixes.dedup_report, debruijn.dedup_report):
        assert report(frame([])).collect() == []
        assert report(frame(ODD, ODD_SCHEMA)).select("doc_id").distinct().count() == 7
