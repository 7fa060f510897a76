"""Statistics, spans and models against brute force and held-out rows."""

import collections
import random
import re
import zlib
from hashlib import sha256

import duckdb
import pytest

from llm.conftest import ODD, ODD_SCHEMA
from oddsmith.llm import langid, pii, rules, subword

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    bad = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(bad)


def test_statistics(frame):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "#|", "é ", "\t", "a\n", "\x0b", " "]) for _ in range(rng.randrange(80)))) for i in range(150)] + [(900 + i, t) for i, (_, t, _) in enumerate(ODD)]
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.statistics(frame(rows)).collect()}
    assert got == {i: counts(t) for i, t in rows}


def test_rules_find_label_zero(docs, labels):
    out = rules.quality_report(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert sum(r.kept for r in out if r.quality == 0) <= 2
    assert sum(not r.kept and not r.base_failed for r in out if r.quality == 1) <= 3


def test_rules_without_labels(frame):
    none = frame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in rules.quality_report(frame(ODD, ODD_SCHEMA), none).collect())
    assert rules.quality_report(frame([]), none).collect() == []


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    t, out = t or "", []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


FRAGMENTS = ["a.b@c.d", "x@y", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 123-4567", "é", "😀", " ", "-", ".", "12", "7", "+", "_q@r.st%", "0001.2.3.4", "..", "1.2.3.4.5.6.7.8", "(", "378282246310005", "1234567890123456789012", "John Smith", "123-45-6789"]


def test_base_spans_and_masks(frame):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(FRAGMENTS) for _ in range(rng.randrange(14)))) for i in range(800)]
    rows += [(9001, None), (9002, ""), (9003, "1 " * 3000), (9004, "9" * 50000), (9005, "a" * 100000), (9006, "1.2.3.4 " * 300)]
    got = {r.doc_id: r for r in pii.report(frame(rows)).collect()}
    for i, t in rows:
        want = base_spans(t)
        text = [f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for _, k, _ in want) for x in range(4))
        assert got[i].base_sha256 == sha256(",".join(text).encode()).hexdigest()
        assert set(text) <= set(got[i].spans.split(","))
    masked = {r.doc_id: r.text for r in pii.masked(frame(rows)).collect()}
    for i, t in rows:
        spans, clear, at = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in got[i].spans.split(",") if x)), "", 0
        order = sorted(((a, pii.KINDS.index(k), b, k) for a, b, k in spans))
        reach = -1
        for a, _, b, k in order:
            if a >= reach:
                clear += (t[at:a] if at <= a else "") + f"[{k.upper()}]"
            at = reach = max(reach, b)
        assert masked[i] == (t if not order else clear + t[at:])


def test_secrets_are_added(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {(r.doc_id, s) for r in pii.report(docs).collect() for s in r.spans.split(",") if s.startswith("secret")}
    planted = sum(len(re.findall(r'token = "[0-9a-f]{40}"', t, re.I)) for t in texts.values())
    assert planted and len(found) == planted


def test_pii_odd_rows(frame):
    assert pii.report(frame([])).collect() == []
    assert pii.masked(frame(ODD, ODD_SCHEMA)).columns == ["doc_id", "text", "id"] and pii.masked(frame(ODD, ODD_SCHEMA)).count() == len(ODD)


def test_language_held_out(docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in langid.report(docs).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)


def test_language_odd_rows(frame):
    df = frame([(i, t, "en") for i, t, _ in ODD] + [(50, "1234 !!", "fr")], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in langid.report(df).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (50, "und")} <= got
    assert {r.lang_pred for r in langid.report(df.selectExpr("doc_id", "text", "cast(null AS string) lang")).collect()} == {"und"}
    assert langid.report(frame([], "doc_id long, text string, lang string")).collect() == []


def test_rank_distance(monkeypatch):
    table = {"a": {"_x": 0, "x_": 1, "x": 2}, "b": {"y": 0}}
    own = sorted(["x", "_x", "x_", "_x_"], key=lambda g: zlib.crc32(g.encode()))
    far = sum(abs(i - table["a"][g]) if g in table["a"] else 10 for i, g in enumerate(own))
    assert langid.Ranker(table, 10).predict("x") == ("a", 1 - far / 40)
    rng = random.Random(6)
    table = {lang: {"".join(rng.choice("abc_") for _ in range(rng.randrange(1, 4))): i for i in range(40)} for lang in "uvw"}
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    want = [langid.slow_predict(t, table, 20) for t in texts]
    for known in (1 << 18, 300):  # also when all is forgotten again and again
        monkeypatch.setattr(langid, "KNOWN", known)
        ranker = langid.Ranker(table, 20)
        assert [ranker.predict(t) for t in texts] == want


def test_classifier_held_out(docs, labels):
    con = duckdb.connect()
    quality = dict(con.execute(f"select doc_id, quality from '{FOLDER}/labels.parquet'").fetchall())
    out = [r for r in subword.report(docs, labels).collect() if r.held_out and r.doc_id in quality]
    good, bad = ([r.score for r in out if quality[r.doc_id] == y] for y in (1, 0))
    assert sum(a > b for a in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_classifier_odd_rows(frame):
    none = frame([], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in subword.report(frame(ODD, ODD_SCHEMA), none).collect())
    assert subword.report(frame([]), none).collect() == []
    one = frame([(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1)], "doc_id long, quality int")
    assert {r.predicted for r in subword.report(frame(ODD, ODD_SCHEMA), one).collect()} == {1}


def test_numerals_are_no_letters():
    table = {"en": {"a": 0, "b": 1}, "fr": {"c": 0}}
    ranker = langid.Ranker(table)
    assert [ranker.predict(t) for t in ("ⅷ ⅷ", "12 ²³ ½", "_ -", "", None)] == [("und", 0.0)] * 5
    assert ranker.predict("a²b ⅷ") == langid.slow_predict("a b", table, langid.PROFILE)
    assert langid.letter_words("A²b b ½x") == {"a": 1, "b": 2, "x": 1}


def test_the_memory_of_words_is_emptied(monkeypatch):
    monkeypatch.setattr(langid, "REMEMBERED", 2_000)
    table, ranker = {"en": langid.gram_counts("a b c")}, None
    ranker = langid.Ranker(table)
    for i in range(50):
        text = f"wort{'abcdefghij'[i % 10]} {'xyz'[i % 3] * (i + 1)} und"
        assert ranker.predict(text) == langid.slow_predict(text, table, langid.PROFILE)
        assert ranker.held < 6_000
