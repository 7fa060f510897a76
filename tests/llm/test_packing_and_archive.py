"""Packing against piece-by-piece best fit, and the archive's exact round trip."""

import collections
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from llm.conftest import ODD, ODD_SCHEMA
from oddsmith.llm import packing, warc


def test_best_fit_equals_piece_by_piece():
    for seed in range(200):
        rng = random.Random(seed)
        window = rng.choice([16, 37, 64])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 120))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
            if fit:
                rooms[min(fit)[1]] -= n
            else:
                rooms.append(window - n)
        used = collections.defaultdict(list)
        for n, _, windows, each, lo, at in packing.best_fit(collections.Counter(lengths), window):
            for k in range(windows * each):
                used[lo + k // each].append((at + k % each * n, n))
        assert sorted(window - sum(n for _, n in v) for v in used.values()) == sorted(rooms)
        for v in used.values():
            assert [a for a, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))]


def check(docs, got):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in docs:
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            want[i, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for v in used.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048


def test_pieces(frame):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("abc ABC\n\t12.,é'sΣ ") for _ in range(rng.choice([5, 300, 9000])))) for i in range(60)]
    docs += [(i, t) for i, t, _ in ODD] + [(80, "<|endoftext|> x<|startoftext|>y"), (81, "á e b c"), (82, "q" * 5000)]
    check(docs, packing.packed_report(frame(docs)).collect())
    assert packing.packed_report(frame([])).collect() == []
    assert len(packing.packed_report(frame(ODD, ODD_SCHEMA)).select("doc_id").distinct().collect()) == 7


def test_many_buckets_of_one_length(spark):
    parts = spark.createDataFrame([(i, 0, 5) for i in range(97)] + [(i, 0, 7) for i in range(200, 260)], "doc_id long, start long, length long")
    used = collections.defaultdict(list)
    for r in packing.pack(parts, 16, per_bucket=10).collect():
        used[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, used.values())) == 157
    for v in used.values():
        assert [a for a, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))]


def test_archive_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b", None), (3, None, "<p>é</p>"), (4, "http://c\r\nX: y", ""), (5, "u", "z" * 5000), (5, "u", "z" * 5000), (None, "n", "only"), (None, "m", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "url AS address", "html AS payload")
    warc.write_archive(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 4
    got = warc.read_records(spark, str(tmp_path / "a")).collect()
    assert sorted((r.id or 0, bytes(r.payload).decode()) for r in got) == sorted((i or 0, h or "") for i, _, h in pages)
    for r in got:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        block = bytes(r.payload) if r.record_type == "response" else b""
        assert rest == block + b"\r\n\r\n" and f"Content-Length: {len(block)}".encode() in head.split(b"\r\n")
    kinds = {(r.id, bytes(r.payload)[:4]): r.record_type for r in got}
    assert kinds[1, "<p>é".encode()[:4]] == "response" and kinds[3, "<p>é".encode()[:4]] == "revisit" and kinds[2, b""] == "response" and kinds[4, b""] == "revisit" and kinds[None, b"only"] == "response"


def test_archive_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    assert sorted(map(tuple, warc.archive_report(spark, "/root/testdata/sf0.001").collect())) == sorted(con.execute(warc.ARCHIVE_SQL).fetchall())
