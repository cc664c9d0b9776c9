import base64
import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from telemill.llm import sharding, skew, warc
from telemill.session import scratch_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello"
PAGES = [
    (1, "http://a", "<p>one</p>"), (2, "http://b\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", FAKE), (6, "u", f"x{FAKE}\r\n\r\n{FAKE}\r\n\r\nrest"),
    (7, "u", "WARC/1.1\r\n"), (8, "u", "a\r\n\r\nb\r\n\r\n"), (9, "u", f"x{FAKE}\r\n\r\n{FAKE}\r\n\r\nrest"), (10, "u", "é" * 4000), (11, "u", "HTTP/1.1 200\r\n\r\nbody"),
    (12, "u", "WARC/1.1\r\nContent-Length: 999999999999\r\n\r\n"), (1, "http://a", "<p>one</p>"), (14, "u", "WARC/1.1\r\n" * 300), (15, "u", "Content-Length: 7\r\n\r\n"),
]


def expected(rows):
    first, out = {}, []
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        same = first[h or ""] == i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else first[h or ""]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", ["128m", "3000", "700"])
def test_round_trip_with_version_lines_inside_payloads(spark, block):
    rows = PAGES + [(100 + i, "u", f"<p>{i}</p>" * (i % 7)) for i in range(60)]
    path = scratch_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(r.verified for r in got)
    assert sorted(((int(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got), key=str) == expected(rows)


@pytest.mark.parametrize("least", [1000, 2])
def test_many_repeated_payloads_are_joined_by_shuffle(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "hot_keys", functools.partial(skew.hot_keys, least=least))
    rows = PAGES + [(100 + i, "u", f"<p>{i % 9}</p>") for i in range(90)] + [(None, "u", "<p>one</p>")]
    path = scratch_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, broadcast_rows=0)
    got = warc.read_warc(spark, path).collect()
    want = [(None if r[0] is None else r[0], *r[1:]) for r in expected([r for r in rows if r[0] is not None])]
    assert sorted(((int(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got if r.id), key=str) == want
    assert [(r.record_type, r.refers_to) for r in got if not r.id] == [("revisit", "1")]


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, "u", "x" * 3_000_000, "a", "b"), (2, "u", "WARC/1.1\r\n" * 100_000, "a", "b"), (3, "u", "x" * 3_000_000, "a", "b")]
    path = scratch_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, size string"), path)
    got = warc.read_warc(spark, path).collect()
    assert sorted((int(r.id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got) == expected([r[:3] for r in rows])


def test_empty_archive(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def shards(df, n=5, **more):
    dims = {"size": F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + 8), "source": sharding.text_prefix(F.col("source"))}
    return sharding.kd_shards(df, dims, n_shards=n, **more).collect()


def test_shards_are_near_equal_and_slots_gapless(spark):
    docs = [(i, None if i % 50 == 0 else "tä" * (i * 37 % 900), "hot" if i % 3 else f"s{i % 11}") for i in range(4000)]
    got = shards(spark.createDataFrame(docs, "doc_id long, text string, source string"), chunk_rows=100)
    by, slots = Counter(), defaultdict(list)
    texts = {i: (t or "").encode() for i, t, _ in docs}
    for r in got:
        assert r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == 4000 and sorted(by) == list(range(5)) and max(by.values()) < 1.02 * min(by.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def split_plainly(points, node, m, out):
    """The k-d tree over all rows at once: points are (coordinates, size, key)."""
    if m == 1:
        out.update({key: node for _, _, key in points})
        return
    spread = [max(c[d] for c, _, _ in points) - min(c[d] for c, _, _ in points) for d in range(len(points[0][0]))]
    d = spread.index(max(spread))
    points = sorted(points, key=lambda p: p[0][d])
    want, before, at = sum(p[1] for p in points) * (m // 2) / m, 0, 0
    while at < len(points) and before + points[at][1] < want:
        before += points[at][1]
        at += 1
    at += int(want - before > before + points[at][1] - want)
    split_plainly(points[:at], node, m // 2, out)
    split_plainly(points[at:], node + m // 2, m - m // 2, out)


@pytest.mark.parametrize("n", [2, 7, 16])
def test_against_a_plain_tree(spark, n):
    rnd = random.Random(n)
    docs = [(i, "x" * rnd.randrange(2000), float(rnd.randrange(50)), rnd.random()) for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, u double, v double")
    dims = {"u": F.col("u"), "v": F.col("v")}
    got = {r.doc_id: r.shard for r in sharding.kd_shards(df, dims, n_shards=n, tolerance=0.0, passes=12).collect()}
    made = sharding._coordinates(sharding._measured(df, "doc_id", "text", dims, 8), 2).collect()
    want = {}
    split_plainly([(r.c, r.size, r.key) for r in made], 0, n, want)
    assert got == want


def test_equal_texts_lie_together_but_for_cuts(spark):
    docs = [(i, f"text {i % 400} " * 9, "s") for i in range(4000)]
    by = defaultdict(set)
    for r in shards(spark.createDataFrame(docs, "doc_id long, text string, source string"), 5):
        by[r.doc_id % 400].add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) <= 4


def test_a_very_long_text_and_clashing_columns(spark):
    docs = [(i, "y" * (5_000_000 if i == 3 else 100), "s", "a", "b", "c") for i in range(50)]
    got = shards(spark.createDataFrame(docs, "doc_id long, text string, source string, node string, shard string, size string"), 2)
    assert sorted(Counter(r.shard for r in got)) == [0, 1] and len(got) == 50


def test_equal_rows_part(spark):
    by = Counter(r.shard for r in shards(spark.createDataFrame([(7, "same", "s")] * 3000, "doc_id long, text string, source string"), 3))
    assert len(by) == 3 and max(by.values()) < 1.2 * min(by.values())


def test_few_or_no_rows(spark):
    assert shards(spark.createDataFrame([], "doc_id long, text string, source string")) == []
    assert len(shards(spark.createDataFrame([(1, None, None), (None, "x", "s")], "doc_id long, text string, source string"))) == 2
