import os
import random

import pytest

from telemill.llm import queries, repeats
from telemill.llm.oracles import OP11

DATA = "/root/testdata/sf0.001"


def brute(rows, window):
    """id, words, removed words and kept text by comparing every window with all others."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            if d is not None:
                first[tuple(w[s : s + window])] = min(first.get(tuple(w[s : s + window]), d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if d is not None and first[tuple(w[s : s + window])] < d:
                gone.update(range(s, s + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in repeats.remove_repeats(df, **options).collect()], key=str)


def mixed(seed):
    """Documents put together from common passages, whole, changed or cut; with shared and null ids, nulls and other blanks."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(40, 200))] for _ in range(10)]
    rows = []
    for i in range(250):
        words = []
        for _ in range(rnd.randint(0, 4)):
            own = list(rnd.choice(passages))
            kind = rnd.random()
            for _ in range(rnd.randint(1, 4) if kind < 0.4 else 0):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            words += [rnd.choice(vocabulary[:3]) for _ in range(rnd.randint(0, 3))] + (own[rnd.randrange(len(own)) :] if kind > 0.8 else own)
        rows.append((rnd.choice([i, i, i, i // 2]) if rnd.random() < 0.98 else None, rnd.choice([" ", "  ", "\n"]).join(words) if rnd.random() < 0.97 else None))
    return rows + [(1000, "a " * 300), (1001, "a " * 120), (1002, ""), *[(7, rows[3][1])] * 5]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"limit": 4, "broadcast_limit": 0}), (3, {"window": 20, "k": 5, "limit": 16})])
def test_against_every_window(spark, seed, options):
    rows = mixed(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, words int").repartition(3)
    assert found(df, **options) == brute(rows, options.get("window", 50))


def test_one_passage_in_many_documents(spark):
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, " ".join(f"x{rnd.randrange(40)}" for _ in range(30)) + " " + passage + " " + " ".join(f"y{rnd.randrange(40)}" for _ in range(30))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(df, limit=8)
    assert got == brute(rows, 50)
    assert sum(r[2] >= 70 for r in got) == 119


def test_maximal_matches_of_one_group():
    line = [b"%d" % i for i in range(30)]
    rows = [([b"a", *line, b"b"], 10, 0, 22, 1, 0, 0), ([b"c", *line, b"b"], 10, 0, 22, 2, 0, 0), ([b"c", *line, b"d"], 10, 0, 22, 3, 0, 0)]
    assert sorted((row[4], a, b) for row, a, b in repeats.extend(rows, 10)) == [(2, 1, 22), (3, 0, 0), (3, 1, 21)]


def test_texts_of_equal_ids_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(2, long), (2, "head " + long), (1, "other " + long[len("w0 ") :]), (None, long)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, long), (2, "start " + long[: len(long) // 2]), (3, "again " * 20_000)]
    got = {r[0]: r[1:3] for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    n = len(rows[1][1].split())
    assert got[1] == (150_000, 0) and got[3] == (20_000, 0) and got[2][0] == n and n - 2 <= got[2][1] <= n - 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_query_against_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = sorted(map(tuple, queries.QUERIES["op11_substring_dedup"](spark, DATA).collect()))
    assert got == sorted(con.sql(f"select doc_id, n_words, n_removed, kept_sha256 from ({OP11})").fetchall())
