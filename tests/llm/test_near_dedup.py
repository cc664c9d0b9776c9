import functools
import random

import pytest

from telemill.llm import near_dedup, skew
from telemill.llm.components import components
from telemill.llm.near_dedup import near_groups


def brute(rows, k, percent=80):
    """component and set size by id, over all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        sets.setdefault(i, set()).update(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"n{rnd.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("k", [4, 5])
def test_against_all_pairs(spark, k):
    rnd = random.Random(k)
    rows, i = [], 0
    for size, copies in [(60, 60), (150, 120), (30, 40), (12, 30), (400, 6)]:
        base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
        for _ in range(copies):
            rows.append((i, edited(rnd, base, rnd.randrange(max(2, size // 14)))))
            i += 1
    rows += [(i + j, t) for j, t in enumerate([None, "", " \n", "a", "A", "a b", "b a", "a b c d", "A B\tC  d", "x\x1cy z w v", "é " * 30, "É " * 30, "w " * 5000, "w " * 6000])]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, "?") for d, t in rows], "doc_id long, text string, component_id string").repartition(3)
    want = brute(rows, k)
    for options in ({}, {"block": 7, "star": 5}, {"broadcast_limit": 0}):
        got = {r.doc_id: r for r in near_groups(df, k=k, **options).collect()}
        assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
        assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(5, "one two three four five six")] * 3 + [(2, "one two three four five six"), (None, "one two three four five six"), (9, None)]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted([(5, 2, 2)] * 3 + [(2, 2, 2), (-1, 2, -1), (9, 0, 9)])
    assert all(r.kept == (r.doc_id in (None, 2, 9)) for r in got)
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_buckets_and_sets_in_parts(spark, monkeypatch):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    rows = [(i, edited(rnd, base, rnd.randrange(6))) for i in range(80)] + [(100 + i, "one text of some seven words here") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 5)
    monkeypatch.setattr(near_dedup, "hot_keys", functools.partial(skew.hot_keys, least=3, most=20))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, block=9, block_shingles=900).collect()}
    assert got == want


def test_texts_of_one_id_belong_together(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(5, a), (5, b), (3, a), (8, b), (9, c)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (8, 3, False), (9, 9, True)]


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2])]
    got = sorted((r.doc_id, r.component_id) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (2, 1), (3, 3)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (200, 199), (199, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 200: 199, 201: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_asked_for_grow_with_the_documents(spark, monkeypatch):
    asked, plain = [], near_dedup._texts_for
    monkeypatch.setattr(near_dedup, "_texts_for", lambda docs, wanted, limit: asked.append(wanted.count()) or plain(docs, wanted, limit))
    shared, shares = [f"s{i}" for i in range(60)], []
    for n in (600, 2400):  # unlike documents that share half of their words, and a changed copy of every 20th
        rnd = random.Random(n)
        rows = [(i, " ".join(shared + [f"w{rnd.randrange(10**7)}" for _ in range(60)])) for i in range(n)]
        rows += [(n + i, " ".join(rows[i][1].split()[:-12] + [f"p{rnd.randrange(10**7)}" for _ in range(12)])) for i in range(0, n, 20)]
        asked.clear()
        got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=20).collect()}
        assert got == {i: i - n if i >= n else i for i, _ in rows}
        shares.append(sum(asked) / len(rows))
    assert shares[1] < 1.5 * shares[0] and shares[1] < 5


def test_wide_buckets_are_taken_apart_by_further_bands(spark):
    classes = [(b, r, 10, r) for r in range(9) for b in ((1, 2, 3) if r < 4 else (1, 2) if r < 6 else (1,))]
    placed = spark.createDataFrame(classes, "bucket long, rep long, n long, root long")
    hot = skew.hot_keys(placed.groupBy("bucket").count(), ["bucket"], "count")

    def together(**options):
        found = {}
        for r in near_dedup.comparable(placed, hot, block_shingles=10**6, **options).collect():
            found.setdefault(r.bucket, set()).add(r.rep)
        return sorted(map(sorted, found.values()))

    assert together(depth=2, block=100) == [list(range(4)), list(range(6)), list(range(9))]  # nothing is wide
    assert together(depth=0, block=2) == [list(range(4)), list(range(6)), list(range(9))]  # nothing is taken apart
    assert together(depth=1, block=4) == [list(range(4)), list(range(6))]  # bucket 3 is narrow; pair (1, 2) has six
    assert together(depth=2, block=2) == [list(range(4))]  # all pairs are wide; four classes share all three bands


def test_pairs_that_share_one_wide_bucket_alone_are_found(spark):
    rnd = random.Random(5)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared + [f"w{rnd.randrange(10**7)}" for _ in range(60)])) for i in range(300)]
    rows += [(300 + i, " ".join(rows[i][1].split()[:-8] + [f"p{rnd.randrange(10**7)}" for _ in range(8)])) for i in range(0, 300, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one_band = dict(n_perm=1, rows=2, block=5)  # one bucket holds many unlike documents, and no second one takes it apart
    whole = {r.doc_id: r.component_id for r in near_groups(df, depth=0, **one_band).collect()}
    assert len(set(whole.values())) < 340  # many of the 60 copies meet their source
    for options in ({}, {"broadcast_limit": 0}):
        assert {r.doc_id: r.component_id for r in near_groups(df, **one_band, **options).collect()} == whole
