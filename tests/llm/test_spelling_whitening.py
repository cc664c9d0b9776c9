import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from telemill.llm import spelling, whitening


def counted(rows):
    out = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n > 1}


def one_off(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = counted(rows)
    near = {w: [v for v in words if one_off(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def found(df, **options):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **options).collect())


def plain(rows):
    return sorted(rows, key=lambda r: r[0])


def test_variants_against_all_pairs(spark):
    rnd = random.Random(4)
    stems = ["".join(rnd.choice("abcdeéíß") for _ in range(rnd.randint(6, 12))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rnd.choice(stems[: rnd.randint(1, 60)])
            for _ in range(rnd.choice([0, 0, 0, 0, 1, 2])):
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice("abcé") + w[at:], w[:at] + rnd.choice("abcÉ") + w[at + 1 :]])
            words.append(rnd.choice([w, w.title(), w.upper()]))
        rows.append((i if i % 50 else None, rnd.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [(900, None), (901, ""), (902, "short an"), *[(903, "Repeated ROWS")] * 3]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string").repartition(3)
    want = brute(rows)
    assert plain(found(df)) == want and sum(r[4] for r in want) > 100 and any(r[1] for r in want)
    assert plain(found(df, parts=4)) == want


def test_chains_end_at_the_last_form(spark):
    words = {"abcdefg": 1000, "abcdefgh": 100, "abcdefghi": 10, "abcdefghiz": 2, "abcdefx": 100, "zzzzzzzz": 5}
    text = " ".join(" ".join([w] * n) for w, n in words.items())
    got = {r[0]: r for r in found(spark.createDataFrame([(None, text)], "doc_id long, text string"))}
    assert got["abcdefghi"] == ("abcdefghi", "abcdefgh", "abcdefg", 10, 2, 100)
    assert got["abcdefghiz"] == ("abcdefghiz", None, "abcdefghiz", 2, 1, None)
    assert got["abcdefx"][1:3] == ("abcdefg", "abcdefg") and got["abcdefg"][4] == 2 and got["zzzzzzzz"][3:] == (5, 0, None)


def test_spelling_of_empty_tables_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).count() == 0
    long = spark.createDataFrame([(None, "einhorn einhörn " * 100_000 + "y" * 100_000)], "doc_id long, text string")
    assert found(long) == [("einhorn", None, "einhorn", 100_000, 1, None), ("einhörn", None, "einhörn", 100_000, 1, None)]


def test_signatures_meet_for_all_near_words():
    rnd = random.Random(8)
    place = {ord(c): i % 8 for i, c in enumerate("abcdefgh")}
    for _ in range(300):
        a = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(7, 12)))
        at = rnd.randrange(len(a))
        for b in (a[:at] + a[at + 1 :], a[:at] + rnd.choice("abcdefgh") + a[at + 1 :]):
            signed = [(kind, *map(int, s)) for kind, s in spelling.signatures([a, b], place, 8)]
            if len(a) == len(b):
                assert any(kind == 0 and x == y for kind, x, y in signed)
            else:
                assert {x for kind, x, _ in signed if kind == 1} & {y for kind, _, y in signed if kind == 2}


def exact(vectors):
    x = np.array([[int(np.floor(64 * float(v))) + 1_000_000 for v in row] for row in vectors], object)
    n = len(x)
    centred = n * x - x.sum(axis=0)
    values, columns = np.linalg.eigh(np.array((centred.T @ centred) / n**3, float))
    return n, centred, values[::-1], columns[:, ::-1]


def test_whitening_against_exact_covariances(spark):
    rnd = np.random.default_rng(2)
    vectors = (rnd.normal(size=(300, 6)) @ rnd.normal(size=(6, 6)) * 3).round(3).tolist()
    bad = [None, [], [1.0] * 5, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6, [-float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]]
    rows = [(i, v, "x") for i, v in enumerate(vectors + bad + vectors[:3])] + [(None, vectors[5], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(4)
    kept = vectors + vectors[:3] + [vectors[5]]
    n, centred, values, columns = exact(kept)
    got = whitening.whitened_components(df, most=4).toPandas()
    assert len(got) == 4 * n and set(got.n) == {n} and got.identity_error.max() < 1e-9
    white = (centred / n).astype(float) @ columns / np.sqrt(values)
    for i, v in enumerate(vectors):
        own = got[got.vec_id == i].sort_values("component")
        assert set(own.deviation) == {int((centred[i] ** 2).sum())}
        assert np.allclose(np.abs(own.whitened), np.abs(white[i, :4]), atol=1e-9)
        assert np.allclose(own.explained, values[:4] / values.sum())
    assert got.vec_id.isna().sum() == 4


@pytest.mark.parametrize("size", [1, 2**30, 2**45])
def test_pair_squares_are_exact(size):
    rnd = random.Random(size)
    y = np.array([[rnd.randrange(-size, size + 1) for _ in range(4)] for _ in range(50)], np.int64)
    want = y.astype(object)
    got = whitening.pair_squares(y)
    for i in range(4):
        for j in range(i, 4):
            pair = want[:, i] + (want[:, j] if i != j else 0)
            assert got[i, j] == (pair * pair).sum()


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whitened_components(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened_components(spark.createDataFrame([(1, [0.5, 2.0])] * 3, kind)).count() == 0
    flat = whitening.whitened_components(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(4)], kind)).collect()
    assert sorted({r.component for r in flat}) == [1] and len(flat) == 4
