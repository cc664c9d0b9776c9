import random
import string
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest

from telemill.llm.packing import SumOfSquares, filled_up, pack_documents
from telemill.llm.token_counts import Encoder, count_tokens, default_paths

TEXTS = [
    None, "", "a", "one two  three\n\n four", "x" * 5000, "word " * 3000, "<|endoftext|> in <|endoftext|><|endoftext|>", "日本語 テキスト " * 400,
    "ğ mixed ſcript – “quotes” €5 don't I'll 've", " \t\n ", "a b c  d", "\x85 \x1c x", "é" * 700 + " fin",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_paths()[0])
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_chunks_equal_whole(plain):
    rnd = random.Random(3)
    e = Encoder(*default_paths(), chunk_chars=64, overlap_chars=4)
    made = ["".join(rnd.choice(["ab", " ", "  ", "\n", "é", "1", "!", "<|endoftext|>", "日", "'s", "longword"]) for _ in range(rnd.randrange(400))) for _ in range(150)]
    for text in [*filter(None, TEXTS), *made]:
        assert e.ids(text).tolist() == plain(text), text[:80]


def test_counts(spark, plain):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, *TEXTS])], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in count_tokens(df, chunk_chars=100, overlap_chars=8).collect()}
    assert len(got) == 2 * len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(plain(t)), len((t or "").encode()))
        assert got[i].over_limit == (got[i].n_tokens > 512)


def test_counts_empty(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_level_is_the_best_by_brute_force():
    rnd, s, size = random.Random(1), SumOfSquares(16), 0
    for _ in range(3000):
        size = rnd.randrange(1, 16)
        n = s.levels.copy()

        def squares(h, n=n, size=size):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < 16:
                m[h + size] += 1
            return int((m**2).sum())

        choices = [0, *[h for h in range(1, 16 - size + 1) if n[h] > 0]]
        assert squares(s.best_level(size)) == min(map(squares, choices))
        s.place(size, size)


def test_long_texts_without_white_space_take_linear_time(plain):
    rnd, e = random.Random(5), Encoder(*default_paths())
    base64 = "".join(rnd.choices(string.ascii_letters + string.digits + "+/", k=1_000_000))
    chinese = "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) if rnd.random() > 0.02 else "，" for _ in range(1_000_000))
    plain("warm"), e.count("warm 日")
    for text in (base64, chinese, "日" * 300_000, "ab" * 300_000):
        began = time.perf_counter()
        whole = plain(text)
        middle = time.perf_counter()
        ids = e.ids(text)
        assert ids.tolist() == whole
        assert time.perf_counter() - middle < 2 * (middle - began) + 0.2


def test_boundaries_between_classes_and_special_strings(plain):
    rnd, e = random.Random(8), Encoder(*default_paths(), chunk_chars=40, overlap_chars=3)
    for _ in range(1500):
        text = "".join(rnd.choice(["a", "Z", "'", "'s", "'re", "7", "42", "-", "<|", "|>", "<|endoftext|>", "é", "汉", "字。", "१", "ह", " ", "\n", "!'", "`"]) for _ in range(rnd.randrange(40, 200)))
        assert e.ids(text).tolist() == plain(text), text


def test_filled_up_keeps_windows_and_leaves_one_open():
    rnd = random.Random(2)
    windows = sorted(([("d", 0, np.arange(rnd.randrange(1, 100)), 0)] for _ in range(57)), key=lambda w: -len(w[0][2]))
    sizes = [len(w[0][2]) for w in windows]
    out = list(filled_up([list(w) for w in windows], 100))
    filled = [sum(len(x[2]) for x in w) for w in out]
    assert sum(filled) == sum(sizes) and sorted(filled)[1:] == [100] * (len(filled) - 1)
    assert all(len(w[0][2]) == s for w, s in zip(out[:-1], sizes, strict=False))


def test_second_pass_keeps_padding_to_one_window_a_task(spark, plain):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, "w " * rnd.randrange(1, 900)) for i in range(600)], "doc_id long, text string").repartition(6)
    by = defaultdict(int)
    for r in pack_documents(docs, with_ids=False).collect():
        by[r.sequence_id] += r.length
    assert sum(x < 1024 for x in by.values()) <= 1


@pytest.mark.parametrize("max_open", [2, 4096])
def test_pack_round_trip(spark, plain, max_open):
    docs = [(i, t) for i, t in enumerate([*TEXTS, *["w " * n for n in range(0, 3000, 97)]])] + [(3, TEXTS[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = pack_documents(df, max_open=max_open).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for i, t in docs:
        copies = docs.count((i, t))
        want = [*plain(t), 0]
        assert sum(r.length for r in pieces[i]) == copies * len(want)
        assert all(r.doc_tokens == len(want) and r.ids == want[r.start : r.start + r.length] for r in pieces[i])
    if max_open > 2:
        assert sum(sum(r.length for r in s) < 1024 for s in sequences.values()) <= 1


def test_pack_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pack_ignores_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "some text", "x", "y", "z")], "doc_id long, text string, open string, ids string, key string")
    assert pack_documents(df).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert pack_documents(df, with_ids=False).count() == 1
