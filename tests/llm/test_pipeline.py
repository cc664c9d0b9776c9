"""The pipeline's stages one after the other against plain Python over all rows, and the registered queries."""

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from telemill.llm import queries
from telemill.llm.quality_rules import LineRules
from telemill.llm.token_counts import default_paths

RULES = LineRules()
EN = "the house of a man and that there is not for which with this river was over by from to be".split()
FR = "la maison de une homme et que dans est pas pour qui avec cette une sur par du en étaient".split()


def bad_line(line):
    b = line.strip(" \t\n\x0b\x0c\r")
    n = b.count(" ") + 1
    count = lambda p: len(re.findall(p, b))
    return b != "" and (
        (b[-1] not in RULES.terminal and not re.search(RULES.sentence_end, b)) or (not any(c.islower() for c in b) and n >= 3)
        or (n <= RULES.boilerplate_words and bool(re.search(RULES.boilerplate, b))) or count(RULES.separators) >= max(2, n * RULES.max_separator_share)
        or count(RULES.symbols) > n * RULES.max_symbols_per_word or b.count("!!") > n * RULES.max_shouts_per_word
    )


def passes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    again = len({p for i, x in enumerate(g) if c[x] > 1 for p in (i, i + 1, i + 2)})
    lines = text.split("\n")
    good = [x for x in lines if not bad_line(x)]
    total = sum(map(len, lines))
    lost = 1.0 if not total or not good else 1 - sum(map(len, good)) / total
    return len(w) >= 50 and 100 * again <= 50 * len(w) and lost <= RULES.max_lost_share, "\n".join(good)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(6)

    def prose(words, n):
        return "\n".join(" ".join(rnd.choice(words) + str(rnd.randrange(60)) * (rnd.random() < 0.7) for _ in range(12)).capitalize() + "." for _ in range(n))

    docs = [(i, prose(FR if i % 3 == 0 else EN, 5 + i % 9), "fr" if i % 3 == 0 else "en") for i in range(60)]
    docs += [(100 + i, docs[i][1], docs[i][2]) for i in range(8)]  # exact copies
    docs += [(120 + i, docs[10 + i][1].replace(" ", " changed ", 1), docs[10 + i][2]) for i in range(8)]  # near copies
    item = " ".join(f"exam{rnd.randrange(99)}" for _ in range(14))
    docs += [(140 + i, prose(EN, 6) + "\n" + item.capitalize() + ".", "en") for i in range(4)]  # benchmark passages
    docs += [(150, None, "en"), (151, "", None), (152, "| a | b | c |\n" * 40, "en"), (153, "BUY!! NOW!! " * 60, "en"), (154, "Menu\nHome\n" + prose(EN, 8), "en"), (155, prose(EN, 1), "en")]
    docs += [docs[20], (None, prose(EN, 9), "en")]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, lang, f"src{(i or 0) % 4}", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "unseen words of an item that nobody copies anywhere at all")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item


def test_stages(spark, folder):
    path, docs, item = folder
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{path}/documents.parquet")
    want = [(i, passes(t or "")[1], lang) for i, t, lang in docs if passes(t or "")[0]]

    now = stages["quality"](spark, now, path).cache()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.lang)) for r in now.collect())
    assert not {150, 151, 152, 153, 155} & {r.doc_id for r in now.collect()} and 154 in {r.doc_id for r in now.collect()}

    now = stages["language"](spark, now, path).cache()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.lang)) for r in now.collect())

    now = stages["near_copies"](spark, now, path).cache()
    sets = {}
    for i, t, _ in want:
        w = t.lower().encode().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(i for i in sets if i is not None)
    for x in ids:
        for y in ids:
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                root[max(find(x), find(y))] = min(find(x), find(y))
    kept = sorted([i for i in ids if find(i) == i]) + [None]
    assert sorted([r.doc_id for r in now.collect()], key=lambda i: (i is None, i)) == kept and not set(range(100, 108)) & set(kept)

    now = stages["benchmark_free"](spark, now, path).cache()
    assert [i for i in kept if i not in range(140, 144)] == sorted([r.doc_id for r in now.collect()], key=lambda i: (i is None, i))
    assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_paths()[0])
    texts = {r.doc_id: r.text for r in now.collect()}
    pieces = {}
    for r in stages["packed"](spark, now, path).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        assert sum((r.ids for r in sorted(pieces[i], key=lambda r: r.start)), []) == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_rows_with_null_or_shared_ids(spark, folder):
    path, docs, item = folder
    stages = dict(corpus_pipeline.STAGES)
    a, b = docs[1][1], docs[2][1]
    rows = [(None, b + "\n" + item), (7, b), (7, a + "\n" + item), (8, a), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, kept string")
    out = stages["benchmark_free"](spark, df, path)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(7, b), (8, a), (9, "")]) and out.columns == corpus_pipeline.COLUMNS


def test_stages_of_no_rows_and_clashing_columns(spark, folder):
    path, docs, _ = folder
    extra = ["kept", "language", "cleaned_text", "row", "ids", "root", "bucket", "id"]
    full = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit("own") for c in extra}).limit(20)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, full.limit(0), path)
        assert out.count() == 0, name
        assert stage(spark, full, path).count() > 0, name
        if name != "packed":
            assert out.columns == corpus_pipeline.COLUMNS


def test_run_equals_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() > 0 and {"doc_id", "ids", "sequence_id"} <= set(out.columns)


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_query(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert rows
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "conversations"):
            con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        rel = con.sql(queries.ORACLES[name])
        at = [rel.columns.index(c) for c in columns]
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
