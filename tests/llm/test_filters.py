import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.llm import chat_format, decontaminate, html_blocks, language_id, page_table, quality_rules

TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a a a a a a", "x y z\nx y z\nx y z\n\n", "The cat sat. " * 30, "| a | b | c |\n" * 30, "q\x0bw e\x1cr t y\r\nend.",
    "é ü " * 4000 + ".", "<|im_end|> % $ # *", "w " * 60 + "\nNo mark here\nAll rights reserved by us.\nThis line is a good one that stays.",
]


def repeats(w):
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    return len({p for i, x in enumerate(g) if c[x] > 1 for p in (i, i + 1, i + 2)})


def test_quality_counts(spark):
    rnd = random.Random(2)
    texts = TEXTS + [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 3) for _ in range(rnd.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality_rules.judge(df).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))), t[:50]
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats(w)), t[:50]
        assert r.base_failed == (len(w) < 50 or 100 * repeats(w) > 50 * len(w))
    last = quality_rules.judge(df).where("doc_id = 12").collect()[0]
    assert last.cleaned_text == "This line is a good one that stays."
    assert quality_rules.judge(df.limit(0)).count() == 0


SCRIPTS = {
    "ar": "ذهب الولد رقم إلى المدرسة في الصباح الباكر؟",
    "ur": "لڑکا نمبر صبح سویرے اسکول گیا تھا۔",
    "he": "הילד מספר הלך לבית הספר בבוקר מוקדם.",
    "hi": "लड़का संख्या सुबह जल्दी विद्यालय गया था।",
    "ko": "소년 번은 아침 일찍 학교에 갔습니다.",
    "th": "เด็กชายคนที่ ไปโรงเรียนแต่เช้า และ กลับบ้านตอนเย็น พร้อมเพื่อน",
    "zh": "第 个 男孩 早上 去 学校。 他 晚上 回家 了",
}


def test_quality_of_other_scripts(spark):
    body = lambda s: "\n".join(" ".join(f"{i}{w}" for w in s.split(" ")) for i in range(12))
    rows = [*((k, body(s)) for k, s in SCRIPTS.items()), ("acronym", body("NASA " + SCRIPTS["ar"]))]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for k, t in rows:
        assert (got[k].n_lines_removed, got[k].lost_share, got[k].cleaned_text, got[k].kept) == (0, 0.0, t, True), k
    bad = ["BUY ALL OF IT NOW.", "12 34 56.", "القائمة الرئيسية", "मुख्य पृष्ठ", "Home of ไทย news", "BUY NOW 한국 ONLY HERE."]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "doc_id int, text string")
    assert {r.text for r in quality_rules.clean_lines(lines).where("n_lines_removed = 0").collect()} == set()


def test_quality_of_other_scripts_against_sql(spark, tmp_path):
    import duckdb

    from telemill.llm import queries

    body = lambda s, n=12: "\n".join(" ".join(f"{i}{w}" for w in s.split(" ")) for i in range(n))
    bad = ["BUY ALL OF IT NOW.", "12 34 56.", "القائمة الرئيسية", "मुख्य पृष्ठ", "Home of ไทย news", "BUY NOW 한국 ONLY HERE.", "2ª 3º EN LA.", "ไทย ไทย ไทย", "他来了。他走了"]
    texts = [body(s, n) for s in SCRIPTS.values() for n in (3, 12)] + [body(a) + "\n" + "\n".join([b] * 9) for a in SCRIPTS.values() for b in bad] + [body(b, 30) for b in bad] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op10_quality_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op10_quality_rules"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert len({r.kept for r in got.collect()}) == 2


def test_chat_parts_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nno", "<!|x", "<!!!|", "<", "|>", "a\n\nb", None, "", "%0A%25", "é😀"]
    rows = [(i // 3, i % 3, ["user", "assistant", "odd\nrole%"][i % 3], t, 0) for i, t in enumerate(texts * 3)] + [(0, 1, "assistant", "tie", 0), (None, 0, None, "n", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted int").withColumn("parts", chat_format.text_part(F.col("text")))
    out = chat_format.format_chats(df).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    want = {}
    for c, n, role, t, _ in sorted(rows, key=lambda r: (r[0] or -1, r[1], r[2] or "")):
        want.setdefault(c, []).append((role or "", t or ""))
    for c, turns in want.items():
        assert [tuple(x) for x in got[c].turns] == turns
        assert got[c].loss == "".join(t for role, t in turns if role == "assistant")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_attachments(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), ("text", "<|image|>", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn int, role string, parts {chat_format.PARTS}")
    r = chat_format.format_chats(df).collect()[0]
    assert r.formatted == "<|im_start|>user\nsee <|image|><|audio|><|document|><!|image|><|im_end|>\n"
    assert [(a.type, a.ref, a.n_tokens) for a in r.attachments] == [("image", "i.png", 4), ("audio", "a.wav", 25), ("document", "d.pdf", 768)]
    assert r.n_tokens_expanded == 797 and r.loss_spans == []


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_contamination_against_brute_force(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice(["the", "of", f"w{rnd.randrange(40)}", "É1"]) for _ in range(rnd.choice([1, 2, 3, 9, 10, 11, 30])))) for i in range(25)]
    items += [(90, None), (91, "..."), (92, items[3][1]), (None, "the of the"), (3, "extra words of item three")]
    docs = []
    for d in range(120):
        body = [rnd.choice(["the", "of", f"w{rnd.randrange(40)}", "z"]) for _ in range(rnd.randrange(60))]
        if d % 3 == 0:
            at = rnd.randrange(len(body) + 1)
            piece = words(items[rnd.randrange(25)][1])
            body[at:at] = piece[rnd.randrange(3) :] * rnd.choice([1, 2])
        docs.append((d, rnd.choice([" ", ", ", "-"]).join(body).upper()))
    docs += [(500, None), (501, ""), (502, items[6][1] + "x"), (503, items[6][1])] + [(504, "the of the " * 3000)]
    got = {}
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 22, 0):
        got = {r.doc_id: r for r in decontaminate.contamination(frame, bench, broadcast_limit=limit).collect()}
        for d, t in docs:
            w, hit, held = words(t), set(), set()
            index = {}
            for n in {min(10, len(words(x))) for _, x in items if words(x)}:
                for i in range(len(w) - n + 1):
                    index.setdefault(tuple(w[i : i + n]), []).append(i)
            for item, x in items:
                v = words(x)
                n = min(10, len(v))
                for j in range(len(v) - n + 1 if v and item is not None else 0):
                    for i in index.get(tuple(v[j : j + n]), []):
                        hit.update(range(i, i + n))
                        held.add(str(item))
            r = got[d]
            assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(held), bool(hit)), d
    assert not any(r.contaminated for r in decontaminate.contamination(frame, bench.limit(0)).collect())
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header>
<p>First   <b>bold</b>\n text of a paragraph&nbsp;here.<p>Second one<br>after break, long enough to read as prose in the page.</p><div class="ad">Buy</div></article>
<!-- <p>hidden</p> --><section class=comments><p>First!</p></section><form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""


def test_page_text(spark):
    pages = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>unclosed <script>x"), (5, "u", PAGE), (6, "u", "<article><p>cut off in a tag <a hre"), (7, "u", "a < b and c > d " * 5)]
    got = {r.page_id: r.text for r in html_blocks.extract_text(spark.createDataFrame([(*p, 3) for p in pages], "page_id long, url string, html string, text int")).collect()}
    assert got[1] == "Head & line\n\nFirst bold text of a paragraph here.\n\nSecond one after break, long enough to read as prose in the page." == got[5]
    assert got[2] == got[3] == "" and got[6] == "cut off in a tag"
    assert html_blocks.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_that_only_look_like_furniture(spark):
    tree = html_blocks.default_tree(spark)
    page = """<body class="has-sidebar nav-open"><div class="layout no-ads"><div role=main><div class="post-header"><h1>The head of it</h1></div><p>One line.</p>
    <div class="share-buttons">Share</div><aside>Aside words</aside></div><div id=sidebar-left><p>Side</p></div><div role="navigation">Go</div></div></body>"""
    assert html_blocks.main_text(page, tree) == "The head of it\n\nOne line."


def test_wrappers_with_furniture_words(spark):
    tree = html_blocks.default_tree(spark)
    long = ["The first paragraph has a good number of plain words to read in it.", "Another one follows with as many words that belong to the text of the page."]
    prose = "".join(f"<p>{x}</p>" for x in long)
    side = "<div class=sidebar><p>Popular on this site right now</p></div><div id=footer>Contact us by mail</div>"
    widget = '<div class="elementor-widget elementor-widget-{}"><div class="elementor-widget-container">{}</div></div>'
    pages = [
        f"<div class=content-sidebar-wrap><main>{prose}</main>{side}</div>",
        f"<div class=content-sidebar-wrap><article>{prose}</article>{side}</div>",
        f"<div class=content-sidebar-wrap><div class=entry>{prose}</div>{side}</div>",
        f'<div class="layout sidebar-left"><div>{prose}</div><div id=sidebar-left-box class=sidebar><p>Popular</p></div></div>',
        f'<div class="page-with-sidebar"><div>{prose}</div></div>',
        f"<div class=header><div role=main>{prose}</div></div>",
        "".join(widget.format("text-editor", f"<p>{x}</p>") for x in long) + widget.format("nav-menu", "<a href=/>Home</a> <a href=/n>News</a>"),
    ]
    for page in pages:
        assert html_blocks.main_text(f"<body><nav><a href=/>Home</a></nav>{page}</body>", tree) == "\n\n".join(long), page
    entries = f'<div id=comments class=comments-area><article class="comment-body"><p>{long[0]}</p></article></div>'
    assert html_blocks.main_text(f"<article>{prose}</article>{entries}", tree) == "\n\n".join(long)


def test_tree_on_pages_not_seen(spark):
    table = html_blocks.labelled_table(spark)
    assert table.count() >= 300
    tree = html_blocks.fit_tree(table)
    assert len({x[0] for x in tree if x[0] >= 0}) >= 8
    marks = {html_blocks.FEATURES.index(x) for x in ("furniture", "named")}
    alike = hits = wrong = missed = 0
    for *vector, label in html_blocks.table_rows(page_table.pages(4242, 300)):
        main = html_blocks.is_main(tree, tuple(vector))
        hits, wrong, missed = hits + (main and label == 1), wrong + (main and label == 0), missed + (not main and label == 1)
        alike += main == (not any(vector[i] for i in marks))
    assert 2 * hits / (2 * hits + wrong + missed) > 0.92
    assert alike < 0.97 * sum(1 for _ in html_blocks.table_rows(page_table.pages(4242, 300)))


def test_blocks_without_names(spark):
    tree = html_blocks.default_tree(spark)
    prose = [f"Paragraph {i} of the piece has some plain words, and then a few more of them to end with." for i in range(5)]
    body = "".join(f"<p>{x}</p>" for x in prose)
    cases = [
        (f"<article><h1>The title</h1>{body}</article><div>All rights reserved 2020 Example Company of things</div>", ["The title", *prose]),
        (f"<article><h1>The title</h1>{body}</article><div><p>I think this is a great piece, thank you for it.</p></div>", ["The title", *prose]),
        (f"<article>{body}<div class='search-history'><p>{prose[0]} {prose[1]}</p></div>{body}</article>", [*prose, f"{prose[0]} {prose[1]}", *prose]),
        (f"<article>{body}<section id='related-work'><h2>Related work</h2><p>{prose[2]} {prose[0]}</p></section>{body}</article>", [*prose, "Related work", f"{prose[2]} {prose[0]}", *prose]),
    ]
    for page, want in cases:
        assert html_blocks.main_text(f"<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>{page}</body>", tree) == "\n\n".join(want), page


def sentences(n):
    rnd = random.Random(n)
    words = "the old bridge over a river was closed to lorries and many people in town had asked for new work which should begin in spring".split()
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(18, 40))).capitalize() + "." for _ in range(n)]


@pytest.mark.parametrize("mark", ["class=byline", "class=tags", "class=share", "role=navigation", "hidden", "style='display:none'"])
@pytest.mark.parametrize("end", ["</p>", ""])
def test_paragraphs_with_telling_names_end(spark, mark, end):
    body = sentences(4)
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>A new bridge</h1><p {mark}><span class=share>Share it</span> all{end}" + "".join(f"<p>{x}</p>" for x in body) + "</article></body>"
    assert html_blocks.main_text(page, html_blocks.default_tree(spark)) == "\n\n".join(["A new bridge", *body])


@pytest.mark.parametrize("cell", ["<div>{}</div>", "<div class=row><p>{}</p></div>", "<p>{}"])
@pytest.mark.parametrize("n", [6, 60])
def test_late_paragraphs_of_flat_pages_stay(spark, cell, n):
    body = sentences(n)
    page = "<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><h1>A new bridge</h1>" + "".join(cell.format(x) for x in body) + "</body>"
    assert html_blocks.main_text(page, html_blocks.default_tree(spark)) == "\n\n".join(["A new bridge", *body])


def test_the_tree_uses_the_links_of_neighbours(spark):
    used = {html_blocks.FEATURES[node[0]] for node in html_blocks.default_tree(spark) if node[0] >= 0}
    assert {"words", "links", "near_words", "named"} <= used and used & {"prev_links", "next_links"}


def test_columns_named_like_helpers(spark):
    rows = spark.createDataFrame([(1, "<p>" + sentences(1)[0], "a")], "page_id long, html string, _page string")
    assert html_blocks.extract_text(rows).columns == ["page_id", "_page", "text"]


def test_a_very_long_page(spark):
    page = "<article>" + "".join(f"<p>Sentence number {i} of the page, with some more words.</p>" for i in range(60_000)) + "</article><footer>End</footer>"
    text = html_blocks.extract_text(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()[0].text
    assert text.startswith("Sentence number 0 ") and text.endswith("59999 of the page, with some more words.") and text.count("\n\n") == 59_999


EN, DE = "the quick house of the and with that there is not for which", "der das und nicht mit einer schule über wir haben auch noch"


def corpus(spark):
    rnd, rows = random.Random(9), []
    for i in range(300):
        lang = ["en", "de"][i % 2]
        w = (EN if lang == "en" else DE).split()
        rows.append((i, " ".join(rnd.choice(w) for _ in range(40)), lang if i % 10 else ["de", "en"][i % 2], f"http://h{i % 2}.example.{'de' if i % 2 else 'uk'}/x", lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, url string, truth string")


def test_language_against_labels(spark):
    df = corpus(spark)
    more = spark.createDataFrame([(900, None, "en", None, None), (901, "", None, None, None), (902, "123 456 !!", "de", "x", None), (903, "0x" * 5000, None, None, None), (904, "über", None, "http://h1.example.de/", None)], df.schema)
    got = {r.doc_id: r for r in language_id.identify(df.unionByName(more), declared="lang", address="url").collect()}
    assert all(r.language == r.truth and r.kept for r in got.values() if r.truth)
    assert not any(got[i].kept for i in (900, 901, 902)) and got[900].language == "und"
    assert got[904].language == "de"
    clashing = df.limit(5).withColumns({c: F.lit("own") for c in ("host", "prior", "language", "kept")})
    row = language_id.identify(clashing, declared="lang", host="host").collect()[0]
    assert (row.host, row.prior) == ("own", "own") and row.language in ("en", "de") and row.kept is True
    assert language_id.identify(df.limit(0), declared="lang").count() == 0


def test_host_prior_decides_thin_texts(spark):
    shown = spark.createDataFrame([("a.x.org", "x.org", 1)] * 30 + [("b.x.org", "x.org", 2)] + [("c.y.org", "y.org", 2)] * 5 + [("", "", None)], "host string, domain string, best int")
    got = {r.host: r.prior for r in language_id.host_priors(shown, 2, 5.0).collect()}
    assert got["a.x.org"][0] > got["b.x.org"][0] > got["c.y.org"][0]
    assert got[""] and abs(sum(2.718281828459045**p for p in got["b.x.org"]) - 1) < 1e-9


def test_posterior_against_plain_python(spark):
    rnd = random.Random(21)
    rows = [(r.doc_id, r.text, r.lang, r.url) for r in corpus(spark).collect()]
    rows = [(i, " ".join(t.split()[: rnd.choice([1, 2, 40])]), rnd.choice([lang, None, "de-AT"]), rnd.choice([u, None, "https://shop.b.co.uk/x", "http://plain.fr"])) for i, t, lang, u in rows]
    rows += [(1000, None, "en", "http://h1.example.de"), (1001, "und", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string")
    model = language_id.fit_languages(df, "text", "lang", 5000)
    names = [*model[0], "und"]
    n = len(names)
    scores = {i: language_id.trigram_counts([(t or "").encode()])[0].astype(float) @ model[1].astype(np.float32).T.astype(float) for i, t, _, _ in rows}
    host = {i: re.sub("^https?://|/.*", "", u or "") for i, _, _, u in rows}

    def domain(h):
        p = h.split(".")
        return ".".join(p[-3:] if len(p) > 2 and p[-2] == "co" and len(p[-1]) == 2 else p[-2:])

    shown = {i: int(np.argmax(s)) for i, s in scores.items() if s.max() < 0}
    count = lambda keep: np.bincount([b for i, b in shown.items() if keep(host[i])], minlength=n).astype(float)
    smooth = lambda own, above: (own + 20 * above) / (own.sum() + 20)
    overall = smooth(count(lambda h: True), np.full(n, 1 / n))

    def prior(h):
        above = overall if h == domain(h) else smooth(count(lambda x: domain(x) == domain(h)), overall)
        return smooth(count(lambda x: x == h), above)

    got = {r.doc_id: r for r in language_id.identify(df, declared="lang", address="url", model=model).collect()}
    for i, _, lang, _ in rows:
        z = 0.3 * scores[i] + np.log(prior(host[i]))
        suffix = language_id.SUFFIXES.get(host[i].rsplit(".", 1)[-1])
        for claim, trust in (((lang or "").split("-")[0], 0.9), (suffix, 0.7)):
            if claim in model[0]:
                z += np.log([trust if x == claim else (1 - trust) / (n - 1) for x in names])
        z[-1] += np.log(1e-3)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        want = (names[int(np.argmax(z))], p.max()) if i in shown else ("und", 0.0)
        assert got[i].language == want[0] and abs(got[i].confidence - want[1]) < 1e-4, i


def test_markup_of_pages(spark):
    pages = ['<!DOCTYPE html><HTML class=x lang="de-AT"><script>var no="the"</script><p>das <b>Haus</b><!-- the --></p>', "<html lang=fr><p>la", "<p>none", None, "<style>x"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    got = df.select("page_id", language_id.declared_language(F.col("html")).alias("l"), language_id.visible_text(F.col("html")).alias("t")).orderBy("page_id").collect()
    assert [(r.l, (r.t or "").split()) for r in got] == [("de-AT", ["das", "Haus"]), ("fr", ["la"]), ("", ["none"]), (None, []), ("", [])]
    hosts = spark.createDataFrame([("www.a.co.uk",), ("a.b.org",), ("co.uk",), ("x",), ("",)], "h string")
    assert [r[0] for r in hosts.select(language_id.domain_of(F.col("h"))).collect()] == ["a.co.uk", "b.org", "co.uk", "x", ""]


def test_every_declared_language_is_a_class(spark):
    rnd, rows = random.Random(11), []
    for k in range(80):
        own = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(20)]
        rows += [(" ".join(rnd.choice(own) for _ in range(40)), [f"x{k:02}", f"X{k:02}-US", f"x{k:02}_GB"][i % 3], f"x{k:02}") for i in range(6)]
    frame = spark.createDataFrame(rows, "text string, lang string, truth string")
    got = language_id.identify(frame, declared="lang").collect()
    assert len(got) == len(rows) and all(r.language == r.text_language == r.truth and r.kept for r in got)


def test_sample_is_by_language_and_distinct_text(spark):
    rnd = random.Random(12)
    body = lambda w: " ".join(rnd.choice(w.split()) for _ in range(40))
    many = [(body(EN), "en") for _ in range(1500)] + [("the same page of numbers zzz", "en")] * 1500
    few = [(body(DE), "de") for _ in range(15)]
    frame = spark.createDataFrame(many + few, "text string, lang string")
    languages, logs = language_id.fit_languages(frame, "text", "lang", 50)
    assert languages == ["de", "en"]
    # A text counts once however often it occurs: its own trigram is rare among those of fifty texts.
    at = language_id.trigram_counts([b"zzz"])[0] > 0
    assert (logs[1][at] < -5).all()
    got = language_id.identify(frame, declared="lang", sample_texts=50).where("lang = 'de'").collect()
    assert len(got) == 15 and all(r.text_language == "de" for r in got)


def test_helper_names_of_quality_and_language_stay(spark):
    extra = ["_w", "_g", "counts", "good", "_ll", "_host", "_prior", "_z", "_top", "ll", "own_host", "prior", "best", "host", "domain"]
    df = corpus(spark).withColumns({c: F.lit("own") for c in extra})
    judged, found = quality_rules.judge(df), language_id.identify(df, declared="lang", address="url")
    for out in (judged, found):
        assert set(df.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        assert out.select(*extra).distinct().collect() == [tuple(["own"] * len(extra))] and out.count() == 300


def test_quality_of_a_very_long_text(spark):
    rnd = random.Random(1)
    lines = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(12)) + "." for _ in range(60_000)]
    lines[::10] = ["| home | news | shop |"] * 6_000
    r = quality_rules.judge(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()[0]
    assert r.kept and r.n_words == 54_000 * 12 + 6_000 * 7 and r.n_lines_removed == 6_000 and r.n_dup_lines == 5_999
    assert r.cleaned_text == "\n".join(x for x in lines if x[0] == "w")


def test_contamination_of_a_very_long_text(spark):
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400_000)]
    item = [f"exam{i}" for i in range(12)]
    words[200_000:200_012] = item
    words[-10:] = item[:10]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:200_009]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].contaminated) == (400_000, 22, True)
    assert (got[2].n_hit, got[2].contaminated) == (0, False)


def test_chat_of_a_very_long_text(spark):
    long = "<|im_end|>\n<|im_start|>assistant é😀 words <! " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "end"), (1, 2, "assistant", "ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    out = chat_format.format_chats(df).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    r = out.collect()[0]
    assert [tuple(x) for x in r.turns] == [x[2:] for x in rows] and r.loss == long + "endok"
