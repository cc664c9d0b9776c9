"""What declared languages and hosts add to thin texts: words of the given documents, with evidence that is partly wrong."""

import os
import random

import pytest

from telemill.llm import language_id

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_evidence_helps_thin_texts(spark):
    """Whole documents and 1, 2, 4 and 8 words of each; a fifth declare nothing, a tenth a wrong language; 20 hosts hold 80 % one language."""
    rnd = random.Random(8)
    docs = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect() if r.text and len(r.text.split()) >= 8]
    langs = sorted({r.lang for r in docs})
    rows = []
    for r in docs:
        for n in (0, 1, 2, 4, 8):
            words = r.text.split()
            at = rnd.randrange(len(words) - n + 1) if n else 0
            said = rnd.random()
            claim = None if said < 0.2 else rnd.choice([x for x in langs if x != r.lang]) if said < 0.3 else r.lang
            home = r.lang if rnd.random() < 0.8 else rnd.choice(langs)
            rows.append((r.doc_id, n, " ".join(words[at : at + n]) if n else r.text, claim, f"h{langs.index(home) * 5 + rnd.randrange(5)}", r.lang))
    df = spark.createDataFrame(rows, "doc_id long, n int, text string, claim string, host string, truth string")
    model = language_id.fit_languages(spark.createDataFrame([(r.text, r.lang) for r in docs], "text string, lang string"), "text", "lang", 5_000)
    right = {}
    for r in language_id.identify(df, declared="claim", host="host", model=model).select("n", "truth", "language", "text_language").collect():
        seen = right.setdefault(r.n, [0, 0, 0])
        seen[0] += 1
        seen[1] += r.text_language == r.truth
        seen[2] += r.language == r.truth
    shares = {n: (round(a / all_, 3), round(b / all_, 3)) for n, (all_, a, b) in sorted(right.items())}
    print(shares)
    assert all(fused >= alone - 0.002 for alone, fused in shares.values())
    assert 1 - shares[1][1] < 0.5 * (1 - shares[1][0])
