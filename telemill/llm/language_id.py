"""Language of texts by Bayesian fusion of evidence.

posterior(language) ~ likelihood(text)^tau x P(declared markup language | language) x P(address suffix | language)
x P(language | host).

* Text likelihood: counts of hashed byte trigrams under one multinomial per declared language, however many there are,
  each fitted on about ``sample_texts`` distinct texts (all of them if fewer; the only bounded part). Declared values
  count by their primary subtag (en-US and en_GB as en). A further class "und" has the uniform
  distribution, so text that fits no language better than chance is not forced into one; it starts from long odds
  (``und_odds``), so a number or key inside a short text doesn't decide.
* Host priors are computed by grouped aggregation over all rows: the languages that texts of a host show by
  themselves, smoothed towards those of its domain (see ``domain_of``; left out for a host that is its own domain), and
  these towards those of all rows.
* Declared languages and suffixes count with fixed trust, as rows may claim what they like.

Two scans score texts (one for the priors, one for the verdict), so no text is shuffled. Host priors are joined by
broadcast only while there are at most ``broadcast_hosts`` hosts (of 64 languages; fewer of more), else by a shuffle that adaptive execution may split.

Defined cases: a null, empty or wordless text has no text evidence, its language is "und" and it is not kept; null
declared languages, addresses and hosts give no evidence (null hosts share one prior); repeated rows are judged each;
of equal posteriors the language first in the alphabet counts; with no labelled row at all every language is "und"; a
very long text is counted whole; an empty table gives no rows; extra columns stay, result columns replace those of
their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.names import spare
from telemill.session import materialize

_BUCKETS = 4096
# Country suffixes with one main written language, that language by its code, and labels registries sell under.
SUFFIXES = {
    "al": "sq", "ar": "es", "at": "de", "bg": "bg", "bo": "es", "br": "pt", "by": "ru", "cl": "es", "cn": "zh", "co": "es", "cr": "es", "cu": "es", "cz": "cs", "de": "de",
    "dk": "da", "do": "es", "ec": "es", "ee": "et", "eg": "ar", "es": "es", "fi": "fi", "fr": "fr", "gr": "el", "gt": "es", "hk": "zh", "hr": "hr", "hu": "hu", "id": "id",
    "ie": "en", "il": "he", "ir": "fa", "is": "is", "it": "it", "jp": "ja", "kr": "ko", "li": "de", "lt": "lt", "lv": "lv", "ma": "ar", "mx": "es", "nl": "nl", "no": "no",
    "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "py": "es", "ro": "ro", "rs": "sr", "ru": "ru", "sa": "ar", "se": "sv", "si": "sl", "sk": "sk", "th": "th", "tr": "tr",
    "tw": "zh", "ua": "uk", "uk": "en", "us": "en", "uy": "es", "ve": "es", "vn": "vi", "au": "en",
}
_SOLD = ("ac", "co", "com", "edu", "go", "gob", "gov", "ne", "net", "or", "org")
UND = "und"


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed trigrams of letters (bytes, ASCII lowered; runs of other bytes as one blank), a row for each text."""
    out = np.zeros((len(texts), _BUCKETS), np.float32)
    table = np.full(256, 32, np.uint32)
    for b in [*range(97, 123), *range(128, 256)]:
        table[b] = b
    for i, text in enumerate(texts):
        codes = table[np.frombuffer(b" " + text.lower() + b" ", np.uint8)]
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        if len(codes) >= 3:
            grams = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
            out[i] = np.bincount((grams ^ (grams >> np.uint32(15))) & np.uint32(_BUCKETS - 1), minlength=_BUCKETS)
    return out


def primary(declared: Column) -> Column:
    """The primary subtag of a declared language in lower case; null if there is none."""
    tag = F.lower(F.trim(F.substring_index(F.translate(declared, "_", "-"), "-", 1)))
    return F.when(~tag.isin("", UND), tag)


def fit_languages(docs: DataFrame, text: str, declared: str, sample_texts: int) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (languages + 1 rows, the last for "und") from about ``sample_texts`` distinct texts of each."""
    labelled = docs.select(F.col(text).alias("text"), primary(F.col(declared)).alias("lang"), F.xxhash64(text).alias("h")).where("lang is not null and text is not null")
    of = materialize(labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")), "languages")
    share = of.select("lang", F.least(F.lit(1.0), sample_texts / F.col("texts")).alias("share"))
    share = F.broadcast(share) if of.count() <= 100_000 else share
    picked = labelled.join(share, "lang").where(F.pmod("h", F.lit(1 << 30)) <= F.col("share") * (1 << 30))
    picked = picked.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                sums = np.zeros(_BUCKETS)
                for at in range(0, len(own), 256):
                    sums += trigram_counts([t.encode() for t in own["text"].iloc[at : at + 256]]).sum(0)
                yield pd.DataFrame({"lang": lang, "bucket": np.arange(_BUCKETS), "c": sums})

    sums = picked.mapInPandas(run, "lang string, bucket int, c double").groupBy("lang", "bucket").agg(F.sum("c").alias("c"))
    found = sums.where("c > 0 or bucket = 0").toArrow()
    names, at = np.unique(np.array(found["lang"].to_pylist(), dtype=object).astype(str), return_inverse=True)
    counts = np.full((len(names), _BUCKETS), 0.5)
    counts[at, found["bucket"].to_numpy()] += found["c"].to_numpy()
    logs = np.log(counts / counts.sum(1, keepdims=True))
    return names.tolist(), np.vstack([logs, np.full((1, _BUCKETS), -np.log(_BUCKETS))])


def _score(docs: DataFrame, text: str, logs: np.ndarray) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(logs.T.astype(np.float32))

    @F.pandas_udf("array<double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for at in range(0, len(part), 256):
                counts = trigram_counts([(t or "").encode() for t in part.iloc[at : at + 256]])
                out += list((counts @ shared.value).astype(np.float64))
            yield pd.Series(out, index=part.index)

    return score(F.col(text))


def host_of(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels; three where the last but one is a registry's (example.co.uk)."""
    sold = F.element_at(F.split(host, "\\."), -2).isin(*_SOLD) & (F.length(F.substring_index(host, ".", -1)) == 2)
    return F.when((F.size(F.split(host, "\\.")) > 2) & sold, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def declared_language(page: Column) -> Column:
    """The language that the html element of a page declares; empty if none."""
    return F.regexp_extract(page, "(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z-]+)", 1)


def visible_text(page: Column) -> Column:
    """A page without scripts, styles, comments and tags."""
    return F.regexp_replace(page, "(?is)<(script|style)\\b.*?(</\\1\\s*>|\\z)|<!--.*?(-->|\\z)|<[^>]*>", " ")


def _best(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int")


def host_priors(shown: DataFrame, n: int, strength: float) -> DataFrame:
    """host, prior (array of n log probabilities): counts of a host, smoothed by its domain and that by all rows.

    ``shown`` has host, domain, best (1 to n, or null).
    """
    marks = shown.groupBy("host", "domain", "best").agg(F.count("*").cast("double").alias("x"))

    def counts(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        """Arrays of n counts from rows with best and x."""
        entries = F.collect_list(F.when(F.col("best").isNotNull(), F.struct("best", "x")))
        held = rows.groupBy(*by).agg(F.map_from_entries(entries).alias("m"))
        return held.select(*by, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias(name))

    summed = lambda *by: marks.groupBy(*by, "best").agg(F.sum("x").alias("x"))
    hosts, domains, everything = counts(marks, ["host", "domain"], "c"), counts(summed("domain"), ["domain"], "dc"), counts(summed(), [], "ac")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def smooth(own: Column, above: Column) -> Column:
        return F.element_at(F.transform(F.array(total(own)), lambda t: F.zip_with(own, above, lambda x, p: (x + strength * p) / (t + strength))), 1)

    flat = F.array_repeat(F.lit(1.0 / n), n)
    level = everything.select(smooth(F.col("ac"), flat).alias("ap"))
    joined = domains.crossJoin(F.broadcast(level)).select("domain", "ap", smooth(F.col("dc"), F.col("ap")).alias("dp"))
    above = F.when(F.coalesce("host", F.lit("")) == F.col("domain"), F.col("ap")).otherwise(F.col("dp"))
    prior = smooth(F.col("c"), F.col("above"))
    named = hosts.withColumn("domain", F.coalesce("domain", F.lit(""))).join(joined.withColumn("domain", F.coalesce("domain", F.lit(""))), "domain")
    return named.withColumn("above", above).select(F.coalesce("host", F.lit("")).alias("host"), F.transform(prior, lambda p: F.log(p)).alias("prior"))


def identify(docs: DataFrame, text: str = "text", declared: str | None = None, address: str | None = None, host: str | None = None, model: tuple[list[str], np.ndarray] | None = None, sample_texts: int = 5_000, tau: float = 0.3, declared_trust: float = 0.9, suffix_trust: float = 0.7, prior_strength: float = 20.0, und_odds: float = 1e-3, min_confidence: float = 0.5, broadcast_hosts: int = 100_000) -> DataFrame:
    """The rows with language, confidence, text_language (by the text alone) and kept (a language is found with confidence)."""
    languages, logs = model or fit_languages(docs, text, declared, sample_texts)
    names = [*languages, UND]
    n = len(names)
    places = [*([F.col(host)] if host else []), *([F.nullif(host_of(F.col(address)), F.lit(""))] if address else [])]
    place = F.coalesce(*places) if places else F.lit(None).cast("string")
    ll, own_host, prior_host, prior, z, top = (spare(docs, x) for x in ("ll", "own_host", "prior_host", "prior", "z", "top"))
    scored = docs.withColumn(ll, _score(docs, text, logs)).withColumn(own_host, F.coalesce(F.lower(place), F.lit("")))
    shown = scored.select(F.col(own_host).alias("host"), domain_of(F.col(own_host)).alias("domain"), F.when(F.array_max(ll) < 0, _best(F.col(ll))).alias("best"))
    priors = host_priors(shown, n, prior_strength)
    priors = materialize(priors, "host-priors")
    small = priors.count() * n <= broadcast_hosts * 64
    priors = priors.select(F.col("host").alias(prior_host), F.col("prior").alias(prior))
    joined = scored.join(F.broadcast(priors) if small else priors, F.col(own_host) == F.col(prior_host), "left")

    name = F.lit(names)

    def evidence(value: Column, trust: float) -> Column:
        """Log weight of a claimed language; nothing where the claim is unknown."""
        rest = float(np.log((1 - trust) / max(1, n - 1)))
        some = F.transform(name, lambda x: F.when(x == value, F.lit(float(np.log(trust)))).otherwise(F.lit(rest)))
        return F.when(F.array_contains(F.lit(languages).cast("array<string>"), value), some).otherwise(F.array_repeat(F.lit(0.0), n))

    claims = []
    if declared:
        claims.append(evidence(primary(F.col(declared)), declared_trust))
    if address:
        suffix = F.substring_index(host_of(F.col(address)), ".", -1)
        tongue = F.coalesce(*[F.when(suffix == s, F.lit(x)) for s, x in SUFFIXES.items()])
        claims.append(evidence(tongue, suffix_trust))
    logit = F.zip_with(F.transform(ll, lambda x: x * tau), F.col(prior), lambda a, b: a + b)
    claims.append(F.lit([0.0] * (n - 1) + [float(np.log(und_odds))]))
    for claim in claims:
        logit = F.zip_with(logit, claim, lambda a, b: a + b)
    fused = joined.withColumn(z, logit).withColumn(top, F.array_max(z))
    weight = F.aggregate(F.transform(z, lambda x: F.exp(x - F.col(top))), F.lit(0.0), lambda a, x: a + x)
    has_text = F.array_max(ll) < 0
    return (
        fused.withColumn("language", F.when(has_text, F.element_at(name, _best(F.col(z)))).otherwise(UND))
        .withColumn("confidence", F.when(has_text, 1 / weight).otherwise(0.0))
        .withColumn("text_language", F.when(has_text, F.element_at(name, _best(F.col(ll)))).otherwise(UND))
        .withColumn("kept", (F.col("language") != UND) & (F.col("confidence") >= min_confidence))
        .drop(ll, own_host, z, top, prior_host, prior)
    )
