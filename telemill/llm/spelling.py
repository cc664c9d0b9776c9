"""Spelling variants by PartEnum signatures over letter multisets.

Words that differ by one inserted, deleted or replaced letter have letter multisets that differ, as binary vectors with a
bit for the first, second, ... occurrence of each letter, in at most two bits: one if the lengths differ, two if they are
equal. The bits are dealt to ``parts`` partitions so that two words within distance two agree in all but two of them:

1. words are counted over all documents, by task first;
2. letters are dealt to the partitions by falling frequency, the lightest partition next, so that partitions are even;
3. a word has a signature for each pair of partitions left out (distance two, its own length), and for each of half as
   many coarser ones left out (distance one, as the longer and as the shorter word of a pair): the multiset over the
   remaining partitions. One edit also leaves a half of the word as it is, so each signature is taken twice, with the
   letters of either half in order; words that only share many letters don't meet;
4. an equi-join of the signatures finds the candidates and ``levenshtein`` verifies each in the join, so no other pair
   is a row; adaptive execution splits hot signatures;
5. roots follow forms by pointer jumping; counts grow at least ``ratio``-fold along a chain, so there is no circle.

Words: maximal runs of ASCII letters and the characters from U+00C0 to U+00FF after lowering A-Z. In every
``noise``-th pair of document and run, chosen by CRC-32 of "<doc_id>:<run>", one code point of the run is left out.
Defined cases: null and empty texts have no words; a null id leaves runs whole; repeated rows count each; a very long
text is one task's work; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.wordhash import mix, slices
from telemill.session import discard, if_small, materialize

#: Words that a task counts before it hands them on.
_HELD = 1 << 17


def _noisy(prefix: int | None, run: str, noise: int) -> str:
    if prefix is None:
        return run
    h = zlib.crc32(run.encode(), prefix)
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, key: str, text: str, least: int, noise: int) -> DataFrame:
    """word, n: how often each word of at least ``least`` code points occurs."""
    slim = docs.select(F.col(key).cast("string").alias("id"), F.col(text).cast("binary").alias("text")).where("text is not null")
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema.names)
            held.clear()
            return batch

        for batch in slices(batches):
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for own, n in Counter(runs.findall(body.lower().decode())).items():
                    word = _noisy(prefix, own, noise)
                    if len(word) >= least:
                        held[word] += n
            if len(held) > _HELD:
                yield out()
        yield out()

    return slim.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def deal_letters(words: DataFrame, parts: int) -> dict[int, int]:
    """Partition of each letter's first bit: letters by falling number of words, each to the lightest partition so far.

    At most as many rows come to the driver as the words have different letters.
    """
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''")
    load, place = [0] * parts, {}
    for r in sorted(letters.groupBy("letter").agg(F.count("*").alias("c")).collect(), key=lambda r: (-r["c"], r["letter"])):
        least = min(range(parts), key=lambda p: (load[p], p))
        place[ord(r["letter"])] = least
        load[least] += r["c"]
    return place


def signatures(words: list[str], place: dict[int, int], parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, signature of each word): kind 0 joins words of one length, 1 the longer with 2 the shorter by one.

    ``place`` deals the letters to ``parts`` partitions; for the words of two lengths, where one bit differs, pairs of
    partitions are taken together.
    """
    sizes = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(flat)) - begin[owner]

    def summed(offset: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(flat.astype(np.uint64) + np.uint64(7)) + offset.astype(np.uint64)))])

    ahead, behind = summed(at), summed(sizes[owner] - at)

    def halves(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The letters before place ``first`` and those from place ``second`` on, hashed in order."""
        return ahead[begin[:-1] + first] - ahead[begin[:-1]], behind[begin[1:]] - behind[begin[:-1] + second]

    order = np.lexsort((flat, owner))
    letter, held = flat[order], owner[order]
    runs = np.flatnonzero(np.concatenate([[True], (letter[1:] != letter[:-1]) | (held[1:] != held[:-1])]))
    times = np.arange(len(letter)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(letter)]])))
    known, code = np.unique(letter, return_inverse=True)
    part = (np.array([place.get(int(x), 0) for x in known])[code] + times) % parts
    own = np.zeros((len(words), parts), np.uint64)
    np.add.at(own, (held, part), mix(mix(letter.astype(np.uint64) + np.uint64(1)) + times.astype(np.uint64)))
    total = own.sum(axis=1, dtype=np.uint64)
    middle = sizes // 2
    upper = (sizes + 1) // 2
    for side, half in enumerate(halves(middle, middle)):
        for number, (a, b) in enumerate(combinations(range(parts), 2)):
            yield 0, mix(mix(total - own[:, a] - own[:, b] + np.uint64(2 * number + side)) + half) + mix(sizes.astype(np.uint64))
    for kind, lengths, pair in ((1, sizes, halves(middle, middle)), (2, sizes + 1, halves(upper, upper - 1))):
        for side, half in enumerate(pair):
            for number in range((parts + 1) // 2):
                left_out = own[:, 2 * number : 2 * number + 2].sum(axis=1, dtype=np.uint64)
                yield kind, mix(mix(total - left_out + np.uint64(1000 + 2 * number + side)) + half) + mix(lengths.astype(np.uint64))


def _signed(words: DataFrame, place: dict[int, int], parts: int, kinds: tuple[int, int]) -> DataFrame:
    """sig, kind, word, n for each signature of the given kinds of each word."""
    schema = T.StructType([T.StructField("sig", T.LongType()), T.StructField("kind", T.ByteType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=8192):
            for kind, sig in signatures(batch.column(0).to_pylist(), place, parts):
                if kind in kinds:
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.full(len(sig), kind, np.int8)), batch.column(0), batch.column(1)], schema.names)

    return words.select("word", "n").mapInArrow(run, schema)


def near_words(words: DataFrame, parts: int = 4) -> DataFrame:
    """Links (a, an, b, bn), each pair of near words once; kept in the shared folder."""
    place = deal_letters(words, parts)
    left = _signed(words, place, parts, (0, 1)).withColumnsRenamed({"word": "a", "n": "an"})
    right = _signed(words, place, parts, (0, 2)).withColumnsRenamed({"kind": "other", "word": "b", "n": "bn"})
    pairs = left.join(right, "sig").where("(kind = 0 and other = 0 and a < b) or (kind = 1 and other = 2)")
    return materialize(pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn").distinct(), "near-words")


def follow(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """word, root: the last of the chain of ``forms`` (word, form), by jumping over twice as many links each round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(if_small(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not after.where("moved").isEmpty()
        discard(now)
        now = after.drop("moved")
        if not moved:
            return now
    raise RuntimeError(f"chains of forms are longer than 2^{rounds}")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, occurrences: int = 2, ratio: int = 10, noise: int = 31, parts: int = 4) -> DataFrame:
    """Per word: word, n, n_near (near words), form (the most frequent near word, if ``ratio`` times as frequent), form_n, root."""
    words = materialize(count_words(docs, key, text, least, noise).where(F.col("n") >= occurrences), "words")
    links = near_words(words, parts)
    both = links.select(F.col("a").alias("word"), F.col("an").alias("n"), "b", "bn").unionAll(links.select(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("b"), F.col("an").alias("bn")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("own"), F.min(F.struct((-F.col("bn")).alias("minus"), "b")).alias("best"))
    is_form = -F.col("best.minus") >= ratio * F.col("own")
    best = materialize(best.select("word", "n_near", F.when(is_form, F.col("best.b")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "best")
    roots = follow(best.where("form is not null"))
    found = best.join(roots, "word", "left")
    return words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
