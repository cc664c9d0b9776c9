"""Passages that repeat across documents, by seed and extend.

A window is ``window`` consecutive words of one document. A word goes if a window over it also starts in a document
with a smaller id; windows are judged on the input.

1. Anchors: of the ``k``-word grams of a window the one with the smallest hash (the leftmost of equals) is its anchor.
   The choice depends on the window's words alone, so equal windows have equal anchors at equal places, and an anchor
   speaks for a run of windows (21 on average). One scan emits a row for each: its hash, its place, its run and a
   64-bit fingerprint of all words that the run's windows cover.
2. Rows with equal anchors and fingerprints are a class. Its windows are equal throughout, so in all documents but the smallest they
   go whole, and only places in the smallest take part in what follows: copies are never compared with each other.
3. Anchors with several classes are the seeds. Their classes' words are read from the texts and extended from the anchor
   both ways against the smallest document of the group (the pivot). The maximal match covers the windows between its
   ends. Windows that reach beyond it can only equal those of documents that part from the pivot at the same place with
   the same word, so they go on in the group of that place and word; each window lies in exactly one group. Every round
   lengthens the words known to be common to a group, so there are at most 2 * ``window`` rounds.
   Groups of up to ``limit`` rows are finished in one task; larger ones take a round as a join with their pivots, dealt
   to parts.
4. Covered spans are merged by document and cut out of the texts.

Words are compared as they are in step 3; step 2 rests on the 64 bits of an anchor and 64 more of all words around it.

Words: runs of all but ASCII white space, unchanged. Defined cases: null and short texts have no windows; rows with
equal ids are one document, whose windows don't remove each other; rows with a null id keep all words and remove none;
equal rows get equal results; a very long text is scanned by one task (about 100 bytes a word); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.skew import hot_keys, salted_join
from telemill.llm.wordhash import INK, Words, blocks, mix, slices
from telemill.session import discard, materialize

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.uint64((1 << 22) - 1)
_CHUNK = 1 << 20


def _choices(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the index of the smallest one, by the upper 42 bits and then the place."""
    out = np.empty(max(0, len(grams) - width + 1), np.int64)
    for c in range(0, len(out), _CHUNK):
        part = grams[c : c + _CHUNK + width - 1]
        v, size = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * size <= width:
            v, size = np.minimum(v[:-size], v[size:]), 2 * size
        v = np.minimum(v[: len(v) - (width - size)], v[width - size :])
        out[c : c + _CHUNK] = (v & _PLACE).astype(np.int64) + c
    return out


def _prints(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words begin..end, from differences of running sums."""
    up = np.cumprod(np.full(len(hashes), _BASE))
    down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(hashes), _INVERSE))])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + _BASE) * up)])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def anchors(texts: list[bytes], window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """By block of texts: text index, first window, place of the anchor from there, number of windows, gram, fingerprint."""
    for base, block in blocks(texts):
        w = Words(block, INK, lower=False)
        grams = w.windows(k)
        if len(w.hashes) < window:
            continue
        choice = _choices(grams, window - k + 1)
        sizes = np.diff(w.first)
        at = np.flatnonzero(np.arange(len(choice)) + window <= np.repeat(w.first[1:], sizes)[: len(choice)])
        if not len(at):
            continue
        chosen = choice[at]
        runs = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(at) != 1)]))
        count = np.diff(np.concatenate([runs, [len(at)]]))
        begin, place = at[runs], chosen[runs]
        own = np.searchsorted(w.first, begin, "right") - 1
        yield base + own, begin - w.first[own], place - begin, count, grams[place], _prints(w.hashes, begin, begin + count - 1 + window)


def _id_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, t (hash of the text) and text as bytes; rows with equal id and t are taken as one."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.xxhash64(body, F.octet_length(body)).alias("t"), body.cast("binary").alias("text"))


def _scan(own: DataFrame, window: int, k: int) -> DataFrame:
    """A row for each anchor: id, t, s (first window), p (words from there to the anchor), m (windows), h, c."""
    names = ["s", "p", "m", "h", "c"]
    kinds = [pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int64()]
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("t", T.LongType())])
    for name, kind in zip(names, (T.IntegerType(), T.ShortType(), T.ShortType(), T.LongType(), T.LongType()), strict=True):
        schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc, *columns in anchors(batch.column(2).to_pylist(), window, k):
                index = pa.array(doc)
                cast = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *cast], ["id", "t", *names])

    return own.where("id is not null").mapInArrow(run, schema)


def _small(df: DataFrame, cells: Column, limit: int) -> DataFrame:
    """``df`` for broadcast if its rows and ``cells`` together are at most ``limit``, else as it is."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(cells), F.lit(0)).alias("c")).collect()[0]
    return F.broadcast(df) if size["n"] + size["c"] <= limit else df


def _seed_rows(own: DataFrame, seeds: DataFrame, window: int, limit: int) -> DataFrame:
    """Seeds (id, t, s, p, m, h) with the words of their windows: g, id, t, s, p, lo, hi, words."""
    place = F.struct("h", "s", "p", "m")
    wanted = materialize(seeds.groupBy("id", "t").agg(F.collect_list(place).alias("places")), "seeds-by-document")
    joined = own.join(_small(wanted, F.size("places"), limit), ["id", "t"]).select("id", "t", "text", "places")
    schema = T.StructType([
        T.StructField("g", T.LongType()), T.StructField("id", own.schema["id"].dataType), T.StructField("t", T.LongType()), T.StructField("s", T.IntegerType()),
        T.StructField("p", T.IntegerType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("words", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), None, pa.int64(), *[pa.int32()] * 4, pa.binary()]
        for batch in slices(batches):
            kinds[1] = batch.schema.field("id").type
            rows = []
            for doc, t, text, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = text.split()
                for x in places:
                    rows.append((x["h"], doc, t, x["s"], x["p"], 0, x["m"] - 1, b" ".join(words[x["s"] : x["s"] + x["m"] - 1 + window])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], schema.names)

    found = materialize(joined.mapInArrow(run, schema), "seeds")
    if found.count() == wanted.agg(F.sum(F.size("places")).alias("n")).collect()[0]["n"]:
        return found
    return materialize(found.dropDuplicates(["g", "id", "t", "s"]), "seeds")  # rows with equal ids and texts


def meet(x: list[bytes], p: int, y: list[bytes], q: int) -> tuple[int, int]:
    """Words that x and y have in common to the left of places p and q, and from there on to the right."""
    left = right = 0
    while left < p and left < q and x[p - 1 - left] == y[q - 1 - left]:
        left += 1
    while p + right < len(x) and q + right < len(y) and x[p + right] == y[q + right]:
        right += 1
    return left, right


def _parts(row: tuple, pivot: tuple, window: int) -> tuple[tuple[int, int] | None, list[tuple[tuple, int, int]]]:
    """Of a row's open windows lo..hi: those that the match with the pivot covers, and the further groups with theirs.

    Rows are (words, p, lo, hi, id, ...). Windows from p - left to p + right - window match.
    """
    words, p, lo, hi, doc = row[:5]
    left, right = meet(words, p, pivot[0], pivot[1])
    first, last = max(lo, p - left), min(hi, p + right - window)
    covered = (first, last) if first <= last and pivot[4] < doc else None
    rest = []
    if lo < p - left:
        rest.append((("L", left, words[p - left - 1]), lo, min(hi, p - left - 1)))
    begin = max(lo, p - left, p + right - window + 1)
    if begin <= hi:
        rest.append((("R", right, words[p + right]), begin, hi))
    return covered, rest


def extend(rows: list[tuple], window: int) -> Iterator[tuple[tuple, int, int]]:
    """Covered windows (row, first, last) of one group, round by round; rows are (words, p, lo, hi, id, t, s)."""
    stack = [rows]
    while stack:
        group = stack.pop()
        if len(group) < 2:
            continue
        pivot = min(group, key=lambda r: r[4:7])
        further = defaultdict(list)
        for row in group:
            if row is pivot:
                continue
            covered, rest = _parts(row, pivot, window)
            if covered:
                yield row, *covered
            for name, lo, hi in rest:
                further[name].append((row[0], row[1], lo, hi, *row[4:]))
        stack += further.values()


def _span_schema(own: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("t", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _finish(state: DataFrame, window: int) -> DataFrame:
    """Spans (id, t, start, end) of groups that fit one task each."""
    schema = _span_schema(state)
    names = ["g", "words", "p", "lo", "hi", "id", "t", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, arrow = None, [], None

        def close() -> pa.RecordBatch:
            found = [(r[4], r[5], r[6] + a, r[6] + b + window) for r, a, b in extend(held, window)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate((arrow, pa.int64(), pa.int32(), pa.int32()))], schema.names)

        for batch in slices(batches):
            arrow = batch.schema.field("id").type
            for g, words, *rest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if g != key and held:
                    yield close()
                key = g
                held.append((words.split(b" "), *rest))
        if held:
            yield close()

    return state.select(*names).repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)


def _round(state: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """One round for large groups: spans (start not null) and the rows of further groups (name not null)."""
    pivots = state.groupBy("g").agg(F.min(F.struct("id", "t", "s", "p", "words")).alias("pivot"))
    met = salted_join(state, pivots, ["g"], hot, F.xxhash64("id", "t", "s")).where(F.struct("id", "t", "s") != F.struct("pivot.id", "pivot.t", "pivot.s"))
    met = met.select("g", "words", "p", "lo", "hi", "id", "t", "s", F.col("pivot.words").alias("pw"), F.col("pivot.p").alias("pp"), F.col("pivot.id").alias("pid"))
    own = state.schema["id"].dataType
    schema = T.StructType([
        T.StructField("g", T.LongType()), T.StructField("id", own), T.StructField("t", T.LongType()), T.StructField("s", T.IntegerType()), T.StructField("p", T.IntegerType()),
        T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("name", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kinds = [pa.int64(), batch.schema.field("id").type, pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.binary()]
            rows = []
            for g, words, p, lo, hi, doc, t, s, pivot_words, q, pivot_doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                covered, rest = _parts((words.split(b" "), p, lo, hi, doc), (pivot_words.split(b" "), q, 0, 0, pivot_doc), window)
                if covered:
                    rows.append((g, doc, t, s, p, *covered, None, None))
                rows += [(g, doc, t, s, p, a, b, words, b"%s%d %s" % (side.encode(), depth, word)) for (side, depth, word), a, b in rest]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], schema.names)

    return met.mapInArrow(run, schema)


def _extended(state: DataFrame, window: int, limit: int) -> list[DataFrame]:
    """Spans of all groups of ``state``."""
    out = []
    for _ in range(2 * window + 1):
        sizes = materialize(state.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), "group-sizes")
        hot = hot_keys(sizes, ["g"], "c", least=limit)
        large = sizes.where(F.col("c") > limit)
        several = salted_join(state, sizes, ["g"], hot, F.xxhash64("id", "t", "s"))
        if large.isEmpty():
            return [*out, materialize(_finish(several, window), "spans")]
        out.append(materialize(_finish(several.where(F.col("c") <= limit), window), "spans"))
        done = materialize(_round(several.where(F.col("c") > limit).drop("c"), hot, window), "round")
        out.append(done.where("name is null").select("id", "t", (F.col("s") + F.col("lo")).alias("start"), (F.col("s") + F.col("hi") + window).alias("end")))
        state = done.where("name is not null").withColumn("g", F.xxhash64("g", "name")).drop("name")
    raise RuntimeError("groups of equal seeds aren't settled")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, k: int = 10, limit: int = 256, broadcast_limit: int = 1 << 20) -> DataFrame:
    """id, t, spans: by document the merged spans (start, end) of words that windows of smaller ids repeat."""
    own = _id_text(docs, key, text)
    seen = materialize(_scan(own, window, k), "anchors")
    kind, places = ["h", "c"], ("id", "t", "s")
    classes = seen.groupBy(*kind).agg(F.min(F.struct(*places)).alias("rep"), F.count("*").alias("n"), F.first("p").alias("p"), F.first("m").alias("m"))
    classes = materialize(classes, "classes")
    copied = materialize(classes.where("n > 1"), "copied")
    others = salted_join(seen.select(*kind, *places), copied.drop("n"), kind, hot_keys(copied, kind, "n"), F.xxhash64(*places)).where(F.struct(*places) != F.col("rep"))
    others = materialize(others.select(*places, "p", "m", "h", (F.col("id") > F.col("rep.id")).alias("whole")).distinct(), "others")
    spans = [others.where("whole").select("id", "t", F.col("s").alias("start"), (F.col("s") + F.col("m") - 1 + window).alias("end"))]
    discard(seen)
    discard(copied)

    tallies = materialize(classes.groupBy("h").agg(F.count("*").alias("c"), F.min("rep.id").alias("low"), F.max("rep.id").alias("high")).where("c > 1 and low < high"), "tallies")
    heads = classes.select("rep.*", "p", "m", "h").unionByName(others.where("not whole").drop("whole"))
    seeds = salted_join(heads, tallies.select("h"), ["h"], hot_keys(tallies, ["h"], "c"), F.xxhash64("id", "t", "s"))
    state = _seed_rows(own, seeds, window, broadcast_limit)
    discard(classes)
    for part in _extended(state, window, limit):
        spans.append(part)
    every = spans[0]
    for part in spans[1:]:
        every = every.unionByName(part)
    return materialize(merged_spans(every), "covered")


def merged_spans(spans: DataFrame) -> DataFrame:
    """id, t, spans: by document the unions (start, end) of its overlapping or touching spans, in order."""
    order = Window.partitionBy("id", "t").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("fresh", F.when(F.col("start") <= reached, 0).otherwise(1))
    islands = opened.withColumn("island", F.sum("fresh").over(order)).groupBy("id", "t", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return islands.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", broadcast_limit: int = 1 << 20, **options) -> DataFrame:
    """Per document row: key, n_words, n_removed, kept_text (kept words joined by a blank), spans (start and end of removed words)."""
    covered = repeated_spans(docs, key, text, broadcast_limit=broadcast_limit, **options)
    own = _id_text(docs, key, text)
    joined = own.join(_small(covered, F.size("spans"), broadcast_limit), ["id", "t"], "left").select("id", "text", "spans")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([
        T.StructField(key, own.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()), T.StructField("spans", span),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        for batch in slices(batches):
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, kept, at = text.split(), [], 0
                for x in spans or []:
                    kept += words[at : x["start"]]
                    at = x["end"]
                kept += words[at:]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), spans or []))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], schema.names)

    return joined.mapInArrow(run, schema)
