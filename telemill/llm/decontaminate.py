"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``n`` consecutive words (a shorter item is one window) and a window into its shingles
of ``k`` words. A document holds a window only if it holds every shingle of it, so for full containment the necessary
prefix of a window, in order of rarity, is its rarest shingle:

1. one scan of the documents finds every place of any item shingle (by hash) and keeps short segments around them;
2. shingles are counted over all documents, and windows with a shingle that no document has are dropped;
3. places are joined with the windows on the rarest shingle alone;
4. the place must leave room for the window before and after (positional and length bounds), and the words there must
   equal the words of the window, so no result rests on a hash.

The scan takes the item shingles as a broadcast only if there are at most ``broadcast_limit`` (8 bytes each, and as
many in Arrow batches on the driver); beyond that it keeps all places and the join on the shuffled shingles does the
rest. Shingles that are the rarest of a window and still common are joined in parts.

Words: after lowering A-Z, runs of digits, ASCII letters and characters beyond ASCII. Defined cases: null texts have no
words; rows with a null item id are ignored; equal item ids count once; repeated document rows are judged each; a very
long text is scanned whole and leaves segments of at most 64 places; an empty benchmark finds nothing, an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.skew import hot_keys, salted_join
from telemill.llm.wordhash import ALNUM, Words, blocks, slices
from telemill.session import materialize

_BITS = 22
#: Places that one segment holds at most; more make further segments.
_PLACES = 64


def item_windows(items: DataFrame, key: str, text: str, n: int, k: int) -> DataFrame:
    """item, window (words joined by a blank), size, and its shingles as array of (at, h)."""
    schema = T.StructType([
        T.StructField("item", T.StringType()), T.StructField("window", T.StringType()), T.StructField("size", T.IntegerType()),
        T.StructField("shingles", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("h", T.LongType())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = Words([body.encode()], ALNUM)
                words = [w.data[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)]
                if not words:
                    continue
                size, step = min(n, len(words)), min(k, len(words))
                hashes = w.windows(step).view(np.int64).tolist()
                for i in range(len(words) - size + 1):
                    rows.append((item, " ".join(words[i : i + size]), size, [{"at": j, "h": hashes[i + j]} for j in range(size - step + 1)]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema.names)

    own = items.select(F.col(key).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("item is not null")
    return own.mapInArrow(run, schema)


def scan_places(docs: DataFrame, key: str, text: str, n: int, ks: list[int], wanted: np.ndarray | None) -> DataFrame:
    """Rows for documents (uid, key, n_words) and for segments (uid, n_words, first, words, places as array of (at, h))."""
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    place = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("h", T.LongType())])
    schema = T.StructType([
        T.StructField("uid", T.LongType()), T.StructField("key", slim.schema[0].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("first", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("places", T.ArrayType(place)),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared else None
        if known is not None:
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[known & np.uint64((1 << _BITS) - 1)] = True
        uid = TaskContext.get().partitionId() << 33

        def found(hashes: np.ndarray) -> np.ndarray:
            if known is None:
                return np.arange(len(hashes))
            maybe = np.flatnonzero(bitmap[hashes & np.uint64((1 << _BITS) - 1)])
            at = np.searchsorted(known, hashes[maybe])
            return maybe[known[np.minimum(at, len(known) - 1)] == hashes[maybe]] if len(known) else maybe[:0]

        for batch in slices(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for base, block in blocks(texts):
                w = Words(block, ALNUM)
                hits = []
                for k in ks:
                    hashes = w.windows(k)
                    at = found(hashes)
                    own = np.searchsorted(w.first, at, "right") - 1
                    fits = at + k <= w.first[np.minimum(own + 1, len(w.first) - 1)]
                    hits += [(int(a), int(d), int(h)) for a, d, h in zip(at[fits], own[fits], hashes[at[fits]].view(np.int64), strict=True)]
                rows = [(uid + i, keys[base + i], int(w.first[i + 1] - w.first[i]), None, None, None) for i in range(len(block))]
                hits.sort()
                for group in _segments(hits, n):
                    doc = group[0][1]
                    low, high = int(w.first[doc]), int(w.first[doc + 1])
                    a, b = max(low, group[0][0] - n), min(high, group[-1][0] + n)
                    words = [w.data[w.starts[i] : w.ends[i]].decode() for i in range(a, b)]
                    rows.append((uid + doc, None, high - low, a - low, words, [{"at": p - a, "h": h} for p, _, h in group]))
                uid += len(block)
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), batch.schema.field(0).type, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema.names)

    return slim.mapInArrow(run, schema)


def _segments(hits: list[tuple[int, int, int]], n: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of places in one document, near each other and not more than _PLACES."""
    group: list = []
    for x in hits:
        if group and (x[1] != group[-1][1] or x[0] > group[-1][0] + n or len(group) >= _PLACES):
            yield group
            group = []
        group.append(x)
    if group:
        yield group


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 10, k: int = 3, broadcast_limit: int = 1 << 22) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (uid, key, n_words), spans (uid, start, size: words of a document that equal a window) and pairs (uid, item)."""
    windows = materialize(item_windows(items, item_key, item_text, n, k), "item-windows")
    distinct = windows.dropDuplicates(["window"]).select("window", "size", F.explode("shingles").alias("s")).select("window", "size", "s.at", "s.h")
    own = materialize(distinct.select("h").distinct(), "item-shingles")
    wanted = np.sort(own.toArrow()["h"].to_numpy().view(np.uint64)) if own.count() <= broadcast_limit else None
    ks = [min(k, r["size"]) for r in windows.select(F.least("size", F.lit(k)).alias("size")).distinct().collect()]
    scanned = materialize(scan_places(docs, key, text, n, sorted(ks), wanted), "places")
    segments = scanned.where("words is not null")
    counts = segments.select(F.explode("places.h").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    rarest = (
        distinct.join(counts, "h", "left").groupBy("window", "size")
        .agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h", "at")).alias("r"))
        .where("r.c > 0").select("window", "size", F.col("r.h").alias("h"), F.col("r.at").alias("at"), F.col("r.c").alias("c"))
    )
    rarest = materialize(rarest, "rarest")
    near = F.transform(
        "places",
        lambda p: F.struct(
            p["h"].alias("h"), (F.col("first") + p["at"]).alias("place"), F.least(p["at"], F.lit(n)).alias("before"),
            F.slice("words", F.greatest(p["at"] - n, F.lit(0)) + 1, F.lit(2 * n)).alias("around"),
        ),
    )
    near_places = segments.select("uid", "n_words", F.explode(near).alias("p")).select("uid", "n_words", "p.*")
    candidates = salted_join(near_places, rarest.drop("c"), ["h"], hot_keys(rarest, ["h"], "c"), F.col("uid"))
    begin = F.col("before") - F.col("at")
    spans = candidates.where((begin >= 0) & (begin + F.col("size") <= F.size("around")) & (F.col("size") <= F.col("n_words"))).where(
        F.array_join(F.slice("around", begin + 1, F.col("size")), " ") == F.col("window")
    ).select("uid", (F.col("place") - F.col("at")).alias("start"), "size", "window")
    spans = materialize(spans.distinct(), "spans")
    pairs = spans.select("uid", "window").distinct().join(windows.select("window", "item").distinct(), "window").select("uid", "item").distinct()
    return scanned.where("words is null").select("uid", "key", "n_words"), spans.select("uid", "start", "size").distinct(), pairs


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per document row: key, n_words, n_hit (words inside any window), n_items, items (sorted), contaminated."""
    rows, spans, pairs = overlaps(docs, items, key, **options)
    order = Window.partitionBy("uid").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    reached = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = spans.select("uid", F.greatest(F.lit(0), end - F.greatest("start", reached)).alias("new")).groupBy("uid").agg(F.sum("new").alias("n_hit"))
    held = pairs.groupBy("uid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = hit.join(held, "uid")
    return rows.join(found, "uid", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
