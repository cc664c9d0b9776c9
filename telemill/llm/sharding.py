"""K-d tree partitioning of a corpus into shards of near equal bytes.

A node that must give ``m`` shards is split, along the metadata dimension in which its rows spread widest, at the
weighted quantile that leaves floor(m / 2) / m of its bytes on the left. One scan of a narrow table a level sums the
bytes of ``buckets`` slices of every dimension's extent in each open node. The slice that holds the quantile is cut
there if it has one row or at most ``tolerance`` of the node's bytes; otherwise its own extent is sliced again. Only
nodes x dimensions x buckets sums are shuffled and one row per node and dimension reaches the driver; rows are routed
by a broadcast of the level's splits (one number each) and written once a level.

Bound: a split is off by half a slice at most, so each side by ``tolerance`` / 2 of the node's bytes or half a row. Over
the log2(shards) levels shards differ by about ``tolerance`` x shards from the mean, and by the largest rows beyond that.

A coordinate is the position of the value in the range of its dimension (2^20 steps), then hashes of the text, the key
and the row. So a value shared by many rows, such as a source with a third of them, can be split anywhere, and rows of
equal text and metadata lie together: only a cut that falls within such a group parts it, as equal bytes need where the
group is larger than a shard.

Slots are dealt by counting small chunks (by hash of the key) of each shard, so no task sorts a whole shard.

Defined cases: null texts have no bytes; null metadata lies at the start of its range; rows of one key and text may
part; a very long text is one row, and its shard is larger by what it has; an empty table gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.session import discard, materialize

_STEPS = 1 << 20


def text_prefix(column: Column) -> Column:
    """An order-preserving number from the first six bytes of a string."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(column, F.lit("")), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _measured(df: DataFrame, key: str, text: str, dims: dict[str, Column], overhead: int) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"),
        *[c.cast("double").alias(f"d{i}") for i, c in enumerate(dims.values())], F.monotonically_increasing_id().alias("at"),
    )
    return materialize(rows, "measured")


def _coordinates(rows: DataFrame, n_dims: int) -> DataFrame:
    ends = rows.agg(*[f(f"d{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("low", F.min), ("high", F.max))]).collect()[0]
    bits = lambda n, *columns: F.shiftrightunsigned(F.xxhash64(*columns), 64 - n)
    fine = (bits(14, "crc", "size") * 512 + bits(9, "key", "crc")) * 512 + bits(9, "at")
    made = []
    for i in range(n_dims):
        low, high = ends[f"low{i}"] or 0.0, ends[f"high{i}"] or 0.0
        place = F.coalesce((F.col(f"d{i}") - low) / ((high - low) or 1.0), F.lit(0.0))
        made.append((F.floor(place * (_STEPS - 1)) + fine / F.lit(float(1 << 32))) / _STEPS)
    return rows.select("key", "size", "crc", F.array(*made).alias("c"), F.lit(0).alias("node"))


def _slices(rows: DataFrame, asked: list[tuple], buckets: int) -> dict[tuple[int, int], tuple]:
    """For each asked (node, dim, low, high, below, share): bytes and extent of the range, and the slice that its quantile is in.

    ``below`` are bytes of the node before the range (-1: the range is the node, and ``share`` of its bytes is wanted
    on the left), ``share`` the bytes wanted on the left otherwise.
    """
    level = rows.sparkSession.createDataFrame(asked, "node int, dim int, low double, high double, below double, share double")
    x = F.element_at("c", F.col("dim") + 1)
    inside = rows.join(F.broadcast(level), "node").withColumn("x", x).where((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
    width = F.greatest(F.col("high") - F.col("low"), F.lit(5e-324))
    slot = F.least(F.floor((F.col("x") - F.col("low")) / width * buckets), F.lit(buckets - 1)).cast("int")
    sums = inside.groupBy("node", "dim", "below", "share", slot.alias("slot")).agg(
        F.sum("size").alias("w"), F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")
    )
    of = Window.partitionBy("node", "dim")
    target = F.when(F.col("below") < 0, F.col("share") * F.sum("w").over(of)).otherwise(F.col("share"))
    through = F.greatest(F.col("below"), F.lit(0.0)) + F.sum("w").over(of.orderBy("slot"))
    hit = F.struct("slot", "w", "n", "a", "b", "through", "target")
    found = sums.withColumn("target", target).withColumn("through", through).groupBy("node", "dim").agg(
        F.sum("w").alias("w"), F.min("a").alias("low"), F.max("b").alias("high"), F.min(F.when(F.col("through") >= F.col("target"), hit)).alias("hit"), F.max(hit).alias("last")
    )
    return {(r["node"], r["dim"]): (float(r["w"]), r["low"], r["high"], r["hit"] or r["last"]) for r in found.collect()}


def _cuts(rows: DataFrame, open_: dict[int, int], n_dims: int, buckets: int, passes: int, tolerance: float) -> dict[int, tuple[int, float]]:
    """The dimension and coordinate at which each open node (first shard, with its shards) is split; rows from the coordinate on go right."""
    seen = _slices(rows, [(n, d, 0.0, 1.0, -1.0, (m // 2) / m) for n, m in open_.items() for d in range(n_dims)], buckets)
    nodes = {n for n, _ in seen}
    dim = {n: max(range(n_dims), key=lambda d, n=n: (seen[n, d][2] - seen[n, d][1], -d)) for n in nodes}
    total = {n: seen[n, dim[n]][0] for n in nodes}
    state = {n: seen[n, dim[n]][3] for n in nodes}
    cuts: dict[int, tuple[int, float]] = {}
    for step in range(passes):
        ask = []
        for n, hit in state.items():
            before = hit["through"] - hit["w"]
            if hit["n"] == 1 or hit["a"] == hit["b"] or hit["w"] <= tolerance * total[n] or step == passes - 1:
                left = hit["target"] - before <= hit["through"] - hit["target"]
                cuts[n] = dim[n], hit["a"] if left else math.nextafter(hit["b"], 2.0)
            else:
                ask.append((n, dim[n], hit["a"], hit["b"], before, hit["target"]))
        if not ask:
            break
        state = {n: x[3] for (n, _), x in _slices(rows, ask, buckets).items()}
    return cuts


def kd_shards(
    df: DataFrame, dims: dict[str, Column], key: str = "doc_id", text: str = "text", n_shards: int | None = None, target_bytes: int | None = None, overhead: int = 8,
    buckets: int = 256, passes: int = 6, tolerance: float = 5e-4, chunk_rows: int = 20_000,
) -> DataFrame:
    """key, size, text_crc32, shard and slot (gapless from 0 in a shard) for every row.

    Either ``n_shards`` or ``target_bytes`` is given; the latter means the bytes of all rows over it, rounded up.
    """
    spark = df.sparkSession
    measured = _measured(df, key, text, dims, overhead)
    total, count = measured.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).collect()[0]
    shards = n_shards or max(1, -(-total // target_bytes))
    rows = materialize(_coordinates(measured, len(dims)), "level")
    discard(measured)
    open_ = {0: shards}  # a node is the number of its first shard; with the shards that it gives
    while count and (wide := {n: m for n, m in open_.items() if m > 1}):
        cuts = _cuts(rows, wide, len(dims), buckets, passes, tolerance)
        if not cuts:
            break
        level = spark.createDataFrame([(n, d, x, n + open_[n] // 2) for n, (d, x) in cuts.items()], "node int, dim int, cut double, other int")
        right = F.element_at("c", F.coalesce("dim", F.lit(0)) + 1) >= F.col("cut")
        routed = rows.join(F.broadcast(level), "node", "left").withColumn("node", F.when(right, F.col("other")).otherwise(F.col("node")))
        after = materialize(routed.select("key", "size", "crc", "c", "node"), "level")
        discard(rows)
        rows = after
        open_ = {x: k for n, m in open_.items() for x, k in ([(n, m // 2), (n + m // 2, m - m // 2)] if m > 1 else [(n, m)])}
    parts = max(1, -(-count // (shards * chunk_rows)))
    chunked = rows.select("key", "size", "crc", F.col("node").alias("shard"), F.pmod(F.xxhash64("key", "crc"), F.lit(parts)).cast("int").alias("chunk"))
    sizes = chunked.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    first = sizes.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("first"))
    own = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("key", "crc", "size"))
    return chunked.withColumn("own", own).join(first, ["shard", "chunk"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("own") - 1).cast("long").alias("slot")
    )
