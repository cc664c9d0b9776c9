"""Row numbers and moving frames over long series without a single sorting task.

Series have few keys and many rows (a handful of workers, months of samples), so a window partitioned by the key alone
would put a whole key into one task. Here a key is cut into ranges of its order column; only counts, sums and last
values of ranges meet per key. Ranges are of equal depth (``ranges``) unless the caller gives a step of the order
column, which saves a pass where the values are known to be spread evenly.

Nulls: rows with a null key are a series of their own, and rows with a null order value come first in theirs (as in
``PARTITION BY`` and Spark's ``ORDER BY``); no row is lost. An as-of join matches null keys and times with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.session import if_small, materialize

#: The range of rows without an order value, before all others.
_NONE = -(1 << 62)

#: Rows of a range of equal depth, about.
RANGE_ROWS = 200_000


def _key(by: tuple[str, ...]) -> Column:
    """The key as one column that is never null itself, so that joins on it match nulls and need no other partitioning than windows."""
    return F.struct(*by) if by else F.struct(F.lit(0))


def ranges(df: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` cut into ranges of about ``rows`` rows by key and ``order``: adds _k (the key), _b (its range) and _id.

    Spark's range partitioner samples keys and order values together, so ranges have equal depth however the values are
    spread: a large key lies in several of them, small keys share one, and an outlier is a row like others. Their number
    comes from the row count. Within a key _b rises with the order, and _id with it inside a range, without gaps. Rows
    that agree in key and all of ``order`` stay together, so ``order`` should end with an id. The rows are written once,
    which fixes the sampled ends for all that reads them.
    """
    spark = df.sparkSession
    n = df.count()
    parts = max(-(-n // rows), min(spark.sparkContext.defaultParallelism, -(-n // max(1, rows // 16))), 1)
    dealt = df.withColumn("_k", _key(by)).repartitionByRange(parts, "_k", *order).sortWithinPartitions("_k", *order)
    return materialize(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_b", F.shiftright("_id", 33))


def placed(df: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """``ranges`` with _at instead of _id: the row's place from 0 within its key, by the counts of the ranges before."""
    dealt = ranges(df, order, by, rows)
    counts = dealt.groupBy("_k", "_b").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    upto = F.sum("_n").over(Window.partitionBy("_k").orderBy("_b"))
    shift = counts.select("_k", "_b", (upto - F.col("_n") - F.col("_first")).alias("_shift"))
    return dealt.join(if_small(shift), ["_k", "_b"]).withColumn("_at", F.col("_id") + F.col("_shift")).drop("_id", "_shift")


def numbered(df: DataFrame, order: str, out: str, by: tuple[str, ...] = (), tie: tuple[str, ...] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """Number rows from 0 by ``order``, then ``tie``, within ``by``."""
    return placed(df, (order, *tie), by, rows).withColumnRenamed("_at", out).drop("_k", "_b")


def peaks(changes: DataFrame, by: tuple[str, ...], order: tuple[str, ...], change: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Per key the highest running sum of ``change`` (null if it has no values): ranges of equal depth give their sums and highest inner sums."""
    dealt = ranges(changes, order, by, rows)
    inner = F.sum(change).over(Window.partitionBy("_k", "_b").orderBy("_id"))
    parts = dealt.withColumn("_p", inner).groupBy("_k", "_b").agg(F.sum(change).alias("_t"), F.max("_p").alias("_p"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_p", F.col("_p") + before).groupBy("_k").agg(F.max("_p").alias("peak")).select(*([f"_k.{c}" for c in by]), "peak")


def _blocks(df: DataFrame, order: str, n: int, by: tuple[str, ...], tie: tuple[str, ...], block: int) -> DataFrame:
    """Rows numbered (_at) and dealt to blocks of ``block``; the last n - 1 rows of a block are also sent to the next one (not _own)."""
    at = numbered(df, order, "_at", by, tie)
    own = F.floor(F.col("_at") / block)
    later = F.floor((F.col("_at") + n - 1) / block)
    return at.withColumn("_block", F.explode(F.sequence(own, later))).withColumn("_own", F.col("_block") == own)


def rolling(df: DataFrame, order: str, n: int, values: dict[str, Column], by: tuple[str, ...] = (), tie: tuple[str, ...] = (), block: int = 20_000) -> DataFrame:
    """Aggregates over the last ``n`` rows up to each row within ``by``; the work for a row grows with ``n``."""
    spread = _blocks(df, order, n, by, tie, block)
    frame = Window.partitionBy(*by, "_block").orderBy("_at").rowsBetween(-(n - 1), 0)
    return spread.withColumns({k: v.over(frame) for k, v in values.items()}).where("_own").drop("_at", "_block", "_own")


def rolling_mean(df: DataFrame, order: str, n: int, values: dict[str, str], by: tuple[str, ...] = (), tie: tuple[str, ...] = (), block: int = 20_000) -> DataFrame:
    """Means of columns (name to column) over the last ``n`` rows up to each row within ``by``, with the same work for any ``n``.

    A frame's sum is the difference of two running sums of its block, which stays short enough to be exact to about
    twelve digits. Nulls don't count; a frame with an infinite or undefined value has the mean that they give.
    """
    spread = _blocks(df, order, n, by, tie, block)
    series = Window.partitionBy(*by, "_block").orderBy("_at")
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    sums, means = {}, {}
    for i, (name, column) in enumerate(values.items()):
        x = F.col(column).cast("double")
        odd = {"nan": F.isnan(x), "up": x == float("inf"), "down": x == float("-inf")}
        finite = F.when(~(odd["nan"] | odd["up"] | odd["down"]), x)
        parts = {"sum": F.coalesce(finite, F.lit(0.0)), "n": x.isNotNull().cast("long"), **{k: F.coalesce(c, F.lit(False)).cast("long") for k, c in odd.items()}}
        sums |= {f"_{k}{i}": F.sum(c).over(upto) for k, c in parts.items()}
        inside = {k: F.col(f"_{k}{i}") - F.lag(f"_{k}{i}", n, 0).over(series) for k in parts}
        means[name] = (
            F.when((inside["nan"] > 0) | ((inside["up"] > 0) & (inside["down"] > 0)), float("nan"))
            .when(inside["up"] > 0, float("inf")).when(inside["down"] > 0, float("-inf")).when(inside["n"] > 0, inside["sum"] / inside["n"])
        )
    return spread.withColumns(sums).withColumns(means).where("_own").drop("_at", "_block", "_own", *sums)


def rolling_range(df: DataFrame, order: str, reach: int, values: dict[str, Column], by: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """Aggregates over rows of ``by`` whose ``order`` lies in [own - reach, own], both ends included; rows without an order value see each other.

    The work for a row grows with the rows in reach; counts and means of dense series are for ``reach_sums``.
    """
    step = block or 16 * max(1, reach)
    own, later = F.floor(F.col(order) / step), F.floor((F.col(order) + reach) / step)
    blocks = F.when(F.col(order).isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(own, later))
    spread = df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block").eqNullSafe(own))
    frame = Window.partitionBy(*by, "_block").orderBy(order).rangeBetween(-reach, 0)
    return spread.withColumns({k: v.over(frame) for k, v in values.items()}).where("_own").drop("_block", "_own")


def reach_sums(df: DataFrame, order: str, reach: int, values: dict[str, Column], by: tuple[str, ...] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """Sums of ``values`` (never null, finite) over the rows that ``rolling_range`` takes, with the same work however many lie in reach.

    Each row is added at its ``order`` and taken off again just after ``order + reach``, so a sum over the reach is a
    running sum of both, which never grows past what lies in reach. Ranges of equal depth carry their totals on.
    """
    enter = df.withColumns({f"_p{i}": v for i, v in enumerate(values.values())}).withColumn("_t", F.col(order).cast("long")).withColumn("_side", F.lit(0))
    parts = [f"_p{i}" for i in range(len(values))]
    leave = enter.select(*by, (F.col("_t") + reach).alias("_t"), F.lit(1).alias("_side"), *[(-F.col(p)).alias(p) for p in parts])
    dealt = ranges(enter.unionByName(leave, allowMissingColumns=True), ("_t", "_side"), by, rows)
    totals = dealt.groupBy("_k", "_b").agg(*[F.sum(p).alias(f"_s{p}") for p in parts])
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_k", "_b", *[F.coalesce(F.sum(f"_s{p}").over(before), F.lit(0)).alias(f"_c{p}") for p in parts])
    upto = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.withColumns({f"_u{p}": F.sum(p).over(upto) for p in parts}).where("_side = 0").join(if_small(carry), ["_k", "_b"])
    return sums.select(*df.columns, *[(F.col(f"_u{p}") + F.col(f"_c{p}")).alias(name) for p, name in zip(parts, values, strict=True)])


def reach_means(df: DataFrame, order: str, reach: int, values: dict[str, str], by: tuple[str, ...] = (), count: str = "points", plain: int = 1000) -> DataFrame:
    """Means of columns (name to column) and the count of rows over the rows that ``rolling_range`` takes.

    Where no stretch of ``reach`` has over ``plain`` rows of a key, frames are summed up row by row; denser series go by
    ``reach_sums`` (exact to about twelve digits). Nulls don't count; a reach with an infinite or undefined value has the mean that they give.
    """
    cells = df.groupBy(*by, F.floor(F.col(order) / max(1, reach)).alias("_cell")).agg(F.count("*").alias("_n"))
    if (cells.agg(F.max("_n")).collect()[0][0] or 0) <= plain:
        return rolling_range(df, order, reach, {**{name: F.avg(column) for name, column in values.items()}, count: F.count("*")}, by)
    parts = {count: F.lit(1).cast("long")}
    for name, column in values.items():
        x = F.col(column).cast("double")
        odd = {"nan": F.isnan(x), "up": x == float("inf"), "down": x == float("-inf")}
        finite = F.when(~(odd["nan"] | odd["up"] | odd["down"]), x)
        parts |= {f"_{name}_sum": F.coalesce(finite, F.lit(0.0)), f"_{name}_n": x.isNotNull().cast("long")}
        parts |= {f"_{name}_{k}": F.coalesce(c, F.lit(False)).cast("long") for k, c in odd.items()}
    sums = reach_sums(df, order, reach, parts, by)
    at = lambda name, k: F.col(f"_{name}_{k}")
    means = {
        name: F.when((at(name, "nan") > 0) | ((at(name, "up") > 0) & (at(name, "down") > 0)), float("nan"))
        .when(at(name, "up") > 0, float("inf")).when(at(name, "down") > 0, float("-inf")).when(at(name, "n") > 0, at(name, "sum") / at(name, "n"))
        for name in values
    }
    return sums.withColumns(means).select(*df.columns, *values, count)


def running(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], values: dict[str, tuple[str, Column]], step: float | Column | None = None, exclusive: bool = False, rows: int = RANGE_ROWS) -> DataFrame:
    """Values over all rows of ``by`` up to each row (or before it, if ``exclusive``) in ``order``.

    ``values`` has for each name a kind and a column. Kinds are sum, max, last (of non-null values), and streak: how
    many rows up to this one, itself included, have been true in a row (``exclusive`` doesn't apply). The series are
    cut into ranges of equal depth or, with a ``step``, into ranges of that width of the first order column, which is
    numeric; a range gets what earlier ranges carry in. With a step the input is read twice, so materialize it where it
    is dear; ask for several values in one call.
    """
    kinds = [kind for kind, _ in values.values()]
    if step is None:
        cut, order = ranges(df, order, by, rows), ("_id",)
    else:
        cut = df.withColumn("_k", _key(by)).withColumn("_b", F.coalesce(F.floor(F.col(order[0]) / step), F.lit(_NONE)))
    rows = cut.withColumns({f"_v{i}": c for i, (_, c) in enumerate(values.values())})
    within = Window.partitionBy("_k", "_b").orderBy(*order)
    frame = within.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    over = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.last(c, True)}
    inside = rows
    if "streak" in kinds:
        inside = inside.withColumn("_rn", F.row_number().over(within))
        inside = inside.withColumns({f"_o{i}": F.max(F.when(~F.col(f"_v{i}"), F.col("_rn"))).over(upto) for i, kind in enumerate(kinds) if kind == "streak"})
    inside = inside.withColumns({
        f"_i{i}": F.col("_rn") - F.coalesce(F.col(f"_o{i}"), F.lit(0)) if kind == "streak" else over[kind](F.col(f"_v{i}")).over(frame) for i, kind in enumerate(kinds)
    })

    def total(i: int, kind: str) -> Column:
        v = F.col(f"_v{i}")
        if kind == "streak":
            return F.max_by(F.struct(F.col(f"_i{i}").alias("n"), F.col(f"_o{i}").isNull().alias("open")), F.struct(*order))
        return F.max_by(v, F.when(v.isNotNull(), F.struct(*order))) if kind == "last" else over[kind](v)

    totals = (inside if "streak" in kinds else rows).groupBy("_k", "_b").agg(*[total(i, kind).alias(f"_t{i}") for i, kind in enumerate(kinds)])
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summed = {f"_p{i}": F.coalesce(F.sum(F.col(f"_t{i}.n")).over(before), F.lit(0)) for i, kind in enumerate(kinds) if kind == "streak"}
    totals = totals.withColumns(summed) if summed else totals

    def carried(i: int, kind: str) -> Column:
        if kind == "streak":
            return F.col(f"_p{i}") - F.coalesce(F.last(F.when(~F.col(f"_t{i}.open"), F.col(f"_p{i}")), True).over(before), F.lit(0))
        return over[kind](F.col(f"_t{i}")).over(before)

    carry = totals.select("_k", "_b", *[carried(i, kind).alias(f"_c{i}") for i, kind in enumerate(kinds)])
    joined = inside.join(carry, ["_k", "_b"])

    def both(i: int, kind: str) -> Column:
        own, old = F.col(f"_i{i}"), F.col(f"_c{i}")
        if kind == "streak":
            return (own + F.when(F.col(f"_o{i}").isNull(), old).otherwise(0)).cast("long")
        if kind == "sum":
            return F.when(own.isNull() & old.isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(old, F.lit(0)))
        return F.greatest(own, old) if kind == "max" else F.coalesce(own, old)

    out = joined.withColumns({name: both(i, kind) for i, (name, (kind, _)) in enumerate(values.items())})
    return out.drop("_k", "_b", "_id", "_rn", *[f"{p}{i}" for i in range(len(values)) for p in ("_v", "_o", "_i", "_c")])


def asof(probes: DataFrame, facts: DataFrame, by: str, at: str, fact_at: str, take: dict[str, str], step: int | None = None, tie: str | None = None) -> DataFrame:
    """Each probe with the columns ``take`` (name to fact column) of the last fact of its key at or before ``at``; null without one.

    One sort of both sides together per key range replaces a range join. Among facts of one time the largest ``tie``
    counts. Probes with a null key or time find nothing, and every probe row stays.
    """
    known = facts.where(F.col(by).isNotNull() & F.col(fact_at).isNotNull())
    fact = known.select(F.col(by), F.col(fact_at).alias("_t"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), F.struct(*[F.col(c).alias(n) for n, c in take.items()]).alias("_f"))
    probe = probes.withColumn("_t", F.col(at)).withColumn("_side", F.lit(1)).withColumn("_tie", F.lit(0).cast("long"))
    both = probe.unionByName(fact, allowMissingColumns=True)
    out = running(both, (by,), ("_t", "_side", "_tie"), {"_last": ("last", F.col("_f"))}, step).where("_side = 1")
    return out.select(*probes.columns, *[F.col(f"_last.{n}").alias(n) for n in take])
