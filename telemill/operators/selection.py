"""Exact percentiles of groups of any size, and order statistics of moving frames.

Spark's own exact percentiles hold the distinct values of a group in one task. That is right for groups up to a size;
for larger ones ``select_percentiles`` counts the values of an interval in cells, takes the cell that holds the wanted
rank, and goes on with the ends of the values found there until they are equal: a handful of counting passes for all
groups and ranks together, in which a task gives at most a row for each cell.

Values are compared as doubles, nulls left out, infinite values and NaN ordered as Spark does (NaN last). Null keys are a
group of their own; an empty table gives no groups, or one row without keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.operators.numbering import numbered
from telemill.session import discard, if_small, materialize

#: Values of a group that one task may hold.
LARGE = 100_000


def _key(by: tuple[str, ...]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def _ranks(kind: str, p: float, n: Column) -> list[Column]:
    """Ranks from 0 whose values give the percentile: the nearest rank (disc), or the two around the place (cont)."""
    if kind == "disc":
        return [F.greatest(F.lit(1), F.ceil(n * p)) - 1]
    return [F.floor((n - 1) * p), F.ceil((n - 1) * p)]


def select_percentiles(rows: DataFrame, value: str, wanted: dict[str, tuple[str, float]], cells: int = 1024, rounds: int = 100) -> DataFrame:
    """_k and a double for each of ``wanted`` (name to kind, disc or cont, and p) over the non-null values of each group _k."""
    held = materialize(rows.select("_k", F.col(value).cast("double").alias("_x")).where("_x is not null"), "values")
    x = F.col("_x")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    ends = held.groupBy("_k").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.min(finite).alias("a"), F.max(finite).alias("b"))
    aims = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(i).alias("part"), r.cast("long").alias("rank")) for name, (kind, p) in wanted.items() for i, r in enumerate(_ranks(kind, p, F.col("n")))])
    state = materialize(ends.select("_k", "n", F.inline(aims), "lo", "hi", "a", "b").withColumn("base", F.lit(0).cast("long")), "aims")
    interval = ["_k", "lo", "hi"]
    for _ in range(rounds):
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        asked = if_small(open_.groupBy(*interval).agg(F.first("a").alias("a"), F.first("b").alias("b")))
        inside = held.join(asked, "_k").where((x >= F.col("lo")) & (x <= F.col("hi")))
        width = F.col("b") / 2 - F.col("a") / 2
        place = F.when(width > 0, F.least(F.lit(cells - 1), F.floor((x / 2 - F.col("a") / 2) / F.nullif(width, F.lit(0.0)) * cells))).otherwise(0)
        cell = F.when(F.isnan(x), cells + 1).when(x == float("inf"), cells).when(x == float("-inf"), -1).otherwise(place)
        tally = inside.groupBy(*interval, cell.alias("cell")).agg(F.count("*").alias("c"), F.min("_x").alias("m"), F.max("_x").alias("w"))
        upto = tally.withColumn("upto", F.sum("c").over(Window.partitionBy(*interval).orderBy("cell")))
        met = open_.select(*interval, "name", "part", "rank", "base", "n").join(upto, interval)
        hit = met.where((F.col("rank") < F.col("base") + F.col("upto")) & (F.col("rank") >= F.col("base") + F.col("upto") - F.col("c")))
        narrowed = hit.select("_k", "n", "name", "part", "rank", F.col("m").alias("lo"), F.col("w").alias("hi"), F.col("m").alias("a"), F.col("w").alias("b"), (F.col("base") + F.col("upto") - F.col("c")).alias("base"))
        after = materialize(state.where("not (lo < hi)").unionByName(narrowed), "aims")
        discard(state)
        state = after
    else:
        raise RuntimeError(f"ranks aren't found after {rounds} rounds")
    of = lambda name, part: F.max(F.when((F.col("name") == name) & (F.col("part") == part), F.col("lo")))
    columns = []
    for name, (kind, p) in wanted.items():
        place = (F.max("n") - 1) * p
        low, high = of(name, 0), of(name, 1)
        mixed = F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)
        columns.append((low if kind == "disc" else mixed).alias(name))
    return state.groupBy("_k").agg(*columns)


def _built_in(value: str, kind: str, p: float) -> Column:
    x = f"cast(`{value}` as double)"
    return F.expr(f"percentile_disc({p}) within group (order by {x})" if kind == "disc" else f"percentile({x}, {p})")


def with_percentiles(rows: DataFrame, by: tuple[str, ...], aggregates: list[Column], value: str, wanted: dict[str, tuple[str, float]], large: int = LARGE) -> DataFrame:
    """``by``, the aggregates, and a double for each percentile in ``wanted`` (name to kind, disc or cont, and p).

    Groups of up to ``large`` values are aggregated at once; larger ones get their percentiles by selection. Without
    ``by`` there is one row, as in an aggregation of a whole table.
    """
    keyed = rows.withColumn("_k", _key(by))
    built_in = [_built_in(value, kind, p).alias(name) for name, (kind, p) in wanted.items()]
    hot = materialize(keyed.groupBy("_k").agg(F.count(value).alias("_n")).where(F.col("_n") > large), "large-groups")
    keys = [F.col(f"_k.{c}").alias(c) for c in by]
    if hot.isEmpty():
        return keyed.groupBy("_k").agg(*aggregates, *built_in).select(*keys, "*").drop("_k") if by else rows.agg(*aggregates, *built_in)
    mark = if_small(hot.select("_k"))
    of_large = keyed.join(mark, "_k", "left_semi")
    selected = of_large.groupBy("_k").agg(*aggregates).join(if_small(select_percentiles(of_large, value, wanted)), "_k")
    others = keyed.join(mark, "_k", "left_anti").groupBy("_k").agg(*aggregates, *built_in)
    return selected.unionByName(others).select(*keys, "*").drop("_k")


def frame_percentiles(values: list, n: int, p: float, least: int) -> list:
    """The nearest-rank percentile of the last ``n`` entries up to each, None below ``least`` non-null ones.

    Counts of the frame's values by rank lie in an indexed tree, so an entry costs the logarithm of the number of values.
    """
    known = np.array([v is not None for v in values], bool)
    distinct, codes = np.unique(np.array([v for v in values if v is not None]), return_inverse=True)
    of, m = np.full(len(values), -1), len(distinct)
    of[known] = codes
    of, back = of.tolist(), distinct.tolist()
    tree, top, size, out = [0] * (m + 1), 1 << max(0, m.bit_length() - 1), 0, []
    for i, code in enumerate(of):
        for at, step in ((code, 1), (of[i - n] if i >= n else -1, -1)):
            if at >= 0:
                size += step
                at += 1
                while at <= m:
                    tree[at] += step
                    at += at & -at
        if size and size >= least:
            rank, at, bit = max(1, math.ceil(size * p)), 0, top
            while bit:
                ahead = at + bit
                if ahead <= m and tree[ahead] < rank:
                    rank -= tree[ahead]
                    at = ahead
                bit >>= 1
            out.append(back[at])
        else:
            out.append(None)
    return out


def moving_percentile(df: DataFrame, order: str, n: int, value: str, p: float, least: int, out: str, by: tuple[str, ...] = (), tie: tuple[str, ...] = (), block: int = 50_000) -> DataFrame:
    """Add ``out``: the nearest-rank percentile of the last ``n`` values of the key up to each row, null below ``least`` of them.

    Series are dealt to blocks of rows, which also get the ``n`` - 1 rows before them (a block has at least 4 ``n``).
    """
    block = max(block, 4 * n)
    at = numbered(df, order, "_at", by, tie)
    own = F.floor(F.col("_at") / block)
    spread = at.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col("_at") + n - 1) / block)))).withColumn("_own", F.col("_block") == own)
    schema = T.StructType([*df.schema.fields, T.StructField(out, df.schema[value].dataType)])

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        found = pa.array(frame_percentiles(table.column(value).to_pylist(), n, p, least), table.schema.field(value).type)
        kept = table.append_column("_found", found).filter(table.column("_own"))
        return kept.select([*range(len(schema) - 1), kept.num_columns - 1]).rename_columns(schema.names)

    return spread.select(*df.columns, "_at", "_block", "_own").groupBy(*by, "_block").applyInArrow(walk, schema)
