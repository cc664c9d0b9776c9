"""Joins whose large side has hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.session import materialize

#: Rows of one key that a task of a join may get, and hot keys that are told apart (the most frequent ones; a few MB).
LEAST = 1000
MOST = 50_000


def hot_keys(weighted: DataFrame, on: list[str], weight: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The ``most`` heaviest keys of more than ``least`` rows with ``_salts``, the number of parts to deal each to."""
    heavy = weighted.where(F.col(weight) > least).groupBy(*on).agg(F.max(weight).alias("_w"))
    return materialize(heavy.orderBy(F.desc("_w"), *on).limit(most).select(*on, F.ceil(F.col("_w") / least).cast("int").alias("_salts")), "hot")


def salted_join(large: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """``large`` joined with ``small``; rows of a hot key are dealt to its parts by ``spread``, and ``small`` repeats them.

    Every key is joined whole whether or not it is in ``hot``; keys left out of it are no heavier than those in it.
    """
    if hot.isEmpty():
        return large.join(small, on, how)
    mark = F.broadcast(hot)
    dealt = large.join(mark, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    repeated = small.join(mark, on, "left").withColumn("_salt", every).drop("_salts")
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")
