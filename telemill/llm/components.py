"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.session import discard, materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).collect()[0]
    return row["n"], row["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of an edge that isn't a root itself.

    ``edges`` has columns a, b; direction, repeats and loops don't matter. A round moves each neighbour of a node to
    the smallest one (only larger ones in the large-star half), so chains halve; all state is written to the shared
    folder each round, and only a count and a checksum come to the driver. It fails if ``max_rounds`` don't suffice.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    seen = _digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        star = joined.select("a", F.col("m").alias("b")).unionAll(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a > b").distinct()
        after = materialize(star, "edges")
        fresh = _digest(after)
        discard(now)
        now, done = after, fresh == seen
        seen = fresh
        if done:
            break
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
