"""Set-based placement: one decision per task from its candidate workers, without a loop over tasks.

``candidates`` has one row per (task, worker). Scores are column expressions; the pick is an aggregate per task, so the
only shuffle is the one by task, with partial minima before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.session import if_small

SCORERS: dict[str, Callable[[], Column]] = {}


def register_scorer(name: str, score: Callable[[], Column]) -> None:
    """Add a strategy: a column over the candidate columns, the lowest of which wins."""
    SCORERS[name] = score


def pick_lowest(candidates: DataFrame, score: Column, key: str = "task_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """The worker with the lowest score per task; ties go to the lowest id; null scores never win."""
    scored = candidates.withColumn("_s", score).where("_s is not null")
    return scored.groupBy(key).agg(F.min(F.struct("_s", "worker_id", *extra)).alias("p")).select(key, "p.worker_id", F.col("p._s").alias("score"), *[f"p.{e}" for e in extra])


def least_loaded() -> Column:
    return (F.col("active") + F.col("queue_len")).cast("double")


def resource_aware(cpu: float = 0.4, mem: float = 0.2, load: float = 0.4) -> Column:
    return cpu * F.col("cpu_pct") / 100 + mem * F.col("mem_pct") / 100 + load * (F.col("active") + F.col("queue_len")) / F.greatest(F.lit(1), F.col("pool_size"))


register_scorer("least_loaded", least_loaded)
register_scorer("resource_aware", resource_aware)


def place(candidates: DataFrame, strategy: str, key: str = "task_id") -> DataFrame:
    return pick_lowest(candidates, SCORERS[strategy](), key)


def open_candidates(tasks: DataFrame, workers: DataFrame, in_flight: DataFrame, factor: float) -> DataFrame:
    """Task and worker pairs with room (in flight < max(1, round(pool x factor))), healthy, and not the worker avoided if another is open.

    Workers are a control table (a fleet), broadcast after a count.
    """
    room = workers.join(in_flight, "worker_id", "left").where("healthy").where(
        F.coalesce("n", F.lit(0)) < F.greatest(F.lit(1), F.round(F.col("pool_size") * factor))
    )
    pairs = tasks.crossJoin(if_small(room.select("worker_id", "pool_size")))
    others = F.count_if(~F.coalesce(F.col("worker_id") == F.col("avoid"), F.lit(False))).over(Window.partitionBy("task_id"))
    return pairs.withColumn("_others", others).where(~F.coalesce(F.col("worker_id") == F.col("avoid"), F.lit(False)) | (F.col("_others") == 0)).drop("_others")


def round_robin(tasks: DataFrame, workers: DataFrame, order: str) -> DataFrame:
    """The i-th task goes to worker i mod n, ids in order; positions come from range counts, not from one sort."""
    from telemill.operators.numbering import numbered

    ids = workers.agg(F.sort_array(F.collect_list("worker_id")).alias("ids"))
    at = numbered(tasks, order, "_at").crossJoin(F.broadcast(ids))
    return at.select(*tasks.columns, F.get("ids", F.pmod(F.col("_at"), F.size("ids")).cast("int")).alias("worker_id"))


def random_choice(tasks: DataFrame, workers: DataFrame, key: str, seed: int) -> DataFrame:
    """A uniform choice by the first 60 bits of the MD5 of "key:seed": the same on every run and every partitioning."""
    ids = workers.agg(F.sort_array(F.collect_list("worker_id")).alias("ids"))
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return tasks.crossJoin(F.broadcast(ids)).select(*tasks.columns, F.get("ids", F.pmod(drawn, F.size("ids")).cast("int")).alias("worker_id"))


def predictive(candidates: DataFrame, risk: float = 1.0, limit: float = 0.8, urgent_limit: float = 0.5, urgent_from: int = 8) -> DataFrame:
    """Lowest expected cost (wait + exec)(1 + risk x overload) per task.

    A candidate over the overload limit is skipped while any is at or below it. If any candidate of a task has no
    prediction the least loaded wins, with the reason.
    """
    own = Window.partitionBy("task_id")
    cap = F.when(F.col("priority") >= urgent_from, urgent_limit).otherwise(limit)
    each = F.when(F.col("avg_exec_ms") > 0, F.col("avg_exec_ms")).otherwise(F.col("pred_exec_ms"))
    wait = F.greatest(F.lit(0), F.col("queue_len")) * each / F.greatest(F.lit(1), F.col("pool_size"))
    scored = candidates.withColumns({
        "_cost": (wait + F.col("pred_exec_ms")) * (1 + risk * F.col("overload_prob")), "_missing": F.count_if(F.col("pred_exec_ms").isNull()).over(own) > 0,
        "_some": F.min("overload_prob").over(own) <= cap, "_over": F.col("overload_prob") > cap,
    })
    score = F.when(F.col("_missing"), least_loaded()).when(~(F.col("_some") & F.col("_over")), F.col("_cost"))
    picked = pick_lowest(scored, score, extra=("_missing",))
    return picked.select("task_id", "worker_id", F.round("score", 6).alias("score"), F.when(F.col("_missing"), "no prediction").alias("fallback"))


def breakdown(candidates: DataFrame, score: Column) -> DataFrame:
    """Per task the candidates and their scores as JSON, workers in order; scores that aren't finite are null."""
    s = F.round(score, 4)
    finite = F.when(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))), s)
    listed = candidates.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("worker_id", finite.alias("score")))).alias("c"))
    return listed.select("task_id", F.to_json("c", {"ignoreNullFields": "false"}).alias("breakdown"), F.size("c").cast("long").alias("n"))
