"""Listings and look-ups with their arguments: filters first, then an order and a limit that are the feature itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.scalars import straggler_limit
from telemill.operators.aggregates import disc


def list_tasks(tasks: DataFrame, status: str | None = None, task_type: str | None = None, limit: int = 200, most: int = 5000) -> DataFrame:
    """The newest tasks with their latency, of a status and type (any case) if given; the limit is kept within 1 and ``most``."""
    rows = tasks
    for column, wanted in (("status", status), ("task_type", task_type)):
        if wanted:
            rows = rows.where(F.upper(column) == wanted.upper())
    rows = rows.orderBy(F.desc("submitted_ms"), F.desc("task_no")).limit(max(1, min(most, limit)))
    return rows.select("task_id", "task_type", "status", "submitted_ms", (F.col("completed_ms") - F.col("submitted_ms")).alias("latency_ms"))


def newest(rows: DataFrame, order: tuple[str, str], limit: int, where: dict[str, list] | None = None) -> DataFrame:
    """The last rows by time and id, of those whose columns have one of the values given."""
    for column, values in (where or {}).items():
        rows = rows.where(F.col(column).isin(*values))
    return rows.orderBy(*[F.desc(c) for c in order]).limit(limit)


def dead_letters(tasks: DataFrame, default_retries: int, limit: int = 0) -> DataFrame:
    """Failed tasks with more attempts than retries (``max_retries``; negative or null: the default) allow, newest first; a limit of 0 or less gives all."""
    allowed = F.when(F.col("max_retries") >= 0, F.col("max_retries")).otherwise(default_retries)
    dead = tasks.where((F.col("status") == "FAILED") & (F.col("attempts") > allowed)).orderBy(F.desc("submitted_ms"), "task_no")
    return dead.limit(limit) if limit > 0 else dead


def stragglers(running: DataFrame, finished: DataFrame, k: float, least: int = 20) -> DataFrame:
    """Original attempts whose elapsed time is over the larger of k x prediction and their type's p90, whichever there are.

    ``running`` has task_type, attempt, elapsed_ms and pred_ms (or null); types with fewer than ``least`` finished runs
    have no p90.
    """
    p90 = finished.groupBy("task_type").agg(F.count("exec_ms").alias("_n"), disc("exec_ms", 0.9).cast("double").alias("_p90")).where(F.col("_n") >= least)
    joined = running.where("attempt = 1").join(p90.drop("_n"), "task_type", "left")
    limited = joined.withColumn("limit_ms", straggler_limit(F.col("pred_ms"), F.col("_p90"), k))
    return limited.where(F.col("elapsed_ms") > F.col("limit_ms")).drop("_p90")
