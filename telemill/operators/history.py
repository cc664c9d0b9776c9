"""Leak-free features, labels and signals over execution and sample history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.catalogue import LEGAL_CHANGES
from telemill.operators.numbering import asof, numbered, reach_sums, rolling_mean, running
from telemill.operators.selection import moving_percentile
from telemill.session import materialize

DAY = 86_400_000


def worker_windows(executions: DataFrame, size_ms: int, slide_ms: int) -> DataFrame:
    """Arrivals per second, mean and largest queue per worker in sliding windows."""
    at = F.timestamp_millis("dispatched_ms")
    grouped = executions.groupBy("worker_id", F.window(at, f"{size_ms} milliseconds", f"{slide_ms} milliseconds").alias("w"))
    out = grouped.agg(F.count("*").alias("n"), F.avg("queue_len").alias("mean"), F.max("queue_len").alias("queue_max"))
    return out.select(
        "worker_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), F.round(F.col("n") * 1000.0 / size_ms, 9).alias("arrival_rate"),
        F.round("mean", 6).alias("queue_mean"), "queue_max",
    )


def asof_window(executions: DataFrame, windows: DataFrame, step: int = DAY) -> DataFrame:
    """Each execution with the latest window of its worker that had ended at its dispatch."""
    take = {"win_end_ms": "end_ms", "win_arrival_rate": "arrival_rate", "win_queue_mean": "queue_mean", "win_queue_max": "queue_max"}
    return asof(executions, windows, "worker_id", "dispatched_ms", "end_ms", take, step)


def label_queue_future(executions: DataFrame, samples: DataFrame, horizon_ms: int, tolerance_ms: int, step: int = DAY) -> DataFrame:
    """queue_len_future: the queue at the last sample at or before dispatch + horizon, if that is within the tolerance."""
    end = executions.withColumn("_end", F.col("dispatched_ms") + horizon_ms)
    out = asof(end, samples, "worker_id", "_end", "ts_ms", {"_q": "queue_len", "_at": "ts_ms"}, step, "sample_id")
    return out.withColumn("queue_len_future", F.when(F.col("_end") - F.col("_at") <= tolerance_ms, F.col("_q"))).drop("_end", "_q", "_at")


def label_overload_future(executions: DataFrame, samples: DataFrame, workers: DataFrame, horizon_ms: int, cpu: float, factor: float, step: int = DAY) -> DataFrame:
    """overloaded_future: any sample in (dispatch, dispatch + horizon] over the CPU threshold or with queue >= factor x pool; null without samples.

    Counts at both ends come from running sums for each distinct worker and dispatch, so no interval is joined and
    repeated rows all stay; an unknown pool never flags by queue, and an unknown worker or dispatch has no samples.
    """
    key = ["worker_id", "dispatched_ms"]
    pools = samples.where("worker_id is not null and ts_ms is not null").join(workers.select("worker_id", "pool_size"), "worker_id", "left")
    flag = (F.col("cpu_pct") > cpu) | F.coalesce(F.col("queue_len") >= factor * F.col("pool_size"), F.lit(False))
    fact = pools.select("worker_id", F.col("ts_ms").alias("_t"), F.lit(0).alias("_side"), F.lit(1).alias("_one"), flag.cast("int").alias("_flag"))
    ends = F.array(F.struct(F.col("dispatched_ms").alias("_t"), F.lit(1).alias("_side")), F.struct((F.col("dispatched_ms") + horizon_ms).alias("_t"), F.lit(2).alias("_side")))
    probe = executions.where("worker_id is not null and dispatched_ms is not null").select(*key).distinct().select(*key, F.inline(ends))
    both = probe.unionByName(fact, allowMissingColumns=True)
    counts = running(both, ("worker_id",), ("_t", "_side"), {"_n": ("sum", F.col("_one")), "_f": ("sum", F.col("_flag"))}, step).where("_side > 0")
    at = lambda c, side: F.max(F.when(F.col("_side") == side, F.coalesce(F.col(c), F.lit(0))))
    per = counts.groupBy(*key).agg((at("_n", 2) - at("_n", 1)).alias("n"), (at("_f", 2) - at("_f", 1)).alias("f"))
    return executions.join(per.select(*key, F.when(F.col("n") > 0, F.col("f") > 0).alias("overloaded_future")), key, "left")


def prior_stats(executions: DataFrame, step: int = DAY) -> DataFrame:
    """prior_mean_ms, prior_count, prior_stats_ms: completed runs of the same type and worker finished at or before dispatch.

    Runs with an unknown type, worker or finish are nobody's prior runs.
    """
    key = ("task_type", "worker_id")
    end = F.col("dispatched_ms") + F.col("wait_ms") + F.col("exec_ms")
    fact = executions.where("status = 'COMPLETED' and task_type is not null and worker_id is not null").select(*key, end.alias("_t"), F.lit(0).alias("_side"), F.col("exec_ms").alias("_x")).where("_t is not null")
    probe = executions.withColumn("_t", F.col("dispatched_ms")).withColumn("_side", F.lit(1))
    both = probe.unionByName(fact, allowMissingColumns=True)
    values = {"_sum": ("sum", F.col("_x")), "_n": ("sum", F.when(F.col("_x").isNotNull(), 1)), "prior_stats_ms": ("max", F.when(F.col("_side") == 0, F.col("_t")))}
    out = running(both, key, ("_t", "_side"), values, step).where("_side = 1")
    return out.select(*executions.columns, F.round(F.col("_sum") / F.col("_n"), 6).alias("prior_mean_ms"), F.coalesce("_n", F.lit(0)).cast("long").alias("prior_count"), "prior_stats_ms")


def tag_runs(executions: DataFrame, runs: DataFrame) -> DataFrame:
    """Executions with the last run (by ``run_order``) whose prefix and suffix their task id has; untagged rows are dropped.

    Each distinct task id meets runs by equal ends: it is cut once for every pair of lengths that prefixes and suffixes
    have (few, and all that the driver sees), so no product of ids and runs is made. Repeated executions all stay.
    """
    sized = runs.where("prefix is not null and suffix is not null").select("prefix", "suffix", "run", "run_order", F.length("prefix").alias("p"), F.length("suffix").alias("s"))
    lengths = [(r["p"], r["s"]) for r in sized.select("p", "s").distinct().collect()]
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, s in lengths]) if lengths else F.lit(None).cast("array<struct<p: int, s: int>>")
    ids = executions.select("task_id").distinct().select("task_id", F.inline(pairs)).where("length(task_id) >= greatest(p, s)")
    ends = ids.select("task_id", "p", "s", F.left("task_id", F.col("p")).alias("prefix"), F.right("task_id", F.col("s")).alias("suffix"))
    tagged = ends.join(sized, ["prefix", "suffix", "p", "s"]).groupBy("task_id").agg(F.max_by("run", "run_order").alias("run"))
    return executions.join(tagged, "task_id").select(*executions.columns, "run")


def enrich_worker(executions: DataFrame, workers: DataFrame) -> DataFrame:
    """pool_size (null if unknown) and slowdown (1 if unknown)."""
    return executions.join(workers.select("worker_id", "pool_size", "slowdown"), "worker_id", "left").withColumn("slowdown", F.coalesce("slowdown", F.lit(1.0)))


def workers_latest(workers: DataFrame, samples: DataFrame) -> DataFrame:
    """Every worker with its newest sample, or none."""
    newest = samples.groupBy("worker_id").agg(F.max_by(F.struct("ts_ms", "cpu_pct", "queue_len", "active_threads"), F.struct("ts_ms", "sample_id")).alias("s"))
    return workers.join(newest, "worker_id", "left").select("worker_id", "pool_size", "s.*")


def close_failures(failures: DataFrame, recoveries: DataFrame, step: int = DAY) -> DataFrame:
    """recovered_ms: the first recovery of a failure's node at or after its detection."""
    probe = failures.withColumn("_neg", -F.col("detected_ms"))
    fact = recoveries.withColumn("_neg", -F.col("recovered_ms"))
    return asof(probe, fact, "node_id", "_neg", "_neg", {"recovered_ms": "recovered_ms"}, step).drop("_neg")


def first_rows(rows: DataFrame, by: tuple[str, ...], order: tuple, k: int, parts: int = 64) -> DataFrame:
    """The first ``k`` rows of each key: of each of ``parts`` random sub-groups of a key first, then of those left.

    No task holds a whole key, and no rows are collected; ``order`` should decide between any two rows of a key.
    """
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    within = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_r") <= k)
    return within.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r", "_part")


def nearest_samples(queries: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """For each query the ``k`` executions of its type nearest in log1p(size), the smaller side first on ties, then the id.

    History is counted per type and size first (sizes repeat) and the sizes of a type are numbered. An as-of join gives
    a query's place among them, so it meets the ``k`` sizes on either side of it alone; only as many rows are expanded
    as are needed. Unknown types and sizes find nothing.
    """
    key = ("task_type", "input_size")
    known = history.where("task_type is not null and input_size is not null")
    first = first_rows(known.where("exec_id is not null").select(*key, "exec_id"), key, ("exec_id",), k)
    ids = first.groupBy(*key).agg(F.sort_array(F.collect_list("exec_id")).alias("ids"))
    sizes = materialize(numbered(known.groupBy(*key).agg(F.count("*").alias("c")), "input_size", "at", ("task_type",)), "sizes")
    asked = queries.where("task_type is not null and input_size is not null").select("task_type", F.col("input_size").alias("size")).distinct()
    placed = asof(asked, sizes, "task_type", "size", "input_size", {"place": "at"})
    place = F.coalesce("place", F.lit(-1))
    near = placed.select("task_type", "size", F.explode(F.sequence(place - k + 1, place + k)).alias("at")).join(sizes, ["task_type", "at"])
    near = near.withColumn("distance", F.abs(F.log1p("input_size") - F.log1p("size")))
    order = Window.partitionBy("task_type", "size").orderBy(F.round("distance", 9), "input_size")
    taken = near.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < k)
    held = taken.join(ids, [*key]).select("task_type", F.col("size").alias("input_size"), "before", F.posexplode("ids").alias("i", "near_id"))
    picked = held.withColumn("rank", F.col("before") + F.col("i") + 1)
    return queries.join(picked.where(F.col("rank") <= k), [*key]).select("query_id", "rank", "near_id")


def rolling_mae(outcomes: DataFrame, last: int) -> DataFrame:
    """Mean absolute error of the last ``last`` outcomes after each, overall and per type. Writes both steps' inputs."""
    outcomes = materialize(outcomes, "outcomes")
    overall = materialize(rolling_mean(outcomes, "ts_ms", last, {"rolling_mae_ms": "abs_error_ms"}, tie=("exec_id",)), "outcomes")
    both = rolling_mean(overall, "ts_ms", last, {"rolling_type_mae_ms": "abs_error_ms"}, by=("task_type",), tie=("exec_id",))
    return both.withColumns({c: F.round(c, 6) for c in ("rolling_mae_ms", "rolling_type_mae_ms")})


def avg_exec_recent(executions: DataFrame, last: int) -> DataFrame:
    """Mean execution time of a worker's last ``last`` finished tasks, failed ones included, as of each finish."""
    done = executions.withColumn("finished_ms", F.col("dispatched_ms") + F.col("wait_ms") + F.col("exec_ms"))
    means = rolling_mean(done, "finished_ms", last, {"avg_exec_recent_ms": "exec_ms"}, by=("worker_id",), tie=("exec_id",))
    return means.withColumn("avg_exec_recent_ms", F.round("avg_exec_recent_ms", 6))


def arrival_rate(executions: DataFrame, reach_ms: int) -> DataFrame:
    """Dispatches in [t - reach, t] per second of the reach."""
    return reach_sums(executions, "dispatched_ms", reach_ms, {"_n": F.lit(1).cast("long")}).withColumn("arrival_rate", F.round(F.col("_n") * 1000.0 / reach_ms, 9)).drop("_n")


def running_means(executions: DataFrame, step: int = DAY) -> DataFrame:
    """Count and mean of executions so far, per type and per type and worker. Writes the first step."""
    ones = executions.withColumn("_one", F.lit(1).cast("long"))
    per_type = running(ones, ("task_type",), ("dispatched_ms", "exec_id"), {"type_n": ("sum", F.col("_one")), "_s": ("sum", F.col("exec_ms"))}, step)
    per_type = materialize(per_type.withColumn("type_mean_ms", F.round(F.col("_s") / F.col("type_n"), 6)).drop("_s"), "per-type")
    both = running(per_type, ("task_type", "worker_id"), ("dispatched_ms", "exec_id"), {"pair_n": ("sum", F.col("_one")), "_s": ("sum", F.col("exec_ms"))}, step)
    return both.withColumn("pair_mean_ms", F.round(F.col("_s") / F.col("pair_n"), 6)).drop("_s", "_one")


def recent_percentile(executions: DataFrame, last: int, p: float, least: int, by: tuple[str, ...], value: str = "exec_ms") -> DataFrame:
    """Nearest-rank percentile of the last ``last`` values per key, null below ``least`` of them."""
    return moving_percentile(executions, "dispatched_ms", last, value, p, least, "recent_p", by, ("exec_id",))


def queue_over_time(replay: DataFrame, step: int = 30 * DAY) -> DataFrame:
    """Waiting tasks of each run after every change (+1 on submission, -1 on start)."""
    steps = F.array(F.struct(F.col("submit_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("start_ms").alias("t"), F.lit(-1).alias("d")))
    changes = replay.select("run_id", F.inline(steps)).where("t is not null").groupBy("run_id", "t").agg(F.sum("d").alias("change"))
    return running(changes, ("run_id",), ("t",), {"waiting": ("sum", F.col("change"))}, step).select("run_id", "t", F.col("waiting").cast("long").alias("waiting"))


def queue_actual(samples: DataFrame, bucket_ms: int, shift_ms: int = 0, value: str = "queue_len") -> DataFrame:
    """Per bucket the mean queue of each worker, added up; ``shift_ms`` moves forecasts to the time they are for."""
    at = F.floor((F.col("ts_ms") + shift_ms) / bucket_ms) * bucket_ms
    return samples.groupBy("worker_id", at.alias("at_ms")).agg(F.avg(value).alias("m")).groupBy("at_ms").agg(F.round(F.sum("m"), 6).alias("queue"))


def drift_episodes(errors: DataFrame, threshold: float, patience: int, step: int = DAY) -> DataFrame:
    """Starts of drift episodes: the row at which the ratio has been over the threshold ``patience`` times in a row.

    ``errors`` has series, t, id, mae, baseline; rows with a null or non-positive baseline are left out.
    """
    usable = errors.where("baseline > 0 and mae is not null").withColumn("ratio", F.col("mae") / F.col("baseline"))
    over = running(usable, ("series",), ("t", "id"), {"_over": ("streak", F.col("ratio") > threshold)}, step)
    return over.where(F.col("_over") == patience).select("series", F.col("t").alias("started_ms"), "id")


def scale_signals(usage: DataFrame, up: float, down: float, cool: int, step: int = DAY) -> DataFrame:
    """scale_up where demand is over capacity x up on two checks in a row; scale_down where utilisation stayed under ``down`` for ``cool`` checks."""
    high, low = F.col("demand") > F.col("capacity") * up, F.col("utilisation") < down
    streaks = {"_high": ("streak", F.coalesce(high, F.lit(False))), "_quiet": ("streak", F.coalesce(low, F.lit(True)))}
    out = running(usage, (), ("bucket",), streaks, step)
    return out.select("bucket", (F.col("_high") >= 2).alias("scale_up"), (F.col("_quiet") >= cool).alias("scale_down"))


def illegal_transitions(changes: DataFrame, legal: list[tuple[str, str]] = LEGAL_CHANGES, key: str = "task_id", status: str = "type", order: tuple[str, ...] = ("physical_ms", "seq")) -> DataFrame:
    """Status changes of one task outside ``legal`` (a status to itself is illegal too)."""
    lagged = changes.withColumn("previous", F.lag(status).over(Window.partitionBy(key).orderBy(*order))).where("previous is not null")
    fine = F.struct("previous", status).isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in legal])
    return lagged.where(~fine).select(key, "seq", "previous", F.col(status).alias("status"))


def log_gaps(log: DataFrame, step: int) -> DataFrame:
    """Entries whose sequence number isn't that of the node's entry before plus one (equal numbers count too)."""
    lagged = running(log, ("node_id",), ("seq_no", "applied_ms", "task_id"), {"previous_seq": ("last", F.col("seq_no"))}, step, exclusive=True)
    return lagged.where("previous_seq is not null and seq_no <> previous_seq + 1").select("node_id", "seq_no", "previous_seq")
