"""Grouped statistics of executions, tasks and runs.

Each is one partial-and-final aggregation; several groupings of one input share a shuffle by grouping sets or rollup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.catalogue import NEVER_CACHED
from telemill.operators.numbering import numbered, peaks, running
from telemill.operators.selection import with_percentiles
from telemill.session import if_small


def disc(column: str, p: float) -> Column:
    """Nearest-rank percentile."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def exec_stats(executions: DataFrame, keys: tuple[str, str] = ("task_type", "worker_id"), value: str = "exec_ms") -> DataFrame:
    """Count, mean and total of completed executions by each key alone, in one shuffle; a null key is a group of its kind."""
    a, b = keys
    done = executions.where("status = 'COMPLETED'")
    sets = done.groupingSets([[a], [b]], a, b).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"), F.grouping(a).alias("_of_b"))
    of_a = F.col("_of_b") == 0
    return sets.select(F.when(of_a, "type").otherwise("worker").alias("kind"), F.when(of_a, F.col(a)).otherwise(F.col(b)).alias("key"), "n", F.round("mean", 6).alias("mean_ms"), F.col("total").alias("total_ms"))


def type_worker_stats(executions: DataFrame) -> DataFrame:
    """Count, mean, p50, p95 and sample deviation (0 for one row) per type and worker."""
    plain = [F.count("*").alias("n"), F.round(F.avg("exec_ms"), 6).alias("mean_ms"), F.round(F.coalesce(F.stddev_samp("exec_ms"), F.lit(0.0)), 6).alias("std_ms")]
    done = executions.where("status = 'COMPLETED'")
    out = with_percentiles(done, ("task_type", "worker_id"), plain, "exec_ms", {"p50_ms": ("disc", 0.5), "p95_ms": ("disc", 0.95)})
    return out.withColumns({c: F.col(c).cast("long") for c in ("p50_ms", "p95_ms")})


def sla_report(tasks: DataFrame, by: str = "strategy") -> DataFrame:
    """Tasks with a deadline: on time, late (finished any other way), open; by a key (null too) and for all, with the share on time."""
    finished = F.col("status").isin("COMPLETED", "FAILED")
    on_time = (F.col("status") == "COMPLETED") & (F.col("completed_ms") <= F.col("deadline_ms"))
    out = tasks.where("deadline_ms is not null").rollup(by).agg(
        F.count_if(on_time).alias("on_time"), F.count_if(finished & ~F.coalesce(on_time, F.lit(False))).alias("late"), F.count_if(~finished).alias("open"),
        F.grouping(by).alias("_all"),
    )
    ended = F.col("on_time") + F.col("late")
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(by)).alias(by), "on_time", "late", "open", F.round(F.when(ended > 0, 100.0 * F.col("on_time") / ended), 6).alias("on_time_pct"))


def kpis(tasks: DataFrame, window_ms: int) -> DataFrame:
    """Completed tasks of the last ``window_ms`` before the newest completion: counts, mean and p95 latency, rate, compliance."""
    done = tasks.where("status = 'COMPLETED'")
    newest = done.agg(F.max("completed_ms").alias("newest"))
    recent = done.crossJoin(F.broadcast(newest)).where(F.col("completed_ms") > F.col("newest") - window_ms)
    latency = (F.col("completed_ms") - F.col("submitted_ms")).cast("double")
    plain = [
        F.count("*").alias("completed"), F.round(F.avg("latency"), 1).alias("mean_latency_ms"),
        F.count("deadline_ms").alias("with_deadline"), F.count_if(F.col("completed_ms") <= F.col("deadline_ms")).alias("sla_met"),
    ]
    out = with_percentiles(recent.withColumn("latency", latency), (), plain, "latency", {"p95_latency_ms": ("cont", 0.95)})
    out = out.withColumn("p95_latency_ms", F.round("p95_latency_ms", 1))
    return out.withColumn("per_minute", F.round(F.col("completed") * 60000.0 / window_ms, 9)).withColumn(
        "compliance_pct", F.round(F.when(F.col("with_deadline") > 0, 100.0 * F.col("sla_met") / F.col("with_deadline")), 6)
    )


def accuracy_by_type(outcomes: DataFrame, last: int) -> DataFrame:
    """Mean absolute error, count and cold starts per type over the newest ``last`` outcomes."""
    recent = outcomes.orderBy(F.desc("ts_ms"), F.desc("exec_id")).limit(last)
    return recent.groupBy("task_type").agg(F.round(F.avg("abs_error_ms"), 6).alias("mae_ms"), F.count("*").alias("n"), F.count_if("cold_start").alias("cold_starts"))


def replication_lag(log: DataFrame) -> DataFrame:
    """Per node its newest sequence number, entries and last time, and how far it is behind the head."""
    nodes = log.groupBy("node_id").agg(F.max("seq_no").alias("max_seq"), F.count("*").alias("entries"), F.max("applied_ms").alias("last_applied_ms"))
    head = nodes.agg(F.max("max_seq").alias("head"))
    return nodes.crossJoin(F.broadcast(head)).withColumn("lag", F.col("head") - F.col("max_seq")).drop("head")


def suite_counts(runs: DataFrame) -> DataFrame:
    """Runs, first and last repetition per suite (second part of the run id)."""
    return runs.groupBy(F.split_part("run_id", F.lit("/"), F.lit(2)).alias("suite")).agg(F.count("*").alias("runs"), F.min("rep").alias("first_rep"), F.max("rep").alias("last_rep"))


def run_latency(replay: DataFrame, warm_share: float = 0.1) -> DataFrame:
    """Mean, p95 and p99 latency of completed tasks after the first tenth (rounded up, any status) of each run.

    Ranks within a run come from one sort by (run, submission, task): a run is one experiment of bounded length.
    """
    order = Window.partitionBy("run_id").orderBy("submit_ms", "task_no")
    ranked = replay.withColumn("rank", F.row_number().over(order)).withColumn("size", F.count("*").over(Window.partitionBy("run_id")))
    counted = ranked.where((F.col("rank") > F.ceil(F.col("size") * warm_share)) & (F.col("status") == "COMPLETED"))
    return counted.groupBy("run_id").agg(
        F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), disc("latency_ms", 0.95).cast("long").alias("p95_ms"), disc("latency_ms", 0.99).cast("long").alias("p99_ms")
    )


def run_throughput(replay: DataFrame) -> DataFrame:
    """Tasks, completed, failed and completed per second of the makespan (at least 1 ms)."""
    out = replay.groupBy("run_id").agg(
        F.count("*").alias("tasks"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.greatest(F.lit(1), F.max("end_ms") - F.min("submit_ms")).cast("long").alias("makespan_ms"),
    )
    return out.withColumn("throughput", F.round(F.col("completed") * 1000.0 / F.col("makespan_ms"), 9))


def run_imbalance(replay: DataFrame, workers: DataFrame) -> DataFrame:
    """Population deviation of completed tasks per worker, idle workers counting 0."""
    runs = replay.select("run_id").distinct()
    seats = runs.crossJoin(if_small(workers.select(F.col("worker_id").alias("worker"))))
    done = replay.where("status = 'COMPLETED'").groupBy("run_id", "worker").agg(F.count("*").alias("c"))
    return seats.join(done, ["run_id", "worker"], "left").groupBy("run_id").agg(F.round(F.stddev_pop(F.coalesce("c", F.lit(0)).cast("double")), 6).alias("imbalance"))


def run_max_queue(replay: DataFrame) -> DataFrame:
    """The most tasks waiting at once: [submit, start), or until the end, or for ever; starts come first at ties."""
    until = F.coalesce("start_ms", "end_ms")
    waits = replay.where(until.isNull() | (until > F.col("submit_ms")))
    steps = F.array(F.struct(F.col("submit_ms").alias("t"), F.lit(1).alias("d")), F.struct(until.alias("t"), F.lit(-1).alias("d")))
    events = waits.select("run_id", F.inline(steps)).where("t is not null").groupBy("run_id", "t", "d").agg(F.sum("d").alias("d_sum"))
    peak = peaks(events, ("run_id",), ("t", "d"), "d_sum")
    return replay.select("run_id").distinct().join(peak, "run_id", "left").select("run_id", F.greatest(F.lit(0), F.coalesce("peak", F.lit(0))).cast("long").alias("max_queue"))


def run_sla(replay: DataFrame, deadline_ms: int) -> DataFrame:
    """Per cent of all tasks that failed or took longer than the deadline."""
    bad = (F.col("status") == "FAILED") | F.coalesce(F.col("latency_ms") > deadline_ms, F.lit(False))
    return replay.groupBy("run_id").agg(F.round(100.0 * F.avg(bad.cast("int")), 6).alias("violations_pct"))


def run_cpu(samples: DataFrame) -> DataFrame:
    """Mean CPU per worker, then mean and population variance across workers."""
    return samples.groupBy("worker_id").agg(F.avg("cpu_pct").alias("m")).agg(F.round(F.avg("m"), 6).alias("cpu_mean"), F.round(F.var_pop("m"), 6).alias("cpu_var"))


def suite_summary(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Long form: n, mean and sample deviation (null below 2) per scenario, strategy and metric; blanks left out."""
    cells = runs.select("scenario", "strategy", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["scenario", "strategy"], metrics, "metric", "value")
    finite = cells.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return finite.groupBy("scenario", "strategy", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("value")).alias("std"))


def latency_cdf(replay: DataFrame) -> DataFrame:
    """Share of completed latencies up to each value per scenario and strategy, by counts of distinct values."""
    counts = replay.where("status = 'COMPLETED'").groupBy("scenario", "strategy", "latency_ms").agg(F.count("*").alias("c"))
    key = ("scenario", "strategy")
    upto = running(counts, key, ("latency_ms",), {"_upto": ("sum", F.col("c"))}).withColumn("_key", F.struct(*key))
    totals = counts.groupBy(F.struct(*key).alias("_key")).agg(F.sum("c").alias("_n"))
    return upto.join(if_small(totals), "_key").select(*key, "latency_ms", F.round(F.col("_upto") / F.col("_n"), 9).alias("share"))


EDGES = [0, 50, 100, 200, 500, 1000, 2000, 5000]


def latency_histogram(latencies: DataFrame, value: str, edges: list[int] = EDGES) -> DataFrame:
    """Counts in left-closed buckets, the last without end."""
    bucket = F.lit(None).cast("long")
    for edge in edges:
        bucket = F.when(F.col(value) >= edge, F.lit(edge).cast("long")).otherwise(bucket)
    return latencies.where(F.col(value) >= edges[0]).groupBy(bucket.alias("from_ms")).agg(F.count("*").alias("n"))


def imbalance_box(imbalances: DataFrame) -> DataFrame:
    """Quartiles per scenario and strategy."""
    q = F.percentile("imbalance", [0.25, 0.5, 0.75])
    return imbalances.groupBy("scenario", "strategy").agg(q.alias("q")).select("scenario", "strategy", *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("q1", "q2", "q3"))])


def replay_summary(replay: DataFrame) -> DataFrame:
    """Completed, not completed and mean execution (-1 for none) per type (null too) and for all."""
    done = F.col("status").eqNullSafe("COMPLETED")
    return replay.rollup("task_type").agg(
        F.count_if(done).alias("completed"), F.count_if(~done).alias("not_completed"), F.round(F.coalesce(F.avg(F.when(done, F.col("exec_ms"))), F.lit(-1.0)), 6).alias("mean_exec_ms"),
        F.grouping("task_type").alias("_all"),
    ).withColumn("task_type", F.when(F.col("_all") == 1, "all").otherwise(F.col("task_type"))).drop("_all")


def slice_stats(rows: DataFrame, key: str, value: str, category: str, n: int) -> DataFrame:
    """Count, sum, mean, distinct categories and maximum over the first ``n`` rows by key."""
    return rows.orderBy(key).limit(n).agg(
        F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.countDistinct(category).alias("categories"), F.max(value).alias("largest")
    )


def speedup(timings: DataFrame) -> DataFrame:
    """Median time per size and processes, speed-up against one process and efficiency."""
    medians = timings.groupBy("size", "procs").agg(F.percentile("ms", 0.5).alias("ms"))
    one = medians.where("procs = 1").select("size", F.col("ms").alias("base"))
    return medians.join(one, "size", "left").select("size", "procs", F.round("ms", 6).alias("ms"), F.round(F.col("base") / F.col("ms"), 6).alias("speedup"), F.round(F.col("base") / F.col("ms") / F.col("procs"), 6).alias("efficiency"))


def median_run(runs: DataFrame, by: str, value: str, run: str) -> DataFrame:
    """The run with the middle value (upper of two) in each group, not the median of columns."""
    order = Window.partitionBy(by).orderBy(value, run)
    ranked = runs.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).drop("_r", "_n")


def rank_balance(tasks: DataFrame, ranks: int, key: str, size: str) -> DataFrame:
    """Round-robin split over ranks: tasks, sizes and their maximum over the mean.

    Positions come from counts of key ranges added up, so no single task numbers all rows.
    """
    split = numbered(tasks.select(key, size), key, "at").groupBy(F.pmod(F.col("at"), F.lit(ranks)).alias("rank")).agg(F.count("*").alias("tasks"), F.sum(size).alias("busy"))
    whole = split.agg(F.max("busy").alias("makespan"), F.sum("busy").alias("total"), F.avg("busy").alias("mean"))
    return split.crossJoin(F.broadcast(whole)).select("rank", "tasks", "busy", "makespan", "total", F.round(F.col("makespan") / F.col("mean"), 6).alias("max_over_mean"))


def failover_audit(events: DataFrame, start: str, success: str, kill: str) -> DataFrame:
    """Per task starts and successes; lost, duplicated and repeated counts and the first success after the first kill."""
    per = events.where(F.col("type").isin(start, success)).groupBy("task_id").agg(
        F.count_if(F.col("type") == start).alias("starts"), F.count_if(F.col("type") == success).alias("successes")
    )
    counts = per.agg(
        F.count_if((F.col("starts") > 0) & (F.col("successes") == 0)).alias("lost"), F.count_if(F.col("successes") > 1).alias("duplicated"), F.count_if(F.col("starts") > 1).alias("ran_twice")
    )
    killed = events.where(F.col("type") == kill).agg(F.min("physical_ms").alias("kill_ms"))
    after = events.where(F.col("type") == success).crossJoin(F.broadcast(killed)).where("physical_ms > kill_ms").agg(F.min("physical_ms").alias("first_success_ms"), F.min("kill_ms").alias("kill_ms"))
    return counts.crossJoin(F.broadcast(after)).withColumn("failover_ms", F.col("first_success_ms") - F.col("kill_ms"))


def cache_hits(tasks: DataFrame, key: list[str], never: list[str] = NEVER_CACHED) -> DataFrame:
    """Hits and misses per type if the first completed task of each key were kept and later ones served from it.

    Which row of a key comes first doesn't matter for the counts, so a key that many tasks share costs no sort.
    """
    usable = tasks.where((F.col("status") == "COMPLETED") & ~F.col("task_type").isin(*never))
    per = usable.groupBy(*key).agg(F.count("*").alias("n"))
    return per.groupBy("task_type").agg(F.sum(F.col("n") - 1).alias("hits"), F.count("*").alias("misses"))


def load_heatmap(samples: DataFrame, workers: DataFrame, bucket_ms: int) -> DataFrame:
    """Busy threads over pool size per worker and time bucket, 0 where the pool is 0 or unknown."""
    means = samples.groupBy("worker_id", F.floor(F.col("ts_ms") / bucket_ms).alias("bucket")).agg(F.avg("active_threads").alias("busy"))
    joined = means.join(workers.select("worker_id", "pool_size"), "worker_id", "left")
    return joined.select("worker_id", "bucket", F.round(F.when(F.col("pool_size") > 0, F.col("busy") / F.col("pool_size")).otherwise(0.0), 6).alias("load"))


def gantt_rows(tasks: DataFrame) -> DataFrame:
    """Finished tasks with worker, start and end, and the ends of the whole chart."""
    rows = tasks.where("worker_id is not null and started_ms is not null and completed_ms is not null").select("task_id", "worker_id", "started_ms", "completed_ms")
    ends = rows.agg(F.min("started_ms").alias("chart_from_ms"), F.max("completed_ms").alias("chart_to_ms"))
    return rows.crossJoin(F.broadcast(ends))


def dataset_card(rows: DataFrame, label: str = "overloaded", queue: str = "queue_len") -> DataFrame:
    """The tables of a data set's card in one shuffle: section, key, rows, runs, completed runs with their times, and the share with the label.

    Sections: all rows, class balance, and rows by worker, queue length, type, status and run.
    """
    names = {label: "class", "worker_id": "worker", queue: "queue", "task_type": "type", "status": "status", "run_no": "run"}
    done = F.when(F.col("status") == "COMPLETED", F.col("exec_ms"))
    own = rows.withColumns({"_done": done, "_run": F.col("run_no"), "_label": F.col(label)})
    sets = own.groupingSets([[], *[[c] for c in names]], *names)
    percentile = lambda p: F.round(F.expr(f"percentile(cast(_done as double), {p})"), 6)
    out = sets.agg(
        F.count("*").alias("n"), F.countDistinct("_run").alias("runs"), F.count("_done").alias("completed"), F.round(F.avg("_done"), 6).alias("mean_ms"), percentile(0.5).alias("p50_ms"),
        percentile(0.95).alias("p95_ms"), F.max("_done").alias("max_ms"), F.round(F.avg(F.col("_label").cast("double")), 6).alias("label_share"), *[F.grouping(c).alias(f"_g_{c}") for c in names],
    )
    section, key = F.lit("all"), F.lit(None).cast("string")
    for column, name in names.items():
        section = F.when(F.col(f"_g_{column}") == 0, name).otherwise(section)
        key = F.when(F.col(f"_g_{column}") == 0, F.col(column).cast("string")).otherwise(key)
    return out.select(section.alias("section"), key.alias("key"), "n", "runs", "completed", "mean_ms", "p50_ms", "p95_ms", "max_ms", "label_share")


def slot_usage(samples: DataFrame, workers: DataFrame, bucket_ms: int, forecast: DataFrame | None = None) -> DataFrame:
    """Capacity, busy slots, utilisation (1 at no capacity) and reactive demand per time bucket, from each worker's newest sample in it.

    With ``forecast`` (worker_id, bucket, pred_queue_len) also demand_forecast: queued and running tasks and the
    predicted queue (not under 0), or where there is none the tasks over the pool.
    """
    newest = samples.groupBy("worker_id", F.floor(F.col("ts_ms") / bucket_ms).alias("bucket")).agg(
        F.max_by(F.struct("active_threads", "queue_len"), F.struct("ts_ms", "sample_id")).alias("s")
    )
    joined = newest.join(workers.select("worker_id", "pool_size"), "worker_id").select("worker_id", "bucket", "pool_size", "s.*")
    if forecast is not None:
        joined = joined.join(forecast.select("worker_id", "bucket", "pred_queue_len"), ["worker_id", "bucket"], "left")
        waiting = F.coalesce(F.greatest(F.lit(0.0), F.col("pred_queue_len")), F.greatest(F.lit(0), F.col("active_threads") - F.col("pool_size")).cast("double"))
        expected = F.sum(F.col("queue_len") + F.least("active_threads", "pool_size") + waiting)
    more = [] if forecast is None else [F.round(expected, 6).alias("demand_forecast")]
    out = joined.groupBy("bucket").agg(
        F.sum("pool_size").alias("capacity"), F.sum(F.least("active_threads", "pool_size")).alias("busy"), F.sum(F.col("queue_len") + F.col("active_threads")).alias("demand"),
        *more,
    )
    return out.withColumn("utilisation", F.round(F.when(F.col("capacity") == 0, 1.0).otherwise(F.col("busy") / F.col("capacity")), 6))
