"""Registered joins, windows and signals over history."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions.catalogue import LEGAL_CHANGES
from telemill.operators import history as op
from telemill.operators.numbering import reach_means
from telemill.plans.registry import plan
from telemill.session import if_small

HOUR = 3_600_000
_WINDOWS = """w as (select worker_id, s as start_ms, s + 3600000 as end_ms, round(count(*) / 3600.0, 9) as arrival_rate, round(avg(queue_len), 6) as queue_mean, max(queue_len) as queue_max
  from (select worker_id, queue_len, unnest([dispatched_ms // 1800000 * 1800000, dispatched_ms // 1800000 * 1800000 - 1800000]) as s from {executions}) group by 1, 2)"""


@plan("worker_windows", f"with {_WINDOWS} select * from w")
def _(executions):
    return op.worker_windows(executions, HOUR, HOUR // 2)


@plan("asof_window", f"""with {_WINDOWS}
select e.exec_id, w.end_ms as win_end_ms, w.arrival_rate as win_arrival_rate, w.queue_mean as win_queue_mean, w.queue_max as win_queue_max
from {{executions}} e asof left join w on w.worker_id = e.worker_id and w.end_ms <= e.dispatched_ms""")
def _(executions):
    return op.asof_window(executions, op.worker_windows(executions, HOUR, HOUR // 2)).select("exec_id", "win_end_ms", "win_arrival_rate", "win_queue_mean", "win_queue_max")


@plan("label_queue_future", """
select e.exec_id, case when e.dispatched_ms + 3600000 - s.ts_ms <= 1200000 then s.queue_len end as queue_len_future
from {executions} e asof left join {samples} s on s.worker_id = e.worker_id and s.ts_ms <= e.dispatched_ms + 3600000""")
def _(executions, samples):
    return op.label_queue_future(executions, samples, HOUR, HOUR // 3).select("exec_id", "queue_len_future")


@plan("label_overload_future", """
select e.exec_id, bool_or(case when s.ts_ms is null then null else s.cpu_pct > 85 or coalesce(s.queue_len >= 1.0 * w.pool_size, false) end) as overloaded_future
from {executions} e left join {samples} s on s.worker_id = e.worker_id and s.ts_ms > e.dispatched_ms and s.ts_ms <= e.dispatched_ms + 3600000
left join {workers} w on w.worker_id = s.worker_id group by e.exec_id""")
def _(executions, samples, workers):
    return op.label_overload_future(executions, samples, workers, HOUR, 85.0, 1.0).select("exec_id", "overloaded_future")


@plan("prior_stats", """
with f as (select task_type, worker_id, dispatched_ms + wait_ms + exec_ms as t, exec_ms from {executions} where status = 'COMPLETED'),
r as (select task_type, worker_id, t, sum(exec_ms) over w as s, count(*) over w as n from f window w as (partition by task_type, worker_id order by t range between unbounded preceding and current row)),
d as (select distinct * from r)
select e.exec_id, round(d.s / d.n, 6) as prior_mean_ms, coalesce(d.n, 0)::bigint as prior_count, d.t as prior_stats_ms
from {executions} e asof left join d on d.task_type = e.task_type and d.worker_id = e.worker_id and d.t <= e.dispatched_ms""")
def _(executions):
    return op.prior_stats(executions).select("exec_id", "prior_mean_ms", "prior_count", "prior_stats_ms")


@plan("tag_runs", """
with r as (select concat('run-', attempt, '-', priority) as run, concat('task-', priority) as prefix, cast(attempt as varchar) as suffix, attempt * 100 + priority as run_order from (select distinct attempt, priority from {executions}))
select task_id, run from {executions} join (
  select task_id, arg_max(run, run_order) as run from (select distinct task_id from {executions}) join r on starts_with(task_id, prefix) and ends_with(task_id, suffix) group by task_id) using (task_id)""")
def _(executions):
    a, p = F.col("attempt").cast("string"), F.col("priority").cast("string")
    runs = executions.select("attempt", "priority").distinct().select(
        F.concat(F.lit("run-"), a, F.lit("-"), p).alias("run"), F.concat(F.lit("task-"), p).alias("prefix"), a.alias("suffix"), (F.col("attempt") * 100 + F.col("priority")).alias("run_order")
    )
    return op.tag_runs(executions.select("task_id"), runs)


@plan("enrich_worker", "select exec_id, pool_size, coalesce(slowdown, 1.0)::double as slowdown from {executions} e left join {workers} w on w.worker_id = e.worker_id")
def _(executions, workers):
    return op.enrich_worker(executions, workers).select("exec_id", "pool_size", "slowdown")


@plan("workers_latest", """
select w.worker_id, pool_size, s.ts_ms, s.cpu_pct, s.queue_len, s.active_threads from {workers} w
left join (select * from {samples} qualify row_number() over (partition by worker_id order by ts_ms desc, sample_id desc) = 1) s on s.worker_id = w.worker_id""")
def _(workers, samples):
    return op.workers_latest(workers, samples)


@plan("clock_latest", """
select node_id, ts_ms, round_no, offset_ms from {clock_sync} qualify row_number() over (partition by node_id order by ts_ms desc, round_no desc) = 1""")
def _(clock_sync):
    newest = F.max_by(F.struct("ts_ms", "round_no", "offset_ms"), F.struct("ts_ms", "round_no"))
    return clock_sync.groupBy("node_id").agg(newest.alias("s")).select("node_id", "s.*")


@plan("close_failures", """
select failure_id, f.node_id, detected_ms, min(recovered_ms) as recovered_ms from {failures} f left join {recoveries} r on r.node_id = f.node_id and recovered_ms >= detected_ms group by 1, 2, 3""")
def _(failures, recoveries):
    return op.close_failures(failures, recoveries).select("failure_id", "node_id", "detected_ms", "recovered_ms")


@plan("nearest_samples", """
with q as (select task_type, input_size, min(exec_id) as query_id from {executions} where status = 'FAILED' group by 1, 2),
j as (select query_id, h.exec_id as near_id, row_number() over (partition by query_id order by round(abs(ln(1 + h.input_size) - ln(1 + q.input_size)), 9), h.input_size, h.exec_id) as rank
  from q join {executions} h on h.task_type = q.task_type and h.status = 'COMPLETED')
select query_id, rank, near_id from j where rank <= 5""")
def _(executions):
    asked = executions.where("status = 'FAILED'").groupBy("task_type", "input_size").agg(F.min("exec_id").alias("query_id"))
    return op.nearest_samples(asked, executions.where("status = 'COMPLETED'"), 5)


@plan("queue_overlay", """
with a as (select ts_ms // 3600000 as at, avg(queue_len) as q from {samples} group by 1), b as (select (dispatched_ms + 1800000) // 3600000 as at, avg(queue_len) as q from {executions} where status = 'FAILED' group by 1)
select coalesce(a.at, b.at) as hour, round(a.q, 6) as actual, round(b.q, 6) as predicted from a full join b on a.at = b.at""".replace("as at", "as hr").replace("a.at", "a.hr").replace("b.at", "b.hr"))
def _(samples, executions):
    a = samples.groupBy(F.floor(F.col("ts_ms") / HOUR).alias("hour")).agg(F.round(F.avg("queue_len"), 6).alias("actual"))
    b = executions.where("status = 'FAILED'").groupBy(F.floor((F.col("dispatched_ms") + HOUR // 2) / HOUR).alias("hour")).agg(F.round(F.avg("queue_len"), 6).alias("predicted"))
    return a.join(b, "hour", "full")


@plan("pending_runs", """
select p.scenario, p.strategy, p.rep from (select * from (select distinct scenario from {run_metrics}), (select distinct strategy from {run_metrics}), (select unnest(range(1994, 2003)) as rep)) p
where not exists (select 1 from {run_metrics} r where r.scenario = p.scenario and r.strategy = p.strategy and r.rep = p.rep)""")
def _(run_metrics):
    years = run_metrics.sparkSession.range(1994, 2003).withColumnRenamed("id", "rep")
    planned = run_metrics.select("scenario").distinct().crossJoin(if_small(run_metrics.select("strategy").distinct())).crossJoin(if_small(years))
    return planned.join(run_metrics, ["scenario", "strategy", "rep"], "left_anti").select("scenario", "strategy", "rep")


@plan("rolling_mae", """
select exec_id, round(avg(abs_error_ms) over (order by ts_ms, exec_id rows between 499 preceding and current row), 6) as rolling_mae_ms,
  round(avg(abs_error_ms) over (partition by task_type order by ts_ms, exec_id rows between 499 preceding and current row), 6) as rolling_type_mae_ms from {outcomes}""")
def _(outcomes):
    return op.rolling_mae(outcomes, 500).select("exec_id", "rolling_mae_ms", "rolling_type_mae_ms")


@plan("avg_exec_recent", """
select exec_id, round(avg(exec_ms) over (partition by worker_id order by dispatched_ms + wait_ms + exec_ms, exec_id rows between 49 preceding and current row), 6) as avg_exec_recent_ms from {executions}""")
def _(executions):
    return op.avg_exec_recent(executions, 50).select("exec_id", "avg_exec_recent_ms")


@plan("arrival_rate", """
select exec_id, round(count(*) over (order by dispatched_ms range between 3600000 preceding and current row) / 3600.0, 9) as arrival_rate from {executions}""")
def _(executions):
    return op.arrival_rate(executions, HOUR).select("exec_id", "arrival_rate")


@plan("running_means", """
select exec_id, count(*) over t as type_n, round(avg(exec_ms) over t, 6) as type_mean_ms, count(*) over p as pair_n, round(avg(exec_ms) over p, 6) as pair_mean_ms from {executions}
window t as (partition by task_type order by dispatched_ms, exec_id rows unbounded preceding), p as (partition by task_type, worker_id order by dispatched_ms, exec_id rows unbounded preceding)""")
def _(executions):
    return op.running_means(executions).select("exec_id", "type_n", "type_mean_ms", "pair_n", "pair_mean_ms")


@plan("type_p90", """
with f as (select exec_id, list(exec_ms) over (partition by task_type order by dispatched_ms, exec_id rows between 199 preceding and current row) as x from {executions})
select exec_id, case when len(x) >= 20 then list_sort(x)[ceil(len(x) * 0.9)::int] end as p90_ms from f""")
def _(executions):
    return op.recent_percentile(executions, 200, 0.9, 20, ("task_type",)).select("exec_id", F.col("recent_p").alias("p90_ms"))


@plan("last_n_percentiles", """
with f as (select exec_id, list(wait_ms) over (partition by worker_id order by dispatched_ms, exec_id rows between 99 preceding and current row) as x from {executions})
select exec_id, list_sort(x)[greatest(1, ceil(len(x) * 0.5))::int] as p50_ms from f""")
def _(executions):
    return op.recent_percentile(executions, 100, 0.5, 1, ("worker_id",), "wait_ms").select("exec_id", F.col("recent_p").alias("p50_ms"))


@plan("queue_over_time", """
with e as (select run_id, submit_ms as t, 1 as d from {replay} union all select run_id, start_ms, -1 from {replay} where start_ms is not null), c as (select run_id, t, sum(d) as d from e group by 1, 2)
select run_id, t, (sum(d) over (partition by run_id order by t))::bigint as waiting from c""")
def _(replay):
    return op.queue_over_time(replay)


@plan("queue_actual", """
select at_ms, round(sum(m), 6) as queue from (select worker_id, ts_ms // 3600000 * 3600000 as at_ms, avg(queue_len) as m from {samples} group by 1, 2) group by 1""")
def _(samples):
    return op.queue_actual(samples, HOUR)


@plan("queue_forecast", """
select at_ms, round(sum(m), 6) as queue from (select worker_id, (ts_ms + 1800000) // 3600000 * 3600000 as at_ms, avg(queue_len) as m from {samples} group by 1, 2) group by 1""")
def _(samples):
    return op.queue_actual(samples, HOUR, HOUR // 2)


@plan("drift_episodes", """
with r as (select model_version as series, ts_ms as t, exec_id as id, abs_error_ms / 40 as ratio from {outcomes}),
n as (select *, row_number() over (partition by series order by t, id) as pos, ratio > 1.5 as high from r),
b as (select *, max(case when not high then pos end) over (partition by series order by pos) as broke from n)
select series, t as started_ms, id from b where high and pos - coalesce(broke, 0) = 5""")
def _(outcomes):
    errors = outcomes.select(F.col("model_version").alias("series"), F.col("ts_ms").alias("t"), F.col("exec_id").alias("id"), F.col("abs_error_ms").alias("mae"), F.lit(40.0).alias("baseline"))
    return op.drift_episodes(errors, 1.5, 5)


_USAGE = """
u as (select ts_ms // 3600000 as bucket, sum(active_threads)::bigint as busy, count(*) * 2 as capacity, sum(queue_len)::bigint as demand from {samples} group by 1),
v as (select *, busy::double / capacity as utilisation, row_number() over (order by bucket) as pos from u)"""


@plan("scale_signals", f"""
with {_USAGE}, h as (select *, demand > capacity * 2 as high, utilisation < 0.75 as low from v)
select bucket, high and coalesce(lag(high) over (order by bucket), false) as scale_up,
  pos - coalesce(max(case when not low then pos end) over (order by bucket), 0) >= 3 as scale_down from h""")
def _(samples):
    usage = samples.groupBy(F.floor(F.col("ts_ms") / HOUR).alias("bucket")).agg(
        F.sum("active_threads").alias("busy"), (F.count("*") * 2).alias("capacity"), F.sum("queue_len").alias("demand")
    ).withColumn("utilisation", F.col("busy") / F.col("capacity"))
    return op.scale_signals(usage, 2.0, 0.75, 3, step=1000)


_STATUS = {"DISPATCH": "QUEUED", "RESULT": "RUNNING", "WORKER_DEAD": "FAILED", "WORKER_JOINED": "BLOCKED", "ELECTION": "COMPLETED"}
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in LEGAL_CHANGES)


@plan("illegal_transitions", f"""
with s as (select *, case type {' '.join(f"when '{k}' then '{v}'" for k, v in _STATUS.items())} end as status from {{log_events}}),
l as (select task_id, seq, status, lag(status) over (partition by task_id order by physical_ms, seq) as previous from s)
select task_id, seq, previous, status from l where previous is not null and (previous, status) not in ({_LEGAL})""")
def _(log_events):
    changes = log_events.withColumn("status", F.col("type")).replace(_STATUS, subset=["status"])
    return op.illegal_transitions(changes, status="status")


@plan("log_gaps", """
with l as (select node_id, seq_no, lag(seq_no) over (partition by node_id order by seq_no, applied_ms, task_id) as previous_seq from {replication})
select * from l where previous_seq is not null and seq_no <> previous_seq + 1""")
def _(replication):
    return op.log_gaps(replication, 1000)


@plan("sparkline_5m", """
select sample_id, round(avg(cpu_pct) over (partition by worker_id order by ts_ms range between 3600000 preceding and current row), 6) as cpu, count(*) over (partition by worker_id order by ts_ms range between 3600000 preceding and current row) as points from {samples}""")
def _(samples):
    return reach_means(samples, "ts_ms", HOUR, {"cpu": "cpu_pct"}, by=("worker_id",)).select("sample_id", F.round("cpu", 6).alias("cpu"), "points")
