"""Registered aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.operators import aggregates as op
from telemill.operators.selection import with_percentiles
from telemill.plans.registry import plan

METRICS = ["latency_ms", "throughput", "sla_violations", "completed"]


@plan("exec_stats", """
select case when task_type is not null then 'type' else 'worker' end as kind, coalesce(task_type, worker_id) as key, count(*) as n,
  round(avg(exec_ms), 6) as mean_ms, sum(exec_ms)::bigint as total_ms
from {executions} where status = 'COMPLETED' group by grouping sets ((task_type), (worker_id))""")
def _(executions):
    return op.exec_stats(executions)


@plan("type_worker_stats", """
select task_type, worker_id, count(*) as n, round(avg(exec_ms), 6) as mean_ms, quantile_disc(exec_ms, 0.5) as p50_ms, quantile_disc(exec_ms, 0.95) as p95_ms,
  round(coalesce(stddev_samp(exec_ms), 0), 6) as std_ms
from {executions} where status = 'COMPLETED' group by task_type, worker_id""")
def _(executions):
    return op.type_worker_stats(executions)


@plan("sla_report", """
select coalesce(strategy, 'all') as strategy, on_time, late, open, round(case when on_time + late > 0 then 100.0 * on_time / (on_time + late) end, 6) as on_time_pct
from (select strategy, count(*) filter (status = 'COMPLETED' and completed_ms <= deadline_ms) as on_time,
  count(*) filter (status in ('COMPLETED', 'FAILED') and not coalesce(status = 'COMPLETED' and completed_ms <= deadline_ms, false)) as late,
  count(*) filter (status not in ('COMPLETED', 'FAILED')) as open
  from {tasks} where deadline_ms is not null group by rollup (strategy))""")
def _(tasks):
    return op.sla_report(tasks)


@plan("kpis", """
select *, round(completed * 60000.0 / 7776000000, 9) as per_minute, round(case when with_deadline > 0 then 100.0 * sla_met / with_deadline end, 6) as compliance_pct
from (select count(*) as completed, round(avg(completed_ms - submitted_ms), 1) as mean_latency_ms, round(quantile_cont((completed_ms - submitted_ms)::double, 0.95), 1) as p95_latency_ms,
  count(deadline_ms) as with_deadline, count(*) filter (completed_ms <= deadline_ms) as sla_met
  from {tasks} where status = 'COMPLETED' and completed_ms > (select max(completed_ms) from {tasks} where status = 'COMPLETED') - 7776000000)""")
def _(tasks):
    return op.kpis(tasks, 90 * 86_400_000)


@plan("accuracy_by_type", """
select task_type, round(avg(abs_error_ms), 6) as mae_ms, count(*) as n, count(*) filter (cold_start) as cold_starts
from (select * from {outcomes} order by ts_ms desc, exec_id desc limit 2000) group by task_type""")
def _(outcomes):
    return op.accuracy_by_type(outcomes, 2000)


@plan("replication_lag", """
select node_id, max(seq_no) as max_seq, count(*) as entries, max(applied_ms) as last_applied_ms, (select max(seq_no) from {replication}) - max(seq_no) as lag
from {replication} group by node_id""")
def _(replication):
    return op.replication_lag(replication)


@plan("suite_counts", """
select split_part(run_id, '/', 2) as suite, count(*) as runs, min(rep) as first_rep, max(rep) as last_rep from {run_metrics} group by 1""")
def _(run_metrics):
    return op.suite_counts(run_metrics)


@plan("run_latency", """
with ranked as (select *, row_number() over (partition by run_id order by submit_ms, task_no) as rank, count(*) over (partition by run_id) as size from {replay})
select run_id, count(*) as n, round(avg(latency_ms), 6) as mean_ms, quantile_disc(latency_ms, 0.95) as p95_ms, quantile_disc(latency_ms, 0.99) as p99_ms
from ranked where rank > ceil(size * 0.1) and status = 'COMPLETED' group by run_id""")
def _(replay):
    return op.run_latency(replay)


@plan("run_throughput", """
select *, round(completed * 1000.0 / makespan_ms, 9) as throughput from (
  select run_id, count(*) as tasks, count(*) filter (status = 'COMPLETED') as completed, count(*) filter (status = 'FAILED') as failed,
    greatest(1, max(end_ms) - min(submit_ms))::bigint as makespan_ms from {replay} group by run_id)""")
def _(replay):
    return op.run_throughput(replay)


@plan("run_imbalance", """
select r.run_id, round(stddev_pop(coalesce(c, 0)), 6) as imbalance from (select distinct run_id from {replay}) r cross join {workers} w
left join (select run_id, worker, count(*) as c from {replay} where status = 'COMPLETED' group by 1, 2) d on d.run_id = r.run_id and d.worker = w.worker_id group by r.run_id""")
def _(replay, workers):
    return op.run_imbalance(replay, workers)


@plan("run_max_queue", """
with w as (select run_id, submit_ms, coalesce(start_ms, end_ms) as until from {replay}),
e as (select run_id, submit_ms as t, 1 as d from w where until is null or until > submit_ms union all select run_id, until, -1 from w where until > submit_ms),
g as (select run_id, t, d, sum(d) as s from e group by 1, 2, 3),
q as (select run_id, sum(s) over (partition by run_id order by t, d) as depth from g)
select r.run_id, greatest(0, coalesce(max(depth), 0))::bigint as max_queue from (select distinct run_id from {replay}) r left join q on q.run_id = r.run_id group by r.run_id""")
def _(replay):
    return op.run_max_queue(replay)


@plan("run_sla", """
select run_id, round(100.0 * avg(case when status = 'FAILED' or coalesce(latency_ms > 500000, false) then 1 else 0 end), 6) as violations_pct from {replay} group by run_id""")
def _(replay):
    return op.run_sla(replay, 500_000)


@plan("run_cpu", """
select round(avg(m), 6) as cpu_mean, round(var_pop(m), 6) as cpu_var from (select worker_id, avg(cpu_pct) as m from {samples} group by worker_id)""")
def _(samples):
    return op.run_cpu(samples)


@plan("run_overhead", """
select model_version, round(avg(actual_ms), 6) as mean_us, round(quantile_cont(actual_ms::double, 0.95), 6) as p95_us, round(avg(abs_error_ms), 6) as mae_ms from {outcomes} group by model_version""")
def _(outcomes):
    plain = [F.round(F.avg("actual_ms"), 6).alias("mean_us"), F.round(F.avg("abs_error_ms"), 6).alias("mae_ms")]
    out = with_percentiles(outcomes, ("model_version",), plain, "actual_ms", {"p95_us": ("cont", 0.95)})
    return out.withColumn("p95_us", F.round("p95_us", 6))


_LONG = " union all ".join(f"select scenario, strategy, '{m}' as metric, cast({m} as double) as value from {{run_metrics}}" for m in METRICS)
_SUMMARY = f"""select scenario, strategy, metric, count(*) as n, avg(value) as mean, case when count(*) > 1 then stddev_samp(value) end as std
  from ({_LONG}) where value is not null group by 1, 2, 3"""


@plan("suite_summary", f"select scenario, strategy, metric, n, round(mean, 4) as mean, round(std, 4) as std from ({_SUMMARY})")
def _(run_metrics):
    return op.suite_summary(run_metrics, METRICS).withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@plan("suite_cells", f"select scenario, strategy, metric, round(mean, 4) as mean from ({_SUMMARY})")
def _(run_metrics):
    return op.suite_summary(run_metrics, METRICS).select("scenario", "strategy", "metric", F.round("mean", 4).alias("mean"))


@plan("latency_cdf", """
with c as (select scenario, strategy, latency_ms, count(*) as c from {replay} where status = 'COMPLETED' group by 1, 2, 3)
select scenario, strategy, latency_ms, round(sum(c) over (partition by scenario, strategy order by latency_ms)::double / sum(c) over (partition by scenario, strategy), 9) as share from c""")
def _(replay):
    return op.latency_cdf(replay)


@plan("latency_histogram", """
select (case when exec_ms >= 5000 then 5000 when exec_ms >= 2000 then 2000 when exec_ms >= 1000 then 1000 when exec_ms >= 500 then 500 when exec_ms >= 200 then 200
  when exec_ms >= 100 then 100 when exec_ms >= 50 then 50 else 0 end)::bigint as from_ms, count(*) as n from {executions} where exec_ms >= 0 group by 1""")
def _(executions):
    return op.latency_histogram(executions, "exec_ms")


@plan("imbalance_box", """
with i as (select run_id, any_value(scenario) as scenario, any_value(strategy) as strategy, worker, count(*) as c from {replay} where status = 'COMPLETED' group by run_id, worker),
b as (select run_id, any_value(scenario) as scenario, any_value(strategy) as strategy, stddev_pop(c) as imbalance from i group by run_id)
select scenario, strategy, round(quantile_cont(imbalance, 0.25), 6) as q1, round(quantile_cont(imbalance, 0.5), 6) as q2, round(quantile_cont(imbalance, 0.75), 6) as q3 from b group by 1, 2""")
def _(replay):
    per = replay.where("status = 'COMPLETED'").groupBy("run_id", "scenario", "strategy", "worker").agg(F.count("*").alias("c"))
    return op.imbalance_box(per.groupBy("run_id", "scenario", "strategy").agg(F.stddev_pop("c").alias("imbalance")))


@plan("replay_summary", """
select coalesce(task_type, 'all') as task_type, count(*) filter (status = 'COMPLETED') as completed, count(*) filter (status <> 'COMPLETED') as not_completed,
  round(coalesce(avg(exec_ms) filter (status = 'COMPLETED'), -1), 6) as mean_exec_ms from {replay} group by rollup (task_type)""")
def _(replay):
    return op.replay_summary(replay)


@plan("db_slice", """
select count(*) as n, round(sum(p_retailprice), 4) as total, round(avg(p_retailprice), 6) as mean, count(distinct p_size) as categories, max(p_retailprice) as largest
from (select * from {part} order by p_partkey limit 1000)""")
def _(part):
    return op.slice_stats(part, "p_partkey", "p_retailprice", "p_size", 1000)


_CARD = {"overloaded": "class", "worker_id": "worker", "queue_len": "queue", "task_type": "type", "status": "status", "run_no": "run"}


@plan("dataset_card", f"""
with e as (select *, run_no as run, queue_len >= 4 as overloaded, case when status = 'COMPLETED' then exec_ms end as done from {{executions}})
select case {' '.join(f"when grouping({c}) = 0 then '{n}'" for c, n in _CARD.items())} else 'all' end as section, case {' '.join(f"when grouping({c}) = 0 then {c}::varchar" for c in _CARD)} end as key,
  count(*) as n, count(distinct run) as runs, count(done) as completed, round(avg(done), 6) as mean_ms, round(quantile_cont(done::double, 0.5), 6) as p50_ms, round(quantile_cont(done::double, 0.95), 6) as p95_ms,
  max(done) as max_ms, round(avg((queue_len_ >= 4)::int::double), 6) as label_share
from (select *, queue_len as queue_len_ from e) group by grouping sets ((), {', '.join(f'({c})' for c in _CARD)})""")
def _(executions):
    return op.dataset_card(executions.withColumn("overloaded", F.col("queue_len") >= 4))


@plan("drop_reasons", """
select case when status <> 'COMPLETED' then 'not completed' when w.worker_id is null then 'unknown worker' when w.pool_size = 0 then 'no pool' when queue_len = 0 then 'no queue sample' else 'kept' end as reason, count(*) as n
from {executions} e left join {workers} w on w.worker_id = e.worker_id group by 1""")
def _(executions, workers):
    joined = executions.join(workers.withColumn("known", F.lit(True)), "worker_id", "left")
    reason = (
        F.when(F.col("status") != "COMPLETED", "not completed").when(F.col("known").isNull(), "unknown worker").when(F.col("pool_size") == 0, "no pool")
        .when(F.col("queue_len") == 0, "no queue sample").otherwise("kept")
    )
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@plan("speedup", """
with t as (select input_size % 10 as size, attempt as procs, exec_ms::double / attempt as ms from {executions}),
m as (select size, procs, quantile_cont(ms, 0.5) as ms from t group by 1, 2), b as (select size, ms as base from m where procs = 1)
select m.size, procs, round(ms, 6) as ms, round(base / ms, 6) as speedup, round(base / ms / procs, 6) as efficiency from m left join b on b.size = m.size""")
def _(executions):
    return op.speedup(executions.select((F.col("input_size") % 10).alias("size"), F.col("attempt").alias("procs"), (F.col("exec_ms").cast("double") / F.col("attempt")).alias("ms")))


@plan("median_run", """
with r as (select *, row_number() over (partition by strategy order by throughput, run_id) as r, count(*) over (partition by strategy) as n from {run_metrics})
select strategy, run_id, round(throughput, 9) as throughput, tasks from r where r = n // 2 + 1""")
def _(run_metrics):
    return op.median_run(run_metrics, "strategy", "throughput", "run_id").select("strategy", "run_id", F.round("throughput", 9).alias("throughput"), "tasks")


@plan("tuning_summary", """
with s as (select priority as param, avg(exec_ms) as mean, stddev_samp(exec_ms) as std from {executions} group by 1)
select param, round(mean, 6) as mean_ms, round(std, 6) as std_ms, param = (select arg_min(param, (mean, param)) from s) as is_best from s""")
def _(executions):
    s = executions.groupBy(F.col("priority").alias("param")).agg(F.avg("exec_ms").alias("mean"), F.stddev_samp("exec_ms").alias("std"))
    best = s.agg(F.min_by("param", F.struct("mean", "param")).alias("best"))
    return s.crossJoin(F.broadcast(best)).select("param", F.round("mean", 6).alias("mean_ms"), F.round("std", 6).alias("std_ms"), (F.col("param") == F.col("best")).alias("is_best"))


@plan("election_summary", """
select task_type as algorithm, attempt as scenario, count(*) as n, round(avg(queue_len), 6) as messages, round(avg(wait_ms), 6) as failover_ms, round(avg(exec_ms), 6) as election_ms from {executions} group by 1, 2""")
def _(executions):
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return executions.groupBy(F.col("task_type").alias("algorithm"), F.col("attempt").alias("scenario")).agg(
        F.count("*").alias("n"), mean("queue_len", "messages"), mean("wait_ms", "failover_ms"), mean("exec_ms", "election_ms")
    )


@plan("failover_audit", """
with p as (select task_id, count(*) filter (type = 'DISPATCH') as starts, count(*) filter (type = 'RESULT') as successes from {log_events} where type in ('DISPATCH', 'RESULT') group by 1),
k as (select min(physical_ms) as kill_ms from {log_events} where type = 'WORKER_DEAD'),
f as (select min(physical_ms) as first_success_ms, min(kill_ms) as kill_ms from {log_events}, k where type = 'RESULT' and physical_ms > kill_ms)
select count(*) filter (starts > 0 and successes = 0) as lost, count(*) filter (successes > 1) as duplicated, count(*) filter (starts > 1) as ran_twice,
  (select first_success_ms from f) as first_success_ms, (select kill_ms from f) as kill_ms, (select first_success_ms - kill_ms from f) as failover_ms from p""")
def _(log_events):
    return op.failover_audit(log_events, "DISPATCH", "RESULT", "WORKER_DEAD")


@plan("rank_balance", """
with p as (select row_number() over (order by exec_id) - 1 as pos, exec_ms from {executions}),
s as (select pos % 4 as rank, count(*) as tasks, sum(exec_ms)::bigint as busy from p group by 1)
select rank, tasks, busy, max(busy) over () as makespan, (sum(busy) over ())::bigint as total, round(max(busy) over () / avg(busy) over (), 6) as max_over_mean from s""")
def _(executions):
    return op.rank_balance(executions, 4, "exec_id", "exec_ms")


@plan("slot_usage", """
with n as (select worker_id, ts_ms // 3600000 as bucket, active_threads, queue_len, row_number() over (partition by worker_id, ts_ms // 3600000 order by ts_ms desc, sample_id desc) as r from {samples}),
u as (select n.bucket, sum(pool_size)::bigint as capacity, sum(least(n.active_threads, pool_size))::bigint as busy, sum(n.queue_len + n.active_threads)::bigint as demand,
  round(sum(n.queue_len + least(n.active_threads, pool_size) + coalesce(greatest(0.0, p.queue_len - 1.0), greatest(0, n.active_threads - pool_size))), 6)::double as demand_forecast
  from n join {workers} w on w.worker_id = n.worker_id left join n p on p.worker_id = n.worker_id and p.bucket = n.bucket - 1 and p.r = 1 where n.r = 1 group by n.bucket)
select bucket, capacity, busy, demand, demand_forecast, round(case when capacity = 0 then 1.0 else busy::double / capacity end, 6) as utilisation from u""")
def _(samples, workers):
    hour = F.floor(F.col("ts_ms") / 3_600_000)
    last = samples.groupBy("worker_id", (hour + 1).alias("bucket")).agg((F.max_by("queue_len", F.struct("ts_ms", "sample_id")) - 1.0).alias("pred_queue_len"))
    return op.slot_usage(samples, workers, 3_600_000, last)


@plan("speculation_stats", """
select count(*) filter (attempt = 2) as launched, count(*) filter (attempt = 2 and status = 'COMPLETED') as won_by_copy, count(*) filter (attempt = 1 and status = 'COMPLETED') as won_by_original,
  sum(greatest(0, exec_ms - 500)) filter (attempt = 2)::bigint as wasted_ms from {executions}""")
def _(executions):
    copy, done = F.col("attempt") == 2, F.col("status") == "COMPLETED"
    return executions.agg(
        F.count_if(copy).alias("launched"), F.count_if(copy & done).alias("won_by_copy"), F.count_if((F.col("attempt") == 1) & done).alias("won_by_original"),
        F.sum(F.when(copy, F.greatest(F.lit(0), F.col("exec_ms") - 500))).cast("long").alias("wasted_ms"),
    )


@plan("overhead_mae_tables", """
select 'decision' as "table", task_type as key, round(avg(wait_ms), 6) as value from {executions} group by 2 union all
select 'mae', model_version, round(avg(abs_error_ms), 6) from {outcomes} group by 2""")
def _(executions, outcomes):
    a = executions.groupBy("task_type").agg(F.avg("wait_ms").alias("v")).select(F.lit("decision").alias("table"), F.col("task_type").alias("key"), F.round("v", 6).alias("value"))
    b = outcomes.groupBy("model_version").agg(F.avg("abs_error_ms").alias("v")).select(F.lit("mae").alias("table"), F.col("model_version").alias("key"), F.round("v", 6).alias("value"))
    return a.unionByName(b)


@plan("cache_hits", """
with k as (select task_type, input_size, count(*) as n from {executions} where status = 'COMPLETED' and task_type not in ('signup') group by 1, 2)
select task_type, sum(n - 1)::bigint as hits, count(*) as misses from k group by 1""")
def _(executions):
    return op.cache_hits(executions, ["task_type", "input_size"], ["signup"])


@plan("status_counts", "select status, count(*) as n from {tasks} group by 1")
def _(tasks):
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


@plan("type_counts", "select task_type, count(*) as n from {executions} group by 1")
def _(executions):
    return executions.groupBy("task_type").agg(F.count("*").alias("n"))


@plan("load_heatmap", """
with m as (select worker_id, ts_ms // 3600000 as bucket, avg(active_threads) as busy from {samples} group by 1, 2)
select m.worker_id, bucket, round(case when pool_size > 0 then busy / pool_size else 0.0 end, 6) as load from m left join {workers} w on w.worker_id = m.worker_id""")
def _(samples, workers):
    return op.load_heatmap(samples, workers, 3_600_000)


@plan("gantt_rows", """
select task_id, worker_id, started_ms, completed_ms, min(started_ms) over () as chart_from_ms, max(completed_ms) over () as chart_to_ms from {tasks}
where worker_id is not null and started_ms is not null and completed_ms is not null""")
def _(tasks):
    return op.gantt_rows(tasks)
