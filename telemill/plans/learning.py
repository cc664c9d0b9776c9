"""Registered stateful, streaming and model queries, and the dataset build."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions.scalars import from_log_target
from telemill.operators import evaluation as ev
from telemill.operators import history, linear
from telemill.operators import models as ml
from telemill.plans import features
from telemill.plans.registry import plan
from telemill.session import materialize
from telemill.streaming import sequential, streams

HOUR = 3_600_000

#: Rows of a trigger of streams whose tasks hold what a trigger brings of a key.
TRIGGER_ROWS = 2_000_000


@plan("marker_dedupe", """
with recursive e as (select type, seq, physical_ms as t, row_number() over (partition by type order by physical_ms, seq) as rn from {log_events}),
r(type, rn, seq, last, kept) as (select type, rn, seq, t, true from e where rn = 1 union all
  select e.type, e.rn, e.seq, case when e.t - r.last > 1800000 then e.t else r.last end, e.t - r.last > 1800000 from r join e on e.type = r.type and e.rn = r.rn + 1)
select type, seq, kept from r""")
def _(log_events):
    return sequential.dedupe_within(log_events.select("type", "seq", "physical_ms"), ("type",), "physical_ms", "seq", 1_800_000).select("type", "seq", "kept")


@plan("alert_suppress", """
with recursive e as (select type, seq, physical_ms as t, row_number() over (partition by type order by physical_ms, seq) as rn from {log_events}),
r(type, rn, seq, last, held, sent, suppressed) as (select type, rn, seq, t, 0, true, 0 from e where rn = 1 union all
  select e.type, e.rn, e.seq, case when e.t - r.last >= 1800000 then e.t else r.last end, case when e.t - r.last >= 1800000 then 0 else r.held + 1 end, e.t - r.last >= 1800000,
    case when e.t - r.last >= 1800000 then r.held else 0 end from r join e on e.type = r.type and e.rn = r.rn + 1)
select type, seq, sent, suppressed::bigint as suppressed from r""")
def _(log_events):
    return sequential.suppress_alerts(log_events.select("type", "seq", "physical_ms"), ("type",), "physical_ms", "seq", 1_800_000).select("type", "seq", "sent", "suppressed")


@plan("token_bucket", """
with recursive e as (select task_type, exec_id, dispatched_ms as t, row_number() over (partition by task_type order by dispatched_ms, exec_id) as rn from {executions}),
r(task_type, rn, exec_id, t, tokens, allowed) as (select task_type, rn, exec_id, t, 1.0::double, true from e where rn = 1 union all
  select task_type, rn, exec_id, t, case when have >= 1 then have - 1 else have end, have >= 1 from (
    select e.task_type, e.rn, e.exec_id, e.t, least(2.0::double, r.tokens + (e.t - r.t) * (1.0::double / 2097152)) as have from r join e on e.task_type = r.task_type and e.rn = r.rn + 1))
select exec_id, allowed from r""")
def _(executions):
    rows = executions.select("task_type", "exec_id", "dispatched_ms")
    return sequential.token_bucket(rows, ("task_type",), "dispatched_ms", "exec_id", 2, 1.0 / 2_097_152).select("exec_id", "allowed")


@plan("stream_worker_windows", f"""
with {features._WINDOWS}, m as (select max(dispatched_ms) - 600000 as mark from {{executions}})
select w.* from w, m where end_ms <= mark""")
def _(executions):
    source = streams.replay_source(executions, "dispatched_ms", 3, "windows-in")
    return streams.run_to_files(streams.worker_windows(source, HOUR, HOUR // 2, 600_000), "windows-out")


@plan("stream_running_stats", """
with r as (select exec_id, task_type, ts_ms, avg(abs_error_ms) over (partition by task_type order by ts_ms, exec_id rows between 19 preceding and current row) as mae from {outcomes}),
n as (select *, row_number() over (partition by task_type order by ts_ms, exec_id) as pos, mae / 80 > 1.3 as high from r),
b as (select *, coalesce(max(case when not high then pos end) over (partition by task_type order by pos), 0) as broke from n)
select exec_id, task_type, round(mae, 6) as rolling_type_mae_ms, high and pos - broke = 5 as drift_starts from b""")
def _(outcomes):
    rows = outcomes.select("exec_id", "task_type", "ts_ms", "abs_error_ms", F.lit(80.0).alias("baseline"))
    out = streams.run_to_files(streams.running_stats(streams.replay_source(rows, "ts_ms", 3, "stats-in", ties=("exec_id",), bounded=True, trigger_rows=TRIGGER_ROWS), 20, 1.3, 5), "stats-out")
    return out.withColumn("rolling_type_mae_ms", F.round("rolling_type_mae_ms", 6))


@plan("stream_upsert", "select task_id, seq, type, physical_ms from {log_events} qualify row_number() over (partition by task_id order by physical_ms desc, seq desc) = 1")
def _(log_events):
    rows = log_events.select("task_id", "seq", "type", "physical_ms")
    return streams.upsert(streams.replay_source(rows, "physical_ms", 3, "upsert-in"), "task_id", ("physical_ms", "seq"), "upsert")


@plan("stream_throttle_live", """
with m as (select max(physical_ms) - 600000 as mark from {log_events}),
r as (select type, physical_ms // 3600000 as tick, physical_ms, seq, row_number() over (partition by type, physical_ms // 3600000 order by physical_ms desc, seq desc) as r, count(*) over (partition by type, physical_ms // 3600000) as n from {log_events})
select type, tick, physical_ms, seq, greatest(0, n - 2)::bigint as dropped from r, m where r <= 2 and (tick + 1) * 3600000 < mark""")
def _(log_events):
    source = streams.replay_source(log_events.select("type", "physical_ms", "seq"), "physical_ms", 3, "throttle-in", ties=("seq",))
    return streams.run_to_files(streams.throttle(source, "type", "physical_ms", "seq", HOUR, 2, 600_000), "throttle-out")


@plan("stream_dead_workers", """
with m as (select max(ts_ms) - 600000 as mark from {samples}), g as (select worker_id, ts_ms, lead(ts_ms) over (partition by worker_id order by ts_ms) as next_ms from (select distinct worker_id, ts_ms from {samples}))
select worker_id, ts_ms as silent_from_ms from g, m where next_ms - ts_ms >= 7200000 or (next_ms is null and ts_ms + 7200000 < mark)""")
def _(samples):
    source = streams.replay_source(samples.select("worker_id", "ts_ms"), "ts_ms", 3, "silence-in", bounded=True, trigger_rows=TRIGGER_ROWS)
    return streams.run_to_files(streams.dead_workers(source, "worker_id", "ts_ms", HOUR, 2, 600_000), "silence-out")


def _dataset(executions, samples, workers):
    executions, samples, workers = materialize(executions, "executions"), materialize(samples, "samples"), materialize(workers, "workers")
    windows = materialize(history.worker_windows(executions, HOUR, HOUR // 2), "windows")
    rows = materialize(history.enrich_worker(history.prior_stats(executions), workers), "dataset")
    rows = materialize(history.asof_window(rows, windows), "dataset")
    rows = materialize(history.label_queue_future(rows, samples, HOUR, HOUR // 3), "dataset")
    rows = history.label_overload_future(rows, samples, workers, HOUR, 85.0, 1.0)
    kept = rows.where("status = 'COMPLETED' and queue_len_future is not null and overloaded_future is not null and win_end_ms is not null")
    return kept.withColumn("holdout_pattern", F.col("run_no") == "2").withColumn("holdout_type", F.col("task_type") == "signup")


_QUEUE = """select e.exec_id, case when e.dispatched_ms + 3600000 - s.ts_ms <= 1200000 then s.queue_len end as queue_len_future
from {executions} e asof left join {samples} s on s.worker_id = e.worker_id and s.ts_ms <= e.dispatched_ms + 3600000"""
_OVER = """select e.exec_id, bool_or(case when s.ts_ms is null then null else s.cpu_pct > 85 or coalesce(s.queue_len >= 1.0 * w.pool_size, false) end) as overloaded_future
from {executions} e left join {samples} s on s.worker_id = e.worker_id and s.ts_ms > e.dispatched_ms and s.ts_ms <= e.dispatched_ms + 3600000
left join {workers} w on w.worker_id = s.worker_id group by e.exec_id"""
_PRIOR = """select e.exec_id, count(f.exec_id) as prior_count, round(avg(f.exec_ms), 6) as prior_mean_ms from {executions} e
left join {executions} f on f.task_type = e.task_type and f.worker_id = e.worker_id and f.status = 'COMPLETED' and f.dispatched_ms + f.wait_ms + f.exec_ms <= e.dispatched_ms group by e.exec_id"""


@plan("build_dataset", f"""
with {features._WINDOWS}, q as ({_QUEUE}), o as ({_OVER}), p as ({_PRIOR}),
a as (select e.exec_id, w.end_ms as win_end_ms, w.queue_max as win_queue_max from {{executions}} e asof left join w on w.worker_id = e.worker_id and w.end_ms <= e.dispatched_ms)
select e.exec_id, prior_count, prior_mean_ms, win_end_ms, win_queue_max, queue_len_future, overloaded_future, run_no = '2' as holdout_pattern, task_type = 'signup' as holdout_type
from {{executions}} e join q using (exec_id) join o using (exec_id) join p using (exec_id) join a using (exec_id)
where status = 'COMPLETED' and queue_len_future is not null and overloaded_future is not null and win_end_ms is not null""")
def _(executions, samples, workers):
    return _dataset(executions, samples, workers).select(
        "exec_id", "prior_count", "prior_mean_ms", "win_end_ms", "win_queue_max", "queue_len_future", "overloaded_future", "holdout_pattern", "holdout_type"
    )


def _inputs(rows):
    """Model inputs: event types stand for catalogue types, and columns take the names of the contract."""
    kinds = {"view": "CPU_TASK", "click": "SORT_TASK", "error": "HASH_TASK", "signup": "SLEEP_TASK", "purchase": "GRAPH_TASK"}
    known = {"pool_size": "worker_pool_size", "slowdown": "worker_slowdown", "prior_mean_ms": "prior_type_worker_mean_ms", "prior_count": "prior_type_worker_count"}
    return ml.with_features(rows.replace(kinds, subset=["task_type"]).withColumnsRenamed(known))


def _rows(executions, workers):
    """Executions with model inputs from leak-free history, split by time.

    Only the history is written, in narrow rows; the split compares with one boundary, and inputs are made as they are read.
    """
    known = executions.where("status = 'COMPLETED'").drop("task_id", "trace_id", "run_no")
    rows = materialize(history.enrich_worker(history.prior_stats(known), workers), "model-rows")
    return _inputs(ev.time_split(rows, "dispatched_ms", "exec_id", F.lit(False), F.lit(False)).withColumn("label", (F.col("exec_ms") > 600).cast("int")))


def _fitted_rows(executions, workers):
    """The rows without inputs that are constant over training rows, which no model uses."""
    rows = _rows(executions, workers)
    return ml.varying(rows, rows.where("split = 'train'"))


def _regression(executions, workers, fit):
    rows = _fitted_rows(executions, workers)
    scored = ml.predict_ms(fit(rows.where("split = 'train'"), "exec_ms"), rows.where("split = 'test'"))
    return ev.regression_metrics(scored.withColumn("actual", F.col("exec_ms").cast("double")))


def _best(fit, grid, prepare=None):
    """The fit with the settings that predict best over three time folds of the training rows."""
    return lambda train, target: ml.fit_best(train, "dispatched_ms", "exec_id", target, fit, grid, prepare=prepare)[0]


@plan("fit_linear")
def _(executions, workers):
    rows = _rows(executions, workers)
    folds = ev.ts_cv_folds(rows.where("split = 'train'"), "dispatched_ms", "exec_id", 3)
    model, _ = linear.best_ridge(folds, ml.inputs(rows), "exec_ms", 3, ml.LINEAR_GRID)
    scored = rows.where("split = 'test'").select(F.col("exec_ms").cast("double").alias("actual"), from_log_target(model.score()).alias("predicted"))
    return ev.regression_metrics(scored)


@plan("fit_forest")
def _(executions, workers):
    rows = _fitted_rows(executions, workers)
    return ev.regression_metrics(ml.best_forest_scores(rows.where("split = 'train'"), rows.where("split = 'test'"), "dispatched_ms", "exec_id", "exec_ms", ml.FOREST_GRID)[0])


@plan("fit_boosted")
def _(executions, workers):
    return _regression(executions, workers, _best(ml.fit_boosted, ml.BOOSTED_GRID, ml.tree_cells))


@plan("fit_logistic")
def _(executions, workers):
    rows = _fitted_rows(executions, workers)
    model, _, threshold = ml.fit_best_logistic(rows.where("split = 'train'"), "dispatched_ms", "exec_id", "label", ml.LOGISTIC_GRID)
    scored = materialize(ml.predict_probability(model, rows.where("split = 'test'")).select("label", "score"), "test-scores")
    return ev.classification_metrics(scored, threshold)


@plan("ts_cross_validate")
def _(executions, workers):
    folds = ev.ts_cv_folds(_rows(executions, workers), "dispatched_ms", "exec_id", 3)
    tried, _ = linear.ridges(folds, ml.inputs(folds), "exec_ms", 3, ml.LINEAR_GRID[:1])
    return ev.regression_metrics(linear.ridge_out_of_fold(folds, "exec_ms", tried[0]), "fold")


@plan("importances")
def _(executions, workers):
    rows = _rows(executions, workers)
    model = ml.fit_linear(rows, "exec_ms")
    return executions.sparkSession.createDataFrame(ml.importances(model, ml.inputs(rows)), "feature string, importance double")


@plan("score_candidates")
def _(executions, workers, candidates):
    rows = _rows(executions, workers)
    timed, over = ml.fit_linear(rows, "exec_ms"), ml.fit_logistic(rows, "label")
    own = candidates.select("task_id", "exec_id", "task_type", "priority", "worker_id", "queue_len", "pool_size").join(executions.select("exec_id", "input_size", "attempt", "wait_ms"), "exec_id")
    return ml.score_candidates(_inputs(own), timed, over).select("task_id", "worker_id", F.round("pred_exec_ms", 3).alias("pred_exec_ms"), "pred_queue_len", F.round("overload_prob", 4).alias("overload_prob"))


@plan("batch_inference")
def _(executions, workers):
    rows = _rows(executions, workers)
    return ml.batch_inference(rows, ml.fit_linear(rows, "exec_ms"), 5000, "exec_id", 11)


@plan("retrain_m1")
def _(executions, workers):
    rows = _rows(executions, workers)
    test = rows.where("split = 'test'").withColumn("actual", F.col("exec_ms").cast("double"))
    fresh = ev.regression_metrics(ml.predict_ms(ml.fit_linear(rows.where("split = 'train'"), "exec_ms"), test)).withColumn("model", F.lit("retrained"))
    live = ev.group_mean(rows.where("split = 'train'"), test, "worker_id", "exec_ms", "predicted")
    return fresh.unionByName(ev.regression_metrics(live).withColumn("model", F.lit("live")))
