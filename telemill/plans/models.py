"""Registered scalar, experiment, evaluation, listing and ordering queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from telemill.functions import catalogue, scalars
from telemill.operators import evaluation as ev
from telemill.operators import experiments as ex
from telemill.operators import history, listings
from telemill.operators.aggregates import suite_summary
from telemill.operators.selection import with_percentiles
from telemill.plans.aggregates import _SUMMARY, METRICS
from telemill.plans.registry import plan
from telemill.session import scratch_path
from telemill.sources import files

_PROPS = "replace(replace(replace(replace(props, '{', ''), '}', ''), '\"', ''), ': ', '=')"


def _text(c="props"):
    return F.regexp_replace(F.regexp_replace(c, '[{}"]', ""), ": ", "=")


@plan("kv_parse", """select event_id, regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_]* *=.*[^ ]') as valid, regexp_extract(t, '=(.*)$', 1) as value from (select event_id, regexp_replace(regexp_replace(props, '["}]|[{]', '', 'g'), ': ', '=', 'g') as t from {events})""")
def _(events):
    return events.withColumn("kv", scalars.kv_parse(_text())).select("event_id", "kv.valid", F.try_element_at("kv.pairs", F.lit("k")).alias("value"))


def _sql_value(key: str) -> str:
    return f"nullif(regexp_extract(input, '(^|, ){key}=([^,]*)', 2), '')"


def _sql_case(values: dict[str, str], column: str = "type") -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


def _sql_rules() -> list[str]:
    """One SQL case for each problem that a parameter can have, in the order of the catalogue."""
    out = ["case when input = 'broken' then 'input: not key=value' end"]
    for kind, key, form, required, low, high, choices in catalogue.PARAMETERS:
        v, own = _sql_value(key), f"type = '{kind}' and input <> 'broken'"
        if required:
            out.append(f"case when {own} and {v} is null then '{key}: missing' end")
        if form in ("number", "fraction"):
            out.append(f"case when {own} and {v} is not null and try_cast({v} as double) is null then '{key}: not a number' end")
            out.append(f"case when {own} and try_cast({v} as double) not between {float(low)} and {float(high)} then '{key}: out of range' end")
        elif form == "choice":
            out.append(f"case when {own} and {v} not in ({', '.join(repr(c) for c in choices)}) then '{key}: not a choice' end")
        elif form == "url":
            out.append(f"case when {own} and not ({v} like 'http://%' or {v} like 'https://%') then '{key}: no URL' end")
    return out


def _parsed(submissions):
    return submissions.withColumn("kv", scalars.kv_parse(F.col("input")))


@plan("input_size", "select sub_id, coalesce(try_cast(" + _sql_case({k: _sql_value(v) for k, v in catalogue.SIZE_KEYS.items()}) + " as bigint), length(input)) as input_size from {submissions}")
def _(submissions):
    return _parsed(submissions).select("sub_id", scalars.input_size(F.col("type"), F.col("kv.pairs"), F.col("input")).alias("input_size"))


@plan("validate_input", "select sub_id, concat_ws('; ', " + ", ".join(_sql_rules()) + ") as problems from {submissions}")
def _(submissions):
    return _parsed(submissions).select("sub_id", F.array_join(scalars.input_problems(F.col("type"), F.col("kv")), "; ").alias("problems"))


@plan("validate_task", "with n as (select *, count(*) over (partition by task_id) as copies from {submissions}) select sub_id, concat_ws('; ', case when trim(task_id) = '' then 'task_id: empty' end, case when copies > 1 then 'task_id: exists already' end, case when type = 'IMAGE_TASK' then 'type: not supported' end, "
  + ", ".join(_sql_rules()) + ", case when priority not between 1 and 10 then 'priority: not 1 to 10' end) as problems from n")
def _(submissions):
    copies = submissions.groupBy("task_id").agg(F.count("*").alias("copies"))
    rows = _parsed(submissions).join(copies, "task_id")
    found = scalars.task_problems(*[F.col(c) for c in ("task_id", "type", "input", "priority", "copies", "kv")])
    return rows.select("sub_id", F.array_join(found, "; ").alias("problems"))


@plan("cache_key", """
select sub_id, sha256(type || '|' || case when input = 'broken' then input else array_to_string(list_sort(string_split(input, ', ')), ',') end) as cache_key from {submissions}""")
def _(submissions):
    return _parsed(submissions).select("sub_id", scalars.cache_key(F.col("type"), F.col("kv.pairs"), F.col("input")).alias("cache_key"))


_WORDS = "w as (select unnest(list_concat([event_type], regexp_extract_all(props, '[A-Za-z_][A-Za-z0-9_.-]*'))) as word from {events}), c as (select word, count(*) as n from w group by 1)"


def _words(events):
    return events.select(F.explode(scalars.event_words(F.col("event_type"), F.col("props"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@plan("wordcount", f"with {_WORDS} select * from c")
def _(events):
    return _words(events)


@plan("top_words", """
with w as (select unnest(regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand, '[A-Za-z_][A-Za-z0-9_.-]*')) as word from {part}) select word, count(*) as n from w group by 1 order by n desc, word limit 15""")
def _(part):
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    words = part.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_.-]*"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@plan("event_words", "select event_id, 1 + len(regexp_extract_all(props, '[A-Za-z_][A-Za-z0-9_.-]*')) as n_words from {events}")
def _(events):
    return events.select("event_id", F.size(scalars.event_words(F.col("event_type"), F.col("props"))).cast("long").alias("n_words"))


@plan("sla_flags", """
select task_id, deadline_ms is not null and status = 'COMPLETED' and coalesce(completed_ms <= deadline_ms, false) as sla_met, case when deadline_ms is not null and completed_ms is not null then greatest(0, completed_ms - deadline_ms) end as over_ms from {tasks}""")
def _(tasks):
    return tasks.select("task_id", scalars.sla_met(F.col("status"), F.col("completed_ms"), F.col("deadline_ms")).alias("sla_met"), scalars.over_ms(F.col("completed_ms"), F.col("deadline_ms")).alias("over_ms"))


def _sql_features() -> str:
    hot = [f"(type = '{t}')::int::double as type_{t}" for t in catalogue.TASK_TYPES]
    hot += [f"(coalesce({_sql_case({k: repr(v) for k, v in catalogue.PROFILE_OF.items()})}, '') = '{p}')::int::double as profile_{p}" for p in catalogue.PROFILES]
    sizes = [f"round(case when type = '{t}' then ln(1 + size) else 0 end, 9) as log_size_x_{t}" for t in catalogue.TASK_TYPES]
    given = {"priority": "priority::double", "queue_len": "queue_len::double", "worker_pool_size": "coalesce(pool_size, 1)::double", "worker_slowdown": "coalesce(slowdown, 1.0)::double"}
    numbers = [f"{given.get(n, f'{d}::double')} as {n}" for n, d in catalogue.NUMERIC_DEFAULTS.items()]
    rest = [
        "0.0::double as busy_ratio", "round(queue_len::double / greatest(coalesce(pool_size, 1), 1), 9) as queue_ratio", "0.0::double as log_avg_exec_recent", "(wait_ms > 9)::int::double as has_prior",
        "round(case when wait_ms > 9 then ln(1 + exec_ms) else 0 end, 9) as log_prior_mean_ms", "round(ln(1 + wait_ms), 9) as log_prior_count",
    ]
    return ", ".join(["exec_id", *hot, "round(ln(1 + size), 9) as log_size", *sizes, *numbers, *rest])


@plan("feature_columns", """
with e as (select e.exec_id, s.type, e.input_size as size, e.priority, e.queue_len, e.wait_ms, e.exec_ms, w.pool_size, w.slowdown from {executions} e join {submissions} s on s.sub_id = e.exec_id left join {workers} w on w.worker_id = e.worker_id)
select """ + _sql_features() + " from e")
def _(executions, submissions, workers):
    types = submissions.select(F.col("sub_id").alias("exec_id"), F.col("type").alias("task_type"))
    rows = history.enrich_worker(executions.drop("task_type").join(types, "exec_id"), workers)
    rows = rows.withColumnsRenamed({"pool_size": "worker_pool_size", "slowdown": "worker_slowdown", "exec_ms": "_exec"}).withColumn("prior_type_worker_count", F.col("wait_ms"))
    rows = rows.withColumn("prior_type_worker_mean_ms", F.when(F.col("wait_ms") > 9, F.col("_exec")))
    return rows.select("exec_id", *[F.round(v, 9).alias(k) for k, v in scalars.feature_columns(rows.columns).items()])


@plan("log_target", "select exec_id, round(ln(1 + exec_ms), 9) as target, exec_ms::double as back from {executions}")
def _(executions):
    target = scalars.log_target(F.col("exec_ms"))
    return executions.select("exec_id", F.round(target, 9).alias("target"), F.round(scalars.from_log_target(target), 6).alias("back"))


@plan("resolve_refs", """select event_id, 'in=' || event_type || ';' || case when event_id % 2 = 0 then 'even' else '' end as resolved from {events}""")
def _(events):
    text = F.concat(F.lit("in=${kind.result};${other.result}"))
    known = F.map_from_arrays(F.array(F.lit("kind"), F.when(F.col("event_id") % 2 == 0, "other").otherwise("none")), F.array(F.col("event_type"), F.lit("even")))
    return events.select("event_id", scalars.resolve_refs(text, known).alias("resolved"))


@plan("retry_delay", "select exec_id, least(5000, 200 * power(2, attempt + priority - 1))::bigint as delay_ms from {executions}")
def _(executions):
    return executions.select("exec_id", scalars.retry_delay(F.col("attempt") + F.col("priority"), 200, 5000).alias("delay_ms"))


@plan("straggler_limit", "select task_id, worker_id, greatest(2 * pred_exec_ms, case when avg_exec_ms > 0 then avg_exec_ms end) as limit_ms from {candidates}")
def _(candidates):
    return candidates.select("task_id", "worker_id", scalars.straggler_limit(F.col("pred_exec_ms"), F.when(F.col("avg_exec_ms") > 0, F.col("avg_exec_ms")), 2.0).alias("limit_ms"))


@plan("profile_of_type", "select sub_id, coalesce(" + _sql_case({k: repr(v) for k, v in catalogue.PROFILE_OF.items()}) + ", '') as profile from {submissions}")
def _(submissions):
    return submissions.select("sub_id", scalars.profile_of_type(F.col("type")).alias("profile"))


@plan("exec_samples", "select exec_id, task_type, round_even(exec_ms / coalesce(slowdown, 1.0)::double, 1) as exec_ms from {executions} e left join {workers} w on w.worker_id = e.worker_id where status = 'COMPLETED'")
def _(executions, workers):
    rows = history.enrich_worker(executions, workers).where("status = 'COMPLETED'")
    return rows.select("exec_id", "task_type", F.bround(F.col("exec_ms") / F.col("slowdown"), 1).alias("exec_ms")).orderBy("task_type", "exec_id")


_BEST = f"""
s as ({_SUMMARY}), o as (select *, row_number() over (partition by scenario, metric order by case when metric in ('throughput', 'completed') then -mean else mean end, strategy) as r from s where strategy <> 'predictive'),
b as (select o.scenario, o.metric, o.strategy as baseline, o.mean as bm, o.std as bs, o.n as bn, p.mean as am, p.std as asd, p.n as an, case when o.mean <> 0 then 100.0 * (p.mean - o.mean) / abs(o.mean) end as diff_pct
  from o join s p on p.scenario = o.scenario and p.metric = o.metric and p.strategy = 'predictive' where r = 1)"""


@plan("best_baseline", f"with {_BEST} select scenario, metric, baseline, round(bm, 4) as base_mean, round(am, 4) as arm_mean, round(diff_pct, 4) as diff_pct from b")
def _(run_metrics):
    best = ex.best_baseline(suite_summary(run_metrics, METRICS))
    return best.select("scenario", "metric", "baseline", F.round("base_mean", 4).alias("base_mean"), F.round("arm_mean", 4).alias("arm_mean"), F.round("diff_pct", 4).alias("diff_pct"))


# Student's two-sided p is 1 - 2c * integral of cos^(df - 1) from 0 to atan(|t| / sqrt(df)), here by Simpson's rule over 2,000 steps.
_WELCH = f"""
{_BEST}, v as (select *, an >= 2 and bn >= 2 as enough, asd * asd / an as va, bs * bs / bn as vb from b),
k as (select *, case when enough and va + vb > 0 then (am - bm) / sqrt(va + vb) end as t, case when enough and va + vb > 0 then power(va + vb, 2) / (va * va / (an - 1) + vb * vb / (bn - 1)) end as df,
  case when enough then case when (an - 1) * asd * asd + (bn - 1) * bs * bs > 0 then (am - bm) / sqrt(((an - 1) * asd * asd + (bn - 1) * bs * bs) / (an + bn - 2)) else 0 end end as d from v),
area as (select scenario, metric, 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * atan(abs(t) / sqrt(df)) / 6000
  * sum(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * power(cos(atan(abs(t) / sqrt(df)) * i / 2000), df - 1)) as inside from k, range(2001) g(i) where t is not null group by scenario, metric, t, df),
w as (select k.*, case when not enough then null when t is not null then 1 - inside when am = bm then 1.0 else 0.0 end as p from k left join area using (scenario, metric))"""


@plan("welch_cohen", f"with {_WELCH} select scenario, metric, round(t, 6) as t, round(df, 6) as df, round(p, 6) + 0.0 as p, round(d, 6) as d from w")
def _(run_metrics):
    out = ex.compare_arms(ex.best_baseline(suite_summary(run_metrics, METRICS)))
    return out.select("scenario", "metric", *[F.round(c, 6).alias(c) for c in ("t", "df", "p", "d")])


@plan("headlines", f"""
with {_WELCH} select scenario, metric, baseline, round(diff_pct, 4) as diff_pct,
  case when diff_pct is null or p is null or p >= 0.05 or diff_pct = 0 then 'no difference' when (diff_pct > 0) = (metric = 'throughput') then 'better' else 'worse' end as verdict
from w where metric in ('latency_ms', 'throughput', 'sla_violations')""")
def _(run_metrics):
    out = ex.headlines(ex.compare_arms(ex.best_baseline(suite_summary(run_metrics, METRICS))), ["latency_ms", "throughput", "sla_violations"])
    return out.withColumn("diff_pct", F.round("diff_pct", 4))


@plan("radar_scores", f"""
with s as ({_SUMMARY}), x as (select *, min(mean) over w as lo, max(mean) over w as hi from s window w as (partition by scenario, metric))
select strategy, metric, round(avg(case when hi = lo then 1.0 when metric in ('throughput', 'completed') then (mean - lo) / (hi - lo) else (hi - mean) / (hi - lo) end), 6) as score from x group by 1, 2""")
def _(run_metrics):
    return ex.radar_scores(suite_summary(run_metrics, METRICS)).withColumn("score", F.round("score", 6))


@plan("regression_metrics", """
select task_type, count(*) as n, round(avg(abs(predicted - actual)), 6) as mae, round(sqrt(avg((predicted - actual) ** 2)), 6) as rmse, round(1 - avg((predicted - actual) ** 2) / var_pop(actual), 6) as r2 from {scored} group by 1""")
def _(scored):
    return ev.regression_metrics(scored, "task_type")


_ROC = "g as (select score as s, sum(label) as pos, sum(1 - label) as neg from {scored} group by 1), r as (select s, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n from g window w as (order by s desc))"


@plan("classification_metrics", """
with c as (select count(*) as n, count(*) filter (score >= 0.5 and label = 1) as tp, count(*) filter (score >= 0.5 and label = 0) as fp, count(*) filter (score < 0.5 and label = 1) as fn, sum(label) as p from {scored}),
g as (select score as s, sum(label) as pos, sum(1 - label) as neg from {scored} group by 1),
w as (select sum(pos * (below + neg / 2.0)) as wins from (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from g))
select n, round(tp::double / (tp + fp), 6) as precision, round(tp::double / (tp + fn), 6) as recall, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1, round(wins::double / (p * (n - p)), 6) as auc from c, w""")
def _(scored):
    return ev.classification_metrics(scored, 0.5)


@plan("roc_points", f"with {_ROC} select s as threshold, tp::bigint as tp, fp::bigint as fp, round(tp::double / p, 6) as tpr, round(fp::double / n, 6) as fpr from r")
def _(scored):
    return ev.roc_points(scored)


@plan("best_f1_threshold", f"with {_ROC} select s as threshold, round(2.0 * tp / (tp + fp + p), 6) as f1 from r order by round(2.0 * tp / (tp + fp + p), 9) desc, s limit 1")
def _(scored):
    return ev.best_f1_threshold(scored)


@plan("residuals", "select exec_id, actual - predicted as residual from {scored}")
def _(scored):
    return scored.select("exec_id", (F.col("actual") - F.col("predicted")).alias("residual"))


_CUT = "'2024-01-20'"


@plan("baseline_group_mean", """
with m as (select worker_id, avg(exec_ms) as m from {executions} where dispatched_ms < 1705708800000 group by 1), g as (select avg(exec_ms) as g from {executions} where dispatched_ms < 1705708800000)
select exec_id, round(coalesce(m, g), 6) as baseline from {executions} e left join m on m.worker_id = e.worker_id, g where dispatched_ms >= 1705708800000""")
def _(executions):
    cut = F.col("dispatched_ms") < 1_705_708_800_000
    return ev.group_mean(executions.where(cut), executions.where(~cut), "worker_id", "exec_ms").select("exec_id", F.round("baseline", 6).alias("baseline"))


@plan("baseline_group_rate", """
with r as (select worker_id, avg((exec_ms > 600)::int) as m from {executions} group by 1) select exec_id, round(m, 6) as baseline from {executions} e join r on r.worker_id = e.worker_id""")
def _(executions):
    rows = executions.withColumn("y", (F.col("exec_ms") > 600).cast("int"))
    return ev.group_mean(rows, rows, "worker_id", "y").select("exec_id", F.round("baseline", 6).alias("baseline"))


@plan("baseline_persistence", "select exec_id, queue_len as predicted from {executions}")
def _(executions):
    return executions.select("exec_id", F.col("queue_len").alias("predicted"))


@plan("baseline_majority", "select exec_id, round((select avg((exec_ms > 600)::int) from {executions}), 9) as predicted from {executions}")
def _(executions):
    rate = executions.agg(F.round(F.avg((F.col("exec_ms") > 600).cast("int")), 9).alias("predicted"))
    return executions.select("exec_id").crossJoin(F.broadcast(rate))


@plan("time_split", """
with h as (select exec_id, dispatched_ms, case when task_type = 'signup' then 'holdout_type' when run_no = '2' then 'holdout_pattern' end as held from {executions}),
n as (select exec_id, row_number() over (order by dispatched_ms, exec_id) as pos, count(*) over () as n from h where held is null)
select exec_id, held as split from h where held is not null union all select exec_id, case when pos <= round_even(n * 0.8, 0) then 'train' else 'test' end from n""")
def _(executions):
    return ev.time_split(executions, "dispatched_ms", "exec_id", F.col("task_type") == "signup", F.col("run_no") == "2").select("exec_id", "split")


@plan("holdout_flags", "select exec_id, run_no = '2' as holdout_pattern, task_type = 'signup' as holdout_type from {executions}")
def _(executions):
    return executions.select("exec_id", (F.col("run_no") == "2").alias("holdout_pattern"), (F.col("task_type") == "signup").alias("holdout_type"))


@plan("ts_cv_folds", """
with p as (select exec_id, row_number() over (order by dispatched_ms, exec_id) - 1 as pos, count(*) over () as n from {executions})
select exec_id, (case when pos < n - 3 * (n // 4) then 0 else (pos - (n - 3 * (n // 4))) // (n // 4) + 1 end)::int as fold from p""")
def _(executions):
    return ev.ts_cv_folds(executions, "dispatched_ms", "exec_id", 3).select("exec_id", "fold")


@plan("select_model", """
with s as (select task_type as name, case when task_type in ('error', 'view') then 'baseline' else 'model' end as kind, length(task_type) * 10 + ascii(task_type) as ord, avg(abs_error_ms) * length(task_type) as score from {outcomes} group by 1),
b as (select name, score from s where kind = 'baseline' order by score limit 1), m as (select s.name, s.score from s, b where kind = 'model' and s.score <= 0.9 * b.score order by ord limit 1)
select coalesce(m.name, b.name) as chosen, round(coalesce(m.score, b.score), 6) as score, b.name as baseline from b left join m on true""")
def _(outcomes):
    s = outcomes.groupBy(F.col("task_type").alias("name")).agg((F.avg("abs_error_ms") * F.length(F.first("task_type"))).alias("score"))
    s = s.withColumn("kind", F.when(F.col("name").isin("error", "view"), "baseline").otherwise("model")).withColumn("order", F.length("name") * 10 + F.ascii("name"))
    return ev.select_model(s, 0.1)


@plan("cold_start", """
with r as (select exec_id, task_type <> 'signup' as seen, exec_ms::double as model_ms, case when exec_id % 3 = 0 then wait_ms::double end as type_mean, queue_len as prior_count, queue_len * 10.0::double as prior_mean, 123.0::double as global_mean from {executions})
select exec_id, not seen as cold_start, case when seen then model_ms else coalesce(case when type_mean > 0 then type_mean end, case when prior_count > 0 and prior_mean > 0 then prior_mean end, global_mean) end as pred_ms from r""")
def _(executions):
    rows = executions.select(
        "exec_id", (F.col("task_type") != "signup").alias("seen"), F.col("exec_ms").cast("double").alias("model_ms"), F.when(F.col("exec_id") % 3 == 0, F.col("wait_ms").cast("double")).alias("type_mean"),
        F.col("queue_len").alias("prior_count"), (F.col("queue_len") * 10.0).alias("prior_mean"), F.lit(123.0).alias("global_mean"),
    )
    return ev.cold_start(rows).select("exec_id", "cold_start", "pred_ms")


_PAIRS = """p as (select c.task_id, c.worker_id, c.pred_exec_ms as live, c.pred_exec_ms + c.cpu_pct - 50 as shadow, e.exec_ms::double as actual
  from {candidates} c join {executions} e on e.task_id = c.task_id and e.worker_id = c.worker_id where e.status = 'COMPLETED' and c.pred_exec_ms is not null)"""


def _pairs(candidates, executions):
    live = F.collect_list(F.struct("worker_id", F.col("pred_exec_ms").alias("pred")))
    shadow = F.collect_list(F.struct("worker_id", (F.col("pred_exec_ms") + F.col("cpu_pct") - 50).alias("pred")))
    log = candidates.where("pred_exec_ms is not null").groupBy("task_id", F.col("exec_id").alias("at")).agg(live.alias("live"), shadow.alias("shadow"))
    return ev.shadow_pairs(log, executions.where("status = 'COMPLETED'").select("task_id", "worker_id", F.col("exec_ms").cast("double").alias("actual")))


@plan("shadow_pairs", f"with {_PAIRS} select * from p")
def _(candidates, executions):
    return _pairs(candidates, executions)


@plan("shadow_compare", f"with {_PAIRS} select count(*) as n, round(avg(abs(live - actual)), 6) as live_mae, round(avg(abs(shadow - actual)), 6) as shadow_mae from p")
def _(candidates, executions):
    return ev.shadow_compare(_pairs(candidates, executions))


@plan("promotion_gate", f"""
with {_PAIRS}, c as (select count(*) as n, round(avg(abs(live - actual)), 6) as live_mae, round(avg(abs(shadow - actual)), 6) as shadow_mae from p)
select *, concat_ws('; ', case when n < 200 then 'too few pairs' end, case when shadow_mae > 0.95 * live_mae then 'no gain' end) as reasons, n >= 200 and shadow_mae <= 0.95 * live_mae as allowed from c""")
def _(candidates, executions):
    return ev.promotion_gate(ev.shadow_compare(_pairs(candidates, executions)), 0.05, 200)


@plan("registry_status", """
with v as (select model_version, count(*) as n, max(ts_ms) as newest from {outcomes} group by 1)
select model_version, case when newest = (select max(newest) from v) then 'live' else 'shadow' end as status from v""")
def _(outcomes):
    v = outcomes.groupBy("model_version").agg(F.max("ts_ms").alias("newest"))
    top = v.agg(F.max("newest").alias("top"))
    return v.crossJoin(F.broadcast(top)).select("model_version", F.coalesce(F.when(F.col("newest") == F.col("top"), "live"), F.lit("shadow")).alias("status"))


@plan("list_tasks", """
select task_id, task_type, status, submitted_ms, completed_ms - submitted_ms as latency_ms from {tasks} where status = 'COMPLETED' order by submitted_ms desc, task_no desc limit 5000""")
def _(tasks):
    return listings.list_tasks(tasks, status="completed", limit=9000)


@plan("list_events", "select seq, type, task_id from {log_events} where type in ('DISPATCH', 'ELECTION') order by physical_ms desc, seq desc limit 500")
def _(log_events):
    return listings.newest(log_events, ("physical_ms", "seq"), 500, {"type": ["DISPATCH", "ELECTION"]}).select("seq", "type", "task_id")


@plan("list_failures", "select failure_id, node_id, detected_ms from {failures} order by detected_ms desc, failure_id desc limit 200")
def _(failures):
    return listings.newest(failures, ("detected_ms", "failure_id"), 200)


@plan("recent_accuracy", "select exec_id, actual_ms, pred_ms, abs_error_ms from {outcomes} order by ts_ms desc, exec_id desc limit 300")
def _(outcomes):
    return listings.newest(outcomes, ("ts_ms", "exec_id"), 300).select("exec_id", "actual_ms", "pred_ms", "abs_error_ms")


@plan("worker_history", """
select sample_id, ts_ms, cpu_pct, queue_len from {samples} where worker_id = 'worker-1' and ts_ms > (select max(ts_ms) from {samples} where worker_id = 'worker-1') - 172800000""")
def _(samples):
    own = samples.where("worker_id = 'worker-1'")
    last = own.agg(F.max("ts_ms").alias("last"))
    return own.crossJoin(F.broadcast(last)).where("ts_ms > last - 172800000").orderBy("ts_ms").select("sample_id", "ts_ms", "cpu_pct", "queue_len")


@plan("metrics_slice", """
select sample_id, ts_ms from {samples} where ts_ms between (select min(dispatched_ms) from {executions} where status = 'FAILED') - 60000 and (select max(dispatched_ms) from {executions} where status = 'FAILED') + 120000""")
def _(samples, executions):
    ends = executions.where("status = 'FAILED'").agg((F.min("dispatched_ms") - 60_000).alias("a"), (F.max("dispatched_ms") + 120_000).alias("b"))
    return samples.crossJoin(F.broadcast(ends)).where("ts_ms between a and b").select("sample_id", "ts_ms")


@plan("run_slice", """
select count(*) as n, round(avg(exec_ms), 6) as mean_ms, round(quantile_cont(exec_ms::double, 0.95), 6) as p95_ms from {executions} where ends_with(task_id, '7')""")
def _(executions):
    plain = [F.count("*").alias("n"), F.round(F.avg("exec_ms"), 6).alias("mean_ms")]
    out = with_percentiles(executions.where(F.endswith("task_id", F.lit("7"))), (), plain, "exec_ms", {"p95_ms": ("cont", 0.95)})
    return out.withColumn("p95_ms", F.round("p95_ms", 6))


@plan("log_search", "select seq, node, lamport, task_id from {log_events} where node = 'node-1' and contains(task_id, '77') order by lamport desc, seq desc limit 400")
def _(log_events):
    found = log_events.where((F.col("node") == "node-1") & F.contains("task_id", F.lit("77")))
    return found.orderBy(F.desc("lamport"), F.desc("seq")).limit(400).select("seq", "node", "lamport", "task_id")


@plan("route_events", "select seq, case when type = 'DISPATCH' then 'decisions' when type = 'RESULT' then 'tasks' else 'events' end as topic from {log_events}")
def _(log_events):
    return log_events.select("seq", F.when(F.col("type") == "DISPATCH", "decisions").when(F.col("type") == "RESULT", "tasks").otherwise("events").alias("topic"))


@plan("event_order_diff", """
with p as (select row_number() over (order by physical_ms, node, seq) as pos, seq as pseq, node as pnode, type as ptype, task_id as ptask from (select * from {log_events} order by physical_ms desc, seq desc limit 500)),
l as (select row_number() over (order by lamport, node, seq) as pos, seq as lseq, node as lnode, type as ltype, task_id as ltask from (select * from {log_events} order by physical_ms desc, seq desc limit 500))
select pos, pseq as physical_seq, lseq as lamport_seq, pnode is distinct from lnode or ptype is distinct from ltype or ptask is distinct from ltask as differs from p full join l using (pos)""")
def _(log_events):
    last = log_events.orderBy(F.desc("physical_ms"), F.desc("seq")).limit(500)
    ranked = lambda order, x: last.select(F.row_number().over(Window.orderBy(order, "node", "seq")).alias("pos"), *[F.col(c).alias(x + c) for c in ("seq", "node", "type", "task_id")])
    both = ranked("physical_ms", "p").join(ranked("lamport", "l"), "pos", "full")
    differs = ~F.col("pnode").eqNullSafe(F.col("lnode")) | ~F.col("ptype").eqNullSafe(F.col("ltype")) | ~F.col("ptask_id").eqNullSafe(F.col("ltask_id"))
    return both.select(F.col("pos").cast("long").alias("pos"), F.col("pseq").alias("physical_seq"), F.col("lseq").alias("lamport_seq"), differs.alias("differs"))


@plan("ageing_order", """
select task_id, round(least(10.0, priority + 0.000001 * greatest(0, 1000000000000 - submitted_ms) / 1000)::double, 6) as effective from {tasks} where status = 'RUNNING'""")
def _(tasks):
    waited = F.greatest(F.lit(0), F.lit(1_000_000_000_000) - F.col("submitted_ms")) / 1000
    effective = F.least(F.lit(10.0), F.col("priority") + 0.000001 * waited)
    return tasks.where("status = 'RUNNING'").withColumn("effective", effective).orderBy(F.desc("effective"), "submitted_ms", "task_no").select("task_id", F.round("effective", 6).alias("effective"))


@plan("dead_letters", "select task_id, attempts from {tasks} where attempts > case task_no % 3 when 0 then 3 when 1 then 2 else 1 end and status = 'FAILED'")
def _(tasks):
    retries = F.when(F.col("task_no") % 3 == 0, 3).when(F.col("task_no") % 3 == 1, -1).otherwise(1)
    return listings.dead_letters(tasks.withColumn("max_retries", retries), 2).select("task_id", "attempts")


@plan("verified_sort", "select count(*) as n, 0::bigint as out_of_order, sum(exec_ms)::bigint as total, min(exec_ms) as first_value, max(exec_ms) as last_value from {executions}")
def _(executions):
    parts = executions.select("exec_ms").repartitionByRange("exec_ms").withColumn("part", F.spark_partition_id()).sortWithinPartitions("exec_ms").withColumn("at", F.monotonically_increasing_id())
    before = F.lag("exec_ms").over(Window.partitionBy("part").orderBy("at"))
    per = parts.withColumn("bad", F.coalesce((before > F.col("exec_ms")).cast("int"), F.lit(0))).groupBy("part").agg(
        F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("exec_ms").alias("total"), F.min("exec_ms").alias("lo"), F.max("exec_ms").alias("hi")
    )
    edge = F.lag("hi").over(Window.orderBy("part"))
    joined = per.withColumn("bad", F.col("bad") + F.coalesce((edge > F.col("lo")).cast("int"), F.lit(0)))
    return joined.agg(F.sum("n").alias("n"), F.sum("bad").alias("out_of_order"), F.sum("total").alias("total"), F.min("lo").alias("first_value"), F.max("hi").alias("last_value"))


@plan("upsert_tasks", "select task_id, seq, type, physical_ms from {log_events} qualify row_number() over (partition by task_id order by physical_ms desc, seq desc) = 1")
def _(log_events):
    newest = F.max_by(F.struct("seq", "type", "physical_ms"), F.struct("physical_ms", "seq"))
    return log_events.groupBy("task_id").agg(newest.alias("x")).select("task_id", "x.*")


@plan("insert_if_absent", """
select task_id, seq, type from {log_events} l where not exists (select 1 from {tasks} t where t.task_id = l.task_id and t.status = 'FAILED') qualify row_number() over (partition by task_id order by physical_ms, seq) = 1""")
def _(log_events, tasks):
    first = log_events.groupBy("task_id").agg(F.min_by(F.struct("seq", "type"), F.struct("physical_ms", "seq")).alias("x")).select("task_id", "x.*")
    return first.join(tasks.where("status = 'FAILED'").select("task_id"), "task_id", "left_anti")


@plan("task_detail", """
select t.task_id, t.status, coalesce(n, 0)::bigint as n_events, kinds from {tasks} t
left join (select task_id, count(*) as n, string_agg(type, '>' order by physical_ms, seq) as kinds from {log_events} group by 1) e on e.task_id = t.task_id""")
def _(tasks, log_events):
    steps = F.sort_array(F.collect_list(F.struct("physical_ms", "seq", "type")))
    events = log_events.groupBy("task_id").agg(steps.alias("events"))
    joined = tasks.join(events, "task_id", "left")
    return joined.select("task_id", "status", F.coalesce(F.size("events"), F.lit(0)).cast("long").alias("n_events"), F.array_join(F.transform("events", lambda x: x["type"]), ">").alias("kinds"))


@plan("unpack_run_metrics", """
select run_id, metric, round(value, 4) as value from (select run_id, 'latency_ms' as metric, latency_ms as value from {run_metrics} union all select run_id, 'throughput', throughput from {run_metrics}) where value is not null and isfinite(value)""")
def _(run_metrics):
    packed = run_metrics.select("run_id", F.to_json(F.struct("latency_ms", "throughput")).alias("metrics"))
    cells = packed.select("run_id", F.explode(F.from_json("metrics", "map<string,double>")).alias("metric", "value"))
    return cells.where("value is not null and not isnan(value) and abs(value) < double('infinity')").select("run_id", "metric", F.round("value", 4).alias("value"))


@plan("worker_health", """
select worker_id, max(ts_ms) as last_ms, case when (select max(ts_ms) from {samples}) - max(ts_ms) <= 600000 then 'UP' else 'SILENT' end as health from {samples} group by 1""")
def _(samples):
    last = samples.groupBy("worker_id").agg(F.max("ts_ms").alias("last_ms"))
    now = last.agg(F.max("last_ms").alias("now"))
    return last.crossJoin(F.broadcast(now)).select("worker_id", "last_ms", F.when(F.col("now") - F.col("last_ms") <= 600_000, "UP").otherwise("SILENT").alias("health"))


@plan("dead_workers", """
with g as (select worker_id, ts_ms, lead(ts_ms) over (partition by worker_id order by ts_ms, sample_id) as next_ms from {samples})
select worker_id, ts_ms as silent_from_ms, (next_ms - ts_ms) // 3600000 as misses from g where (next_ms - ts_ms) // 3600000 >= 1""")
def _(samples):
    from telemill.operators.numbering import running

    lagged = running(samples, ("worker_id",), ("ts_ms", "sample_id"), {"before": ("last", F.col("ts_ms"))}, history.DAY, exclusive=True)
    gap = F.floor((F.col("ts_ms") - F.col("before")) / 3_600_000)
    return lagged.where(gap >= 1).select("worker_id", F.col("before").alias("silent_from_ms"), gap.alias("misses"))


@plan("stream_throttle", """
with r as (select type, physical_ms // 3600000 as tick, seq, row_number() over (partition by type, physical_ms // 3600000 order by physical_ms desc, seq desc) as r, count(*) over (partition by type, physical_ms // 3600000) as n from {log_events})
select type, tick, seq, greatest(0, n - 2) as dropped from r where r <= 2""")
def _(log_events):
    rows = log_events.select("type", F.floor(F.col("physical_ms") / 3_600_000).alias("tick"), "physical_ms", "seq")
    top = history.first_rows(rows, ("type", "tick"), (F.desc("physical_ms"), F.desc("seq")), 2)
    ticks = rows.groupBy(F.col("type").alias("_type"), F.col("tick").alias("_tick")).agg(F.count("*").alias("n"))
    joined = top.join(ticks, F.col("type").eqNullSafe(F.col("_type")) & F.col("tick").eqNullSafe(F.col("_tick")))
    return joined.select("type", "tick", "seq", F.greatest(F.lit(0), F.col("n") - 2).alias("dropped"))


@plan("stragglers", """
with p as (select task_type, quantile_disc(exec_ms, 0.9)::double as p90 from {executions} where status = 'COMPLETED' group by 1 having count(*) >= 20),
x as (select e.exec_id, e.exec_ms, greatest(2 * o.pred_ms, p.p90) as limit_ms from {executions} e left join {outcomes} o on o.exec_id = e.exec_id and o.exec_id % 4 > 0 left join p on p.task_type = e.task_type where e.attempt = 1)
select * from x where exec_ms > limit_ms""")
def _(executions, outcomes):
    known = outcomes.where("exec_id % 4 > 0").select("exec_id", "pred_ms")
    running = executions.join(known, "exec_id", "left").withColumn("elapsed_ms", F.col("exec_ms"))
    return listings.stragglers(running, executions.where("status = 'COMPLETED'"), 2.0).select("exec_id", "exec_ms", "limit_ms")


@plan("union_runs", "select run_id, count(*) as n, sum(exec_ms)::bigint as exec_ms from {replay} group by 1")
def _(replay):
    path = scratch_path(replay.sparkSession, "runs")
    replay.select("run_id", "task_no", "status", "exec_ms").repartition("run_id").write.partitionBy("run_id").parquet(path)
    return files.read_runs(replay.sparkSession, path, "task_no long, status string, exec_ms long").groupBy("run_id").agg(F.count("*").alias("n"), F.sum("exec_ms").alias("exec_ms"))
