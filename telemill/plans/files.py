"""Registered sources and sinks: driver tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.operators.numbering import numbered
from telemill.plans.registry import plan
from telemill.session import materialize, scratch_path
from telemill.sources import files as src


def _spark(df):
    return df.sparkSession


@plan("scan_history", "select exec_id, task_type, exec_ms::double as exec_ms, case when queue_len = 3 then 0 else queue_len end::int as queue_len from {executions} where status = 'COMPLETED'")
def _(executions):
    path = scratch_path(_spark(executions), "history")
    rows = executions.select(
        "exec_id", "task_id", "task_type", "worker_id", F.timestamp_millis("dispatched_ms").alias("dispatched_at"), "wait_ms", "exec_ms", "status", F.when(F.col("queue_len") != 3, F.col("queue_len")).alias("queue_len")
    )
    rows.write.option("header", True).csv(path)
    return src.scan_history(_spark(executions), path).select("exec_id", "task_type", "exec_ms", "queue_len")


@plan("scan_history_lines", "select cast(exec_id as varchar) as exec_id, task_type, 'COMPLETED' as status from {executions} where exec_id % 5 <> 0")
def _(executions):
    path = scratch_path(_spark(executions), "lines")
    line = F.concat_ws(",", F.col("exec_id").cast("string"), "task_type", F.when(F.col("exec_id") % 5 == 0, "stray"))
    executions.select(line.alias("value")).write.text(path)
    return src.scan_history_lines(_spark(executions), path, ["exec_id", "task_type"])


@plan("scan_events", "select node, lamport, type, task_id from {log_events} where seq % 7 <> 0 and seq % 11 <> 0")
def _(log_events):
    path = scratch_path(_spark(log_events), "events")
    body = F.to_json(F.struct(F.when(F.col("seq") % 11 != 0, F.col("node")).alias("node"), "lamport", "physical_ms", "type", "task_id", F.lit("x").alias("unknown")))
    log_events.select(F.when(F.col("seq") % 7 == 0, F.concat(F.lit("{broken "), body)).otherwise(body).alias("value")).write.text(path)
    return src.scan_events(_spark(log_events), path).select("node", "lamport", "type", "task_id")


@plan("scan_trace", "select exec_id * 1000 as offset_ms, task_id, task_type as type, priority::int as priority, (case when exec_id % 2 = 0 then 500 else 0 end)::bigint as timeout_ms from {executions} where exec_id % 13 <> 0")
def _(executions):
    path = scratch_path(_spark(executions), "trace")
    executions.select(
        (F.col("exec_id") * 1000).alias("offset_ms"), "task_id", F.col("task_type").alias("type"), F.when(F.col("exec_id") % 13 != 0, "k=1").alias("input"), "priority",
        F.when(F.col("exec_id") % 2 == 0, 500).alias("timeout_ms"), F.lit(1).alias("extra"),
    ).write.json(path)
    return src.scan_trace(_spark(executions), path).select("offset_ms", "task_id", "type", "priority", "timeout_ms")


@plan("scan_replay", "select run_id, task_no, coalesce(start_ms, -1)::bigint as start_ms, coalesce(end_ms, -1)::bigint as end_ms, coalesce(latency_ms, -1)::bigint as latency_ms, status, exec_ms from {replay}")
def _(replay):
    path = scratch_path(_spark(replay), "replay")
    replay.select("run_id", "task_no", "submit_ms", "start_ms", "end_ms", "latency_ms", "status", "exec_ms").write.option("header", True).csv(path)
    return src.scan_replay(_spark(replay), path).drop("submit_ms")


@plan("scan_run_dir", """
select scenario as run_key, task_no, exec_ms, length(scenario)::bigint as weight from {replay} where scenario <> 'ASIA'""")
def _(replay):
    path = scratch_path(_spark(replay), "runs")
    replay.select("task_no", "exec_ms", F.col("scenario").alias("run")).write.partitionBy("run").option("header", True).csv(path)
    runs = replay.where("scenario <> 'ASIA'").select(F.col("scenario").alias("run_key")).distinct().withColumn("weight", F.length("run_key").cast("long"))
    return src.scan_run_dir(_spark(replay), path, "task_no long, exec_ms long", runs)


@plan("scan_prediction_log", "select task_id, count(*) as n, round(sum(pred_exec_ms), 6) as total from {candidates} where exec_id % 9 <> 0 group by 1")
def _(candidates):
    path = scratch_path(_spark(candidates), "predictions")
    per = candidates.groupBy("task_id", "exec_id").agg(F.collect_list(F.struct("worker_id", F.col("pred_exec_ms").alias("pred"))).alias("predictions"))
    body = F.to_json(F.struct(F.col("exec_id").alias("at"), "task_id", F.lit("v1").alias("version"), "predictions"))
    per.select(F.when(F.col("exec_id") % 9 == 0, F.lit("not json")).otherwise(body).alias("value")).write.text(path)
    got = src.scan_prediction_log(_spark(candidates), path).select("task_id", F.inline("predictions"))
    return got.groupBy("task_id").agg(F.count("*").alias("n"), F.round(F.sum("pred"), 6).alias("total"))


@plan("scan_dataset", "select exec_id, dispatched_ms, exec_ms from {executions}")
def _(executions):
    path = scratch_path(_spark(executions), "dataset")
    executions.select("exec_id", "dispatched_ms", "exec_ms").write.parquet(path)
    return src.scan_dataset(_spark(executions), path, ["dispatched_ms", "exec_id"])


@plan("export_history", "select 'executions' as kind, count(*) as n, sum(exec_ms)::bigint as total from {executions} union all select 'events', count(*), sum(lamport)::bigint from {log_events}")
def _(executions, log_events):
    spark, path = _spark(executions), scratch_path(_spark(executions), "export")
    src.export_history(executions.select("exec_id", "dispatched_ms", "exec_ms"), log_events.select("seq", "physical_ms", "lamport", "type"), path)
    a = spark.read.schema("exec_id long, dispatched_ms long, exec_ms long").csv(f"{path}/executions", header=True).agg(F.count("*").alias("n"), F.sum("exec_ms").alias("total"))
    b = spark.read.schema("seq long, physical_ms long, lamport long, type string").json(f"{path}/events").agg(F.count("*").alias("n"), F.sum("lamport").alias("total"))
    return a.select(F.lit("executions").alias("kind"), "n", "total").unionByName(b.select(F.lit("events").alias("kind"), "n", "total"))


@plan("sink_csv", "select task_type, count(*) as n from {executions} group by 1")
def _(executions):
    path = scratch_path(_spark(executions), "sink")
    executions.groupBy("task_type").agg(F.count("*").alias("n")).write.option("header", True).csv(path)
    return _spark(executions).read.schema("task_type string, n long").csv(path, header=True)


@plan("sink_parquet", "select exec_id, task_type, exec_ms from {executions}")
def _(executions):
    return materialize(executions.select("exec_id", "task_type", "exec_ms"), "sink")


#: Most lines of one file of a trace; each file is hashed as one value.
_TRACE_LINES = 100_000


@plan("trace_checksum", """
with t as (select scenario, '{"task_no":' || task_no || ',"submit_ms":' || submit_ms || '}' as line, (row_number() over (partition by scenario order by task_no, submit_ms) - 1) // 100000 as part from {replay} where scenario is not null),
s as (select scenario, part, sha256(string_agg(line, chr(10) order by line) || chr(10)) as sum from t group by 1, 2)
select scenario as region, part, sum as expected, sum as actual, true as ok from s""")
def _(replay):
    """The manifest comes from the rows, before any file is written; files are found again by their folder."""
    spark, path = _spark(replay), scratch_path(_spark(replay), "traces")
    lines = numbered(replay.where("scenario is not null"), "task_no", "at", ("scenario",), ("submit_ms",))
    lines = lines.select("scenario", F.floor(F.col("at") / _TRACE_LINES).alias("part"), F.to_json(F.struct("task_no", "submit_ms")).alias("line"))
    lines = materialize(lines, "trace-lines")
    text = F.concat(F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("\n"))
    manifest = lines.groupBy("scenario", "part").agg(F.sha2(text, 256).alias("expected"))
    lines.repartition("scenario", "part").sortWithinPartitions("scenario", "part", "line").write.partitionBy("scenario", "part").text(path)
    key = F.struct(F.url_decode(F.regexp_extract("path", "scenario=([^/]+)/", 1)).alias("scenario"), F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long").alias("part"))
    checked = src.trace_checksum(spark, f"{path}/*/*", manifest.select(F.struct("scenario", "part").alias("file"), "expected"), key)
    return checked.select(F.col("file.scenario").alias("region"), F.col("file.part").alias("part"), "expected", "actual", "ok")
