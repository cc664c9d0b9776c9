"""Readers and writers with explicit schemas: no inference, tolerant where the formats are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "exec_id long, task_id string, task_type string, worker_id string, dispatched_at timestamp, wait_ms long, exec_ms double, status string, queue_len int"
EVENTS = "node string, lamport long, physical_ms long, type string, task_id string, trace string, details map<string,string>"
TRACE = "offset_ms long, task_id string, type string, input string, priority int, timeout_ms long"
REPLAY = "run_id string, task_no string, submit_ms string, start_ms string, end_ms string, latency_ms string, status string, exec_ms string"
PREDICTIONS = "at long, task_id string, version string, predictions array<struct<worker_id:string,pred:double>>, shadow_version string, shadow_predictions array<struct<worker_id:string,pred:double>>"


def scan_history(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header: completed rows, null queue lengths as 0."""
    return spark.read.schema(HISTORY).csv(path, header=True).where("status = 'COMPLETED'").fillna({"queue_len": 0})


def scan_history_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines with exactly as many fields as there are columns (header and ragged lines dropped), all as strings; no status means COMPLETED."""
    fields = F.split("value", ",", -1)
    rows = spark.read.text(path).where((F.size(fields) == len(columns)) & (F.get(fields, F.lit(0)) != columns[0]))
    out = rows.select(*[F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return out if "status" in columns else out.withColumn("status", F.lit("COMPLETED"))


def _valid_json(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """JSON lines by schema: malformed lines and those without a required field are skipped, unknown keys ignored."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = F.col("_bad").isNull()
    for c in required:
        good &= F.col(c).isNotNull()
    return rows.where(good).drop("_bad")


def scan_events(spark: SparkSession, path: str) -> DataFrame:
    return _valid_json(spark, path, EVENTS, ["node", "lamport"])


def scan_trace(spark: SparkSession, path: str) -> DataFrame:
    return _valid_json(spark, path, TRACE, ["task_id", "type", "input"]).fillna({"timeout_ms": 0})


def scan_replay(spark: SparkSession, path: str) -> DataFrame:
    """Replay CSV: blank start, end and latency are -1, blank execution times 0."""
    number = lambda c, d: F.coalesce(F.expr(f"try_cast(nullif(trim({c}), '') as bigint)"), F.lit(d)).cast("long").alias(c)
    rows = spark.read.schema(REPLAY).csv(path, header=True)
    return rows.select("run_id", number("task_no", -1), number("submit_ms", -1), number("start_ms", -1), number("end_ms", -1), number("latency_ms", -1), "status", number("exec_ms", 0))


def scan_run_dir(spark: SparkSession, path: str, schema: str, runs: DataFrame) -> DataFrame:
    """Every per-run CSV of a folder, the run id from the folder's partition or file name; files of unknown runs are skipped."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)/[^/]*$", 1)
    rows = spark.read.schema(schema).csv(path, header=True, recursiveFileLookup=True).withColumn("run_key", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))
    return rows.join(runs, "run_key")


def read_runs(spark: SparkSession, path: str, schema: str, run: str = "run_id") -> DataFrame:
    """The files of all runs below ``path`` (a folder run_id=... for each) as one table with the run's id."""
    return spark.read.schema(f"{schema}, {run} string").parquet(path)


def scan_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    return _valid_json(spark, path, PREDICTIONS, ["task_id"])


def scan_dataset(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    return spark.read.parquet(path).orderBy(*order)


def export_history(executions: DataFrame, events: DataFrame, path: str) -> None:
    """Executions as CSV with header and events as JSON lines, each in time order over its files."""
    executions.repartitionByRange("dispatched_ms").sortWithinPartitions("dispatched_ms", "exec_id").write.option("header", True).csv(f"{path}/executions")
    events.repartitionByRange("physical_ms").sortWithinPartitions("physical_ms", "seq").write.json(f"{path}/events")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in ``parts`` ranges of a numeric column, read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options)
    return reader.load()


def trace_checksum(spark: SparkSession, path: str, manifest: DataFrame, key: Column | None = None) -> DataFrame:
    """file, expected, actual, ok for each file of the manifest (file, sha256): a mismatch or a missing file isn't ok.

    ``key`` makes what the manifest calls ``file`` from the column path; by default it is the file's name. Each file is
    hashed as one value, so traces of any size are to be kept in files of bounded size.
    """
    name = F.element_at(F.split("path", "/"), -1) if key is None else key
    files = spark.read.format("binaryFile").load(path).select(name.alias("file"), F.sha2("content", 256).alias("actual"))
    return manifest.join(files, "file", "left").withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))
