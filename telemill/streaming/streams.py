"""Structured Streaming twins of batch operators; each equals the batch result once its input has ended.

Checkpoints and sinks lie in the shared folder. Time columns are epoch milliseconds; the watermark is a parameter, as
lateness is a property of the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from telemill.session import scratch_path, shared_dir
from telemill.streaming.keyed import KeyedTable


def replay_source(rows: DataFrame, order: str, parts: int, label: str, ties: tuple[str, ...] = (), file_rows: int = 100_000, bounded: bool = False, trigger_rows: int | None = None) -> DataFrame:
    """A stream over ``rows`` in time order: files of at most ``file_rows`` rows each, cut at approximate quantiles.

    There are ``parts`` triggers or so, each with several files of a large input; ``bounded`` adds triggers so that none
    has more than ``trigger_rows`` rows (by default, one file). A trigger costs a round of tasks over all partitions of the state,
    whatever it brings, so small ones cost more than their rows. Streams take files by their time, which is set by their order.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, label)
    files = max(parts, -(-rows.count() // file_rows))
    rows.repartitionByRange(files, order, *ties).sortWithinPartitions(order, *ties).write.option("maxRecordsPerFile", file_rows).parquet(path)
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f for f in fs.listStatus(top) if f.getPath().getName().startswith("part-")), key=lambda f: [int(x) for x in re.match(r"part-(\d+)-.*?-c(\d+)", f.getPath().getName()).groups()])
    first = min((f.getModificationTime() for f in found), default=0) - 1000 * len(found)
    for i, f in enumerate(found):
        fs.setTimes(f.getPath(), first + 1000 * i, -1)
    share = max(1, -(-len(found) // parts))
    taken = min(share, max(1, (trigger_rows or file_rows) // file_rows)) if bounded else share
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", taken).option("maxFileAge", "36500d").parquet(path)


def _place(spark: SparkSession, label: str, name: str | None) -> str:
    """The folder of a run: a new one, or that of the run called ``name``, which a later start finds again."""
    return f"{shared_dir(spark)}/telemill/streams/{name}" if name else scratch_path(spark, label)


def run_to_files(stream: DataFrame, label: str, mode: str = "append", name: str | None = None) -> DataFrame:
    """Run a stream over all its input so far into Parquet files and read them.

    A run with a ``name`` keeps its checkpoint and files under it: started again, by another driver too, it goes on
    after the last batch, with its state and watermark. The sink's own log leaves out a batch that is written twice.
    """
    spark = stream.sparkSession
    path = _place(spark, label, name)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def worker_windows(stream: DataFrame, size_ms: int, slide_ms: int, watermark_ms: int) -> DataFrame:
    """Arrivals, mean and largest queue per worker in sliding windows; a window is given once the watermark has passed its end."""
    at = stream.withColumn("_at", F.timestamp_millis("dispatched_ms")).withWatermark("_at", f"{watermark_ms} milliseconds")
    grouped = at.groupBy("worker_id", F.window("_at", f"{size_ms} milliseconds", f"{slide_ms} milliseconds").alias("w"))
    out = grouped.agg(F.count("*").alias("n"), F.avg("queue_len").alias("mean"), F.max("queue_len").alias("queue_max"))
    return out.select(
        "worker_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), F.round(F.col("n") * 1000.0 / size_ms, 9).alias("arrival_rate"),
        F.round("mean", 6).alias("queue_mean"), "queue_max",
    )


def running_stats(stream: DataFrame, last: int, threshold: float, patience: int) -> DataFrame:
    """Per outcome of a type its rolling mean absolute error over ``last`` outcomes and whether a drift episode starts there.

    State of a type: its last errors and the length of its run of ratios over the threshold. Triggers bring rows in
    time order; within one they are sorted.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, streak = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "exec_id"])
        mean, starts = [], []
        for error, base in zip(rows["abs_error_ms"].tolist(), rows["baseline"].tolist(), strict=True):
            errors = [*errors[-(last - 1) :], error] if last > 1 else [error]
            mean.append(sum(errors) / len(errors))
            if base == base and base > 0:
                streak = streak + 1 if mean[-1] / base > threshold else 0
                starts.append(streak == patience)
            else:
                starts.append(False)
        state.update((errors, streak))
        yield pd.DataFrame({"exec_id": rows["exec_id"], "task_type": key[0], "rolling_type_mae_ms": mean, "drift_starts": starts})

    return stream.groupBy("task_type").applyInPandasWithState(
        update, "exec_id long, task_type string, rolling_type_mae_ms double, drift_starts boolean", "errors array<double>, streak int", "append", GroupStateTimeout.NoTimeout
    )


def upsert(stream: DataFrame, key: str, order: tuple[str, ...], label: str, buckets: int = 16, name: str | None = None) -> DataFrame:
    """The newest row per key of a change stream, kept in a ``KeyedTable``: a micro-batch rewrites the buckets it touches.

    A batch that is run again after a failure is left out if it was committed. A run with a ``name`` goes on where the
    last one ended.
    """
    spark: SparkSession = stream.sparkSession
    path = _place(spark, label, name)
    held = KeyedTable(spark, f"{path}/table", stream.schema, key, order, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        held.merge(batch, number)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return held.rows()


def throttle(stream: DataFrame, by: str, at: str, tie: str, tick_ms: int, k: int, watermark_ms: int) -> DataFrame:
    """The newest ``k`` rows of each key and tick, and how many older ones were dropped, once the watermark has passed the tick's end.

    Each Arrow batch is cut down to the newest ``k`` of a key and tick before the shuffle, so a hot key brings at most
    ``k`` rows a batch to its task, and the state of a tick is ``k`` rows and a count. Rows without a time belong to no
    tick, and rows of a tick that is closed are late; both are left out. A null key is a key of its own.
    """
    spec = dict((f.name, f.dataType.simpleString()) for f in stream.schema)
    partial = f"{by} {spec[by]}, tick long, {at} long, {tie} {spec[tie]}, _n long"

    def newest(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values([at, tie], ascending=False).groupby([by, "tick"], dropna=False, sort=False).head(k)

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.dropna(subset=[at])
            rows = rows.assign(tick=rows[at].astype("int64") // tick_ms)
            top = newest(rows)
            total, first = rows.groupby([by, "tick"], dropna=False, sort=False)[tie].transform("size"), ~top.duplicated([by, "tick"])
            yield top.assign(_n=total.loc[top.index].where(first, 0))[[by, "tick", at, tie, "_n"]]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end = (int(key[1]) + 1) * tick_ms
        if state.hasTimedOut:
            times, ties, n = state.get
            state.remove()
            yield pd.DataFrame({by: [key[0]] * len(times), "tick": key[1], at: times, tie: ties, "dropped": max(0, n - k)})
        elif end > state.getCurrentWatermarkMs():
            times, ties, n = state.get if state.exists else ([], [], 0)
            held = list(zip(times, ties, strict=True))
            for batch in batches:
                n += int(batch["_n"].sum())
                held = sorted([*held, *zip(batch[at].tolist(), batch[tie].tolist(), strict=True)], reverse=True)[:k]
            state.update(([t for t, _ in held], [x for _, x in held], n))
            state.setTimeoutTimestamp(end)

    small = stream.select(by, at, tie).mapInPandas(shrink, partial)
    timed = small.withColumn("_at", F.timestamp_millis(at)).withWatermark("_at", f"{watermark_ms} milliseconds")
    return timed.groupBy(by, "tick").applyInPandasWithState(
        update, f"{by} {spec[by]}, tick long, {at} long, {tie} {spec[tie]}, dropped long", f"times array<long>, ties array<{spec[tie]}>, n long", "append", GroupStateTimeout.EventTimeTimeout
    )


def dead_workers(stream: DataFrame, worker: str, at: str, interval_ms: int, misses: int, watermark_ms: int) -> DataFrame:
    """A row per silence of a worker: the time of its last sample, once ``misses`` heartbeat intervals have gone by without another.

    A silence is told by the sample that ends it or, if the watermark gets that far first, by a timer; never by both.
    State of a worker: its last time and whether its silence has been told. Samples of a trigger are cut down to their
    distinct times batch by batch; samples older than the last one of their worker change nothing. Samples without a time are left out.
    """
    kind = dict((f.name, f.dataType.simpleString()) for f in stream.schema)[worker]
    reach = interval_ms * misses

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told, found = (*state.get, []) if state.exists else (None, False, [])
        if state.hasTimedOut:
            found.append(last)
            state.update((last, True))
        else:
            for t in sorted({int(t) for batch in batches for t in batch[at].unique()}):
                if last is None or t > last:
                    if last is not None and t - last >= reach and not told:
                        found.append(last)
                    last, told = t, False
            if not told and last + reach <= state.getCurrentWatermarkMs():
                found.append(last)
                told = True
            state.update((last, told))
            if not told:
                state.setTimeoutTimestamp(last + reach)
        yield pd.DataFrame({worker: [key[0]] * len(found), "silent_from_ms": pd.Series(found, dtype="int64")})

    timed = stream.where(F.col(at).isNotNull()).select(worker, at).withColumn("_at", F.timestamp_millis(at)).withWatermark("_at", f"{watermark_ms} milliseconds")
    return timed.groupBy(worker).applyInPandasWithState(
        update, f"{worker} {kind}, silent_from_ms long", "last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
