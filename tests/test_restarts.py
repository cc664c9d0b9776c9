"""Streams that are stopped and started again, and the table that a change stream keeps."""

import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from telemill.session import shared_dir
from telemill.streaming import streams
from telemill.streaming.keyed import KeyedTable


def local(path):
    return path.removeprefix("file:")


def source(spark, top, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(top)


def add(spark, top, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(top)


def forget_last_batch(path):
    """As if the driver had died after the sink wrote its last batch and before the batch was noted as done."""
    commits = f"{local(path)}/state/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for n in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{n}"):
            os.unlink(f"{commits}/{n}")


SAMPLES = "worker_id string, dispatched_ms long, ts_ms long, queue_len long, task_type string, exec_id long, abs_error_ms double, baseline double, type string, physical_ms long, seq long"


def samples():
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        t = i * 1000 + rnd.randrange(900)
        rows.append((rnd.choice("ab"), t, t, rnd.randrange(9), rnd.choice("xy"), i, rnd.random() * 50, 20.0, rnd.choice("pq"), t, i))
    return rows


KINDS = {
    "windows": lambda s: streams.worker_windows(s, 20_000, 10_000, 2_000),
    "stats": lambda s: streams.running_stats(s, 5, 1.3, 2),
    "throttle": lambda s: streams.throttle(s, "type", "physical_ms", "seq", 15_000, 2, 2_000),
    "silence": lambda s: streams.dead_workers(s, "worker_id", "ts_ms", 1_500, 2, 2_000),
}


@pytest.mark.parametrize("kind", KINDS)
def test_stopped_streams_go_on(spark, tmp_path, kind):
    rows = samples()
    split, whole = str(tmp_path / "split"), str(tmp_path / "whole")
    name = f"{kind}-{uuid.uuid4().hex}"
    cuts = [rows[:60], rows[60:130], rows[130:190], rows[190:]]
    for cut in cuts:
        add(spark, whole, cut, SAMPLES)
    want = sorted(map(repr, streams.run_to_files(KINDS[kind](source(spark, whole, SAMPLES)), kind).collect()))
    for i, cut in enumerate(cuts):
        add(spark, split, cut, SAMPLES)
        if i in (1, 3):
            streams.run_to_files(KINDS[kind](source(spark, split, SAMPLES)), kind, name=name)
            forget_last_batch(f"{shared_dir(spark)}/telemill/streams/{name}")
    got = sorted(map(repr, streams.run_to_files(KINDS[kind](source(spark, split, SAMPLES)), kind, name=name).collect()))
    assert got == want and got


def test_upserts_go_on_and_ignore_repeated_batches(spark, tmp_path):
    rnd = random.Random(9)
    schema = "task_id string, seq long, type string"
    rows = [(rnd.choice([None, *"abcdefgh"]), i, rnd.choice("xyz")) for i in range(120)]
    top, name = str(tmp_path / "changes"), f"upsert-{uuid.uuid4().hex}"
    for i in range(4):
        add(spark, top, rows[30 * i : 30 * i + 30], schema)
        out = streams.upsert(source(spark, top, schema), "task_id", ("seq",), "upsert", buckets=4, name=name)
        seen = {}
        for r in rows[: 30 * i + 30]:
            seen[r[0]] = r
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(seen.values(), key=repr)
        forget_last_batch(f"{shared_dir(spark)}/telemill/streams/{name}")


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n long, v string").schema
    path = str(tmp_path / "table")
    table = KeyedTable(spark, path, schema, "k", ("n",), buckets=8)
    assert table.rows().count() == 0 and table.last_commit() == -1
    everything = [(f"k{i}", i, "old") for i in range(100)]
    assert table.merge(spark.createDataFrame(everything, schema), 0) == list(range(8))
    before = table.folders()
    one = spark.createDataFrame([("k7", 500, "new"), ("k7", 400, "older"), ("k7", 3, "late")], schema)
    touched = table.merge(one, 1)
    assert len(touched) == 1 and {b for b, f in table.folders().items() if f != before[b]} == set(touched)
    assert table.merge(spark.createDataFrame([("k7", 900, "twice")], schema), 1) == []
    again = KeyedTable(spark, path, schema, "k", ("n",), buckets=8)
    got = {r.k: (r.n, r.v) for r in again.rows().collect()}
    assert got == {**{k: (n, v) for k, n, v in everything}, "k7": (500, "new")}
    again.merge(spark.createDataFrame(everything, schema).withColumn("n", F.col("n") + 1000), 2)
    assert again.vacuum() == 2 and again.rows().where("n < 1000").isEmpty()
    with open(local(f"{path}/commits/2")) as f:
        assert len(json.load(f)) == 8
