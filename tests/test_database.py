"""Reading a database in ranges, and exporting what was read."""

import uuid

import pytest
from pyspark.sql import functions as F

from telemill.sources import files

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def url(spark):
    """An in-memory database that comes with Spark; it lives in the driver, where a local master's tasks run."""
    try:
        spark._jvm.java.lang.Class.forName(DRIVER)
    except Exception:  # noqa: BLE001
        pytest.skip("no database driver here")
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def test_a_table_is_read_in_ranges(spark, url, tmp_path):
    rows = [(i if i % 7 else None, i * 1000, f"task {i}", i / 4) for i in range(-20, 200)]
    made = spark.createDataFrame(rows, "exec_id long, dispatched_ms long, task_id string, exec_ms double")
    made.write.jdbc(url, "executions", properties={"driver": DRIVER})
    got = files.read_jdbc(spark, url, "executions", "exec_id", 0, 150, 4, driver=DRIVER).withColumnsRenamed({c.upper(): c for c in made.columns})
    assert got.rdd.getNumPartitions() == 4
    assert sorted(map(repr, got.select(*made.columns).collect())) == sorted(map(repr, made.collect()))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and sum(sizes) == len(rows)


def test_filters_reach_the_database(spark, url):
    spark.createDataFrame([(i, i % 3) for i in range(30)], "seq long, kind int").write.jdbc(url, "entries", properties={"driver": DRIVER})
    few = files.read_jdbc(spark, url, "entries", "seq", 0, 30, 2, driver=DRIVER).where("kind = 1").select("seq")
    assert "PushedFilters: [*IsNotNull(kind), *EqualTo(kind,1)]" in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in few.collect()) == list(range(1, 30, 3))


def test_what_was_read_is_exported_in_time_order(spark, url, tmp_path):
    executions = spark.createDataFrame([(i, (i * 37) % 100) for i in range(100)], "exec_id long, dispatched_ms long")
    events = spark.createDataFrame([(i, (i * 53) % 100, "start") for i in range(100)], "seq long, physical_ms long, type string")
    for name, df in (("history", executions), ("log", events)):
        df.write.jdbc(url, name, properties={"driver": DRIVER})
    read = lambda name, column: files.read_jdbc(spark, url, name, column, 0, 100, 3, driver=DRIVER)
    lower = lambda df: df.toDF(*map(str.lower, df.columns))
    files.export_history(lower(read("history", "exec_id")), lower(read("log", "seq")), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out/executions"), header=True, inferSchema=True)
    assert sorted(map(tuple, back.select("exec_id", "dispatched_ms").collect())) == sorted(map(tuple, executions.collect()))
    assert spark.read.json(str(tmp_path / "out/events")).count() == 100
