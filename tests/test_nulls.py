"""Nulls, repeated rows and ties in operators over series, groups and scores, against plain Python."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from telemill.operators import aggregates, evaluation, graphs, history
from telemill.operators.numbering import asof, numbered, reach_means, reach_sums, rolling, rolling_mean, rolling_range, running


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(0, 300, 3)]), i % 40, rnd.choice([None, 1, 2, 5]), rnd.random() < 0.7) for i in range(300)]
    rows += rows[:20]
    return spark.createDataFrame(rows, "k string, t long, id long, x long, ok boolean").withColumn("row", F.monotonically_increasing_id()).cache()


def same(got, want, columns):
    key = lambda r: tuple(repr(r[c]) for c in columns)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


@pytest.mark.parametrize("step", [7, 1000])
def test_running_values_equal_plain_windows(series, step):
    order = Window.partitionBy("k").orderBy("t", "id", "row")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    values = {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}
    plain = {"s": F.sum("x"), "m": F.max("x"), "l": F.last("x", True)}
    for exclusive, frame in ((False, upto), (True, before)):
        got = running(series, ("k",), ("t", "id", "row"), values, step, exclusive)
        same(got, series.withColumns({n: c.over(frame) for n, c in plain.items()}), ["row", *plain])


@pytest.mark.parametrize("step", [7, 1000])
def test_streaks(series, step):
    got = {r.row: r.n for r in running(series, ("k",), ("t", "id", "row"), {"n": ("streak", F.col("ok"))}, step).collect()}
    held = {}
    for r in sorted(series.collect(), key=lambda r: (r.t is not None, r.t or 0, r.id, r.row)):
        held[r.k] = held.get(r.k, 0) + 1 if r.ok else 0
        assert got[r.row] == held[r.k]


def test_numbers_and_moving_frames_keep_every_row(series):
    order = Window.partitionBy("k").orderBy("t", "id", "row")
    same(numbered(series, "t", "n", ("k",), ("id", "row"), rows=9), series.withColumn("n", F.row_number().over(order) - 1), ["row", "n"])
    same(numbered(series, "t", "n", (), ("id", "row"), rows=9), series.withColumn("n", F.row_number().over(Window.orderBy("t", "id", "row")) - 1), ["row", "n"])
    want = series.withColumn("s", F.sum("x").over(order.rowsBetween(-4, 0)))
    same(rolling(series, "t", 5, {"s": F.sum("x")}, ("k",), ("id", "row"), block=11), want, ["row", "s"])
    odd = F.when(F.col("row") % 50 == 7, float("inf")).when(F.col("row") % 60 == 9, float("nan")).when(F.col("row") % 70 == 3, float("-inf")).otherwise(F.col("x").cast("double"))
    mixed, order = series.withColumn("y", odd), Window.partitionBy("k").orderBy("t", "id", "row")
    for n, block in ((1, 11), (5, 11), (25, 11), (25, 1000)):
        frame = order.rowsBetween(1 - n, 0)
        want = mixed.select("row", F.avg("x").over(frame).alias("m"), F.avg("y").over(frame).alias("o"))
        same(rolling_mean(mixed, "t", n, {"m": "x", "o": "y"}, ("k",), ("id", "row"), block=block), want, ["row", "m", "o"])
    span = Window.partitionBy("k").orderBy("t").rangeBetween(-20, 0)
    same(rolling_range(series, "t", 20, {"n": F.count("*")}, ("k",), block=15), series.withColumn("n", F.count("*").over(span)), ["row", "n"])


def test_asof_keeps_every_probe(spark):
    probes = spark.createDataFrame([("a", 5, 1), (None, 5, 2), ("a", None, 3), ("b", 5, 4), ("a", 5, 1)], "k string, at long, id long")
    facts = spark.createDataFrame([("a", 5, "x"), ("a", None, "no"), (None, 4, "no"), ("b", 6, "late")], "k string, t long, v string")
    got = sorted((r.id, r.v) for r in asof(probes, facts, "k", "at", "t", {"v": "v"}, 3).collect())
    assert got == [(1, "x"), (1, "x"), (2, None), (3, None), (4, None)]


EXEC = "exec_id long, task_type string, worker_id string, dispatched_ms long, wait_ms long, exec_ms long, status string, queue_len long"


def test_labels_and_prior_statistics_with_nulls_and_repeats(spark):
    rows = [(1, "A", "w", 100, 0, 10, "COMPLETED", 0), (2, "A", "w", 200, 0, 30, "COMPLETED", 0), (2, "A", "w", 200, 0, 30, "COMPLETED", 0), (None, "A", None, 300, 0, 5, "COMPLETED", 0),
            (3, None, "w", 300, 0, 5, "COMPLETED", 0), (4, None, "w", 900, 0, 5, "COMPLETED", 0), (5, "A", "w", None, 0, 5, "COMPLETED", 0), (6, "A", "w", 400, None, 7, "FAILED", 0)]
    df = spark.createDataFrame(rows, EXEC)
    prior = sorted((r.exec_id or 0, r.prior_count, r.prior_mean_ms) for r in history.prior_stats(df, 50).collect())
    assert prior == [(0, 0, None), (1, 0, None), (2, 1, 10.0), (2, 1, 10.0), (3, 0, None), (4, 0, None), (5, 0, None), (6, 3, round(70 / 3, 6))]
    samples = spark.createDataFrame([("w", 150, 99.0, 0, 1), ("w", None, 99.0, 0, 2), (None, 310, 99.0, 0, 3), ("w", 450, 1.0, 0, 4)], "worker_id string, ts_ms long, cpu_pct double, queue_len long, sample_id long")
    workers = spark.createDataFrame([("w", 4)], "worker_id string, pool_size int")
    over = sorted(((r.exec_id or 0, r.overloaded_future) for r in history.label_overload_future(df, samples, workers, 100, 85.0, 1.0, 50).collect()), key=repr)
    assert over == [(0, None), (1, True), (2, None), (2, None), (3, None), (4, None), (5, None), (6, False)]
    future = sorted(((r.exec_id or 0, r.queue_len_future) for r in history.label_queue_future(df, samples, 100, 60, 50).collect()), key=repr)
    assert future == [(0, None), (1, 0), (2, None), (2, None), (3, None), (4, None), (5, None), (6, 0)]


def test_tagged_executions_stay_repeated(spark):
    runs = spark.createDataFrame([("r1", "t-", "9", 1), ("r2", "t-1", "9", 2), ("r3", "", "z", 3), ("r4", None, "9", 9)], "run string, prefix string, suffix string, run_order int")
    ids = spark.createDataFrame([("t-19", 1), ("t-19", 1), ("t-29", 2), ("none", 3), (None, 4), ("z", 5), ("t-1", 6), ("9", 7)], "task_id string, n int")
    got = sorted((r.n, r.run) for r in history.tag_runs(ids, runs).collect())
    assert got == [(1, "r2"), (1, "r2"), (2, "r1"), (5, "r3")]
    assert history.tag_runs(ids, runs.limit(0)).count() == 0


def test_nearest_samples_against_all_pairs(spark):
    rnd = random.Random(13)
    held = [(i, rnd.choice(["A", "B", None]), rnd.choice([None, *[rnd.randrange(400) for _ in range(6)], 50, 50])) for i in range(300)]
    asked = [(i, rnd.choice(["A", "B", "C", None]), rnd.choice([None, 0, 50, rnd.randrange(500)])) for i in range(60)]
    got = history.nearest_samples(spark.createDataFrame(asked, "query_id long, task_type string, input_size long"), spark.createDataFrame(held, "exec_id long, task_type string, input_size long"), 7)
    want = []
    for q, kind, size in asked:
        near = sorted((round(abs(math.log1p(s) - math.log1p(size)), 9), s, i) for i, t, s in held if None not in (kind, size, s) and t == kind)
        want += [(q, n + 1, i) for n, (_, _, i) in enumerate(near[:7])]
    assert sorted((r.query_id, r["rank"], r.near_id) for r in got.collect()) == sorted(want)


def test_null_groups_are_their_own(spark):
    df = spark.createDataFrame([(1, None, "w", 0, 0, 10, "COMPLETED", 0), (2, "A", None, 0, 0, 20, "COMPLETED", 0)], EXEC)
    got = {(r.kind, r.key): r.n for r in aggregates.exec_stats(df).collect()}
    assert got == {("type", None): 1, ("type", "A"): 1, ("worker", "w"): 1, ("worker", None): 1}
    tasks = spark.createDataFrame([(None, "COMPLETED", 1, 2), ("s", "FAILED", 1, 2)], "strategy string, status string, completed_ms long, deadline_ms long")
    assert sorted((str(r.strategy), r.on_time, r.late) for r in aggregates.sla_report(tasks).collect()) == [("None", 1, 0), ("all", 1, 1), ("s", 0, 1)]
    replay = spark.createDataFrame([(None, "COMPLETED", 4), ("A", None, 6)], "task_type string, status string, exec_ms long")
    assert sorted((str(r.task_type), r.completed, r.not_completed) for r in aggregates.replay_summary(replay).collect()) == [("A", 0, 1), ("None", 1, 0), ("all", 1, 1)]


def test_cut_offs_are_scores(spark):
    rnd = random.Random(6)
    one = spark.createDataFrame([(1, 0.1234567), (0, 0.1), (0, None), (None, 0.9)], "label int, score double")
    best = evaluation.best_f1_threshold(one).collect()[0]
    assert (best.threshold, best.f1) == (0.1234567, 1.0)
    rows = [(int(rnd.random() < 0.4), rnd.choice([rnd.gauss(0, 3), 0.5, -0.5, 1e-9 * rnd.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, score double")
    f1 = lambda t: round(2 * sum(y for y, s in rows if s >= t) / (sum(s >= t for _, s in rows) + sum(y for y, _ in rows)), 9)
    want = max(sorted({s for _, s in rows}), key=f1)
    got = evaluation.best_f1_threshold(df).collect()[0]
    assert (got.threshold, got.f1) == (want, round(f1(want), 6))
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(evaluation.classification_metrics(df, 0.5).collect()[0].auc - auc) < 1e-6


def test_graph_loops_fail_at_their_bound(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    assert {r.node: r.hops for r in graphs.bfs(chain, 0).collect()} == {i: i for i in range(9)}
    with pytest.raises(RuntimeError):
        graphs.bfs(chain, 0, max_rounds=4)
    tasks = spark.createDataFrame([(1, i, i - 1 if i else None, "BLOCKED" if i else "FAILED") for i in range(6)] + [(2, 1, 1, "BLOCKED")], "workflow_id long, node long, parent long, status string")
    assert {(r.workflow_id, r.node): r.level for r in graphs.dag_levels(tasks).collect()} == {**{(1, i): i for i in range(6)}, (2, 1): None}
    assert sorted(r.node for r in graphs.dag_cancel(tasks).collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(RuntimeError):
        graphs.dag_levels(tasks, max_rounds=3, most=0)
    with pytest.raises(RuntimeError):
        graphs.dag_cancel(tasks, max_rounds=3, most=0)


def test_references_to_tasks_that_are_no_parents(spark):
    rows = [(1, 1, None, []), (1, 2, 1, [1]), (1, 3, 1, [1, 2]), (1, 4, None, None)]
    tasks = spark.createDataFrame(rows, "workflow_id long, node long, parent long, refs array<long>")
    assert [(r.node, r.problem) for r in graphs.dag_validate(tasks).collect()] == [(3, "reference to a non-parent")]


def test_streams_of_ticks_and_silences_against_plain_python(spark):
    from telemill.streaming import streams

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.02 else rng.randrange(0, 400), i) for i in range(1500)]
    rows += [("hot", 5, i) for i in range(2000, 4000)]
    df = spark.createDataFrame(rows, "k string, t long, seq long").repartition(4)
    got = streams.run_to_files(streams.throttle(streams.replay_source(df, "t", 4, "ticks", ties=("seq",)), "k", "t", "seq", 10, 3, 20), "ticks-out").collect()
    ticks = {}
    for k, t, s in rows:
        if t is not None:
            ticks.setdefault((k, t // 10), []).append((t, s))
    mark = max(t for _, t, _ in rows if t is not None) - 20
    want = {(k, b, t, s, max(0, len(v) - 3)) for (k, b), v in ticks.items() if (b + 1) * 10 < mark for t, s in sorted(v)[-3:]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want

    beats = [(w, t) for w in ("x", "y", None) for t in sorted(rng.sample(range(3000), 60))] + [("gone", 40), ("gone", 40), ("x", None)]
    df = spark.createDataFrame(beats, "w string, t long").repartition(3)
    got = streams.run_to_files(streams.dead_workers(streams.replay_source(df, "t", 6, "beats"), "w", "t", 20, 3, 30), "beats-out").collect()
    mark, want = max(t for _, t in beats if t is not None) - 30, set()
    for w in {w for w, _ in beats}:
        own = sorted({t for v, t in beats if v == w and t is not None})
        want |= {(w, a) for a, b in zip(own, own[1:], strict=False) if b - a >= 60} | ({(w, own[-1])} if own[-1] + 60 < mark else set())
    assert len(got) == len(want) and {tuple(r) for r in got} == want and ("gone", 40) in want


def test_sums_within_reach_keep_every_row(series):
    odd = F.when(F.col("row") % 50 == 7, float("inf")).when(F.col("row") % 60 == 9, float("nan")).when(F.col("row") % 70 == 3, float("-inf")).otherwise(F.col("x").cast("double"))
    mixed, span = series.withColumn("y", odd), Window.partitionBy("k").orderBy("t").rangeBetween(-20, 0)
    want = mixed.select("row", F.avg("x").over(span).alias("m"), F.avg("y").over(span).alias("o"), F.count("*").over(span).alias("points"))
    for plain in (0, 1000):
        same(reach_means(mixed, "t", 20, {"m": "x", "o": "y"}, ("k",), plain=plain), want, ["row", "m", "o", "points"])
    for by in ((), ("k",)):
        span = Window.partitionBy(*by).orderBy("t").rangeBetween(-20, 0)
        same(reach_sums(series, "t", 20, {"n": F.lit(1).cast("long")}, by, rows=9), series.withColumn("n", F.count("*").over(span)), ["row", "n"])


def test_rows_within_reach_are_not_walked_for_each_row(spark):
    dense = spark.range(200_000).select("id", (F.col("id") % 1000).alias("t"))  # every row has 200,000 in reach
    got = reach_sums(dense, "t", 1000, {"n": F.lit(1).cast("long")})
    assert got.agg(F.min(F.col("n") == 200 * (F.col("t") + 1))).collect()[0][0]
