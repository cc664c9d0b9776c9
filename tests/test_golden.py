"""Golden values and properties of the telemetry operators."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from telemill.functions import scalars
from telemill.operators import aggregates, evaluation, experiments, graphs, history, placement
from telemill.operators.numbering import asof, numbered, rolling, rolling_range, running

T0 = 1_790_000_000_000


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


EXEC = "exec_id long, task_type string, worker_id string, dispatched_ms long, wait_ms long, exec_ms long, status string, queue_len long"


@pytest.fixture(scope="module")
def executions(spark):
    types = ["CPU_TASK", "SORT_TASK", "HASH_TASK", "SLEEP_TASK"]
    rows = [(i, types[i % 4], f"worker-{i % 3 + 1}", T0 + 1500 * i, i + 1, 30 + 15 * i, "FAILED" if i == 19 else "COMPLETED", i % 5) for i in range(20)]
    return frame(spark, rows, EXEC).cache()


def test_exec_stats_counts_completed_rows_twice(executions):
    got = aggregates.exec_stats(executions).collect()
    for kind in ("type", "worker"):
        assert sum(r.n for r in got if r.kind == kind) == 19
    assert next(r for r in got if r.key == "CPU_TASK").mean_ms == sum(30 + 15 * i for i in (0, 4, 8, 12, 16)) / 5


def test_every_row_is_in_two_windows(executions):
    rates = history.worker_windows(executions, 10_000, 5_000).agg(F.sum("arrival_rate")).collect()[0][0]
    assert round(rates * 10) == 40


SAMPLE = "sample_id long, worker_id string, ts_ms long, cpu_pct double, queue_len long"


def samples(spark):
    one = [(s, "worker-1", T0 + 1000 * s, 90.0 if s == 13 else 20.0, 0 if s < 6 else 2 if s <= 8 else 1) for s in range(16)]
    return frame(spark, one + [(100 + s, "worker-2", T0 + 1000 * s, 10.0, 0) for s in range(4)], SAMPLE)


DISPATCHES = [("worker-1", 0.5, 0, False), ("worker-1", 2.0, 2, True), ("worker-1", 3.5, 2, True), ("worker-1", 8.5, 1, True), ("worker-1", 9.0, 1, True), ("worker-2", 0.0, 0, False), ("worker-2", 2.5, None, False), ("worker-3", 1.0, None, None)]


@pytest.mark.parametrize("step", [1000, 3000, 10**9])
def test_future_labels(spark, step):
    rows = [(i, w, T0 + int(1000 * at)) for i, (w, at, _, _) in enumerate(DISPATCHES)]
    probes = frame(spark, rows, "exec_id long, worker_id string, dispatched_ms long")
    workers = frame(spark, [("worker-1", 2), ("worker-2", 4)], "worker_id string, pool_size long")
    queue = {r.exec_id: r.queue_len_future for r in history.label_queue_future(probes, samples(spark), 5000, 2000, step).collect()}
    over = {r.exec_id: r.overloaded_future for r in history.label_overload_future(probes, samples(spark), workers, 5000, 85.0, 1.0, step).collect()}
    assert [queue[i] for i in range(8)] == [q for _, _, q, _ in DISPATCHES]
    assert [over[i] for i in range(8)] == [o for _, _, _, o in DISPATCHES]


@pytest.mark.parametrize("step", [700, 10**9])
def test_prior_statistics(spark, step):
    rows = [(i, "CPU_TASK", "worker-1", T0 + 1000 * i, 0, ms, status, 0) for i, (ms, status) in enumerate([(500, "COMPLETED"), (4000, "COMPLETED"), (100, "FAILED"), (200, "COMPLETED")])]
    got = {r.exec_id: r for r in history.prior_stats(frame(spark, rows, EXEC), step).collect()}
    assert [got[i].prior_count for i in range(4)] == [0, 1, 1, 1]
    assert [got[i].prior_mean_ms for i in range(4)] == [None, 500.0, 500.0, 500.0]
    assert got[3].prior_stats_ms == T0 + 500


def test_features_never_look_ahead(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("AB"), rnd.choice("xy"), T0 + rnd.randrange(60_000), rnd.randrange(50), rnd.randrange(1, 5000), rnd.choice(["COMPLETED", "FAILED"]), rnd.randrange(4)) for i in range(200)]
    df = frame(spark, rows, EXEC)
    joined = history.asof_window(history.prior_stats(df, 5000), history.worker_windows(df, 10_000, 5_000), 7000).collect()
    assert len(joined) == 200
    for r in joined:
        done = [x for x in rows if x[1] == r.task_type and x[2] == r.worker_id and x[6] == "COMPLETED" and x[3] + x[4] + x[5] <= r.dispatched_ms]
        assert r.prior_count == len(done) and (not done or r.prior_stats_ms == max(x[3] + x[4] + x[5] for x in done))
        assert r.win_end_ms is None or 0 <= r.dispatched_ms - r.win_end_ms


def test_ranges_equal_plain_windows(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice("ab"), rnd.randrange(300), rnd.randrange(9)) for i in range(500)]
    df = frame(spark, rows, "id long, k string, t long, v long")
    for by in ((), ("k",)):
        group = lambda r, by=by: r[1] if by else 0
        ordered = sorted(rows, key=lambda r: (r[2], r[0]))
        at = {r.id: r for r in numbered(df, "t", "at", by, ("id",), 7).collect()}
        mean = {r.id: r.s for r in rolling(df, "t", 13, {"s": F.sum("v")}, by, ("id",), 20).collect()}
        total = {r.id: r.s for r in running(df, by, ("t", "id"), {"s": ("sum", F.col("v"))}, 11).collect()}
        reach = {r.id: r.n for r in rolling_range(df, "t", 10, {"n": F.count("*")}, by, 4).collect()}
        for g in {group(r) for r in rows}:
            own = [r for r in ordered if group(r) == g]
            for i, r in enumerate(own):
                assert at[r[0]].at == i
                assert mean[r[0]] == sum(x[3] for x in own[max(0, i - 12) : i + 1])
                assert total[r[0]] == sum(x[3] for x in own[: i + 1])
                assert reach[r[0]] == sum(r[2] - 10 <= x[2] <= r[2] for x in own)


def test_asof_takes_equal_times_and_the_larger_tie(spark):
    facts = frame(spark, [("a", 5, 1, "x"), ("a", 5, 2, "y"), ("a", 9, 1, "z"), ("b", 1, 1, "w")], "k string, t long, tie long, v string")
    probes = frame(spark, [(1, "a", 4), (2, "a", 5), (3, "a", 100), (4, "c", 3)], "id long, k string, t long")
    got = {r.id: r.v for r in asof(probes, facts, "k", "t", "t", {"v": "v"}, 3, "tie").collect()}
    assert got == {1: None, 2: "y", 3: "z", 4: None}


REPLAY = "run_id string, task_no long, submit_ms long, start_ms long, end_ms long, latency_ms long, status string, worker string, exec_ms long"
RUN = [(0, 1000, 1000, 1500, 500, "COMPLETED", "worker-1", 500), (1, 1100, 1100, 1200, 100, "COMPLETED", "worker-1", 100), (2, 1200, 1300, 1400, 200, "COMPLETED", "worker-2", 100), (3, 1300, 1400, 1600, 300, "COMPLETED", "worker-2", 200), (4, 1400, 1500, 3900, 2500, "COMPLETED", "worker-2", 2400), (5, 1500, None, 2000, 500, "FAILED", "worker-1", 0)]


def test_run_metrics(spark):
    run = frame(spark, [("r", *x) for x in RUN], REPLAY)
    latency = aggregates.run_latency(run).collect()[0]
    assert (latency.mean_ms, latency.p95_ms, latency.p99_ms) == (775, 2500, 2500)
    through = aggregates.run_throughput(run).collect()[0]
    assert through.makespan_ms == 2900 and abs(through.throughput - 5000 / 2900) < 1e-8
    workers = frame(spark, [(f"worker-{i}",) for i in (1, 2, 3)], "worker_id string")
    assert abs(aggregates.run_imbalance(run, workers).collect()[0].imbalance - math.sqrt(14 / 9)) < 1e-6
    assert abs(aggregates.run_sla(run, 2000).collect()[0].violations_pct - 100 * 2 / 6) < 1e-6
    assert aggregates.run_max_queue(run).collect()[0].max_queue == 1


def test_queue_sweep(spark):
    waits = [("r", i, a, b, b, 0, "COMPLETED", "w", 0) for i, (a, b) in enumerate([(0, 30), (10, 50), (20, 30), (30, 35)])]
    assert aggregates.run_max_queue(frame(spark, waits, REPLAY)).collect()[0].max_queue == 3


def stats(spark, a, b):
    mean = lambda x: sum(x) / len(x)
    std = lambda x: math.sqrt(sum((v - mean(x)) ** 2 for v in x) / (len(x) - 1)) if len(x) > 1 else None
    df = frame(spark, [("s", "m", "x", mean(b), std(b), len(b), mean(a), std(a), len(a), 0.0)], "scenario string, metric string, baseline string, base_mean double, base_std double, base_n long, arm_mean double, arm_std double, arm_n long, diff_pct double")
    return experiments.compare_arms(df).collect()[0]


def test_welch_and_cohen(spark):
    assert abs(stats(spark, [1, 2, 3, 4, 5], [2, 4, 6, 8, 10]).p - 0.10753119493062718) < 1e-9
    r = stats(spark, [101.2, 98.7, 105.1, 99.9, 102.3], [95.1, 97.3, 94.8, 96.0, 98.2])
    assert abs(r.p - 0.005712675617121665) < 1e-9 and abs(r.d - 2.5616538096112342) < 1e-9
    assert stats(spark, [3, 3], [3, 3]).p == 1 and stats(spark, [1], [2, 3]).p is None


def test_best_baseline_and_headlines(spark):
    runs = [("s", arm, i, x, t) for arm, xs, t in (("round_robin", (200, 210, 190), 20.0), ("least_loaded", (150, 160, 140), 10.0), ("predictive", (120, 125, 115), 10.0)) for i, x in enumerate(xs)]
    df = frame(spark, runs, "scenario string, strategy string, rep long, latency_ms long, throughput double")
    compared = experiments.compare_arms(experiments.best_baseline(aggregates.suite_summary(df, ["latency_ms", "throughput"])))
    best = {r.metric: r for r in compared.collect()}
    assert best["latency_ms"].baseline == "least_loaded" and best["latency_ms"].diff_pct == -20 and best["latency_ms"].p < 0.05
    assert best["throughput"].baseline == "round_robin"
    assert {r.metric: r.verdict for r in experiments.headlines(compared, ["latency_ms"]).collect()} == {"latency_ms": "better"}


def test_sla_report(spark):
    rows = [(["round_robin", "least_loaded"][i % 2], "COMPLETED", 100, 50 if i < 4 else 1000) for i in range(10)] + [("round_robin", "RUNNING", None, 1000)]
    got = {r.strategy: r for r in aggregates.sla_report(frame(spark, rows, "strategy string, status string, completed_ms long, deadline_ms long")).collect()}
    assert [(got[s].on_time, got[s].late) for s in ("round_robin", "least_loaded")] == [(3, 2), (3, 2)]
    assert (got["all"].on_time_pct, got["all"].open) == (60, 1)


def test_predictive_placement(spark):
    schema = "task_id string, worker_id string, pool_size long, active long, queue_len long, avg_exec_ms double, pred_exec_ms double, overload_prob double, priority long"
    rows = [("t", "w1", 2, 2, 2, 100.0, 40.0, 0.5, 5), ("t", "w2", 4, 1, 1, 50.0, 60.0, 0.1, 5), ("t", "w3", 8, 0, 0, 0.0, 90.0, 0.0, 5)]
    assert placement.predictive(frame(spark, rows, schema)).collect()[0][:3] == ("t", "w2", 79.75)
    gone = placement.predictive(frame(spark, [*rows[:2], (*rows[2][:6], None, 0.0, 5)], schema)).collect()[0]
    assert (gone.worker_id, gone.fallback) == ("w3", "no prediction")
    risky = [("t", "w1", 1, 0, 0, 0.0, 1.0, 0.6, 9), ("t", "w2", 1, 0, 0, 0.0, 500.0, 0.4, 9)]
    assert placement.predictive(frame(spark, risky, schema)).collect()[0].worker_id == "w2"


def test_drift_episodes(spark):
    series = [20, 20, 20, 20, 20, 12, 12, 30, 30, 30, 30, 5, 30, 30]
    df = frame(spark, [("s", i, i, float(x), 10.0) for i, x in enumerate(series)], "series string, t long, id long, mae double, baseline double")
    for step in (2, 100):
        assert sorted(r.id for r in history.drift_episodes(df, 1.5, 3, step).collect()) == [2, 9]


def test_scalars(spark):
    df = frame(spark, [(a,) for a in (1, 2, 3, 4, 5, 6, 20)], "a int")
    assert [r[0] for r in df.select(scalars.retry_delay(F.col("a"), 200, 5000)).collect()] == [200, 400, 800, 1600, 3200, 5000, 5000]
    limits = frame(spark, [(100.0, 150.0), (100.0, 300.0), (None, 150.0), (100.0, None), (None, None)], "p double, q double")
    assert [r[0] for r in limits.select(scalars.straggler_limit(F.col("p"), F.col("q"), 2.0)).collect()] == [200, 300, 150, 200, None]
    texts = ["n=5,", "n=5,,x=1", "a=1, a=2", "q=a=b", "=1", "x=", None, "1a=2"]
    got = frame(spark, [(t,) for t in texts], "t string").select(scalars.kv_parse(F.col("t")).alias("k")).select("k.*").collect()
    assert [r.valid for r in got] == [True, False, True, True, False, False, False, False]
    assert [r.pairs for r in got[:4]] == [{"n": "5"}, None, {"a": "2"}, {"q": "a=b"}]
    refs = frame(spark, [("${a.result}-${b.result}", {"a": "1"})], "t string, m map<string,string>").select(scalars.resolve_refs(F.col("t"), F.col("m"))).collect()[0][0]
    assert refs == "1-"


def test_inputs_are_checked_by_type(spark):
    cases = [
        ("CPU_TASK", "n=5,", []), ("CPU_TASK", "n=1", ["n: out of range"]), ("CPU_TASK", "m=1", ["n: missing"]), ("CPU_TASK", "n=x", ["n: not a number"]), ("CPU_TASK", "n", ["input: not key=value"]),
        ("SLEEP_TASK", "ms=5, failRate=1.5", ["failRate: out of range"]), ("MATRIX_TASK", "size=3, mode=gpu, threads=99", ["threads: out of range", "mode: not a choice"]),
        ("HTTP_TASK", "url=ftp://abc.de, timeout=3", ["url: no URL"]), ("MAPREDUCE_TASK", "dataset=d", ["job: missing"]), ("IMAGE_TASK", "a=1", []),
    ]
    df = frame(spark, [(t, x) for t, x, _ in cases], "t string, x string")
    got = df.select(scalars.input_problems(F.col("t"), scalars.kv_parse(F.col("x")))).collect()
    assert [r[0] for r in got] == [p for _, _, p in cases]
    one = frame(spark, [(" ", "NONE", None, 11)], "i string, t string, x string, p int")
    found = one.select(scalars.task_problems(F.col("i"), F.col("t"), F.col("x"), F.col("p"), F.lit(1), scalars.kv_parse(F.col("x")))).collect()[0][0]
    assert found == ["task_id: empty", "type: not supported", "input: empty", "priority: not 1 to 10"]


def test_input_sizes_may_have_a_sign(spark):
    cases = [("n=-3, algo=dfs", -3), ("n=+7", 7), ("n=12", 12), ("n=9223372036854775807", 2**63 - 1), ("n=9223372036854775808", 21), ("n=abc", 5), ("broken", 6), (None, 0)]
    df = frame(spark, [("CPU_TASK", x) for x, _ in cases], "t string, x string")
    got = df.select(scalars.input_size(F.col("t"), scalars.kv_parse(F.col("x"))["pairs"], F.col("x"))).collect()
    assert [r[0] for r in got] == [n for _, n in cases]


def test_equal_parameters_share_a_cache_key(spark):
    df = frame(spark, [("n=5, seed=1",), ("seed=1,n=5",), ("seed=2,n=5",)], "x string")
    a, b, c = (r[0] for r in df.select(scalars.cache_key(F.lit("CPU_TASK"), scalars.kv_parse(F.col("x"))["pairs"], F.col("x"))).collect())
    assert a == b != c


def test_model_inputs(spark):
    df = frame(spark, [("SORT_TASK", 99.0, 6, 3, float("nan"), 8.0, 2), ("ODD", None, None, 0, None, None, None)], "task_type string, input_size double, queue_len int, worker_pool_size int, cpu_pct double, prior_type_worker_mean_ms double, prior_type_worker_count int")
    made = scalars.feature_columns(df.columns)
    assert len(made) == 51
    one, two = df.select(*[v.alias(k) for k, v in made.items()]).collect()
    assert (one.type_SORT_TASK, one.profile_MEMORY_BOUND, one.queue_ratio, one.cpu_pct, one.has_prior, one.priority) == (1, 1, 2, 0, 1, 5)
    assert abs(one.log_size_x_SORT_TASK - math.log(100)) < 1e-12 and abs(one.log_prior_mean_ms - math.log(9)) < 1e-12
    assert (two.has_prior, two.log_size, two.queue_ratio, sum(two[f"type_{t}"] for t in ("CPU_TASK", "SORT_TASK"))) == (0, 0, 0, 0)


def test_checksums(spark, tmp_path):
    from telemill.sources import files

    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text(name)
    import hashlib

    manifest = frame(spark, [("a.jsonl", hashlib.sha256(b"a.jsonl").hexdigest()), ("b.jsonl", "0"), ("c.jsonl", "0")], "file string, expected string")
    assert {r.file: r.ok for r in files.trace_checksum(spark, str(tmp_path), manifest).collect()} == {"a.jsonl": True, "b.jsonl": False, "c.jsonl": False}


def test_shadow_and_promotion(spark):
    pair = "array<struct<worker_id:string,pred:double>>"
    log = frame(spark, [(0, "a", [("w1", 100.0), ("w2", 50.0)], [("w1", 90.0), ("w2", 70.0)]), (1, "b", [("w1", 10.0)], [("w1", 30.0)]), (2, "c", [("w1", 5.0)], None), (3, "b", [("w1", 99.0)], [("w1", 99.0)])], f"at long, task_id string, live {pair}, shadow {pair}")
    actual = frame(spark, [("a", "w2", 60.0), ("b", "w1", 20.0), ("c", "w1", 5.0)], "task_id string, worker_id string, actual double")
    r = evaluation.shadow_compare(evaluation.shadow_pairs(log, actual)).collect()[0]
    assert (r.n, r.live_mae, r.shadow_mae) == (2, 10, 10)
    cases = frame(spark, [(150, 30.0, 10.0), (500, 30.0, 29.0), (0, None, None), (500, 30.0, 25.0)], "n long, live_mae double, shadow_mae double")
    assert [x.allowed for x in evaluation.promotion_gate(cases, 0.05, 200).collect()] == [False, False, False, True]


def test_cold_start(spark):
    schema = "seen boolean, model_ms double, type_mean double, prior_mean double, prior_count long, global_mean double"
    rows = [(False, 1.0, None, None, 0, 123.0), (False, 1.0, None, 40.0, 4, 123.0), (False, 1.0, None, 55.0, 0, 123.0), (False, 1.0, 70.0, None, 0, 123.0), (True, 9.0, 70.0, None, 0, 123.0)]
    assert [r.pred_ms for r in evaluation.cold_start(frame(spark, rows, schema)).collect()] == [123, 40, 123, 70, 9]


@pytest.mark.parametrize(("score", "lower", "chosen"), [(8.9, True, "m"), (9.5, True, "b"), (0.55, False, "m"), (0.52, False, "b")])
def test_margin_rule(spark, score, lower, chosen):
    base = 10.0 if lower else 0.5
    df = frame(spark, [("b", "baseline", 0, base), ("m", "model", 1, score)], "name string, kind string, order int, score double")
    assert evaluation.select_model(df, 0.1, lower).collect()[0].chosen == chosen


def test_time_split_is_disjoint_and_half_to_even(spark):
    rows = [(i, i, "x" if i < 3 else "y" if i < 5 else "z") for i in range(20)]
    got = evaluation.time_split(frame(spark, rows, "id long, t long, k string"), "t", "id", F.col("k") == "x", F.col("k").isin("x", "y")).collect()
    count = {s: sum(r.split == s for r in got) for s in ("holdout_type", "holdout_pattern", "train", "test")}
    assert len({r.id for r in got}) == len(got) == 20 and count == {"holdout_type": 3, "holdout_pattern": 2, "train": 12, "test": 3}


def test_graphs(spark):
    edges = frame(spark, [(0, 1), (1, 2), (2, 0), (3, 0)], "src long, dst long")
    assert {r.node: r.hops for r in graphs.bfs(edges, 0).collect()} == {0: 0, 1: 1, 2: 2}
    ranks = {r.node: r["rank"] for r in graphs.pagerank(edges, 5, every=2).collect()}
    want = {n: 0.25 for n in range(4)}
    for _ in range(5):
        want = {n: 0.15 / 4 + 0.85 * sum(want[s] for s, d in [(0, 1), (1, 2), (2, 0), (3, 0)] if d == n) for n in want}
    assert all(abs(ranks[n] - want[n]) < 1e-12 for n in want)
    dag = frame(spark, [("w", 0, None, "FAILED"), ("w", 1, 0, "BLOCKED"), ("w", 2, 1, "BLOCKED"), ("w", 3, None, "COMPLETED"), ("w", 4, 3, "BLOCKED"), ("v", 0, 1, "BLOCKED"), ("v", 1, 0, "BLOCKED")], "workflow_id string, node long, parent long, status string")
    assert {(r.workflow_id, r.node): r.level for r in graphs.dag_levels(dag).collect()} == {("w", 0): 0, ("w", 1): 1, ("w", 2): 2, ("w", 3): 0, ("w", 4): 1, ("v", 0): None, ("v", 1): None}
    assert {(r.workflow_id, r.node) for r in graphs.dag_cancel(dag).collect()} == {("w", 1), ("w", 2)}
    assert {(r.workflow_id, r.node) for r in graphs.dag_ready(dag).collect()} == {("w", 4)}
    built = graphs.edge_build(spark.range(5).withColumnRenamed("id", "src"), 5, 1).collect()
    assert len(built) == 15 and all(0 <= r.dst < 5 for r in built)


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def registry_query(name):
    from telemill.plans import catalog, registry  # noqa: F401

    return registry.QUERIES[name]


def test_first_rows_of_a_hot_key_without_collecting(spark):
    rows = [("hot", i % 7, i) for i in range(3000)] + [(None, 5, 9000), ("one", None, 9001), ("one", 1, 9002)]
    df = spark.createDataFrame(rows, "k string, t int, seq long").repartition(5)
    got = sorted((r.k or "", r.seq) for r in history.first_rows(df, ("k",), (F.desc("t"), F.desc("seq")), 2).collect())
    assert got == [("", 9000), ("hot", 2988), ("hot", 2995), ("one", 9001), ("one", 9002)]
    if os.path.isdir("/root/testdata/sf0.001"):
        assert "collect_list" not in planned(registry_query("stream_throttle")(spark, "/root/testdata/sf0.001"))


def test_traces_are_hashed_in_bounded_files(spark, monkeypatch):
    from telemill.plans import files

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no driver tables here")
    monkeypatch.setattr(files, "_TRACE_LINES", 40)
    check, lines = files.src.trace_checksum, []

    def seen(spark, path, manifest, key):
        lines.extend(len(bytes(r.content).splitlines()) for r in spark.read.format("binaryFile").load(path).collect())
        return check(spark, path, manifest, key)

    monkeypatch.setattr(files.src, "trace_checksum", seen)
    got = registry_query("trace_checksum")(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.ok and r.actual == r.expected for r in got)
    assert max(lines) <= 40 < sum(lines)


def test_nearest_samples_ranks_before_it_collects(spark):
    rows = [(i, "a", 10) for i in range(500)] + [(900, "a", 11), (None, "a", 10)]
    df = spark.createDataFrame(rows, "exec_id long, task_type string, input_size long")
    asked = spark.createDataFrame([(1, "a", 10)], "query_id long, task_type string, input_size long")
    out = history.nearest_samples(asked, df, 3)
    assert sorted((r["rank"], r.near_id) for r in out.collect()) == [(1, 0), (2, 1), (3, 2)]
    assert "row_number()" in planned(out)


def test_replay_bounds_rows_of_a_trigger(spark):
    from telemill.streaming import streams

    df = spark.createDataFrame([(i, 5 if i % 3 == 0 else 100_000 - i) for i in range(1000)], "exec_id long, ts_ms long").repartition(4)
    sizes, firsts = [], []

    def seen(batch, epoch):
        sizes.append(batch.count())
        firsts.append(tuple(batch.selectExpr("min(struct(ts_ms, exec_id)) a", "max(struct(ts_ms, exec_id)) b").collect()[0]))

    source = streams.replay_source(df, "ts_ms", 3, "bounded", ties=("exec_id",), file_rows=60, bounded=True)
    source.writeStream.foreachBatch(seen).trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 1000 and max(sizes) <= 60
    assert all(a[1] < b[0] for a, b in zip(firsts, firsts[1:], strict=False))


def test_bounded_triggers_take_several_files(spark):
    from telemill.streaming import streams

    df = spark.range(1000).select("id", (1000 - F.col("id")).alias("ts_ms")).repartition(4)
    sizes = []
    source = streams.replay_source(df, "ts_ms", 2, "bounded", ties=("id",), file_rows=20, bounded=True, trigger_rows=200)
    source.writeStream.foreachBatch(lambda batch, epoch: sizes.append(batch.count())).trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 1000 and max(sizes) <= 200 and len(sizes) <= 12
