"""Series and groups too large for one task: equal-depth ranges, selection, moving order statistics, sequential rules, loops."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from telemill.operators import aggregates, evaluation, graphs, numbering, selection
from telemill.streaming import sequential


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def series(spark):
    """Rows with null and hot keys, null, equal and outlying times, and null values."""
    rnd = random.Random(6)
    rows = []
    for i in range(600):
        t = rnd.choice([rnd.randrange(200), 77, 77, None if i % 40 == 0 else 5])
        rows.append((i, rnd.choice(["a", "a", "a", "b", None]), 4 * 10**12 if i == 9 else t, rnd.choice([None, rnd.randrange(-50, 50)]), rnd.random() < 0.7))
    return frame(spark, rows, "id long, k string, t long, x long, ok boolean").cache()


def test_an_outlier_leaves_ranges_even(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") == 7, 4 * 10**12).otherwise(F.col("id") % 5000).alias("t"), "id")
    for by in ((), ("k",)):
        keyed = rows.withColumn("k", F.when(F.col("id") % 100 < 90, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)))
        sizes = [r["count"] for r in numbering.ranges(keyed, ("t", "id"), by, rows=5000).groupBy("_b").count().collect()]
        assert len(sizes) >= 20 and max(sizes) <= 2 * 100_000 / len(sizes)
    got = numbering.numbered(rows, "t", "n", tie=("id",), rows=5000)
    want = rows.withColumn("n", (F.row_number().over(Window.orderBy("t", "id")) - 1).cast("long"))
    assert got.select("id", "n").exceptAll(want.select("id", "n")).isEmpty()


@pytest.mark.parametrize("by", [(), ("k",)])
def test_running_values_over_even_ranges(spark, series, by):
    order = Window.partitionBy(*by).orderBy("t", "id")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    kinds = {"s": ("sum", F.sum), "m": ("max", F.max), "l": ("last", lambda c: F.last(c, True))}
    for exclusive, over in ((False, upto), (True, before)):
        got = numbering.running(series, by, ("t", "id"), {n: (kind, F.col("x")) for n, (kind, _) in kinds.items()}, exclusive=exclusive, rows=37)
        want = series.withColumns({n: f("x").over(over) for n, (_, f) in kinds.items()})
        assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == 600
    breaks = series.withColumn("g", F.sum((~F.col("ok")).cast("int")).over(upto)).withColumn("n", F.sum(F.col("ok").cast("int")).over(Window.partitionBy(*by, "g").orderBy("t", "id")))
    got = numbering.running(series, by, ("t", "id"), {"n": ("streak", F.col("ok"))}, rows=37)
    assert {r.id: r.n for r in got.collect()} == {r.id: r.n for r in breaks.collect()}


def test_peaks(spark, series):
    got = {r.k: r.peak for r in numbering.peaks(series, ("k",), ("t", "id"), "x", rows=37).collect()}
    depth = F.sum("x").over(Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0))
    assert got == {r.k: r.p for r in series.withColumn("d", depth).groupBy("k").agg(F.max("d").alias("p")).collect()}
    rows = frame(spark, [("r", 0, 10, 90), ("r", 5, 10, 90), ("r", 10, None, None), ("s", 0, None, 0), ("q", 4, 9, 9)], "run_id string, submit_ms long, start_ms long, end_ms long")
    assert {r.run_id: r.max_queue for r in aggregates.run_max_queue(rows).collect()} == {"r": 2, "s": 0, "q": 1}


def test_latency_cdf(spark):
    rows = [("s", st, ms, "COMPLETED") for st, n in (("a", 40), ("b", 7), (None, 3)) for ms in range(n) for _ in range(1 + ms % 3)]
    got = {(r.strategy, r.latency_ms): r.share for r in aggregates.latency_cdf(frame(spark, rows, "scenario string, strategy string, latency_ms long, status string")).collect()}
    for st in ("a", "b", None):
        own = [r[2] for r in rows if r[1] == st]
        for ms in set(own):
            assert got[st, ms] == round(sum(x <= ms for x in own) / len(own), 9)


def test_roc_of_skewed_scores(spark):
    rnd = random.Random(3)
    rows = [(int(rnd.random() < 0.4), rnd.choice([rnd.random() / 1e9, rnd.random(), 0.5])) for _ in range(500)] + [(1, 1e12), (None, 0.4), (1, None)]
    df = frame(spark, rows, "label int, score double")
    known = [r for r in rows if None not in r]
    pos, neg = [s for y, s in known if y], [s for y, s in known if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(evaluation.classification_metrics(df, 0.5).collect()[0].auc - auc) < 1e-6
    for r in evaluation.roc_points(df).collect():
        assert (r.tp, r.fp) == (sum(p >= r.threshold for p in pos), sum(n >= r.threshold for n in neg))


WANTED = {"a": ("disc", 0.5), "b": ("disc", 0.95), "c": ("cont", 0.95), "d": ("cont", 0.25), "e": ("disc", 0.0), "f": ("disc", 1.0)}


def test_selected_percentiles_equal_built_in_ones(spark):
    rnd = random.Random(2)
    rows = [("normal", rnd.gauss(0, 1)) for _ in range(500)] + [("ties", float(rnd.randrange(4))) for _ in range(300)] + [("one", 5.0), (None, 1.5), (None, 2.5)]
    rows += [("outlier", x) for x in [1e300, -1e300, *(i / 7 for i in range(200))]] + [("odd", x) for x in [float("inf"), float("-inf"), float("nan"), *(float(i) for i in range(60))]]
    rows += [("large", float(2**53 - i)) for i in range(90)] + [("none", None), ("ties", None)]
    df = frame(spark, rows, "k string, x double")
    plain = [F.count("*").alias("n")]
    want = sorted(map(repr, selection.with_percentiles(df, ("k",), plain, "x", WANTED).collect()))
    for large in (0, 1, 100):
        assert sorted(map(repr, selection.with_percentiles(df, ("k",), plain, "x", WANTED, large=large).collect())) == want
    whole = selection.with_percentiles(df.where("k = 'normal'"), (), plain, "x", WANTED, large=1).collect()
    own = sorted(x for k, x in rows if k == "normal")
    assert len(whole) == 1 and whole[0].a == own[249] and whole[0].f == own[-1] and abs(whole[0].c - np.quantile(own, 0.95)) < 1e-12
    assert selection.with_percentiles(df.limit(0), (), plain, "x", WANTED).count() == 1 and selection.with_percentiles(df.limit(0), ("k",), plain, "x", WANTED).count() == 0


def test_selection_gives_a_row_for_a_cell_at_most(spark):
    df = spark.range(200_000).select(F.lit(1).alias("all"), ((F.col("id") * 7919) % 199_999).alias("x"))
    keyed = df.select(F.struct("all").alias("_k"), "x")
    got = selection.select_percentiles(keyed, "x", {"p": ("disc", 0.95)}, cells=64).collect()[0]
    assert got.p == sorted((i * 7919) % 199_999 for i in range(200_000))[189_999]


def test_moving_percentiles(spark, series):
    values = sorted(series.collect(), key=lambda r: (r.t is not None, r.t or 0, r.id))
    for n, p, least in ((1, 0.5, 1), (7, 0.9, 3), (60, 0.5, 1), (1000, 0.9, 20)):
        got = {r.id: r.q for r in selection.moving_percentile(series, "t", n, "x", p, least, "q", ("k",), ("id",), block=50).collect()}
        held = {}
        for r in values:
            held.setdefault(r.k, []).append(r.x)
            inside = sorted(x for x in held[r.k][-n:] if x is not None)
            assert got[r.id] == (inside[max(1, math.ceil(len(inside) * p)) - 1] if len(inside) >= least and inside else None)


def test_long_frames_cost_little_more_than_short_ones():
    rnd = random.Random(1)
    values = [rnd.randrange(10**6) for _ in range(60_000)]
    took = {}
    for n in (50, 5000):
        began = time.process_time()
        selection.frame_percentiles(values, n, 0.9, 20)
        took[n] = time.process_time() - began
    assert took[5000] <= 3 * took[50]


def walked(rows, gap):
    """kept and dropped by id, one row after another."""
    out, last, held = {}, {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        ok = t is None or k not in last or t - last[k] >= gap
        out[i] = (ok, held.get(k, 0) if ok and t is not None else 0)
        if t is not None:
            held[k] = 0 if ok else held.get(k, 0) + 1
            last[k] = t if ok else last[k]
    return out


@pytest.mark.parametrize(("seed", "gap", "range_rows"), [(1, 10, 40), (2, 300, 25), (3, 1, 30), (4, 5000, 20), (5, 0, 30)])
def test_spacing_over_many_ranges(spark, seed, gap, range_rows):
    rnd = random.Random(seed)
    rows, t = [], 0
    for i in range(500):
        t += rnd.choice([0, 1, 1, 3, 9])
        rows.append((i, rnd.choice(["a"] * 8 + ["b", None]), t if i % 90 else None))
    df = frame(spark, rows, "id long, k string, t long")
    want = walked(rows, gap)
    assert {r.id: (r.sent, r.suppressed) for r in sequential.suppress_alerts(df, ("k",), "t", "id", gap, range_rows).collect()} == want
    if gap:
        assert {r.id: r.kept for r in sequential.dedupe_within(df, ("k",), "t", "id", gap - 1, range_rows).collect()} == {i: ok for i, (ok, _) in want.items()}


@pytest.mark.parametrize(("burst", "rate", "range_rows"), [(2, 0.1, 40), (5, 0.03, 30), (1, 0.5, 25), (20, 1 / 64, 50)])
def test_token_buckets_over_many_ranges(spark, burst, rate, range_rows):
    rnd = random.Random(burst)
    rows, t = [], 0
    for i in range(600):
        t += rnd.choice([0, 1, 2, 5, 12, 60 if i % 97 == 0 else 3])
        rows.append((i, rnd.choice(["a"] * 6 + ["b", None]), t if i % 110 else None))
    bucket = sequential.Bucket(burst, rate)
    want = {}
    for k in ("a", "b", None):
        own = [r for r in rows if r[1] == k and r[2] is not None]
        want |= dict(zip([r[0] for r in own], bucket.walk(bucket.full, [r[2] for r in own])[0], strict=True))
    want |= {r[0]: True for r in rows if r[2] is None}
    df = frame(spark, rows, "id long, k string, t long")
    assert {r.id: r.allowed for r in sequential.token_bucket(df, ("k",), "t", "id", burst, rate, range_rows).collect()} == want
    assert 50 < sum(want.values()) < 590


def test_bucket_maps_equal_the_walk_at_every_level():
    rnd = random.Random(7)
    for burst, rate in ((1, 0.25), (3, 0.125), (4, 0.3), (7, 0.01)):
        bucket = sequential.Bucket(burst, rate)
        for size in (1, 2, 9, 300):
            t, times = 0, []
            for _ in range(size):
                t += rnd.choice([0, 0, 1, 2, 7])
                times.append(t)
            pieces = bucket.pieces(times)
            assert len(pieces) <= 4 * burst + 4
            for level in range(bucket.full + 1):
                begin, rises, value = max(p for p in pieces if p[0] <= level)
                assert value + rises * (level - begin) == bucket.walk(level, times)[1]


def test_deep_workflows_take_one_job(spark):
    chain = [(1, i, i - 1 if i else None, "BLOCKED" if i else "FAILED") for i in range(1000)]
    tasks = spark.createDataFrame(chain, "workflow_id long, node long, parent long, status string")
    began = time.time()
    assert {r.node: r.level for r in graphs.dag_levels(tasks).collect()} == {i: i for i in range(1000)}
    assert sorted(r.node for r in graphs.dag_cancel(tasks).collect()) == list(range(1, 1000))
    assert time.time() - began < 30


def test_workflows_whole_and_by_rounds_agree(spark):
    rnd = random.Random(5)
    rows = []
    for w in [*range(12), None]:
        for node in range(rnd.randint(1, 12)):
            status = rnd.choice(["BLOCKED", "BLOCKED", "FAILED", "COMPLETED"])
            for parent in {rnd.choice([None, rnd.randrange(14), max(0, node - 1)]) for _ in range(rnd.randint(1, 3))}:
                rows += [(w, node, parent, status)] * rnd.choice([1, 1, 2])
    tasks = frame(spark, rows, "workflow_id long, node long, parent long, status string")
    for f in (graphs.dag_levels, graphs.dag_cancel):
        whole, rounds, mixed = (sorted(map(tuple, f(tasks, most=most).collect()), key=repr) for most in (1000, 0, 9))
        assert whole == rounds == mixed and whole


def test_rounds_do_not_shuffle_links(spark):
    edges = graphs.edge_build(spark.range(200).withColumnRenamed("id", "src"), 200, 3)
    held = edges.join(edges.groupBy("src").agg(F.count("*").alias("out")), "src")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with graphs.bucketed(held, "src", "links") as links, graphs.bucketed(spark.range(200).select(F.col("id").alias("node")), "node", "nodes") as nodes:
            one = graphs.rank_round(links, nodes, nodes.withColumn("rank", F.lit(1 / 200)), 200, 0.85)
            two = graphs.rank_round(links, nodes, one, 200, 0.85)
            assert [f()._jdf.queryExecution().executedPlan().toString().count(" Exchange ") for f in (lambda: one, lambda: two)] == [1, 2]
            hop = graphs.next_hop(links, spark.range(3).select(F.col("id").alias("node")))
            plan = hop._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(src" not in plan and "Bucketed: true" in plan
            assert two.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ranks = {r.node: r.rank for r in graphs.pagerank(edges, 12, every=5).collect()}
    links, plain = [tuple(r) for r in edges.collect()], dict.fromkeys(range(200), 1 / 200)
    for _ in range(12):
        given = dict.fromkeys(range(200), 0.0)
        for a, b in links:
            given[b] += plain[a] / 3
        plain = {v: 0.15 / 200 + 0.85 * g for v, g in given.items()}
    assert all(abs(ranks[v] - plain[v]) < 1e-12 for v in plain)
