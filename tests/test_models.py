"""Properties of the models and of what uses them."""

import random

import pytest
from pyspark.sql import functions as F

from telemill.operators import boosting, evaluation, forest, linear, listings, models


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(8)
    made = []
    for i in range(600):
        a, b, noise = rnd.uniform(0, 4), rnd.uniform(0, 1), rnd.gauss(0, 0.05)
        ms = round(2.718281828 ** (2 + a + noise))
        made.append((i, i * 10, a, b, rnd.uniform(0, 1), ms, int(a + noise > 2), float(i % 5)))
    return spark.createDataFrame(made, "id long, at long, f_size double, f_cpu double, f_noise double, exec_ms long, label int, queue_len double").cache()


FITS = {"linear": models.fit_linear, "forest": models.fit_forest, "boosted": models.fit_boosted}


@pytest.mark.parametrize("name", FITS)
def test_regressions_beat_the_mean(rows, name):
    train, test = rows.where("id < 450"), rows.where("id >= 450")
    scored = models.predict_ms(FITS[name](train, "exec_ms"), test).withColumn("actual", F.col("exec_ms").cast("double"))
    mean = train.agg(F.avg("exec_ms")).collect()[0][0]
    mae = evaluation.regression_metrics(scored).collect()[0].mae
    assert mae < 0.4 * test.agg(F.avg(F.abs(F.col("exec_ms") - mean))).collect()[0][0]
    assert scored.where("predicted < 0 or predicted is null").isEmpty()


def test_classifiers_rank(rows):
    for fit in (models.fit_logistic, lambda t, y: models.fit_forest(t, y, classify=True), lambda t, y: models.fit_boosted(t, y, classify=True)):
        scored = models.predict_probability(fit(rows.where("id < 450"), "label"), rows.where("id >= 450"))
        assert scored.where("score < 0 or score > 1").isEmpty()
        assert evaluation.classification_metrics(scored, 0.5).collect()[0].auc > 0.95


def test_cross_validation_scores_each_late_row_once(rows):
    out = models.ts_cross_validate(rows, "at", "id", "exec_ms", 3, models.fit_linear)
    assert {r.fold: r.n for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {1: 150, 2: 150, 3: 150}
    folds = evaluation.ts_cv_folds(rows, "at", "id", 3)
    ends = {r.fold: (r.low, r.high) for r in folds.groupBy("fold").agg(F.min("at").alias("low"), F.max("at").alias("high")).collect()}
    assert all(ends[i][1] < ends[i + 1][0] for i in range(3))


def test_the_grid_picks_what_predicts_best(rows):
    tried = []

    def fit(train, target, size):
        tried.append(size)
        return models.fit_linear(train if size else train.withColumn("f_size", F.lit(0.0)), target)

    _, best = models.fit_best(rows, "at", "id", "exec_ms", fit, [{"size": False}, {"size": True}], 2)
    assert best == {"size": True} and tried[-1] is True and sorted(tried) == [False, False, True, True, True]


def test_the_classifier_grid_brings_its_cut_off(rows):
    def fit(train, label, size, c=1.0):
        return models.fit_logistic(train if size else train.withColumn("f_size", F.lit(0.0)), label, c)

    model, best, threshold = models.fit_best_classifier(rows.where("id < 450"), "at", "id", "label", fit, [{"size": False}, {"size": True}, {"size": True, "c": 1e-9}])
    scored = models.predict_probability(model, rows.where("id >= 450"))
    assert best == {"size": True} and 0 < threshold < 1
    assert evaluation.classification_metrics(scored, threshold).collect()[0].f1 > 0.9
    assert [len(g) for g in (models.LINEAR_GRID, models.LOGISTIC_GRID, models.FOREST_GRID, models.BOOSTED_GRID)] == [3, 3, 4, 4]


def test_importances_find_the_input_that_counts(rows):
    for fit in FITS.values():
        found = models.importances(fit(rows, "exec_ms"), models.inputs(rows))
        assert found[0][0] == "f_size" and [x for _, x in found] == sorted((x for _, x in found), reverse=True)


def test_candidates_and_batches(rows):
    timed, over = models.fit_linear(rows, "exec_ms"), models.fit_logistic(rows, "label")
    got = models.score_candidates(rows.withColumn("queue_len", F.col("queue_len") - 2), timed, over)
    assert got.count() == 600 and got.where("pred_queue_len < 0 or pred_exec_ms < 0 or overload_prob < 0 or overload_prob > 1").isEmpty()
    one = models.batch_inference(rows.repartition(7), timed, 100, "id", 3).collect()
    assert one == models.batch_inference(rows.coalesce(1), timed, 100, "id", 3).collect() and one[0].n == 100
    assert models.batch_inference(rows, timed, 5000, "id", 3).collect()[0].n == 600


def test_listings_take_arguments(spark):
    tasks = spark.createDataFrame(
        [(f"t{i}", "SORT" if i % 2 else "HASH", "FAILED" if i % 3 == 0 else "COMPLETED", i // 2, i, 10 * i, i, [None, -1, 0, 5][i % 4]) for i in range(12)],
        "task_id string, task_type string, status string, submitted_ms long, task_no long, completed_ms long, attempts int, max_retries int",
    )
    ids = lambda df: [r.task_id for r in df.collect()]
    assert ids(listings.list_tasks(tasks, "completed", "Sort", 2)) == ["t11", "t7"]
    assert ids(listings.list_tasks(tasks, limit=-4)) == ["t11"] and len(ids(listings.list_tasks(tasks, limit=9999, most=5))) == 5
    assert ids(listings.dead_letters(tasks, 3)) == ["t6", "t9"][::-1] and ids(listings.dead_letters(tasks, 3, 1)) == ["t9"] and ids(listings.dead_letters(tasks, 99, -1)) == ["t6"]
    running = spark.createDataFrame([(1, "A", 1, 100, 10.0), (2, "A", 1, 100, None), (3, "B", 1, 100, 10.0), (4, "B", 1, 100, None), (5, "A", 2, 100, 1.0), (6, "A", 1, 60, 10.0)], "id int, task_type string, attempt int, elapsed_ms long, pred_ms double")
    finished = spark.createDataFrame([("A", i) for i in range(1, 101)] + [("B", 1)], "task_type string, exec_ms long")
    assert sorted((r.id, r.limit_ms) for r in listings.stragglers(running, finished, 2.0).collect()) == [(1, 90.0), (2, 90.0), (3, 20.0)]


def test_one_pass_ridge_equals_a_fit_for_each_fold_and_setting(rows):
    folds = evaluation.ts_cv_folds(rows.withColumn("f_none", F.lit(3.0)), "at", "id", 3).cache()
    names, grid = models.inputs(folds), [{"alpha": 0.1}, {"alpha": 50.0}]
    tried, whole = linear.ridges(folds, names, "exec_ms", 3, grid)
    for settings, by_fold, last in zip(grid, tried, whole, strict=True):
        for fold, model in [*by_fold.items(), (4, last)]:
            train = folds.where(F.col("fold") < fold)
            scored = models.fit_linear(train, "exec_ms", **settings).transform(train).withColumn("own", model.score())
            assert scored.agg(F.max(F.abs(F.col("own") - F.col("prediction")))).collect()[0][0] < 1e-5
            assert "f_none" not in model.weights
    model, best = linear.best_ridge(folds, names, "exec_ms", 3, grid)
    assert best == models.fit_best(rows, "at", "id", "exec_ms", models.fit_linear, grid)[1] and model == whole[grid.index(best)]
    alike = linear.ridge_out_of_fold(folds, "exec_ms", tried[0])
    plain = models.ts_cross_validate(rows, "at", "id", "exec_ms", 3, models.fit_linear)
    metrics = lambda df: {r.fold: (r.n, round(r.mae, 3)) for r in evaluation.regression_metrics(df, "fold").collect()}
    assert metrics(alike) == metrics(plain)


def test_one_pass_ridge_takes_few_jobs(spark, rows):
    folds = evaluation.ts_cv_folds(rows, "at", "id", 3)
    names = models.inputs(folds)
    spark.sparkContext.setJobGroup("ridge", "ridge")
    linear.best_ridge(folds, names, "exec_ms", 3, models.LINEAR_GRID)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ridge")) <= 8  # ten fits by themselves take over thirty


def test_folds_and_splits_leave_wide_rows_where_they_are(spark):
    rows = spark.range(0, 1000, 1, 5).select(F.when(F.col("id") % 50 > 0, F.col("id") * 7 % 333).alias("t"), "id", F.lit("x").alias("k"))
    want = {r.id: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (r.t is not None, r.t or 0, r.id)))}
    folds, split = evaluation.ts_cv_folds(rows, "t", "id", 3), evaluation.time_split(rows, "t", "id", F.lit(False), F.lit(False), 0.01)
    assert all(r.fold == want[r.id] // 250 for r in folds.collect()) and all((r.split == "train") == (want[r.id] < 10) for r in split.collect())
    assert not any("Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in (folds, split))
    same = rows.withColumn("t", F.lit(1)).withColumn("id", F.lit(2))  # a boundary inside rows that agree still gives whole blocks
    assert {r.fold: r.n for r in evaluation.ts_cv_folds(same, "t", "id", 3).groupBy("fold").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(4), 250)


def test_boosted_trees_over_cells_equal_those_over_rows(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    made = spark.range(0, 3000, 1, 3).select(((F.col("id") * 7) % 6).cast("double").alias("f_a"), ((F.col("id") * 11) % 40 * 1.5).alias("f_b"), (F.col("id") * 7 % 6 * 50 + F.col("id") * 13 % 101 + 1).alias("exec_ms"))
    cells = models.tree_cells(made, "exec_ms")
    got = cells.frame.agg(F.count("*").alias("n"), F.sum("_w").alias("w")).collect()[0]
    assert got.w == 3000 and got.n <= 6 * models.BINS
    assert models.tree_cells(made.union(made).union(made), "exec_ms").frame.count() == got.n  # more rows, no more cells
    join = VectorAssembler(inputCols=cells.binner.getOutputCols(), outputCol="features")
    rows = join.transform(cells.binner.transform(made.withColumn("_y", F.log1p("exec_ms"))))
    plain = GBTRegressor(labelCol="_y", maxIter=5, maxDepth=3, stepSize=0.1, seed=7).fit(rows)
    own = models.fit_boosted(cells, "exec_ms", rounds=5, depth=3)
    both = own.transform(made).withColumnRenamed("prediction", "own").drop("features")
    gaps = plain.transform(join.transform(both)).agg(F.max(F.abs(F.col("own") - F.col("prediction")))).collect()[0][0]
    assert gaps < 1e-6


@pytest.mark.parametrize("classify", [False, True])
def test_boosted_trees_of_one_task_and_of_all_tasks_are_the_same(rows, classify):
    target = "label" if classify else "exec_ms"
    cells = models.tree_cells(rows, target, classify)
    once, split = (boosting.boost(cells.binner, cells.frame, 13, 3, 0.1, classify, most) for most in (10**6, 50))
    both = split.transform(once.transform(rows).withColumnRenamed("prediction", "own").drop(*cells.binner.getOutputCols()))
    assert both.agg(F.max(F.abs(F.col("own") - F.col("prediction")))).collect()[0][0] < 1e-9
    assert len(once.trees) == len(split.trees) == 13 and abs(once.importance - split.importance).max() < 1e-9


def test_boosted_trees_take_all_their_rounds(spark, rows):
    spark.sparkContext.setJobGroup("boosted", "boosted")
    model = models.fit_boosted(rows, "exec_ms")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.trees) == 300  # as the reference's n_estimators
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted")) <= 30  # small tables take no job for each round


@pytest.fixture(scope="module")
def grid_rows(spark):
    i = F.col("id")
    return spark.range(0, 3000, 1, 3).select("id", (i * 7 % 6).cast("double").alias("f_a"), (i * 11 % 40 * 1.5).alias("f_b"), (F.floor(i / 10) % 3).cast("double").alias("f_c"), (i * 7 % 6 * 50 + F.pmod(F.xxhash64(i), F.lit(101)) + 1).alias("exec_ms")).cache()


def test_a_tree_over_cells_equals_one_over_rows(spark, grid_rows):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    drawn = models.forest_cells(grid_rows, "exec_ms", trees=1)
    edges = dict(zip(drawn.names, drawn.edges, strict=True))
    ranges = grid_rows.select("id", F.log1p("exec_ms").alias("_y"), *drawn.names, *[sum((F.col(c) >= float(e)).cast("int") for e in edges[c]).alias(f"b_{c}") for c in drawn.names])
    whole = ranges.groupBy(F.concat(*[F.unhex(F.lpad(F.hex(f"b_{c}"), 2, "0")) for c in drawn.names]).alias("cell")).agg(F.count("*").cast("double").alias("w_0"), F.sum("_y").alias("s_0"))
    own = forest.grow(drawn._replace(frame=whole), 5, 4, 3, models.BINS, 7)
    joined = VectorAssembler(inputCols=[f"b_{c}" for c in drawn.names], outputCol="features").transform(ranges)
    plain = DecisionTreeRegressor(labelCol="_y", maxDepth=5, minInstancesPerNode=4, predictionCol="plain").fit(joined)
    gaps = own.transform(plain.transform(joined)).agg(F.max(F.abs(F.col("plain") - F.col("prediction"))), F.countDistinct("plain")).collect()[0]
    assert gaps[0] < 1e-9 and gaps[1] > 10
    assert max(abs(own.importance - plain.featureImportances.toArray())) < 1e-9


def test_forests_draw_rows_and_not_cells(grid_rows):
    cells = models.forest_cells(grid_rows, "exec_ms", trees=8)
    sums = cells.frame.agg(F.count("*").alias("n"), *[F.sum(f"w_{t}").alias(f"w_{t}") for t in range(8)], *[(F.sum(f"s_{t}") / F.sum(f"w_{t}")).alias(f"m_{t}") for t in range(8)]).collect()[0]
    mean = grid_rows.agg(F.avg(F.log1p("exec_ms"))).collect()[0][0]
    assert all(abs(sums[f"w_{t}"] - 3000) < 5 * 3000**0.5 and abs(sums[f"m_{t}"] - mean) < 0.15 for t in range(8)) and len({sums[f"w_{t}"] for t in range(8)}) > 4
    more = grid_rows.union(grid_rows.withColumn("id", F.col("id") + 3000)).union(grid_rows.withColumn("id", F.col("id") + 6000))
    tripled = models.forest_cells(more, "exec_ms", trees=8).frame.agg(F.count("*").alias("n"), F.sum("w_0").alias("w")).collect()[0]
    assert tripled.n == sums.n and abs(tripled.w - 9000) < 5 * 9000**0.5  # more rows, no more cells
    by_cell = lambda c: sorted((bytes(r.cell), r.w_3, round(r.s_3, 6)) for r in c.frame.collect())
    assert by_cell(models.forest_cells(grid_rows.repartition(7), "exec_ms", trees=8)) == by_cell(cells)


@pytest.mark.parametrize("depth", [2, 7])
def test_large_nodes_are_split_to_the_same_forest(grid_rows, depth):
    cells = models.forest_cells(grid_rows, "exec_ms", trees=4)
    once, split = (forest.grow(cells, depth, 2, 1, models.BINS, 7, most) for most in (10**6, 6))
    for name in ("roots", "feature", "cut", "left"):
        assert getattr(once, name).tolist() == getattr(split, name).tolist(), name
    assert abs(once.value - split.value).max() < 1e-9 and abs(once.importance - split.importance).max() < 1e-9 and len(once.roots) == 4


def test_forests_take_all_their_trees(grid_rows):
    assert len(models.fit_forest(grid_rows, "exec_ms").roots) == 200  # as the reference's n_estimators
    assert models.forest_cells(grid_rows, "exec_ms").trees == 200


def test_settings_that_share_a_growth_have_the_forests_of_their_own(grid_rows):
    import numpy as np

    cells = models.forest_cells(grid_rows, "exec_ms", trees=6)
    both = forest.grow_all(cells, 9, [1, 40], 1, models.BINS, 7)
    x = np.array([[int(v) for v in r.cell] for r in cells.frame.select("cell").collect()], "uint8")
    for least, shared in zip([1, 40], both, strict=True):
        own = forest.grow(cells, 9, least, 1, models.BINS, 7)
        for name in ("roots", "feature", "cut", "left", "value", "importance"):
            assert getattr(shared, name).tolist() == getattr(own, name).tolist(), name
        flat = forest.grow(cells, 4, least, 1, models.BINS, 7)
        cut_off, whole = shared.sums(x, [4, 9])
        assert abs(cut_off - flat.sums(x, [4])[0]).max() < 1e-9 and abs(whole - own.sums(x, [9])[0]).max() < 1e-9 and abs(whole - cut_off).max() > 0
    assert len(both[0].feature) > len(both[1].feature)


def test_forests_that_score_some_trees_at_a_time_equal_whole_ones(grid_rows):
    train, test = grid_rows.where("id < 2400"), grid_rows.where("id >= 2400")
    grid = [{"depth": depth, "least": least} for depth in (2, 6) for least in (1, 30)]
    trees = models.TREES_AT_ONCE + 3
    got = models.forest_scores(train, test, "exec_ms", grid, trees)
    for i, settings in enumerate(grid):
        plain = models.predict_ms(models.fit_forest(train, "exec_ms", trees=trees, **settings), test)
        pairs = [sorted((r.a, round(r.p, 6)) for r in df.collect()) for df in (got.select(F.col("actual").alias("a"), F.col(f"predicted_{i}").alias("p")), plain.select(F.col("exec_ms").cast("double").alias("a"), F.col("predicted").alias("p")))]
        assert len(pairs[0]) == len(pairs[1]) == 600 and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(*pairs, strict=True))
    train = train.withColumn("at", F.col("id") * 10)
    scored, best = models.best_forest_scores(train, test, "at", "id", "exec_ms", grid[:2], 2, 3)
    assert best == models.fit_best(train, "at", "id", "exec_ms", lambda t, y, **s: models.fit_forest(t, y, trees=3, **s), grid[:2], 2)[1] and scored.count() == 600


def test_forests_refuse_missing_labels(grid_rows):
    with pytest.raises(Exception, match="labels have missing"):
        models.fit_forest(grid_rows.withColumn("exec_ms", F.when(F.col("id") > 5, F.col("exec_ms"))), "exec_ms")


@pytest.fixture(scope="module")
def class_rows(spark):
    i, u = F.col("id"), lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000
    made = spark.range(0, 900, 1, 3).select("id", i.alias("at"), (u(1) * 50 + 1e5).alias("f_a"), u(2).alias("f_b"), (i % 3 == 0).cast("double").alias("f_c"), (i % 3 != 0).cast("double").alias("f_d"), F.lit(2.0).alias("f_none"))
    return made.withColumn("label", ((F.col("f_a") - 1e5) / 50 + F.col("f_b") + u(3) > 1.9).cast("int")).cache()


def test_logistic_fits_of_all_folds_and_settings_equal_mllib(spark, class_rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    grid, names = [{"c": 0.1}, {"c": 10.0}], models.inputs(class_rows)
    folds = linear.numbers(evaluation.ts_cv_folds(class_rows, "at", "id", 2), names, "label")
    spark.sparkContext.setJobGroup("logistic", "logistic")
    tried, whole = linear.logistics(folds, names, "label", 2, grid)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("logistic")) <= 30  # six fits by themselves take over a hundred
    for settings, by_fold, last in zip(grid, tried, whole, strict=True):
        for fold, model in [*by_fold.items(), (3, last)]:
            train = folds.where(F.col("fold") < fold)
            n, ones = train.agg(F.count("*"), F.sum("label")).collect()[0]
            weighted = train.withColumn("_w", n / 2 / F.when(F.col("label") == 1, ones).otherwise(n - ones))
            stages = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
            plain = Pipeline(stages=[*stages, LogisticRegression(labelCol="label", weightCol="_w", regParam=1 / (settings["c"] * n), standardization=False, maxIter=1000, tol=1e-12)]).fit(weighted)
            both = models.predict_probability(plain, models.predict_probability(model, weighted, "own"), "mllib")
            assert both.agg(F.max(F.abs(F.col("own") - F.col("mllib")))).collect()[0][0] < 1e-4
            assert max(abs(model.importance - abs(plain.stages[-1].coefficients.toArray()))) < 1e-3 and "f_none" not in model.linear.weights


def test_the_logistic_grid_is_judged_as_fits_by_themselves_are(class_rows):
    train, grid = class_rows.where("id < 700"), [{"c": 1e-7}, {"c": 1.0}, {"c": 10.0}]
    model, best, threshold = models.fit_best_logistic(train, "at", "id", "label", grid)
    plain, same, cut = models.fit_best_classifier(train, "at", "id", "label", models.fit_logistic, grid)
    assert best == same and abs(threshold - cut) < 1e-6 and model.linear.weights == pytest.approx(plain.linear.weights, rel=1e-5)
    assert evaluation.classification_metrics(models.predict_probability(model, class_rows.where("id >= 700")), threshold).collect()[0].auc > 0.85


def test_logistic_fits_of_parted_single_and_missing_classes(class_rows):
    parted = class_rows.withColumn("label", (F.col("f_b") > 0.5).cast("int"))
    scored = models.predict_probability(models.fit_logistic(parted, "label", 1e9), parted)
    assert scored.where("score is null or score < 0 or score > 1 or (score > 0.5) != (label = 1)").isEmpty()
    for label in (0, 1):
        same = class_rows.withColumn("label", F.lit(label))
        assert {r.score for r in models.predict_probability(models.fit_logistic(same, "label"), same).collect()} == {float(label)}
    with pytest.raises(ValueError, match="missing"):
        models.fit_logistic(class_rows.withColumn("label", F.when(F.col("id") > 5, F.col("label"))), "label")
