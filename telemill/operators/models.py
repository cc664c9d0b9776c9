"""Training, scoring and inspection of execution-time, queue and overload models, on MLlib or on sums over all rows."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.ml import Pipeline
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.functions.scalars import feature_columns, from_log_target, log_target
from telemill.operators import boosting, linear
from telemill.operators import forest as rf
from telemill.operators.evaluation import best_f1_threshold, regression_metrics, ts_cv_folds
from telemill.session import discard, materialize

# Settings that are tried for each family.
LINEAR_GRID = [{"alpha": alpha} for alpha in (0.1, 1.0, 10.0)]
LOGISTIC_GRID = [{"c": c} for c in (0.1, 1.0, 10.0)]
FOREST_GRID = [{"depth": depth, "least": least} for depth in (8, 16) for least in (1, 5)]
BOOSTED_GRID = [{"depth": depth, "step": step} for depth in (3, 6) for step in (0.05, 0.1)]

#: Settings that are tried at a time; their jobs share the cluster.
TRIED_AT_ONCE = 4

#: Trees of a forest that are drawn and grown at a time.
TREES_AT_ONCE = 40

#: Ranges of an input that trees tell apart, as many as MLlib's own.
BINS = 32


def with_features(rows: DataFrame) -> DataFrame:
    """The rows with the model inputs as columns f_*."""
    return rows.withColumns({f"f_{k}": v for k, v in feature_columns(rows.columns).items()})


def inputs(rows: DataFrame) -> list[str]:
    return sorted(c for c in rows.columns if c.startswith("f_"))


def varying(rows: DataFrame, train: DataFrame) -> DataFrame:
    """``rows`` without the inputs that have one value in all of ``train``: linear models give them no weight, trees no split."""
    names = inputs(rows)
    ends = train.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")) for c in names]).collect()[0]
    return rows.drop(*[c for c, e in zip(names, ends, strict=True) if e["low"] == e["high"]])


def _pipeline(rows: DataFrame, estimator) -> Pipeline:
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs(rows), outputCol="raw", handleInvalid="keep"), scaler, estimator])


def fit_linear(train: DataFrame, target: str, alpha: float = 0.1):
    """Ridge regression of log1p(target) on standardised inputs; the penalty is per row, as MLlib averages the loss."""
    rows = train.withColumn("_y", log_target(F.col(target)))
    n = rows.count()
    return _pipeline(rows, LinearRegression(labelCol="_y", regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False)).fit(rows)


def fit_logistic(train: DataFrame, label: str, c: float = 1.0) -> linear.Logistic:
    """Logistic regression with balanced class weights."""
    names = inputs(train)
    rows = linear.numbers(train.withColumn("fold", F.lit(0)), names, label)
    model = linear.logistics(rows, names, label, 0, [{"c": c}])[1][0]
    discard(rows)
    return model


def _edges(train: DataFrame) -> dict[str, list[float]]:
    """Inner ends of the ranges of each input over all rows of ``train``: one range for each value up to ``BINS`` of them, else of about equal depth."""
    names = inputs(train)
    about = train.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).collect()[0]
    few = [c for c in names if about[c] <= 2 * BINS]
    found = train.agg(*[F.collect_set(c).alias(c) for c in few]).collect()[0] if few else {}
    values = {c: sorted(found[c]) for c in few if 0 < len(found[c]) <= BINS}
    inner = {c: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] or v for c, v in values.items()}
    many = [c for c in names if c not in inner]
    if many:
        inner |= dict(zip(many, train.approxQuantile(many, [i / BINS for i in range(1, BINS)], 0.001), strict=True))
    return {c: sorted(set(inner[c]) or {0.0}) for c in names}


class Ranges(NamedTuple):
    """What finds the ranges of inputs, as plain numbers: MLlib's marks that buckets are categories without an order are left out."""

    bucketizer: Bucketizer

    def getOutputCols(self) -> list[str]:
        return self.bucketizer.getOutputCols()

    def transform(self, rows: DataFrame) -> DataFrame:
        made = self.bucketizer.transform(rows)
        return made.select(*rows.columns, *[F.col(c).alias(c, metadata={}) for c in self.getOutputCols()])


class Cells(NamedTuple):
    """Training rows counted by the ranges that their inputs lie in: what finds the ranges, and a frame with b_* (ranges), _y (label) and _w (rows)."""

    binner: Ranges
    frame: DataFrame


def _binner(train: DataFrame) -> Ranges:
    edges = _edges(train)
    ends = [[-float("inf"), *e, float("inf")] for e in edges.values()]
    return Ranges(Bucketizer(inputCols=list(edges), outputCols=[f"b_{c}" for c in edges], splitsArray=ends, handleInvalid="keep"))


def tree_cells(train: DataFrame, target: str, classify: bool = False) -> Cells:
    """The rows of ``train`` as cells, written once; as many as there are combinations of ranges, however many the rows.

    Trees see no more of a row than its ranges, and a split's gain in variance depends on sums of labels alone, so a
    cell's mean label (regression of log1p) with its count stands for its rows; labels of classes are part of the key.
    """
    binner = _binner(train)
    bins = binner.getOutputCols()
    rows = binner.transform(train.select(*inputs(train), (F.col(target) if classify else log_target(F.col(target))).alias("_y")))
    grouped = rows.groupBy(*bins, "_y") if classify else rows.groupBy(*bins)
    count = F.count("*").cast("double").alias("_w")
    cells = grouped.agg(count) if classify else grouped.agg(F.avg("_y").alias("_y"), count)
    parts = train.sparkSession.sparkContext.defaultParallelism
    return Cells(binner, materialize(cells, "cells").repartition(parts))


def fit_boosted(train: DataFrame | Cells, target: str, classify: bool = False, rounds: int = 300, depth: int = 4, step: float = 0.1) -> boosting.Boosted:
    """Boosted trees over the cells of ``train``, which all settings of a grid can share (``tree_cells``)."""
    cells = train if isinstance(train, Cells) else tree_cells(train, target, classify)
    return boosting.boost(cells.binner, cells.frame, rounds, depth, step, classify)


def forest_rows(train: DataFrame, target: str, classify: bool = False) -> rf.Rows:
    """The rows of ``train`` in the narrow form from which trees draw, written once."""
    edges = _edges(train)
    return rf.narrow_rows(train, list(edges), list(edges.values()), F.col(target) if classify else log_target(F.col(target)), 7)


def forest_cells(train: DataFrame, target: str, classify: bool = False, trees: int = 200) -> rf.Cells:
    """Bootstrap samples of the rows of ``train`` for ``trees`` trees, summed by cell."""
    return forest_rows(train, target, classify).cells(trees)


def _subset(d: int, classify: bool = False) -> int:
    """As in MLlib, a node may split by a third of the inputs (classes: by the square root of their number)."""
    return math.ceil(math.sqrt(d) if classify else d / 3)


def fit_forest(train: DataFrame | rf.Cells, target: str, classify: bool = False, trees: int = 200, depth: int = 8, least: int = 5) -> rf.Forest:
    """A random forest over the drawn cells of ``train``, which all settings of a grid can share (``forest_cells``).

    ``least`` counts drawn rows. Labels of two classes are 0 and 1, for which the gains in variance and in Gini impurity rank alike.
    """
    cells = train if isinstance(train, rf.Cells) else forest_cells(train, target, classify, trees)
    return rf.grow(cells, depth, least, _subset(len(cells.names), classify), BINS, 7)


def forest_scores(train: DataFrame, rows: DataFrame, target: str, grid: list[dict], trees: int = 200) -> DataFrame:
    """Predicted and actual ``target`` of ``rows`` by a forest of ``train`` for each of the settings: actual, predicted_0, predicted_1, ...

    Some trees at a time are grown for all settings together (those of one ``least`` are cut off at each depth), score the rows
    and are left, so that nothing holds a whole forest of deep trees.
    """
    drawn = forest_rows(train, target)
    names, leasts, depths = drawn.names, sorted({g["least"] for g in grid}), sorted({g["depth"] for g in grid})
    state = materialize(rf.to_score(rows.select(F.col(target).cast("double"), *names), drawn.edges), "to-score")
    for first in range(0, trees, TREES_AT_ONCE):
        some = min(TREES_AT_ONCE, trees - first)
        forests = rf.grow_all(drawn.cells(some, first), depths[-1], leasts, _subset(len(names)), BINS, 7)
        last, state = state, materialize(rf.add_scores(state, forests, depths), "to-score")
        discard(last)
    discard(drawn.frame)
    mean = lambda g: from_log_target(F.col("sums")[leasts.index(g["least"]) * len(depths) + depths.index(g["depth"])] / trees)
    return state.select("actual", *[mean(g).alias(f"predicted_{i}") for i, g in enumerate(grid)])


def best_forest_scores(train: DataFrame, rows: DataFrame, order: str, tie: str, target: str, grid: list[dict], k: int = 3, trees: int = 200) -> tuple[DataFrame, dict]:
    """Predicted and actual ``target`` of ``rows`` by the forest of ``train`` with the settings that ``fit_best`` chooses, and those settings."""
    folds, scored = materialize(ts_cv_folds(train, order, tie, k), "folds"), None
    for fold in range(1, k + 1):
        part = forest_scores(folds.where(F.col("fold") < fold).drop("fold"), folds.where(F.col("fold") == fold), target, grid, trees)
        scored = part if scored is None else scored.unionByName(part)
    errors = scored.agg(*[F.avg(F.abs(F.col(f"predicted_{i}") - F.col("actual"))) for i in range(len(grid))]).collect()[0]
    best = grid[min(range(len(grid)), key=lambda i: errors[i])]
    discard(folds)
    return forest_scores(train, rows, target, [best], trees).withColumnRenamed("predicted_0", "predicted"), best


def predict_ms(model, rows: DataFrame, out: str = "predicted") -> DataFrame:
    """Predicted milliseconds of a regression of log1p."""
    made = model.transform(rows)
    return made.withColumn(out, from_log_target(F.col("prediction"))).drop("raw", "features", "prediction", "rawPrediction", "probability", "_y", "_w", *[f"b_{c}" for c in inputs(rows)])


def predict_probability(model, rows: DataFrame, out: str = "score") -> DataFrame:
    made = model.transform(rows)
    chance = F.col("prediction") if isinstance(model, (rf.Forest, linear.Logistic, boosting.Boosted)) else F.element_at(vector_to_array("probability"), 2)
    return made.withColumn(out, chance).drop("raw", "features", "prediction", "rawPrediction", "probability", "_w", *[f"b_{c}" for c in inputs(rows)])


def _out_of_fold(folds: DataFrame, target: str, k: int, fit, predict, ready: dict | None = None) -> DataFrame:
    """Predictions of each fold from the rows before it (or what is ``ready`` of them): fold, actual and what ``predict`` adds."""
    out = None
    with ThreadPoolExecutor(k) as pool:
        models = list(pool.map(lambda fold: fit(ready[fold] if ready else folds.where(F.col("fold") < fold), target), range(1, k + 1)))
    for fold, model in enumerate(models, 1):
        part = predict(model, folds.where(F.col("fold") == fold)).select("fold", F.col(target).cast("double").alias("actual"), "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def ts_cross_validate(rows: DataFrame, order: str, tie: str, target: str, k: int, fit, predict=predict_ms) -> DataFrame:
    """Out-of-fold predictions over expanding time folds: fold, actual, predicted. The folds are written once."""
    return _out_of_fold(materialize(ts_cv_folds(rows, order, tie, k), "folds"), target, k, fit, predict)


def _tried(rows: DataFrame, order: str, tie: str, target: str, fit, grid: list[dict], k: int, predict, judge, prepare=None) -> list:
    """What ``judge`` makes of the out-of-fold predictions with each of the settings, some of them at a time; ``prepare`` makes of training rows what all settings share."""
    folds = materialize(ts_cv_folds(rows, order, tie, k), "folds")
    ready = {fold: prepare(folds.where(F.col("fold") < fold), target) for fold in range(1, k + 1)} if prepare else None

    def one(settings: dict):
        return judge(_out_of_fold(folds, target, k, lambda train, y: fit(train, y, **settings), predict, ready))

    with ThreadPoolExecutor(TRIED_AT_ONCE) as pool:
        found = list(pool.map(one, grid))
    discard(folds)
    return found


def fit_best(rows: DataFrame, order: str, tie: str, target: str, fit, grid: list[dict], k: int = 3, prepare=None):
    """The fit on all rows with the settings of ``grid`` that have the smallest mean absolute error out of fold (the first of equals), and those settings.

    Folds expand in time, so each is predicted from rows before it; the driver holds one error per setting.
    """
    errors = _tried(rows, order, tie, target, fit, grid, k, predict_ms, lambda scored: regression_metrics(scored).collect()[0]["mae"], prepare)
    best = grid[min(range(len(grid)), key=lambda i: errors[i])]
    return fit(prepare(rows, target) if prepare else rows, target, **best), best


def fit_best_classifier(rows: DataFrame, order: str, tie: str, label: str, fit, grid: list[dict], k: int = 3):
    """The fit on all rows with the settings whose best F1 out of fold is the highest, those settings, and the cut-off with that F1.

    The cut-off comes from pooled predictions out of fold, so rows held out for a test never choose it.
    """
    predict = lambda model, part: predict_probability(model, part, "predicted")
    judge = lambda scored: best_f1_threshold(scored, "actual", "predicted").collect()[0]
    found = _tried(rows, order, tie, label, fit, grid, k, predict, judge)
    at = max(range(len(grid)), key=lambda i: found[i]["f1"])
    return fit(rows, label, **grid[at]), grid[at], found[at]["threshold"]


def fit_best_logistic(rows: DataFrame, order: str, tie: str, label: str, grid: list[dict], k: int = 3):
    """``fit_best_classifier`` for logistic regressions, which fits all folds and settings, and all rows, together."""
    names = inputs(rows)
    folds = linear.numbers(ts_cv_folds(rows, order, tie, k), names, label)
    tried, whole = linear.logistics(folds, names, label, k, grid)
    with ThreadPoolExecutor(TRIED_AT_ONCE) as pool:
        found = list(pool.map(lambda models: best_f1_threshold(linear.logistic_out_of_fold(folds, label, models), "actual", "predicted").collect()[0], tried))
    discard(folds)
    at = max(range(len(grid)), key=lambda i: found[i]["f1"])
    return whole[at], grid[at], found[at]["threshold"]


def importances(model, names: list[str], top: int = 15) -> list[tuple[str, float]]:
    """Inputs by absolute coefficient or impurity importance, the largest first."""
    if isinstance(model, (rf.Forest, linear.Logistic, boosting.Boosted)):
        return sorted(zip(names, map(float, model.importance), strict=True), key=lambda x: (-x[1], x[0]))[:top]
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:top]


def score_candidates(candidates: DataFrame, time_model, overload_model) -> DataFrame:
    """Per task and worker (rows with model inputs): predicted milliseconds, queue (not under 0) and overload probability."""
    timed = predict_ms(time_model, candidates, "pred_exec_ms")
    both = predict_probability(overload_model, timed, "overload_prob")
    return both.withColumn("pred_queue_len", F.greatest(F.lit(0.0), F.col("queue_len").cast("double")))


def batch_inference(rows: DataFrame, model, n: int, key: str, seed: int) -> DataFrame:
    """Mean and count of predictions over a seeded sample of ``n`` rows (the lowest hashes of the key), so any partitioning gives the same."""
    sample = rows.withColumn("_h", F.xxhash64(key, F.lit(seed))).orderBy("_h", key).limit(n).drop("_h")
    return predict_ms(model, sample).agg(F.count("*").alias("n"), F.round(F.avg("predicted"), 4).alias("mean_ms"), F.round(F.sum("predicted"), 2).alias("checksum"))
