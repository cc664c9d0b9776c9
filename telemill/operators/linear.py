"""Linear models over expanding folds: one pass sums the moments of each fold, and all settings and folds are solved from them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.scalars import from_log_target, log_target
from telemill.session import materialize

#: Rounds of a logistic fit at most; it takes about six.
ROUNDS = 100


class Linear(NamedTuple):
    """A linear score: the weight of each input that counts, and the intercept."""

    weights: dict[str, float]
    intercept: float

    def score(self) -> Column:
        return sum((F.col(name) * w for name, w in self.weights.items()), F.lit(self.intercept))


def summed(rows: DataFrame, partial) -> dict[int, np.ndarray]:
    """The sums over all tasks of what ``partial`` makes of Arrow batches: a flat array per part; Spark adds them up, so the driver gets each entry once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, values in partial(batch):
                held[part] = held[part] + values if part in held else values
        for part, values in held.items():
            yield pa.record_batch([pa.array(np.full(len(values), part, "int32")), pa.array(np.arange(len(values), dtype="int32")), pa.array(values)], ["part", "at", "v"])

    found: dict[int, dict[int, float]] = {}
    for r in rows.mapInArrow(emit, "part int, at int, v double").groupBy("part", "at").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["part"], {})[r["at"]] = r["v"]
    return {part: np.array([values[i] for i in range(len(values))]) for part, values in found.items()}


def moments(rows: DataFrame, fold: str, columns: list[str]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Per fold the sums of all products of two of the columns 1 and ``columns``, the latter less a first row's values; and those values."""
    one = rows.select(*columns).first()
    shift = np.array([np.nan if v is None else float(v) for v in one]) if one else np.zeros(len(columns))

    def partial(batch: pa.RecordBatch):
        fold_of = batch.column(0).to_numpy()
        x = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) - s for c, s in zip(batch.columns[1:], shift, strict=True)]])
        return [(int(g), (x[fold_of == g].T @ x[fold_of == g]).ravel()) for g in np.unique(fold_of)]

    sums = summed(rows.select(F.col(fold).cast("int"), *[F.col(c).cast("double") for c in columns]), partial)
    return {g: v.reshape(len(columns) + 1, -1) for g, v in sums.items()}, shift


def ridge(sums: np.ndarray, shift: np.ndarray, names: list[str], alpha: float) -> Linear:
    """Ridge regression of the last column on the others (``names``), standardised, from their moments.

    As in MLlib's ``LinearRegression``, the penalty is alpha / n over the standard deviation of the target; inputs that
    are constant have no weight.
    """
    if not np.isfinite(sums).all():
        raise ValueError("inputs or target have missing or infinite values")
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    var = np.maximum(np.diag(cov), 0.0)
    used = [i for i in range(len(names)) if var[i] > 1e-12 * (sums[i + 1, i + 1] / n + mean[i] ** 2)]
    if not used or var[-1] <= 0:
        return Linear({}, float(mean[-1] + shift[-1]))
    std = np.sqrt(var[used] * n / max(n - 1, 1))
    scaled = cov[np.ix_(used, used)] / np.outer(std, std) + alpha / n / np.sqrt(var[-1]) * np.eye(len(used))
    weights = np.linalg.solve(scaled, cov[used, -1] / std) / std
    intercept = mean[-1] + shift[-1] - weights @ (mean[used] + shift[used])
    return Linear({names[i]: float(w) for i, w in zip(used, weights, strict=True)}, float(intercept))


def ridges(folds: DataFrame, names: list[str], target: str, k: int, grid: list[dict]) -> tuple[list[dict[int, Linear]], list[Linear]]:
    """For each setting of ``grid`` the regression of log1p(target) for folds 1 to k, on the rows of the folds before, and that on all rows; one pass for all."""
    sums, shift = moments(folds.withColumn("_y", log_target(F.col(target))), "fold", [*names, "_y"])
    upto = lambda end: sum(v for g, v in sums.items() if g < end)
    by_fold = [{i: ridge(upto(i), shift, names, s["alpha"]) for i in range(1, k + 1)} for s in grid]
    return by_fold, [ridge(upto(k + 1), shift, names, s["alpha"]) for s in grid]


def by_fold(models: dict[int, Linear]) -> Column:
    """The score of a row by the model of its fold; null in fold 0."""
    return F.coalesce(*[F.when(F.col("fold") == fold, model.score()) for fold, model in models.items()])


def ridge_out_of_fold(folds: DataFrame, target: str, models: dict[int, Linear]) -> DataFrame:
    """Predictions of each fold from the rows before it: fold, actual, predicted."""
    return folds.where("fold > 0").select("fold", F.col(target).cast("double").alias("actual"), from_log_target(by_fold(models)).alias("predicted"))


def best_ridge(folds: DataFrame, names: list[str], target: str, k: int, grid: list[dict]) -> tuple[Linear, dict]:
    """The regression on all rows with the settings of ``grid`` that have the smallest mean absolute error out of fold (the first of equals), and those settings."""
    tried, whole = ridges(folds, names, target, k, grid)
    actual = F.col(target).cast("double")
    errors = [F.round(F.avg(F.abs(from_log_target(by_fold(m)) - actual)), 6) for m in tried]
    found = folds.where("fold > 0").agg(*errors).collect()[0]
    best = min(range(len(grid)), key=lambda i: found[i])
    return whole[best], grid[best]


class Logistic(NamedTuple):
    """A logistic regression: its linear score, and the size of each input's weight on standardised inputs."""

    linear: Linear
    importance: np.ndarray

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.linear.score()))

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``prediction``, the probability of class 1."""
        return rows.withColumn("prediction", self.probability())


class _Newton:
    """The minimum of a balanced, penalised logistic loss by Newton's method: ``at`` is what to try next, ``take`` takes the sums found there."""

    def __init__(self, sums: np.ndarray, c: float):
        """``sums`` are the moments of the training rows: 1, inputs (near standard scale) and the label."""
        self.n, ones = sums[0, 0], sums[0, -1]
        mean, var = sums[0, 1:-1] / self.n, np.diag(sums)[1:-1] / self.n - (sums[0, 1:-1] / self.n) ** 2
        self.used = np.flatnonzero(var > 1e-12 * np.diag(sums)[1:-1] / self.n)
        self.std, self.mean = np.sqrt(var[self.used] * self.n / max(self.n - 1, 1)), mean[self.used]
        self.classes = self.n / 2 / np.array([self.n - ones, ones]) if 0 < ones < self.n else None
        self.constant = 0.0 if self.classes is not None else np.inf if ones else -np.inf
        self.penalty = 1.0 / (c * self.n) * np.array([0.0, *np.ones(len(self.used))])
        self.best, self.loss, self.step = np.zeros(len(self.used) + 1), np.inf, np.zeros(len(self.used) + 1)
        self.done = self.classes is None
        # from 1 and all inputs to 1 and the standardised inputs that count
        self.map = np.zeros((len(self.used) + 1, sums.shape[0] - 1))
        self.map[0, 0] = 1.0
        self.map[np.arange(len(self.used)) + 1, self.used + 1] = 1 / self.std
        self.map[1:, 0] = -self.mean / self.std

    def at(self) -> np.ndarray:
        return self.map.T @ (self.best + self.step)

    def take(self, found: np.ndarray) -> None:
        """A step that makes the loss larger is halved; the last one, too small to matter, is taken unseen."""
        d = self.map.shape[1]
        here = self.best + self.step
        loss = found[0] / self.n + (self.penalty * here**2).sum() / 2
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.step = self.step / 2
            self.done = bool(abs(self.step).max() < 1e-12)
            return
        self.best, self.loss = here, loss
        slope = self.map @ found[1 : d + 1] / self.n + self.penalty * here
        bend = self.map @ found[d + 1 :].reshape(d, d) @ self.map.T / self.n + np.diag(self.penalty)
        bend[0, 0] += 1e-12  # saturated scores leave the intercept without one
        self.step = -np.linalg.solve(bend, slope)
        if -slope @ self.step / 2 < 1e-9:
            self.best, self.done = self.best + self.step, True


def numbers(folds: DataFrame, names: list[str], label: str) -> DataFrame:
    """``folds`` with its fold, inputs and label alone, as numbers, written once for ``logistics``."""
    return materialize(folds.select(F.col("fold").cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in (*names, label)]), "logistic-rows")


def logistics(rows: DataFrame, names: list[str], label: str, k: int, grid: list[dict]) -> tuple[list[dict[int, Logistic]], list[Logistic]]:
    """For each setting of ``grid`` (c) the regression with balanced class weights for folds 1 to k, on the rows of the folds before, and that on all rows.

    ``rows`` are ``numbers`` of folds. A round of all fits is one pass over them; the driver gets sums alone, about the square of the
    number of inputs for each fit. Inputs are standardised over the training rows of a fit, and the penalty is 1 / (c x rows).
    """
    sums, shift = moments(rows, "fold", [*names, label])
    total = sum(sums.values(), np.zeros((len(names) + 2, len(names) + 2)))
    if not np.isfinite(total).all():
        raise ValueError("inputs or labels have missing or infinite values")
    # one scale for all fits: the label keeps its own
    n = max(total[0, 0], 1.0)
    mean = np.array([*(total[0, 1:-1] / n), -shift[-1]])
    std = np.sqrt(np.maximum(np.diag(total)[1:] / n - (total[0, 1:] / n) ** 2, 0.0))
    std[(std <= 0) | (np.arange(len(std)) == len(names))] = 1.0
    scale = np.diag([1.0, *(1 / std)])
    scale[1:, 0] = -mean / std
    upto = lambda end: scale @ sum(v for g, v in sums.items() if g < end) @ scale.T
    fits = {(j, i): _Newton(upto(i), s["c"]) for j, s in enumerate(grid) for i in range(1, k + 2)}
    center, size = shift[:-1] + mean[:-1], std[:-1]
    for _ in range(ROUNDS):
        tried = [(at, f.at(), f.classes) for at, f in fits.items() if not f.done]
        if not tried:
            break

        def partial(batch: pa.RecordBatch, tried=tried):
            fold_of, y = batch.column(0).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            x = np.column_stack([np.ones(batch.num_rows), *[(c.to_numpy() - m) / s for c, m, s in zip(batch.columns[1:-1], center, size, strict=True)]])
            for part, ((_, end), weights, classes) in enumerate(tried):
                own = fold_of < end
                if own.any():
                    xs, ys = (x, y) if own.all() else (x[own], y[own])
                    z, w = xs @ weights, np.where(ys > 0, classes[1], classes[0])
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    yield part, np.concatenate([[w @ (np.logaddexp(0, z) - ys * z)], xs.T @ (w * (p - ys)), ((xs * (w * p * (1 - p))[:, None]).T @ xs).ravel()])

        found = summed(rows, partial)
        for part, (at, _, _) in enumerate(tried):
            fits[at].take(found[part])

    def made(fit: _Newton) -> Logistic:
        importance = np.zeros(len(names))
        if fit.classes is None:
            return Logistic(Linear({}, fit.constant), importance)
        importance[fit.used] = abs(fit.best[1:])
        by_scale = fit.map.T @ fit.best
        weights = by_scale[1:] / size
        return Logistic(Linear({names[i]: float(weights[i]) for i in fit.used}, float(by_scale[0] - weights @ center)), importance)

    return [{i: made(fits[j, i]) for i in range(1, k + 1)} for j in range(len(grid))], [made(fits[j, k + 1]) for j in range(len(grid))]


def logistic_out_of_fold(folds: DataFrame, label: str, models: dict[int, Logistic]) -> DataFrame:
    """Probabilities of class 1 for each fold from the rows before it: fold, actual, predicted."""
    own = F.coalesce(*[F.when(F.col("fold") == fold, model.probability()) for fold, model in models.items()])
    return folds.where("fold > 0").select("fold", F.col(label).cast("double").alias("actual"), own.alias("predicted"))
