"""Boosted trees over cells: a fit of bounded size runs in one task, which holds its cells; larger ones by sums over all tasks, a level at a time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators.linear import summed
from telemill.session import discard, materialize

#: Fits over at most so many cells run in one task (about 100 bytes a cell); larger ones by sums over all tasks.
TASK_CELLS = 4_000_000

#: Combinations of ranges that a group of inputs may have to be counted together.
COMBINATIONS = 2048

#: Rounds after which a fit over all tasks writes the scores so far.
ROUNDS_KEPT = 10


class Tree(NamedTuple):
    """A whole tree: the input and cut of each inner node, level by level (no split: all go left), its leaves' values, and the gains by input."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaf(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The leaf (or node of a level) in which rows of ranges ``x`` end."""
        at, rows = np.zeros(len(x), "int64"), np.arange(len(x))
        for level in range(len(self.value).bit_length() - 1 if levels is None else levels):
            own = at + 2**level - 1
            at = 2 * at + (x[rows, self.feature[own]] > self.cut[own])
        return at


def _split(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of weights and sums (2 x nodes x inputs x ranges) each node's best input, cut and gain, and the two sums of its halves (2 x nodes x 2).

    Among inputs that gain alike, but for rounding, the first counts.
    """
    left = sums.cumsum(3)[..., :-1]
    whole = sums.sum(3, keepdims=True)
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]
        real = (left[0] >= 0.5) & (right[0] >= 0.5) & (gain > 1e-10 * np.abs(whole[1] ** 2 / whole[0]))
    gain = np.where(real, gain, 0.0)
    cuts, best = gain.argmax(2), gain.max(2)
    feature = (best >= best.max(1, keepdims=True) * (1 - 1e-9)).argmax(1)
    nodes = np.arange(len(feature))
    cut, top = cuts[nodes, feature], best[nodes, feature]
    halves = np.stack([left[:, nodes, feature, cut], right[:, nodes, feature, cut]], 2)
    none = top <= 0
    halves[:, none, 0], halves[:, none, 1] = whole[:, none, 0, 0], 0.0
    return np.where(none, 0, feature), np.where(none, 255, cut), np.where(none, 0.0, top), halves


def _tree(depth: int, d: int, level_sums) -> Tree:
    """A tree of the sums that ``level_sums(level, feature, cut)`` gives for the nodes of each level, with the splits above it."""
    feature, cut, gains = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(d)
    for level in range(depth):
        f, c, gain, halves = _split(level_sums(level, feature, cut))
        feature, cut = np.append(feature, f), np.append(cut, c)
        np.add.at(gains, f, gain)
    ends = halves.reshape(2, -1)
    return Tree(feature, cut, ends[1] / np.maximum(ends[0], 1e-300), gains)


def _targets(y: np.ndarray, score: np.ndarray | None, classify: bool) -> np.ndarray:
    """What the next tree fits, as in MLlib: the labels (classes: -1 and 1), then the negative gradient of the loss."""
    if score is None:
        return y
    return 4 * y / (1 + np.exp(2 * y * score)) if classify else 2 * (y - score)


def _bundles(x: np.ndarray) -> list[tuple[np.ndarray, list[int], np.ndarray]]:
    """Inputs in groups of few combinations of ranges: each row's combination, the inputs, and the ranges of each combination."""
    most = min(COMBINATIONS, max(64, len(x) // 64))
    groups: list[tuple[np.ndarray, list[int], np.ndarray]] = []
    for f in np.argsort([len(np.unique(x[:, i])) for i in range(x.shape[1])], kind="stable"):
        own, wide = x[:, f].astype("int64"), int(x[:, f].max()) + 1
        found = []
        for i, (code, _, table) in enumerate(groups):
            seen = np.flatnonzero(np.bincount(code * wide + own, minlength=len(table) * wide))
            if len(seen) <= most:
                found.append((len(seen) / len(table), i, seen))
        if not found:
            values, code = np.unique(own, return_inverse=True)
            groups.append((code, [int(f)], values[:, None].astype("uint8")))
            continue
        _, i, seen = min(found, key=lambda v: v[:2])
        code, inputs, table = groups[i]
        place = np.zeros(len(table) * wide, "int64")
        place[seen] = np.arange(len(seen))
        groups[i] = (place[code * wide + own], [*inputs, int(f)], np.column_stack([table[seen // wide], seen % wide]).astype("uint8"))
    return groups


def _grown(x: np.ndarray, w: np.ndarray, y: np.ndarray, rounds: int, depth: int, step: float, classify: bool) -> list[Tree]:
    """All trees over cells in memory; inputs with few combinations are counted together and told apart by the combinations."""
    groups, d, bins = _bundles(x), x.shape[1], int(x.max()) + 2
    order = np.lexsort([code for code, _, _ in groups] + [y])  # the same sums whatever the order of arrival
    groups = [(code[order], inputs, table) for code, inputs, table in groups]
    w, y = w[order], y[order]
    flat_of = [[(np.arange(2 ** max(depth - 1, 0))[:, None] * bins + table[:, j]).ravel() for j in range(len(inputs))] for _, inputs, table in groups]
    score, trees = None, []
    for _ in range(rounds):
        target = w * _targets(y, score, classify)
        node = np.zeros(len(w), "int64")

        def below(m: int, feature: np.ndarray, cut: np.ndarray, flat: list[np.ndarray]) -> np.ndarray:
            """Which rows go right at the ``m`` nodes of a level."""
            right = np.zeros(len(w), "bool")
            for (_, inputs, table), at in zip(groups, flat, strict=True):
                over = np.zeros((m, len(table)), "bool")
                for i in np.flatnonzero(np.isin(feature, inputs) & (cut < 255)):
                    over[i] = table[:, inputs.index(feature[i])] > cut[i]
                if over.any():
                    right |= over.ravel()[at]
            return right

        flat: list[np.ndarray] = []

        def level_sums(level: int, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
            nonlocal node, flat
            m = 2**level
            if level:
                node = 2 * node + below(m // 2, feature[m // 2 - 1 :], cut[m // 2 - 1 :], flat)
            flat = [node * len(table) + code for code, _, table in groups]
            out = np.empty((2, m, d, bins))
            for at, (_, inputs, table), places in zip(flat, groups, flat_of, strict=True):
                for k, v in enumerate((w, target)):
                    sums = np.bincount(at, v, m * len(table))
                    for f, place in zip(inputs, places, strict=True):
                        out[k, :, f] = np.bincount(place[: len(sums)], sums, m * bins).reshape(m, bins)
            return out

        tree = _tree(depth, d, level_sums)
        half = 2 ** (depth - 1)
        gained = tree.value[2 * node + below(half, tree.feature[half - 1 :], tree.cut[half - 1 :], flat)]
        score = gained if score is None else score + step * gained
        trees.append(tree)
    return trees


def _block(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, ...]:
    """The ranges, weights and labels of a batch of packed cells, and the scores so far where it has them."""
    parts = [np.frombuffer(b"".join(c.to_pylist()), kind) for c, kind in zip(batch.columns, ("uint8", "float64", "float64", "float64"), strict=False)]
    return parts[0].reshape(-1, d), *parts[1:]


def _packed(frame: DataFrame, names: list[str], classify: bool) -> DataFrame:
    """The cells of each batch in one row: ranges, weights and labels (classes: -1 and 1)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *x, w, y = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if not np.isfinite(y).all():
                    raise ValueError("labels have missing or infinite values")
                blobs = np.column_stack(x).astype("uint8"), w, 2 * y - 1 if classify else y
                yield pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in blobs], ["x", "w", "y"])

    return frame.select(*names, "_w", F.col("_y").cast("double")).mapInArrow(pack, "x binary, w binary, y binary")


def _in_one_task(packed: DataFrame, d: int, rounds: int, depth: int, step: float, classify: bool) -> list[Tree]:
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_block(batch, d) for batch in batches if batch.num_rows]
        trees = _grown(*[np.concatenate(v) for v in zip(*blocks, strict=True)], rounds, depth, step, classify)
        yield pa.record_batch([pa.array([pickle.dumps([tuple(t) for t in trees])], pa.binary())], ["trees"])

    return [Tree(*t) for t in pickle.loads(packed.repartition(1).mapInArrow(fit, "trees binary").collect()[0]["trees"])]


def _over_all_tasks(packed: DataFrame, d: int, bins: int, rounds: int, depth: int, step: float, classify: bool) -> list[Tree]:
    """Each level of each tree from one sum over all tasks; the driver gets the sums by node, input and range."""
    state, trees, since = materialize(packed, "boosted"), [], 0

    def scored(x: np.ndarray, score: np.ndarray | None, done: list[Tree]) -> np.ndarray | None:
        for tree in done:
            gained = tree.value[tree.leaf(x)]
            score = gained if score is None else score + step * gained
        return score

    for _ in range(rounds):
        if len(trees) - since == ROUNDS_KEPT:
            done = trees[since:]

            def keep(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        x, w, y, *score = _block(batch, d)
                        blobs = x, w, y, scored(x, score[0] if score else None, done)
                        yield pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in blobs], ["x", "w", "y", "score"])

            last, since = state, len(trees)
            state = materialize(state.mapInArrow(keep, "x binary, w binary, y binary, score binary"), "boosted")
            discard(last)

        def level_sums(level: int, feature: np.ndarray, cut: np.ndarray, done=tuple(trees[since:]), state=state) -> np.ndarray:
            m, above = 2**level, Tree(feature, cut, np.zeros(0), np.zeros(0))

            def partial(batch: pa.RecordBatch):
                if batch.num_rows:
                    x, w, y, *score = _block(batch, d)
                    target = w * _targets(y, scored(x, score[0] if score else None, done), classify)
                    at = above.leaf(x, level) * bins
                    yield 0, np.concatenate([np.bincount(at + x[:, f], v, m * bins) for v in (w, target) for f in range(d)])

            return summed(state, partial)[0].reshape(2, d, m, bins).swapaxes(1, 2)

        trees.append(_tree(depth, d, level_sums))
    discard(state)
    return trees


class Boosted(NamedTuple):
    """Boosted trees with what finds the ranges of their inputs; the first tree counts whole, each later one by ``step``."""

    binner: object
    trees: list[Tree]
    step: float
    classify: bool

    @property
    def importance(self) -> np.ndarray:
        """The share of each input in the gains of all trees, as in MLlib."""
        total = sum(t.gain for t in self.trees)
        return total / max(total.sum(), 1e-300)

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with their ranges (b_*) and ``prediction``, for classes the probability of class 1."""
        names = self.binner.getOutputCols()
        known = rows.sparkSession.sparkContext.broadcast(([tuple(t) for t in self.trees], self.step, self.classify))

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            trees, step, classify = known.value
            x = np.column_stack([c.to_numpy() for c in columns]).astype("uint8")
            total = np.zeros(len(x))
            for i, tree in enumerate(trees):
                own = Tree(*tree)
                total += (step if i else 1.0) * own.value[own.leaf(x)]
            return pd.Series(1 / (1 + np.exp(-2 * total)) if classify else total)

        return self.binner.transform(rows).withColumn("prediction", score(*[F.col(c) for c in names]))


def boost(binner, cells: DataFrame, rounds: int, depth: int, step: float, classify: bool, task_cells: int | None = None) -> Boosted:
    """``rounds`` trees of ``depth`` over cells (b_*: ranges, _y: label, _w: rows), by MLlib's losses and steps.

    Up to ``task_cells`` cells meet in one task, which brings all levels and rounds without another job. Of larger
    tables no task holds more than its part, at the price of a job for each level.
    """
    names = binner.getOutputCols()
    packed = _packed(cells, names, classify)
    n = cells.count()
    if not n:
        raise ValueError("no rows to fit")
    if n <= (TASK_CELLS if task_cells is None else task_cells):
        trees = _in_one_task(packed, len(names), rounds, depth, step, classify)
    else:
        bins = int(cells.agg(F.max(F.greatest(F.lit(0), *names))).collect()[0][0]) + 2
        trees = _over_all_tasks(packed, len(names), bins, rounds, depth, step, classify)
    return Boosted(binner, trees, step, classify)
