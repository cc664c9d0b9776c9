"""Random forests over cells: rows are drawn and counted by the ranges of their inputs once, and all settings grow their trees from these counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators.linear import summed
from telemill.session import materialize

#: Nodes of at most so many cells are finished in one task (about 100 bytes a cell); larger ones are split by sums over all tasks.
NODE_CELLS = 4_000_000

#: Chances of fewer than 1, 2, 3, ... draws of a row in a bootstrap sample (Poisson with mean 1).
_DRAWS = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))

#: What a task gives of the nodes that it grows, and the kinds of these numbers.
_BLOBS, _KINDS = ["node", "feature", "cut", "value", "gain"], ["int64", "int8", "uint8", "float64", "float64"]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of ``x`` (splitmix64)."""
    x = x.astype("uint64") + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The range of each value: how many inner edges lie at or below it."""
    return np.column_stack([np.searchsorted(e, values[:, i], "right") for i, e in enumerate(edges)]).astype("uint8")


def _matrix(cells: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), "uint8").reshape(-1, d)


class Cells(NamedTuple):
    """Training rows by the ranges of their inputs: names and inner edges of the inputs, and a frame with the ranges (cell) and, per tree t, drawn rows (w_t) and the sum of their labels (s_t); the number of its first tree, and of its cells if that is known."""

    names: list[str]
    edges: list[np.ndarray]
    frame: DataFrame
    trees: int
    first: int = 0
    size: int | None = None


class Rows(NamedTuple):
    """Training rows in narrow form, those of a cell side by side: the ranges of their inputs (cell), a hash of all their columns (key), and the label (y)."""

    names: list[str]
    edges: list[np.ndarray]
    frame: DataFrame
    size: int
    seed: int

    def cells(self, trees: int, first: int = 0) -> Cells:
        """Each row is drawn for each tree as often as a bootstrap sample has it, by its key; the draws are summed by cell as they are read.

        So trees see samples of rows, not of cells, whatever the partitioning; rows that agree in all columns are drawn alike.
        """
        d, seed = len(self.names), self.seed
        columns = [f"{c}_{t}" for c in "ws" for t in range(trees)]

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            salt = _mixed(np.arange(first, first + trees) + (seed << 20))
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, key, y = _matrix(batch.column(0), d), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                start = np.append(0, np.flatnonzero((x[1:] != x[:-1]).any(1)) + 1)
                unit = (_mixed(key.view("uint64")[:, None] ^ salt) >> np.uint64(11)) * 2.0**-53
                n = np.searchsorted(_DRAWS, unit, "right").astype("float64")
                sums = np.hstack([np.add.reduceat(n, start), np.add.reduceat(n * y[:, None], start)])
                x = x[start]
                if held is not None and (held[0] == x[0]).all():
                    sums[0] += held[1]
                elif held is not None:
                    x, sums = np.vstack([held[0], x]), np.vstack([held[1], sums])
                held = x[-1], sums[-1]
                yield _wide(x[:-1], sums[:-1], columns)
            if held is not None:
                yield _wide(held[0][None], held[1][None], columns)

        return Cells(self.names, self.edges, self.frame.mapInArrow(emit, "cell binary, " + ", ".join(f"{c} double" for c in columns)), trees, first, self.size)


def _wide(x: np.ndarray, sums: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), *[pa.array(c) for c in np.ascontiguousarray(sums.T)]], ["cell", *columns])


def narrow_rows(rows: DataFrame, names: list[str], edges: list[list[float]], label, seed: int) -> Rows:
    """The rows as ``Rows``, dealt by cell and written once."""
    inner = [np.array(e) for e in edges]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, y, *x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not np.isfinite(y).all():
                raise ValueError("labels have missing or infinite values")
            yield pa.record_batch([pa.array([r.tobytes() for r in _bins(np.column_stack(x), inner)], pa.binary()), pa.array(key), pa.array(y)], ["cell", "key", "y"])

    keyed = rows.select(F.xxhash64(*rows.columns), label.cast("double"), *[F.col(c).cast("double") for c in names])
    parts = rows.sparkSession.sparkContext.defaultParallelism
    dealt = keyed.mapInArrow(emit, "cell binary, key long, y double").repartition(4 * parts, "cell").sortWithinPartitions("cell", "key", "y")
    frame = materialize(dealt, "drawn-rows")
    return Rows(names, inner, frame, frame.select("cell").distinct().count(), seed)


def _allowed(tree: np.ndarray, node: np.ndarray, d: int, subset: int, seed: int) -> np.ndarray:
    """For each node the inputs it may split by: ``subset`` of ``d``, drawn by tree and node."""
    rank = _mixed(_mixed((tree.astype("uint64") << np.uint64(40)) ^ node.astype("uint64"))[:, None] ^ _mixed(np.arange(d) + (seed << 20)))
    return rank.argsort(axis=1).argsort(axis=1) < subset


def _best_cuts(w: np.ndarray, s: np.ndarray, leasts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of sums by range (nodes x ranges) the cut after which range gains most, and its gain in sum of squares; -inf without one; for each of ``leasts``."""
    left_w, left_s = w.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
    all_w, all_s = w.sum(1, keepdims=True), s.sum(1, keepdims=True)
    right_w, right_s = all_w - left_w, all_s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_w + right_s**2 / right_w - all_s**2 / all_w
        smaller = np.where(gain > 1e-10 * np.abs(all_s**2 / np.maximum(all_w, 1.0)), np.minimum(left_w, right_w), -1.0)
    for least in leasts:
        own = np.where(smaller >= least, gain, -np.inf)
        cut = own.argmax(1)
        yield cut, own[np.arange(len(cut)), cut]


def _best_cut(w: np.ndarray, s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    return next(_best_cuts(w, s, [least]))


def _choose(hist, allowed: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best input (-1 for a leaf), cut and gain of each node; ``hist(f, nodes)`` gives the sums by range of input f for some nodes."""
    m = len(allowed)
    feature, cut, gain = np.full(m, -1), np.zeros(m, "int64"), np.zeros(m)
    for f in range(allowed.shape[1]):
        nodes = np.flatnonzero(allowed[:, f])
        if len(nodes):
            at, own = _best_cut(*hist(f, nodes), least)
            better = own > gain[nodes]
            won = nodes[better]
            feature[won], cut[won], gain[won] = f, at[better], own[better]
    return feature, cut, gain


def _best_splits(x: np.ndarray, w: np.ndarray, s: np.ndarray, size: np.ndarray, inputs: np.ndarray, leasts: list[int], bins: int) -> np.ndarray:
    """For each of ``leasts`` the input (-1 for a leaf), cut and gain of nodes, whose rows lie side by side and which may split by their ``inputs``."""
    m, d = len(size), x.shape[1]
    best = np.zeros((len(leasts), 3, m))
    best[:, 0] = -1
    base, row = np.repeat(np.arange(m) * bins, size), np.arange(len(w)) * d
    for own in inputs.T:
        flat = base + x.ravel()[row + np.repeat(own, size)]
        sums = [np.bincount(flat, v, m * bins).reshape(m, bins) for v in (w, s)]
        for start in range(0, m, 1024):  # as many nodes as stay in the processor's cache
            part = slice(start, start + 1024)
            for i, (cut, gain) in enumerate(_best_cuts(*[v[part] for v in sums], leasts)):
                better = gain > best[i, 2, part]
                best[i][:, part][:, better] = own[part][better], cut[better], gain[better]
    return best


def _subtrees(x: np.ndarray, w: np.ndarray, s: np.ndarray, tree: int, root: int, depth: int, leasts: list[int], subset: int, bins: int, seed: int) -> list[tuple[np.ndarray, ...]]:
    """The nodes below and with ``root`` (a node's children are 2 x node and one more), grown level by level from its cells, for each of ``leasts``.

    Nodes that are alike for all ``leasts`` are grown once; the rows of others go on once for each of their splits.
    Gives numbers, inputs, cuts and mean labels of nodes, and the gains by level and input.
    """
    d, count = x.shape[1], len(leasts)
    out: list[list[tuple]] = [[] for _ in leasts]
    gains = np.zeros((count, max(depth, 1), d))
    ids, size, who = np.array([root]), np.array([len(w)]), np.ones((count, 1), "bool")
    while len(ids):
        m, start = len(ids), np.cumsum(size) - size
        value, level = np.add.reduceat(s, start) / np.add.reduceat(w, start), int(ids[0]).bit_length() - 1
        best = np.tile(np.array([-1.0, 0.0, 0.0])[None, :, None], (count, 1, m))
        if level < depth:
            allowed = _allowed(np.full(m, tree), ids, d, subset, seed)
            best = _best_splits(x, w, s, size, np.nonzero(allowed)[1].reshape(m, -1), leasts, bins)
        feature, cut = best[:, 0].astype("int64"), best[:, 1].astype("int64")
        for i in range(count):
            own = np.flatnonzero(who[i])
            out[i].append((ids[own], feature[i, own], cut[i, own], value[own]))
            split = own[feature[i, own] >= 0]
            np.add.at(gains[i, min(level, len(gains[i]) - 1)], feature[i, split], best[i, 2, split])
        # each node goes on once for each of its splits
        ways, left = [], who & (feature >= 0)
        while left.any():
            node = np.flatnonzero(left.any(0))
            first = left[:, node].argmax(0)
            same = left[:, node] & (feature[:, node] == feature[first, node]) & (cut[:, node] == cut[first, node])
            ways.append((node, feature[first, node], cut[first, node], same))
            left[:, node] &= ~same
        if not ways:
            break
        node, feature, cut = (np.concatenate([way[i] for way in ways]) for i in range(3))
        who, size, start = np.concatenate([way[3] for way in ways], 1), size[node], start[node]
        begin = np.cumsum(size) - size
        rows = np.arange(size.sum()) + np.repeat(start - begin, size)
        right = x.ravel()[rows * d + np.repeat(feature, size)] > np.repeat(cut, size)
        lefts = size - np.add.reduceat(right, begin, dtype="int64")
        before = np.cumsum(right) - right
        before -= np.repeat(before[begin], size)
        at = np.arange(len(rows)) - np.repeat(begin, size)
        order = np.empty(len(rows), "int64")
        order[np.repeat(begin, size) + np.where(right, np.repeat(lefts, size) + before, at - before)] = rows
        x, w, s = x[order], w[order], s[order]
        ids, who = np.column_stack([2 * ids[node], 2 * ids[node] + 1]).ravel(), np.repeat(who, 2, axis=1)
        size = np.column_stack([lefts, size - lefts]).ravel()
    return [(*[np.concatenate(v) for v in zip(*levels, strict=True)], gains[i]) for i, levels in enumerate(out)]


class Forest(NamedTuple):
    """Trees in one list of nodes, a tree's root first: the input and cut of a split (-1: leaf), its left child (the right one follows it) and the mean label."""

    names: list[str]
    edges: list[np.ndarray]
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    importance: np.ndarray
    depth: int

    def sums(self, x: np.ndarray, depths: list[int]) -> list[np.ndarray]:
        """The sum over trees of the mean labels of the nodes in which rows of ranges ``x`` end if trees are cut off at each of ``depths``."""
        place, total = np.arange(len(x)) * x.shape[1], [np.zeros(len(x)) for _ in depths]
        for root, end in zip(self.roots, [*self.roots[1:], len(self.feature)], strict=True):
            feature, cut, left, value = (v[root:end] for v in (self.feature, self.cut, self.left, self.value))
            leaf = feature < 0
            step = (np.where(leaf, np.arange(end - root), left - root) << 16) | (np.where(leaf, 0, feature).astype("int64") << 8) | np.where(leaf, 255, cut).astype("int64")
            at, level = np.zeros(len(x), "int64"), 0
            for out, depth in sorted(zip(total, depths, strict=True), key=lambda v: v[1]):
                for level in range(level, depth):
                    packed = step[at]
                    at = (packed >> 16) + (x.ravel()[place + (packed >> 8 & 255)] > (packed & 255))
                level = depth
                out += value[at]
        return total

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``prediction``, the mean over trees of the mean labels of their leaves."""
        known = rows.sparkSession.sparkContext.broadcast(tuple(self))

        @F.pandas_udf("double")
        def mean(*columns: pd.Series) -> pd.Series:
            forest = Forest(*known.value)
            x = _bins(np.column_stack([c.to_numpy() for c in columns]), forest.edges)
            return pd.Series(forest.sums(x, [forest.depth])[0] / len(forest.roots))

        return rows.withColumn("prediction", mean(*[F.col(c).cast("double") for c in self.names]))


def _forest(cells: Cells, depth: int, grown: list[tuple], gains: np.ndarray) -> Forest:
    """The forest of nodes (tree, numbers, inputs, cuts, mean labels) and of gains by tree and input."""
    tree = np.concatenate([np.full(len(g[1]), g[0], "int64") for g in grown])
    node, feature, cut, value = (np.concatenate([g[i] for g in grown]) for i in range(1, 5))
    whole = (tree << 40) | node
    order = np.argsort(whole, kind="stable")
    whole, feature = whole[order], feature[order].astype("int32")
    left = np.where(feature >= 0, np.searchsorted(whole, whole + (whole & ((1 << 40) - 1))), -1)
    # as in MLlib: gains of each tree sum to 1, then those of the forest
    total = gains.sum(1, keepdims=True)
    share = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).sum(0)
    return Forest(cells.names, cells.edges, np.flatnonzero(node[order] == 1), feature, cut[order].astype("uint8"), left.astype("int64"), value[order], share / max(share.sum(), 1e-300), depth)


def _ends(upper: dict[int, dict[int, tuple[int, int]]], x: np.ndarray, tree: int) -> np.ndarray:
    """The node of a tree in which cells end that follow its splits so far (node -> input, cut)."""
    at = np.ones(len(x), "int64")
    for node, (feature, cut) in sorted(upper[tree].items()):
        here = np.flatnonzero(at == node)
        at[here] = 2 * node + (x[here, feature] > cut)
    return at


def _split_large(cells: Cells, upper: dict, large: list[tuple[int, int]], bins: int) -> dict[tuple[int, int], np.ndarray]:
    """For each of the nodes ``large`` its drawn rows, labels and cells by input and range, summed over all tasks."""
    d, trees = len(cells.names), cells.trees
    by_tree = {t: [(i, node) for i, (own, node) in enumerate(large) if own == t] for t in {t for t, _ in large}}

    def partial(batch: pa.RecordBatch):
        x = _matrix(batch.column(0), d)
        for t, nodes in by_tree.items():
            w, s = (batch.column(1 + k * trees + t).to_numpy() for k in (0, 1))
            ends = _ends(upper, x, t)
            for i, node in nodes:
                own = np.flatnonzero((ends == node) & (w > 0))
                flat = x[own].astype("int64") + np.arange(d) * bins
                if len(own):
                    yield i, np.concatenate([np.bincount(flat.ravel(), np.repeat(v[own], d), d * bins) for v in (w, s, np.ones(len(w)))])

    found = summed(cells.frame.select("cell", *[f"{c}_{t}" for c in "ws" for t in range(trees)]), partial)
    return {node: found[i].reshape(3, d, bins) for i, node in enumerate(large)}


def grow(cells: Cells, depth: int, least: int, subset: int, bins: int, seed: int, node_cells: int | None = None) -> Forest:
    """The forest of ``cells`` with one setting (``grow_all``)."""
    return grow_all(cells, depth, [least], subset, bins, seed, node_cells)[0]


def grow_all(cells: Cells, depth: int, leasts: list[int], subset: int, bins: int, seed: int, node_cells: int | None = None) -> list[Forest]:
    """For each of ``leasts`` the forest of ``cells``: nodes split by the largest gain in variance, with at least so many drawn rows on both sides, down to ``depth``.

    Nodes of more than ``node_cells`` cells are split one level at a time by sums over all tasks, of which the driver gets
    those of the ranges; the cells of each smaller one meet in a task that grows all below it. The driver gets the nodes.
    A forest cut off at a smaller depth is the forest of that depth.
    """
    most = NODE_CELLS if node_cells is None else node_cells
    d, trees, first = len(cells.names), cells.trees, cells.first
    frame, spark = cells.frame, cells.frame.sparkSession
    many = bool(depth) and (frame.count() if cells.size is None else cells.size) > most
    if many and len(leasts) > 1:
        return [grow(cells, depth, least, subset, bins, seed, node_cells) for least in leasts]
    upper: dict[int, dict[int, tuple[int, int]]] = {t: {} for t in range(trees)}
    closed: dict[int, list[int]] = {t: [] for t in range(trees)}
    grown: list[list[tuple]] = [[] for _ in leasts]
    gains = np.zeros((len(leasts), trees, d))
    large = [(t, 1) for t in range(trees)] if many else []
    while large:
        found, below = _split_large(cells, upper, large, bins), []
        for (t, node), (w, s, n) in found.items():
            allowed = _allowed(np.array([first + t]), np.array([node]), d, subset, seed)
            feature, cut, gain = (v[0].item() for v in _choose(lambda f, _, w=w, s=s: (w[f : f + 1], s[f : f + 1]), allowed, leasts[0]))
            grown[0].append((t, [node], [feature], [cut], [s[0].sum() / w[0].sum()]))
            if feature < 0:
                closed[t].append(node)
                continue
            gains[0, t, feature] += gain
            upper[t][node] = (feature, cut)
            for child, side in ((2 * node, slice(0, cut + 1)), (2 * node + 1, slice(cut + 1, None))):
                if child.bit_length() > depth:
                    grown[0].append((t, [child], [-1], [0], [s[feature, side].sum() / w[feature, side].sum()]))
                    closed[t].append(child)
                elif n[feature, side].sum() > most:
                    below.append((t, child))
        large = below

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for t in range(trees):
                w, s = (batch.column(1 + k * trees + t).to_numpy() for k in (0, 1))
                ends = _ends(upper, x, t)
                for node in np.setdiff1d(ends, closed[t]):
                    own = np.flatnonzero((ends == node) & (w > 0))
                    if len(own):
                        blobs = [pa.array([v[own].tobytes()], pa.binary()) for v in (x, w, s)]
                        yield pa.record_batch([pa.array([t], "int32"), pa.array([node], "int64"), *blobs], ["tree", "node", "x", "w", "s"])

    def finish(table: pa.Table) -> pa.Table:
        tree, root = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        blocks = sorted(zip(*[table.column(c).to_pylist() for c in "xws"], strict=True))  # the same sums whatever the order of arrival
        x, w, s = (np.frombuffer(b"".join(v), kind) for v, kind in zip(zip(*blocks, strict=True), ("uint8", "float64", "float64"), strict=True))
        made = _subtrees(x.reshape(-1, d), w, s, first + tree, root, depth, leasts, subset, bins, seed)
        blobs = [[v.astype(kind).tobytes() for v, kind in zip(m, _KINDS, strict=True)] for m in made]
        return pa.table({"least": pa.array(range(len(leasts)), "int32"), "tree": pa.array([tree] * len(leasts), "int32"), **{c: pa.array(list(v), pa.binary()) for c, v in zip(_BLOBS, zip(*blobs, strict=True), strict=True)}})

    dealt = frame.select("cell", *[f"{c}_{t}" for c in "ws" for t in range(trees)]).mapInArrow(deal, "tree int, node long, x binary, w binary, s binary")
    parts = max(spark.sparkContext.defaultParallelism, len(upper) + sum(map(len, upper.values())))
    done = dealt.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(finish, "least int, tree int, " + ", ".join(f"{c} binary" for c in _BLOBS))
    for r in done.collect():
        node, feature, cut, value, gain = (np.frombuffer(r[c], kind) for c, kind in zip(_BLOBS, _KINDS, strict=True))
        grown[r["least"]].append((r["tree"], node, feature, cut, value))
        gains[r["least"], r["tree"]] += gain.reshape(-1, d).sum(0)
    return [_forest(cells, depth, own, gain) for own, gain in zip(grown, gains, strict=True)]


def to_score(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Of rows with an actual value and inputs: actual, the ranges of the inputs (cell), and no sums of scores yet."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _bins(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]), edges)
                yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.nulls(len(x), pa.list_(pa.float64()))], ["actual", "cell", "sums"])

    doubles = rows.select(*[F.col(c).cast("double") for c in rows.columns])
    return doubles.mapInArrow(emit, "actual double, cell binary, sums array<double>")


def add_scores(state: DataFrame, forests: list[Forest], depths: list[int]) -> DataFrame:
    """What ``to_score`` gives with the sums over the trees of ``forests`` added, for each forest cut off at each depth."""
    known, width = state.sparkSession.sparkContext.broadcast([tuple(f) for f in forests]), len(forests) * len(depths)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                grown = [Forest(*f) for f in known.value]
                cells, at = np.unique(np.array(batch.column(1).to_pylist(), f"V{len(grown[0].names)}"), return_inverse=True)
                x = cells.view("uint8").reshape(len(cells), -1)
                sums = np.column_stack([v for f in grown for v in f.sums(x, depths)])[at]
                if not batch.column(2).null_count:
                    sums += batch.column(2).flatten().to_numpy().reshape(-1, width)
                ends = pa.array(np.arange(0, sums.size + 1, width, dtype="int32"))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], ["actual", "cell", "sums"])

    return state.mapInArrow(emit, "actual double, cell binary, sums array<double>")
