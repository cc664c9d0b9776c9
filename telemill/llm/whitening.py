"""Whitening of embeddings from exact covariances found by polarisation.

Entries become integers x = floor(scale * c) + shift. Three passes, each a sum over tasks:

1. n and the sums S by dimension;
2. for every dimension i and every pair i < j the sum of squares of y_i and of y_i + y_j, where y = x - floor(S / n).
   With r = S - n * floor(S / n), the exact sums of squared centred values are
   D_i = sum (n x_i - S_i)^2 = n^2 sum y_i^2 - n r_i^2 and D_ij = n^2 sum (y_i + y_j)^2 - n (r_i + r_j)^2, and the
   covariance is (D_ij - D_i - D_j) / (2 n^3): a difference of variances, in integers until the last division;
3. the covariance of the whitened values, as a check.

The d x d matrix is assembled on the driver for ``eigh``: its size depends on the dimensions, not on the rows. Tasks hold
one Arrow batch and d (d + 1) / 2 sums; 64-bit integers are used where bounds show that they suffice, Python's elsewhere.

Defined cases: vectors that are null, empty or hold null or non-finite entries are left out, as are those of another
length than the most common one (of equals the longest); repeated rows and rows without an id count each; components
whose eigenvalue is zero up to rounding aren't returned, so one row or equal rows alone give none; a deviation beyond 64
bits is an error; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.wordhash import slices

_WIDE = pa.decimal128(38, 0)
_EXACT = Context(prec=38)
_SQUARES = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DecimalType(38, 0))])


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: n rows, exact sums by dimension, unit eigenvectors as columns, their eigenvalues, and the trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def clean_vectors(df: DataFrame, key: str, vector: str, scale: float, shift: int) -> DataFrame:
    """id, x (array of longs) of the rows that take part."""
    c = F.col(vector)
    fine = ~F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    own = df.select(F.col(key).alias("id"), F.when(fine, c).alias("c")).where("size(c) > 0")
    sizes = own.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform("c", lambda e: F.floor(e.cast("double") * scale).cast("long") + F.lit(shift))
    return own.where(F.size("c") == (sizes["d"] if sizes else 0)).select("id", x.alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _most(y: np.ndarray) -> int:
    return max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0


def _sum_rows(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys = list(totals)
    columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([_EXACT.create_decimal(totals[k]) for k in keys], _WIDE)]
    return pa.RecordBatch.from_arrays(columns, _SQUARES.names)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in slices(batches, rows=4096):
            x = _matrix(batch.column(0))
            part = (x if _most(x) < 1 << 50 else x.astype(object)).sum(axis=0).tolist()
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            n += len(x)
        if n:
            yield _sum_rows({(-1, -1): n} | {(i, i): s for i, s in enumerate(total)})

    rows = vectors.select("x").mapInArrow(run, _SQUARES).groupBy("i").agg(F.sum("s").alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return found.pop(-1, 0), [found[i] for i in range(len(found))]


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Sums over rows of (y_i + y_j)^2 for i < j and of y_i^2 on the diagonal, exact, as objects; zero below it."""
    d = y.shape[1]
    out = np.zeros((d, d), object)
    bound = (2 * _most(y)) ** 2 + 1
    step = (1 << 62) // bound
    if not step:
        y, step = y.astype(object), 1 << 20
    for at in range(0, len(y), step):
        part = y[at : at + step]
        for i in range(d):
            pair = part[:, i : i + 1] + part[:, i:]
            pair[:, 0] = part[:, i]
            out[i, i:] += np.array((pair * pair).sum(axis=0).tolist(), object)
    return out


def centred_squares(vectors: DataFrame, n: int, totals: list[int]) -> np.ndarray:
    """The matrix D of exact integers: sums of squared n x - S by dimension, and by sum of two dimensions above the diagonal."""
    d = len(totals)
    low = [s // n for s in totals]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        seen = False
        for batch in slices(batches, rows=4096):
            total, seen = total + pair_squares(_matrix(batch.column(0)) - np.array(low, np.int64)), True
        if seen:
            yield _sum_rows({(i, j): total[i, j] for i in range(d) for j in range(i, d)})

    rows = vectors.select("x").mapInArrow(run, _SQUARES).groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    out, rest = np.zeros((d, d), object), [s - n * m for s, m in zip(totals, low, strict=True)]
    for i, j, s in zip(*(rows[c].to_pylist() for c in ("i", "j", "s")), strict=True):
        r = rest[i] + (rest[j] if i != j else 0)
        out[i, j] = n * n * int(s) - n * r * r
    return out


def covariance(squares: np.ndarray, n: int) -> np.ndarray:
    """Covariances with divisor n from the matrix of ``centred_squares``; each is rounded once."""
    d = len(squares)
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = squares[i, i] / n**3
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (squares[i, j] - squares[i, i] - squares[j, j]) / (2 * n**3)
    return out


def fit(vectors: DataFrame, most: int = 32) -> Whitening | None:
    """The transform of the vectors with up to ``most`` components, by falling eigenvalue; None without any vector."""
    n, totals = sums(vectors)
    if not n:
        return None
    squares = centred_squares(vectors, n, totals)
    values, columns = np.linalg.eigh(covariance(squares, n))
    values, columns = values[::-1], columns[:, ::-1]
    kept = int((values[:most] > len(values) * np.finfo(float).eps * max(values[0], 0)).sum())
    trace = sum(squares[i, i] for i in range(len(totals))) / n**3
    return Whitening(n, tuple(totals), np.ascontiguousarray(columns[:, :kept]), values[:kept].copy(), trace)


def _centred(x: np.ndarray, n: int, totals: tuple[int, ...]) -> np.ndarray:
    """n x - S, as 64-bit integers where they and the sum of their squares fit, else as Python's."""
    fits = (n * _most(x) + max(map(abs, totals))) < 1 << 62
    shifted = n * x - np.array(totals, np.int64) if fits else n * x.astype(object) - np.array(totals, object)
    return shifted if fits and _most(shifted) ** 2 * x.shape[1] < 1 << 62 else shifted.astype(object)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation, w (array of whitened components) of each vector."""
    schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    n, totals, turn = model.n, model.sums, model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=4096):
            shifted = _centred(_matrix(batch.column(1)), n, totals)
            w = (shifted.astype(float) / n) @ turn
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            deviation = pa.array((shifted * shifted).sum(axis=1).tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], schema.names)

    return vectors.mapInArrow(run, schema)


def identity_error(white: DataFrame) -> float:
    """The largest absolute entry of the covariance of w (divisor n) minus the identity."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("q", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0.0, 0.0
        for batch in slices(batches, rows=4096):
            w = _matrix(batch.column(0))
            n, s, q = n + len(w), s + w.sum(axis=0), q + w.T @ w
        if n:
            d = len(s)
            yield pa.RecordBatch.from_arrays([pa.array([n] * d), pa.array(range(d), pa.int32()), pa.array(s), pa.array(q.tolist(), pa.list_(pa.float64()))], schema.names)

    parts = white.select("w").mapInArrow(run, schema).select("n", "i", "s", F.posexplode("q").alias("j", "q"))
    rows = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    mean = {r["i"]: r["s"] / r["n"] for r in rows}
    return max((abs(r["q"] / r["n"] - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows), default=0.0)


def whitened_components(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, most: int = 32) -> DataFrame:
    """A row for each vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    vectors = clean_vectors(df, key, vector, scale, shift)
    model = fit(vectors, most)
    d = len(model.values) if model else 0
    white = whiten(vectors, model) if d else vectors.select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w"))
    off = identity_error(white) if d else 0.0
    explained = F.array(*(F.lit(float(v) / model.trace) for v in model.values)) if d else F.array().cast("array<double>")
    return white.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("id").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(off).alias("identity_error"),
    )
