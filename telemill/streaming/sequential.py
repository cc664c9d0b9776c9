"""Rules whose verdict on a row depends on the verdicts before it, over series of any length.

Series are cut into ranges of equal depth (``numbering.placed``). A range is summed up once as a function of what comes
before it, the functions are put together, and each range is then walked with its own start:

* Spacing rules keep a row at least ``gap`` after the last kept one, so each row has a successor: the next row kept if it
  is. A range gives, for each run of its rows that lead to the same last kept row, where that row's successor may begin.
  An as-of join finds the run it falls into, and doubling the links finds the runs on the path from the first row.
* A token bucket maps its level at a range's first row to that after its last: a few pieces, rising with the level or
  flat, as refills end at the burst and each allowed row takes one token. Levels are whole numbers of the rate's
  denominator, so the walk is exact; the rate is the decimal number that it is written as. Only these pieces meet by key.

Times are whole numbers. Rows without one are kept (sent, allowed) and change nothing; rows without a key are a series of
their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.operators.numbering import RANGE_ROWS, asof, placed
from telemill.session import discard, if_small, materialize


def successors(t: np.ndarray, gap: int) -> np.ndarray:
    """For each time (in order) the index of the first later one at least ``gap`` after it, or their number."""
    return np.maximum(np.searchsorted(t, t + gap), np.arange(1, len(t) + 1))


def last_kept(after: np.ndarray) -> np.ndarray:
    """For each row the last row that its chain of successors reaches, by doubling."""
    n = len(after)
    now = np.where(after < n, after, np.arange(n))
    while True:
        further = now[now]
        if (further == now).all():
            return now
        now = further


def _runs(rows: DataFrame, at: str, gap: int) -> DataFrame:
    """A row for each run of rows of a range with one last kept row: _k, _b, node (place of its first row), end (time of its last row), exit (the time from which that kept row's successor may come), last (its place)."""
    schema = T.StructType([rows.schema["_k"], rows.schema["_b"], *(T.StructField(c, T.LongType()) for c in ("node", "end", "exit", "last"))])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        t, place = table.column(at).to_numpy(), table.column("_at").to_numpy()
        last = last_kept(successors(t, gap))
        first = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        ends = np.concatenate([first[1:] - 1, [len(t) - 1]])
        found = [pa.array(c.astype(np.int64)) for c in (place[first], t[ends], t[last[first]] + gap, place[last[first]])]
        return pa.Table.from_arrays([table.column("_k").take(pa.array(first)), table.column("_b").take(pa.array(first)), *found], schema.names)

    return rows.groupBy("_k", "_b").applyInArrow(run, schema)


def _on_path(links: DataFrame, roots: DataFrame, rounds: int = 64) -> DataFrame:
    """_k, node of all nodes on the paths from ``roots`` over ``links`` (_k, node, to), each round twice as far."""
    reached, jump = materialize(roots, "reached"), materialize(links.select("_k", "node", "to"), "jump")
    for _ in range(rounds):
        fresh = materialize(jump.join(reached, ["_k", "node"], "left_semi").select("_k", F.col("to").alias("node")), "reached")
        if fresh.isEmpty():
            return reached
        reached = materialize(reached.unionByName(fresh), "reached")
        second = jump.select("_k", F.col("node").alias("to"), F.col("to").alias("next"))
        twice = materialize(jump.join(second, ["_k", "to"]).select("_k", "node", F.col("next").alias("to")), "jump")
        discard(jump)
        jump = twice
    raise RuntimeError(f"paths are longer than 2^{rounds}")


def _several(rows: DataFrame) -> DataFrame:
    """The keys that lie in more than one range."""
    return materialize(rows.groupBy("_k").agg(F.min("_b").alias("low"), F.max("_b").alias("high")).where("low < high").select("_k"), "several")


def _walked(rows: DataFrame, entries: DataFrame | None, made: list[T.StructField], walk: Callable[[pa.Table], list[list]], out: list[str]) -> DataFrame:
    """``out`` and what ``walk`` makes of each range with its entry; rows are those with a time."""
    ready = rows if entries is None else rows.join(if_small(entries), ["_k", "_b"], "left")
    fields = {f.name: f for f in rows.schema}
    schema = T.StructType([*(fields[c] for c in out), *made])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        columns = [table.column(c) for c in out]
        return pa.Table.from_arrays([*columns, *(pa.array(c) for c in walk(table))], schema.names)

    return ready.groupBy("_k", "_b").applyInArrow(run, schema)


def _timed(rows: DataFrame, by: tuple[str, ...], at: str, tie: str, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a time, placed in ranges, and those without."""
    return placed(rows.where(F.col(at).isNotNull()), (at, tie), by, range_rows), rows.where(F.col(at).isNull())


def spaced(rows: DataFrame, by: tuple[str, ...], at: str, tie: str, gap: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add kept (at least ``gap`` after the last kept row of the key) and dropped (rows dropped between the last kept row and this one, if it is kept)."""
    if gap <= 0:
        return rows.withColumn("kept", F.lit(True)).withColumn("dropped", F.lit(0).cast("long"))
    timed, untimed = _timed(rows, by, at, tie, range_rows)
    several, entries = _several(timed), None
    if not several.isEmpty():
        runs = materialize(_runs(timed.join(if_small(several), "_k", "left_semi").select("_k", "_b", "_at", at), at, gap), "runs")
        facts = runs.select(F.col("_k").alias("key"), (-F.col("end")).alias("_e"), (-F.col("node")).alias("_order"), "node", F.col("_b").alias("range"))
        probes = runs.select(F.col("_k").alias("key"), "node", "exit", "last", (-F.col("exit")).alias("_from"))
        found = asof(probes, facts, "key", "_from", "_e", {"to": "node", "to_b": "range"}, tie="_order").where("to is not null")
        links = materialize(found.select(F.col("key").alias("_k"), "node", "to", "to_b", "exit", "last"), "links")
        path = _on_path(links, runs.where("node = 0").select("_k", "node"))
        entries = materialize(links.join(path, ["_k", "node"], "left_semi").select("_k", F.col("to_b").alias("_b"), F.col("exit").alias("_exit"), F.col("last").alias("_last")), "entries")

    joined = entries is not None

    def walk(table: pa.Table) -> list[list]:
        t, place = table.column(at).to_numpy(), table.column("_at").to_pylist()
        after = successors(t, gap).tolist()
        kept, dropped, i, last = [False] * len(t), [0] * len(t), len(t), -1
        if place[0] == 0:
            i = 0
        elif joined and (start := table.column("_exit")[0].as_py()) is not None:
            i, last = int(np.searchsorted(t, start)), table.column("_last")[0].as_py()
        while i < len(t):
            kept[i], dropped[i], last = True, place[i] - last - 1, place[i]
            i = after[i]
        return [pa.array(kept), pa.array(dropped, pa.int64())]

    made = [T.StructField("kept", T.BooleanType()), T.StructField("dropped", T.LongType())]
    return _walked(timed, entries, made, walk, rows.columns).unionByName(untimed.withColumn("kept", F.lit(True)).withColumn("dropped", F.lit(0).cast("long")))


def dedupe_within(rows: DataFrame, by: tuple[str, ...], at: str, tie: str, reach: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add kept: a marker is dropped if a kept one of its key lies at most ``reach`` before it."""
    return spaced(rows, by, at, tie, reach + 1, range_rows).drop("dropped")


def suppress_alerts(rows: DataFrame, by: tuple[str, ...], at: str, tie: str, interval: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add sent (at least ``interval`` since the last sent one of the key) and suppressed (how many were held back since)."""
    return spaced(rows, by, at, tie, interval, range_rows).withColumnsRenamed({"kept": "sent", "dropped": "suppressed"})


class Bucket:
    """A token bucket in whole numbers: a token is ``unit``, a time unit brings ``rate``, and the level is at most ``full``."""

    def __init__(self, burst: int, per_unit: float):
        per = Fraction(repr(per_unit)) if isinstance(per_unit, float) else Fraction(per_unit)
        self.unit, self.rate, self.full = per.denominator, per.numerator, burst * per.denominator

    def walk(self, level: int, times: list[int]) -> tuple[list[bool], int]:
        """Which rows are allowed, from the level at the first of them, and the level after the last."""
        out, before = [], times[0]
        for t in times:
            level = min(self.full, level + (t - before) * self.rate)
            out.append(level >= self.unit)
            level, before = level - self.unit * out[-1], t
        return out, level

    def pieces(self, times: list[int]) -> list[tuple[int, int, int]]:
        """The level after the last row as a function of that at the first: (from, rises, value there), by from.

        A piece rises with the level (1) or is flat (0). Neighbours that go on in one another are one piece.
        """
        parts, before = [(0, 1, 0)], times[0]
        for t in times:
            parts = self._joined(self._taken(self._filled(parts, (t - before) * self.rate)))
            before = t
        return parts

    def _ends(self, parts: list) -> Iterator[tuple[int, int, int, int]]:
        for i, (begin, rises, value) in enumerate(parts):
            yield begin, (parts[i + 1][0] if i + 1 < len(parts) else self.full + 1), rises, value

    def _filled(self, parts: list, more: int) -> list:
        out = []
        for begin, end, rises, value in self._ends(parts):
            at = begin + self.full - value - more if rises else (begin if value + more >= self.full else end)
            if at > begin:
                out.append((begin, rises, value + more))
            if at < end:
                out.append((max(at, begin), 0, self.full))
        return out

    def _taken(self, parts: list) -> list:
        out = []
        for begin, end, rises, value in self._ends(parts):
            at = begin + self.unit - value if rises else (begin if value >= self.unit else end)
            if at > begin:
                out.append((begin, rises, value))
            if at < end:
                begin, value = (at, value + rises * (at - begin)) if at > begin else (begin, value)
                out.append((begin, rises, value - self.unit))
        return out

    @staticmethod
    def _joined(parts: list) -> list:
        out = [parts[0]]
        for begin, rises, value in parts[1:]:
            first, rose, old = out[-1]
            if rises != rose or value != old + rises * (begin - first):
                out.append((begin, rises, value))
        return out


def _starts(summaries: DataFrame, bucket: Bucket) -> DataFrame:
    """_k, _b, level at the first row of each range, from the pieces of the ranges before it."""
    schema = T.StructType([summaries.schema["_k"], summaries.schema["_b"], T.StructField("_level", T.StringType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_b")
        level, before, out = bucket.full, None, []
        for first, last, pieces in zip(*(table.column(c).to_pylist() for c in ("first", "last", "pieces")), strict=True):
            level = level if before is None else min(bucket.full, level + (first - before) * bucket.rate)
            out.append(str(level))
            begin, rises, value = max(x for x in (tuple(map(int, p.split())) for p in pieces) if x[0] <= level)
            level, before = value + rises * (level - begin), last
        return pa.Table.from_arrays([table.column("_k"), table.column("_b"), pa.array(out, pa.string())], schema.names)

    return summaries.groupBy("_k").applyInArrow(run, schema)


def token_bucket(rows: DataFrame, by: tuple[str, ...], at: str, tie: str, burst: int, per_unit: float, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add allowed: a bucket of ``burst`` tokens refilled by ``per_unit`` a time unit, from which each allowed row takes one."""
    bucket = Bucket(burst, per_unit)
    timed, untimed = _timed(rows, by, at, tie, range_rows)
    several, entries = _several(timed), None
    if not several.isEmpty():
        own = timed.join(if_small(several), "_k", "left_semi").select("_k", "_b", "_at", at)
        schema = T.StructType([own.schema["_k"], own.schema["_b"], T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("pieces", T.ArrayType(T.StringType()))])

        def run(table: pa.Table) -> pa.Table:
            times = table.sort_by("_at").column(at).to_pylist()
            pieces = [" ".join(map(str, p)) for p in bucket.pieces(times)]
            found = [pa.array([x], kind) for x, kind in ((times[0], pa.int64()), (times[-1], pa.int64()), (pieces, pa.list_(pa.string())))]
            return pa.Table.from_arrays([table.column("_k").slice(0, 1), table.column("_b").slice(0, 1), *found], schema.names)

        entries = materialize(_starts(materialize(own.groupBy("_k", "_b").applyInArrow(run, schema), "bucket-maps"), bucket), "levels")

    joined = entries is not None

    def walk(table: pa.Table) -> list[list]:
        known = table.column("_level")[0].as_py() if joined else None
        return [pa.array(bucket.walk(bucket.full if known is None else int(known), table.column(at).to_pylist())[0])]

    return _walked(timed, entries, [T.StructField("allowed", T.BooleanType())], walk, rows.columns).unionByName(untimed.withColumn("allowed", F.lit(True)))
