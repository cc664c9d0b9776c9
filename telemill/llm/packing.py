"""Sum-of-squares online packing of token ids into windows of a fixed length.

What a document has beyond whole windows is an item; N[h] counts the open windows filled to level h, and the item goes
to that level (or to an empty window) for which the sum of N[h]^2 over partly filled windows becomes smallest. Ties go
to the fullest level.

Two passes. In the first each task packs the documents of its input partition as they come, with no shuffle, and
gives out windows as they fill. Items whose windows are still open at its end (a third of the items of a task of 8,000
documents, less of more) are packed again in the second pass, in few tasks of about ``second_tokens`` ids each. Windows
that are open at the end of that one stay as they were placed, but for the emptiest: these are taken apart, and cut,
to fill up the others. So only the last window of a task of the second pass has padding: at most one window for
``second_tokens`` ids, 0.006 % by default.

``max_open`` open windows (64 MB) end a pass early in the same way, which bounds the memory where items never fit
together (all of 600 ids, say).

Sequence ids are the partition's number times 2^32 plus a running number (from 2^62 on in the second pass), and the
first pass is written to the shared folder: a lost task packs the same rows again and gives the same rows.

Defined cases: a null text counts as empty and is the closing id alone; repeated rows are packed each; a very long text
is whole windows and one item; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.token_counts import default_paths, encoder
from telemill.llm.wordhash import slices
from telemill.session import materialize


class SumOfSquares:
    """Fill levels of open windows; ``place`` takes an item and gives the pieces of a window once it is full."""

    def __init__(self, window: int):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def best_level(self, size: int) -> int:
        """The level (0: an empty window) that makes the sum of squares smallest."""
        n, room = self.levels, self.window - size
        there = n[1 : room + 1]
        change = 2 * (n[size + 1 : self.window + 1] - there) + 2
        change[room - 1 :] = 1 - 2 * there[room - 1 :]  # a full window leaves the sum
        change = np.where(there > 0, change, np.iinfo(np.int64).max)
        best = room - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * n[size] + 1 else 0

    def place(self, size: int, item) -> list | None:
        level = self.best_level(size)
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(item)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        self.levels[level + size] += 1
        self.n_open += 1
        return None

    def drain(self) -> list[list]:
        """The open windows, fullest first; none is open then."""
        windows = [pieces for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0
        return windows


def filled_up(windows: list[list[tuple]], window: int) -> Iterator[list[tuple]]:
    """Open windows (fullest first) of items (key, start, ids, total), the emptiest cut up to fill the others; all but one are full."""
    rest, spare = deque(windows), []
    while rest:
        pieces = rest.popleft()
        room = window - sum(len(x[2]) for x in pieces)
        while room and (spare or rest):
            spare = spare or rest.pop()
            doc, start, ids, total = spare.pop()
            pieces.append((doc, start, ids[:room], total))
            if len(ids) > room:
                spare.append((doc, start + room, ids[room:], total))
            room -= min(room, len(ids))
        yield pieces
    if spare:
        yield spare


class _Rows:
    """Rows of pieces as Arrow batches."""

    def __init__(self, schema: T.StructType, kind: pa.DataType, with_ids: bool):
        self.names, self.kind, self.with_ids = schema.names, kind, with_ids
        self.rows: list[tuple] = []
        self.ids: list[np.ndarray | None] = []

    def add(self, doc, start: int, ids: np.ndarray, total: int, sequence: int, offset: int, open_: bool) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, open_))
        self.ids.append(ids if self.with_ids or open_ else None)

    def window(self, pieces: list[tuple], sequence: int) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.add(doc, start, ids, total, sequence, offset, False)
            offset += len(ids)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 8
        arrays = [pa.array(columns[0], self.kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.bool_())]
        sizes = np.array([0, *(0 if x is None else len(x) for x in self.ids)], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *(x for x in self.ids if x is not None)]).astype(np.int32)
        none = pa.array([x is None for x in self.ids], pa.bool_())
        arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat), mask=none))
        self.rows, self.ids = [], []
        return pa.RecordBatch.from_arrays(arrays, self.names)


def pack_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0, paths: tuple[str, str] | None = None,
    max_open: int = 16_384, second_tokens: int = 1 << 24, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids unless ``with_ids`` is off.

    Writes the first pass to the shared folder; the result reads it.
    """
    args = paths or default_paths()
    slim = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [T.StructField("key", slim.schema[0].dataType), *(T.StructField(n, T.LongType()) for n in numbers)]
    schema = T.StructType([*fields, T.StructField("open", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, levels, at, rows = encoder(*args), SumOfSquares(window), TaskContext.get().partitionId() << 32, None

        def hand_over() -> None:
            for pieces in levels.drain():
                for doc, start, ids, total in pieces:
                    rows.add(doc, start, ids, total, -1, 0, True)

        for batch in slices(batches):
            rows = rows or _Rows(schema, batch.schema.field(0).type, with_ids)
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([*e.stream(body.as_py()), np.array([end_id], np.uint32)]).astype("<u4")
                total, whole = len(ids), len(ids) // window * window
                for begin in range(0, whole, window):
                    rows.window([(doc, begin, ids[begin : begin + window], total)], at)
                    at += 1
                if whole < total and (full := levels.place(total - whole, (doc, whole, ids[whole:].copy(), total))):
                    rows.window(full, at)
                    at += 1
                if levels.n_open >= max_open:
                    hand_over()
                if len(rows.rows) >= 1024:
                    yield rows.batch()
        if rows:
            hand_over()
            yield rows.batch()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, at, rows = SumOfSquares(window), (1 << 62) | TaskContext.get().partitionId() << 32, None
        for batch in slices(batches):
            rows = rows or _Rows(schema, batch.schema.field(0).type, with_ids)
            for doc, start, total, ids in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                own = ids.values.to_numpy().astype("<u4")
                if full := levels.place(len(own), (doc, start, own, total)):
                    rows.window(full, at)
                    at += 1
                if levels.n_open >= max_open:
                    for pieces in filled_up(levels.drain(), window):
                        rows.window(pieces, at)
                        at += 1
                if len(rows.rows) >= 1024:
                    yield rows.batch()
        if rows:
            for pieces in filled_up(levels.drain(), window):
                rows.window(pieces, at)
                at += 1
                if len(rows.rows) >= 1024:
                    yield rows.batch()
            yield rows.batch()

    packed = materialize(slim.mapInArrow(first, schema), "packed", by=("open",))
    items = packed.where("open")
    tasks = max(1, -(-(items.agg(F.sum("length")).collect()[0][0] or 0) // second_tokens))
    again = items.select("key", "start", "doc_tokens", "ids").coalesce(tasks).mapInArrow(second, schema)
    out = [F.col("key").alias(key), *numbers, *["ids"] * with_ids]
    return packed.where("not open").select(*out).unionByName(again.select(*out))
