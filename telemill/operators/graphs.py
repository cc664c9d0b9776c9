"""Graphs, workflow DAGs, block products and version merges as DataFrame loops.

Loops write their state to the shared folder each round or few rounds, which cuts lineage and survives lost executors;
only counts come to the driver. What a round finds is written once, beside that of the rounds before. A loop that
reaches its bound of rounds unfinished is an error. Links of loops lie in bucketed tables, so no round shuffles them.
Workflows up to a size are solved whole by the task that holds them; only larger ones take rounds.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.session import discard, if_small, materialize, scratch_path


def edge_build(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """Edges of each node (column src, 0 to n - 1) to src + 1, src + 2 and one hashed target, modulo n."""
    ends = F.array((F.col("src") + 1) % n, (F.col("src") + 2) % n, F.pmod(F.col("src") * F.lit(2 * seed + 1) + seed, F.lit(n)))
    return nodes.select("src", F.explode(ends).alias("dst"))


@contextmanager
def bucketed(rows: DataFrame, key: str, name: str) -> Iterator[DataFrame]:
    """``rows`` as a table in the shared folder bucketed by ``key``, for the time of a loop.

    It has as many buckets as a shuffle has partitions, so such tables join with each other, and with what is
    aggregated on the same key, where they lie.
    """
    spark, held = rows.sparkSession, f"telemill_{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        dealt = rows.repartition(parts, key).write.bucketBy(parts, key).sortBy(key)
        dealt.format("parquet").option("path", scratch_path(spark, name)).saveAsTable(held)
        yield spark.table(held)
    finally:
        spark.sql(f"drop table if exists {held}")


def rank_round(links: DataFrame, nodes: DataFrame, ranks: DataFrame, n: int, damping: float) -> DataFrame:
    """node, rank after one more round: the ranks meet the links (src, dst, out) by source and are added up by target."""
    given = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
    return nodes.join(given, nodes["node"] == given["dst"], "left").select("node", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """node, rank after ``iterations`` rounds from a uniform start; parallel edges count, ranks of sinks are lost.

    Links are bucketed by source and nodes by id, so a round shuffles what targets are given and nothing else; every
    ``every`` rounds the ranks are written, in buckets too.
    """
    edges = materialize(edges.select("src", "dst"), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    links = edges.join(edges.groupBy("src").agg(F.count("*").alias("out")), "src")
    with ExitStack() as held:
        links = held.enter_context(bucketed(links, "src", "links"))
        nodes = held.enter_context(bucketed(nodes, "node", "nodes"))
        n = nodes.count()
        ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
        for i in range(iterations):
            ranks = rank_round(links, nodes, ranks, n, damping)
            if (i + 1) % every == 0 and i + 1 < iterations:
                ranks = held.enter_context(bucketed(ranks, "node", "ranks"))
        return materialize(ranks, "ranks")


def _unfinished(what: str, rounds: int) -> RuntimeError:
    return RuntimeError(f"{what} isn't finished after {rounds} rounds")


class _Found:
    """Rows that rounds find, each round's in its own folder with its number as a column."""

    def __init__(self, like: DataFrame, label: str, number: str):
        self.spark, self.path, self.number = like.sparkSession, scratch_path(like.sparkSession, label), number
        self.plain = like.schema
        self.whole = T.StructType([*like.schema.fields, T.StructField(number, T.IntegerType())])

    def add(self, rows: DataFrame, at: int) -> DataFrame:
        """Write the rows of round ``at`` and read them back."""
        rows.write.parquet(f"{self.path}/{self.number}={at}")
        return self.spark.read.schema(self.plain).parquet(f"{self.path}/{self.number}={at}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.whole).parquet(self.path)


def bfs(edges: DataFrame, start: int, max_rounds: int = 10_000) -> DataFrame:
    """node, hops from ``start`` over directed edges; nodes out of reach are missing.

    Links are bucketed by source, so a hop shuffles its frontier and no links.
    """
    with bucketed(edges.select("src", "dst").distinct(), "src", "links") as links:
        begin = edges.sparkSession.createDataFrame([(start,)], "node long")
        known = _Found(begin, "bfs", "hops")
        frontier = known.add(begin, 0)
        for hop in range(1, max_rounds):
            frontier = known.add(next_hop(links, frontier).join(known.all(), "node", "left_anti"), hop)
            if frontier.isEmpty():
                return known.all()
    raise _unfinished("the search", max_rounds)


def next_hop(links: DataFrame, frontier: DataFrame) -> DataFrame:
    """The distinct targets (node) of the links (src, dst) of a frontier (node)."""
    return links.join(frontier, links["src"] == frontier["node"]).select(F.col("dst").alias("node")).distinct()


#: Rows of a workflow that one task may hold.
WORKFLOW_ROWS = 100_000


def _whole_workflows(tasks: DataFrame, columns: list[str], solve: Callable[[list[tuple]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """``solve`` applied to the rows (``columns``) of each workflow, which one task holds; it yields rows without the workflow."""
    names = ["workflow_id", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kinds = None, [], None

        def close() -> pa.RecordBatch:
            found = list(solve(held))
            held.clear()
            cells = [[key] * len(found), *([row[i] for row in found] for i in range(len(schema) - 1))]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cells, kinds, strict=True)], schema.names)

        for batch in batches:
            kinds = [batch.schema.field("workflow_id").type, batch.schema.field("node").type, pa.int32()][: len(schema)]
            for workflow, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if workflow != key and held:
                    yield close()
                key = workflow
                held.append(tuple(row))
        if held:
            yield close()

    return tasks.select(*names).repartition("workflow_id").sortWithinPartitions("workflow_id").mapInArrow(run, schema)


def _split_by_size(tasks: DataFrame, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """Rows of workflows of at most ``most`` rows, those of larger ones, and whether there are such; rows without a workflow are in neither."""
    known = tasks.where("workflow_id is not null")
    large = materialize(known.groupBy("workflow_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("workflow_id"), "large")
    mark = if_small(large)
    return known.join(mark, "workflow_id", "left_anti"), known.join(mark, "workflow_id", "left_semi"), not large.isEmpty()


def task_levels(rows: list[tuple]) -> Iterator[tuple]:
    """(node, level) of one workflow's rows (node, parent); level None on and behind cycles; parents outside count for nothing."""
    parents: dict = {node: set() for node, _ in rows}
    children = defaultdict(list)
    for node, parent in set(rows):
        if parent is not None and parent in parents:
            parents[node].add(parent)
            children[parent].append(node)
    left = {node: len(held) for node, held in parents.items()}
    level = {node: 0 for node, n in left.items() if not n}
    ready = list(level)
    while ready:
        node = ready.pop()
        for child in children[node]:
            left[child] -= 1
            level[child] = max(level.get(child, 0), level[node] + 1)
            if not left[child]:
                ready.append(child)
    return ((node, None if left[node] else level[node]) for node in parents)


def dag_levels(tasks: DataFrame, max_rounds: int = 10_000, most: int = WORKFLOW_ROWS) -> DataFrame:
    """Level of each task (one more than its highest parent), many workflows at once; null for tasks on or behind cycles.

    ``tasks`` has workflow_id, node, parent (null for none), a row for each parent. Workflows of at most ``most`` rows
    are solved in one job, whatever their depth; larger ones take a round for each level. Tasks without a workflow have
    no parents there, so their level is 0.
    """
    small, large, any_large = _split_by_size(tasks.select("workflow_id", "node", "parent"), most)
    kind = {f.name: f.dataType for f in tasks.schema}
    schema = T.StructType([T.StructField("workflow_id", kind["workflow_id"]), T.StructField("node", kind["node"]), T.StructField("level", T.IntegerType())])
    solved = _whole_workflows(small, ["node", "parent"], task_levels, schema)
    alone = tasks.where("workflow_id is null").select("workflow_id", "node", F.lit(0).alias("level")).distinct()
    solved = solved.unionByName(alone)
    return solved.unionByName(_levels_by_rounds(large, max_rounds)) if any_large else solved


def _levels_by_rounds(tasks: DataFrame, max_rounds: int) -> DataFrame:
    """The levels of large workflows, one round of joins for each."""
    key = ["workflow_id", "node"]
    parents = materialize(tasks.where("parent is not null").select(*key, "parent").distinct(), "dag-parents")
    left = materialize(tasks.select(*key).distinct(), "dag-left")
    done = _Found(left, "dag-levels", "level")
    for level in range(max_rounds):
        waiting = parents.join(left.select("workflow_id", F.col("node").alias("parent")), ["workflow_id", "parent"], "left_semi").select(*key).distinct()
        ready = done.add(left.join(waiting, key, "left_anti"), level)
        if ready.isEmpty():
            return done.all().unionByName(left.withColumn("level", F.lit(None).cast("int")))
        rest = materialize(left.join(ready, key, "left_anti"), "dag-left")
        discard(left)
        left = rest
    raise _unfinished("the levels", max_rounds)


def dag_validate(tasks: DataFrame, most: int = 1000) -> DataFrame:
    """workflow_id, node, problem: duplicate rows, self-dependencies, unknown parents, and workflows with over ``most`` tasks.

    ``tasks`` may have refs (array of nodes whose results a task's input names): one that isn't a parent is a problem too.
    """
    key = ["workflow_id", "node"]
    nodes = tasks.select(*key).distinct()
    twice = tasks.groupBy(*key, "parent").agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("duplicate").alias("problem"))
    own = tasks.where("node = parent").select(*key, F.lit("self-dependency").alias("problem"))
    known = nodes.select("workflow_id", F.col("node").alias("parent"))
    lost = tasks.where("parent is not null").join(known, ["workflow_id", "parent"], "left_anti").select(*key, F.lit("unknown parent").alias("problem"))
    large = nodes.groupBy("workflow_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("workflow_id", F.lit(None).cast("long").alias("node"), F.lit("too many tasks").alias("problem"))
    found = twice.union(own).union(lost).union(large)
    if "refs" in tasks.columns:
        named = tasks.select(*key, F.explode("refs").alias("parent")).distinct()
        stray = named.join(tasks.where("parent is not null").select(*key, "parent"), [*key, "parent"], "left_anti")
        found = found.union(stray.select(*key, F.lit("reference to a non-parent").alias("problem")))
    return found.distinct()


def cancelled_tasks(rows: list[tuple]) -> Iterator[tuple]:
    """(node,) of one workflow's rows (node, parent, status) that are BLOCKED and below a FAILED one."""
    below = defaultdict(set)
    for node, parent, status in rows:
        if status == "BLOCKED" and parent is not None:
            below[parent].add(node)
    ahead, found = [node for node, _, status in rows if status == "FAILED"], set()
    while ahead:
        fresh = below.pop(ahead.pop(), set()) - found
        found |= fresh
        ahead += fresh
    return ((node,) for node in found)


def dag_cancel(tasks: DataFrame, max_rounds: int = 10_000, most: int = WORKFLOW_ROWS) -> DataFrame:
    """BLOCKED tasks below a FAILED one, over paths of any length whose inner tasks are all BLOCKED.

    Workflows of at most ``most`` rows are solved in one job; larger ones take a round for each step of a path. Tasks
    without a workflow are never below another.
    """
    small, large, any_large = _split_by_size(tasks.select("workflow_id", "node", "parent", "status"), most)
    kind = {f.name: f.dataType for f in tasks.schema}
    schema = T.StructType([T.StructField("workflow_id", kind["workflow_id"]), T.StructField("node", kind["node"])])
    solved = _whole_workflows(small, ["node", "parent", "status"], cancelled_tasks, schema)
    return solved.unionByName(_cancelled_by_rounds(large, max_rounds)) if any_large else solved


def _cancelled_by_rounds(tasks: DataFrame, max_rounds: int) -> DataFrame:
    """The cancelled tasks of large workflows."""
    key = ["workflow_id", "node"]
    blocked = materialize(tasks.where("status = 'BLOCKED' and parent is not null").select(*key, "parent").distinct(), "dag-blocked")
    frontier = tasks.where("status = 'FAILED'").select(*key).distinct()
    found = _Found(blocked.select(*key), "dag-cancelled", "round")
    for at in range(max_rounds):
        below = blocked.join(frontier.select("workflow_id", F.col("node").alias("parent")), ["workflow_id", "parent"], "left_semi").select(*key).distinct()
        frontier = found.add(below.join(found.all(), key, "left_anti") if at else below, at)
        if frontier.isEmpty():
            return found.all().select(*key)
    raise _unfinished("the cancellation", max_rounds)


def dag_ready(tasks: DataFrame) -> DataFrame:
    """BLOCKED tasks whose parents have all COMPLETED (those without parents too)."""
    status = tasks.select("workflow_id", F.col("node").alias("parent"), F.col("status").alias("parent_status")).distinct()
    joined = tasks.where("status = 'BLOCKED'").join(status, ["workflow_id", "parent"], "left")
    good = F.bool_and(F.col("parent").isNull() | F.coalesce(F.col("parent_status") == "COMPLETED", F.lit(False)))
    return joined.groupBy("workflow_id", "node").agg(good.alias("ready")).where("ready").select("workflow_id", "node")


def gram(vectors: DataFrame, column: str, block: int = 4096) -> DataFrame:
    """i, j, value of the product of the transposed matrix with itself; rows are the arrays of ``column``.

    Arrow batches multiply on their partition and only the d x d partial sums are shuffled.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        total = None
        for pdf in batches:
            rows = [np.asarray(v, np.float64) for v in pdf[column] if v is not None]
            if rows:
                m = np.vstack(rows)
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel().astype("int32"), "j": j.ravel().astype("int32"), "value": total.ravel()})

    return vectors.select(column).mapInPandas(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def matrix_rows(cells: DataFrame) -> DataFrame:
    """i and row (array of doubles) from cells i, j, value that fill a matrix."""
    row = F.transform(F.sort_array(F.collect_list(F.struct("j", "value"))), lambda c: c["value"])
    return cells.groupBy("i").agg(row.alias("row"))


def product(left: DataFrame, right: DataFrame, key: str, column: str, shared_bytes: int = 1 << 26) -> DataFrame:
    """key and product: the rows (arrays) of ``column`` times the matrix ``right`` (i from 0, row).

    A right side of at most ``shared_bytes`` is shared with all tasks, which multiply it with Arrow batches of rows;
    a larger one is joined on the inner index and summed by row.
    """
    import numpy as np
    import pandas as pd

    size = right.agg(F.count("*"), F.max(F.size("row"))).collect()[0]
    if size[0] * (size[1] or 0) * 8 <= shared_bytes:
        matrix = left.sparkSession.sparkContext.broadcast(np.array([r["row"] for r in right.orderBy("i").collect()], np.float64))

        def run(batches):
            for pdf in batches:
                own = pdf[pdf[column].notna()]
                if len(own):
                    yield pd.DataFrame({key: own[key], "product": list(np.vstack(own[column].to_numpy()).astype(np.float64) @ matrix.value)})

        kind = left.schema[key].dataType.simpleString()
        return left.select(key, column).mapInPandas(run, f"`{key}` {kind}, product array<double>")
    cells = left.select(key, F.posexplode(column).alias("i", "x")).join(right, "i")
    parts = cells.select(key, F.posexplode(F.transform("row", lambda y: y * F.col("x"))).alias("j", "value")).groupBy(key, "j").agg(F.sum("value").alias("value"))
    return parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "value"))), lambda c: c["value"]).alias("product"))


def lww_merge(log: DataFrame) -> DataFrame:
    """The newest version of each task by (lamport, origin)."""
    return log.groupBy("task_id").agg(F.max(F.struct("lamport", "origin", "op")).alias("v")).select("task_id", "v.*")


def clock_round(offsets: DataFrame, limit_ms: int) -> DataFrame:
    """Per round: upper median, offsets kept within the limit of it, their integer mean (toward zero), and spread before and after."""
    per = offsets.groupBy("round_no").agg(F.sort_array(F.collect_list("offset_ms")).alias("o"))
    median = F.get("o", F.floor(F.size("o") / 2).cast("int"))
    kept = F.filter("o", lambda x: F.abs(x - F.col("median")) <= limit_ms)
    total = F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x)
    spread = lambda c: F.element_at(c, -1) - F.element_at(c, 1)
    out = per.withColumn("median", median).withColumn("kept", kept)
    return out.select(
        "round_no", F.col("median").alias("median_ms"), F.size("kept").cast("long").alias("n_kept"), F.expr("cast(0 as bigint)").alias("_z"),
        total.alias("_t"), spread("o").alias("spread_ms"), spread("kept").alias("kept_spread_ms"),
    ).withColumn("mean_ms", (F.col("_t") / F.col("n_kept")).cast("long")).drop("_z", "_t")
