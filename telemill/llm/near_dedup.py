"""Near-duplicate groups by min-max hashing, banding and exact confirmation.

Under each permutation both the smallest and the largest value of a document's shingle set are kept, so ``n_perm``
hash evaluations give 2 * n_perm signature values, and each band mixes the extremes of two permutations.

1. One scan gives every document its set size, a 128-bit fingerprint of the set and its band keys.
2. Documents with equal sets form a class under its smallest id; only classes go on, so copies are never paired.
3. In each band bucket the most central class (the one with the most bucket mates over all its buckets) is the pivot,
   and the others are linked with it alone (a star, not all pairs).
4. Linked candidates are confirmed on their full sets, read again from the texts: edges are dealt by pivot and salt
   (at most ``star`` members each), and a task holds one pivot set at a time.
5. Components join the confirmed links. In a bucket whose classes lie in several components, those outside its
   largest one are compared on full sets with all others of the bucket, in blocks of about ``block`` classes and
   ``block_shingles`` shingles a side: no pair becomes a row, only confirmed links do (one for each class and other
   component). Buckets with the same classes are compared once. Pairs inside one component need no confirmation.
6. Where the classes outside the largest component fill more than one block, blocks against blocks would ask for a
   number of texts that grows with the square of the bucket. Such buckets are taken apart by pairs of the bands that
   their classes share, and what is still too wide by triples (``depth`` 2), before blocks are compared.
7. Classes that share only wide buckets, and too few of them for step 6, are found exactly: all classes of wide
   buckets are joined by the rarest shingles of their sets. Sets as alike as asked share one of their first
   n - ceil(percent * n / 100) + 1 shingles in any one order of all shingles; ordered by how often shingles occur, those
   that many classes share come last. Buckets by these shingles are compared in blocks, as wide as they are.

Joins by bucket or by set deal the rows of hot keys to parts. Ids that choose texts are broadcast up to
``broadcast_limit`` of them (30 MB); beyond that the texts are shuffled.

With 24 bands of 4 values a pair at similarity 0.8 meets in no band with probability (1 - 0.8^4)^24 = 3e-6. No pair
that meets in a band is missed.

Words: runs of all but ASCII white space, after lowering A-Z. A set: distinct ``k``-word shingles; with fewer words
the whole sequence. Defined cases: null or wordless texts have an empty set and are linked with nothing; rows with
equal ids are one document, and what is linked with any of its texts is linked with all of them; rows with a null id
are linked with nothing, have a null component and are kept; of equal texts the smallest id is kept; a very long text
is one set, held by the task that makes or compares it (8 bytes a shingle); an empty table gives no rows; extra columns
are ignored by ``near_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.components import components
from telemill.llm.skew import hot_keys, salted_join
from telemill.llm.wordhash import INK, Words, blocks, mix, slices
from telemill.session import discard, materialize

_SEED = 811


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, block in blocks(texts):
        w = Words(block, INK)
        hashes = w.windows(k)
        for i in range(len(block)):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= k:
                yield np.unique(hashes[a : b - k + 1])
            elif b > a:
                yield mix(np.add.reduce(mix(w.hashes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)), keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _signatures(sets: list[np.ndarray], n_perm: int, rows: int) -> tuple[np.ndarray, ...]:
    """Sizes, two fingerprints and band keys (a row for each set)."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(0, 2**63, n_perm, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    n_bands = 2 * n_perm // rows
    bands, one, two = np.zeros((len(sets), n_bands), np.uint64), np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        one[full], two[full] = np.add.reduceat(flat, starts), np.bitwise_xor.reduceat(mix(flat + np.uint64(7)), starts)
        key = np.zeros(len(full), np.uint64)
        for p in range(n_perm):
            values = flat * factors[p]
            key = mix(key * factors[0] + np.minimum.reduceat(values, starts))
            key = mix(key * factors[0] + np.maximum.reduceat(values, starts))
            if (2 * p + 2) % rows == 0:
                band = (2 * p + 2) // rows - 1
                bands[full, band] = mix(key + np.uint64(band))
                key = np.zeros(len(full), np.uint64)
    return sizes, one.view(np.int64), two.view(np.int64), bands.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, k: int, n_perm: int, rows: int) -> DataFrame:
    """id, n_shingles, f1, f2, bands for every row."""
    slim = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([
        T.StructField("id", slim.schema[0].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("f1", T.LongType()),
        T.StructField("f2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            for base, block in blocks(texts):
                sizes, one, two, bands = _signatures(list(shingle_sets(block, k)), n_perm, rows)
                ends = pa.array(np.arange(len(block) + 1, dtype=np.int32) * bands.shape[1])
                lists = pa.ListArray.from_arrays(ends, pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, len(block)), *map(pa.array, (sizes, one, two)), lists], schema.names)

    return slim.mapInArrow(run, schema)


def _texts_for(docs: DataFrame, wanted: DataFrame, broadcast_limit: int) -> DataFrame:
    """``wanted`` (id, ...) joined with the documents' texts; broadcast only below a counted size."""
    small = wanted.count() <= broadcast_limit
    return docs.join(F.broadcast(wanted) if small else wanted, "id")


def confirm(docs: DataFrame, edges: DataFrame, k: int, percent: int, star: int, broadcast_limit: int) -> DataFrame:
    """Those edges (pivot, member, c) whose full sets have 100 * intersection >= percent * union, as (a, b).

    ``docs`` has id, text; c is the size of the largest bucket that gave the edge. A pivot's members are dealt to parts
    of about ``star`` by it, with no need to bring the members of a pivot together; each part gets the pivot's text.
    """
    part = F.pmod(F.xxhash64("member"), F.ceil(F.col("c") / star)).cast("int")
    member = edges.select("pivot", part.alias("part"), F.col("member").alias("id"))
    head = member.select("pivot", "part").distinct().select("pivot", "part", F.col("pivot").alias("id"))
    sides = materialize(member.withColumn("is_member", F.lit(True)).unionByName(head.withColumn("is_member", F.lit(False))), "sides")
    pairs = _texts_for(docs, sides, broadcast_limit).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "is_member")
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in slices(batches):
            pivots, parts, ids, members, texts = (batch.column(c).to_pylist() for c in ("pivot", "part", "id", "is_member", "text"))
            left, right = [], []
            for i, own_set in enumerate(shingle_sets(texts, k)):
                if not members[i]:
                    held, own = (pivots[i], parts[i]), own_set
                elif held == (pivots[i], parts[i]):
                    both = len(np.intersect1d(own, own_set, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(own_set) - both):
                        left.append(pivots[i])
                        right.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, batch.schema.field("pivot").type), pa.array(right, batch.schema.field("id").type)], schema.names)

    return pairs.select("pivot", "part", "id", "is_member", "text").mapInArrow(run, schema)


def _links_in_block(reps: list, roots: list, sets: list[np.ndarray], kinds: list[int], percent: int) -> list[tuple]:
    """Confirmed links (rep, member) from each outsider (kind 0 or 2) to members (kind 1 or 2) of other components, one for each component."""
    sizes = np.array([len(x) for x in sets])
    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    root = np.array([names[r] for r in roots])
    is_member = np.array(kinds) > 0
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]  # texts by shingle
    begin = np.concatenate([[0], np.cumsum(np.bincount(code))])
    ends = np.cumsum(sizes)
    out = []
    for i in np.flatnonzero(np.array(kinds) != 1):
        own = code[ends[i] - sizes[i] : ends[i]]
        span = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero(is_member & (root != root[i]) & (100 * both >= percent * (sizes + sizes[i] - both)))
        _, first = np.unique(root[near], return_index=True)
        out += [(reps[i], reps[j]) for j in near[first]]
    return out


def open_buckets(placed: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """Each bucket of ``placed`` (bucket, rep, n, root) that holds several components, by what its blocks need.

    bucket, main (its largest component), mb and sb (blocks of all its classes and of those outside main), c (classes),
    members (a sum over their ids).
    """
    tallies = placed.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("members"))
    largest = F.max(F.struct("c", "root", "w")).alias("big")
    whole = tallies.groupBy("bucket").agg(largest, F.sum("c").alias("m"), F.sum("w").alias("mw"), F.sum("members").alias("members"), F.count("*").alias("roots"))
    parts = lambda n, w: F.greatest(F.ceil(n / block), F.ceil(w / block_shingles)).cast("int")
    found = whole.where("roots > 1").select(
        "bucket", F.col("big.root").alias("main"), parts(F.col("m"), F.col("mw")).alias("mb"),
        parts(F.col("m") - F.col("big.c"), F.col("mw") - F.col("big.w")).alias("sb"), F.col("m").alias("c"), "members",
    )
    return materialize(found, "open-buckets")


def refined(placed: DataFrame, wide: DataFrame, hot: DataFrame) -> DataFrame:
    """``placed`` one level deeper: the buckets of two wide buckets that differ in their last band alone.

    ``path`` holds the bands of a bucket, in order, but the last, which is ``last``. Two classes that share some number
    of bands, all of them wide, meet in a bucket for each choice of one band more than before.
    """
    inside = salted_join(placed, wide.select("bucket"), ["bucket"], hot, F.col("rep"))
    bands = inside.groupBy("rep", "n", "root", "path").agg(F.sort_array(F.collect_set("last")).alias("lasts"))
    pairs = F.transform("lasts", lambda x, i: F.transform(F.slice("lasts", i + 2, F.size("lasts")), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    deeper = bands.where(F.size("lasts") > 1).withColumn("pair", F.explode(F.flatten(pairs)))
    path = F.concat("path", F.array("pair.x"))
    return deeper.select(F.xxhash64(path, "pair.y").alias("bucket"), "rep", "n", "root", path.alias("path"), F.col("pair.y").alias("last"))


def comparable(placed: DataFrame, hot: DataFrame, depth: int, block: int, block_shingles: int) -> DataFrame:
    """bucket, rep, n, root and main, mb, sb of its bucket, for the buckets whose blocks are to be compared.

    ``placed`` (bucket, rep, n, root) has the classes of all buckets with several components. A bucket whose classes
    outside its largest component fill one block asks for at most about two texts a class. Wider ones are taken apart,
    up to ``depth`` times, by the further bands that their classes share; ``rare_postings`` gives what is lost by that.
    """
    ready, now = None, placed.select("bucket", "rep", "n", "root", F.array().cast("array<bigint>").alias("path"), F.col("bucket").alias("last"))
    for level in range(depth + 1):
        found = open_buckets(now, block, block_shingles)
        narrow = found if level == depth else found.where("sb = 1")
        once = narrow.groupBy("members", "c").agg(F.min(F.struct("bucket", "main", "mb", "sb")).alias("b")).select("b.*")
        here = salted_join(now.drop("path", "last"), once, ["bucket"], hot, F.col("rep"))
        ready = here if ready is None else ready.unionByName(here)
        wide = found.where("sb > 1")
        if level == depth or wide.isEmpty():
            return ready
        now = materialize(refined(now, wide, hot), "refined")
        hot = hot_keys(now.groupBy("bucket").agg(F.count("*").alias("c")), ["bucket"], "c")


def rare_postings(docs: DataFrame, classes: DataFrame, k: int, percent: int, broadcast_limit: int, cells: int = 1 << 20) -> DataFrame:
    """bucket, rep, n, root: each class of ``classes`` (rep, n, root) under the rarest shingles of its set, enough of them to share one with every set that is as alike.

    Shingles are ordered by how often those of their cell occur (``cells`` counts, the same for all tasks), then by
    their hash, so the order is one for all sets. A shingle alone in its cell belongs to one class and is left out.
    """
    texts = _texts_for(docs, classes.select(F.col("rep").alias("id"), "n", "root"), broadcast_limit)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(cells, np.int64)
        for batch in slices(batches):
            for own in shingle_sets(batch.column(0).to_pylist(), k):
                np.add.at(held, (own % np.uint64(cells)).astype(np.int64), 1)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], ["cell", "c"])

    counts = np.zeros(cells, np.int64)
    found = texts.select("text").mapInArrow(tally, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    counts[found.column("cell").to_numpy()] = found.column("c").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("rep", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("root", classes.schema["root"].dataType)])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, rare = list(shingle_sets(batch.column("text").to_pylist(), k)), []
            for own in sets:
                often = shared.value[(own % np.uint64(cells)).astype(np.int64)]
                first = np.lexsort((own, often))[: len(own) - -(-percent * len(own) // 100) + 1]
                rare.append(own[first[often[first] > 1]])
            at = np.repeat(np.arange(len(rare)), [len(x) for x in rare])
            buckets = np.concatenate([np.zeros(0, np.uint64), *rare]).view(np.int64)
            sizes = np.array([len(x) for x in sets], np.int64)[at]
            yield pa.RecordBatch.from_arrays([pa.array(buckets), batch.column("id").take(pa.array(at)), pa.array(sizes), batch.column("root").take(pa.array(at))], schema.names)

    return texts.select("id", "root", "text").mapInArrow(rarest, schema).distinct()


def confirm_rest(docs: DataFrame, classes: DataFrame, k: int, percent: int, block: int, block_shingles: int, broadcast_limit: int) -> DataFrame:
    """All confirmed links (a, b) that are missing between classes (rep, n, root) of different components, by ``rare_postings``."""
    every = materialize(rare_postings(docs, classes, k, percent, broadcast_limit), "rare")
    open_ = every.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c")).where("low < high")
    open_ = materialize(open_.select("bucket", "c"), "open-buckets")
    hot = hot_keys(open_, ["bucket"], "c")
    placed = materialize(salted_join(every, open_.select("bucket"), ["bucket"], hot, F.col("rep")), "open")
    discard(every)
    return confirm_blocks(docs, comparable(placed, hot, 0, block, block_shingles), k, percent, broadcast_limit)


def confirm_blocks(docs: DataFrame, sized: DataFrame, k: int, percent: int, broadcast_limit: int) -> DataFrame:
    """Links (a, b) between classes of one bucket that lie in different components; ``sized`` is made by ``comparable``."""
    outside, dealt = F.col("root") != F.col("main"), F.xxhash64("rep")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    both = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("m"), F.when(outside, 2).otherwise(1).alias("kind")))
    as_member = F.transform(every(F.col("sb")), lambda x: F.struct(x.alias("s"), F.pmod(dealt, F.col("mb")).cast("int").alias("m"), F.lit(1).alias("kind")))
    as_outsider = F.transform(every(F.col("mb")), lambda x: F.struct(F.pmod(dealt, F.col("sb")).cast("int").alias("s"), x.alias("m"), F.lit(0).alias("kind")))
    seats = F.when((F.col("sb") == 1) & (F.col("mb") == 1), both).otherwise(F.concat(as_member, F.when(outside, as_outsider).otherwise(F.slice(as_outsider, 1, 0))))
    seated = sized.withColumn("seat", F.explode(seats)).select("bucket", "seat.s", "seat.m", "seat.kind", "root", F.col("rep").alias("id"))
    seated = materialize(seated, "seated")
    rows = _texts_for(docs, seated, broadcast_limit).repartition("bucket", "s", "m").sortWithinPartitions("bucket", "s", "m")
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, roots, sets, kinds, arrow = None, [], [], [], [], None

        def close() -> pa.RecordBatch:
            links = _links_in_block(reps, roots, sets, kinds, percent) if len(set(roots)) > 1 else []
            for held in (reps, roots, sets, kinds):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], arrow) for i in (0, 1)], schema.names)

        for batch in slices(batches):
            arrow = batch.schema.field("id").type
            columns = [batch.column(c).to_pylist() for c in ("bucket", "s", "m", "id", "root", "kind", "text")]
            for *place, rep, root, kind_, own in zip(*columns[:6], shingle_sets(columns[6], k), strict=True):
                if place != key and reps:
                    yield close()
                key = place
                reps.append(rep)
                roots.append(root)
                sets.append(own)
                kinds.append(kind_)
        if reps:
            yield close()

    return rows.select("bucket", "s", "m", "id", "root", "kind", "text").mapInArrow(run, schema)


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, n_perm: int = 48, rows: int = 4, star: int = 64,
    block: int = 250, block_shingles: int = 1 << 18, depth: int = 2, broadcast_limit: int = 1 << 18,
) -> DataFrame:
    """Per document row: key, n_shingles, component_id (smallest id reachable over confirmed links), kept (it is that id)."""
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).where("id is not null")
    signed = materialize(signatures(docs, key, text, k, n_perm, rows), "signatures")
    equal = ["f1", "f2", "n_shingles"]
    inked = signed.where("n_shingles > 0 and id is not null")
    classes = materialize(inked.groupBy(*equal).agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "classes")
    hot_sets = hot_keys(classes, equal, "copies")

    every = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    mates = materialize(every.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("members")).where("c > 1"), "mates")
    hot = hot_keys(mates, ["bucket"], "c")
    postings = materialize(salted_join(every, mates, ["bucket"], hot, F.col("rep")), "postings")
    discard(mates)

    fits = F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent
    central = postings.groupBy("rep").agg(F.sum("c").alias("mates"))
    pivots = postings.join(central, "rep").groupBy("bucket").agg(F.max(F.struct("mates", -F.xxhash64("rep"), "rep", "n")).alias("p"))
    pivots = pivots.select("bucket", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pn"))
    met = salted_join(postings, pivots, ["bucket"], hot, F.col("rep"))
    edges = met.where((F.col("rep") != F.col("pivot")) & fits).groupBy("pivot", F.col("rep").alias("member")).agg(F.max("c").alias("c"))
    tried = materialize(edges, "tried")
    links = materialize(confirm(own, tried, k, percent, star, broadcast_limit), "links")
    discard(tried)
    labels = classes.select(*equal, "rep")
    several = inked.groupBy("id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low < high").select("id")
    several = materialize(several, "several")
    if not several.isEmpty():  # the texts of one id belong together
        same = salted_join(inked.join(several, "id", "left_semi").select("id", *equal), labels, equal, hot_sets, F.col("id"))
        links = links.unionByName(same.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    roots = components(links)

    placed = postings.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    placed = materialize(salted_join(placed, materialize(open_, "open-buckets"), ["bucket"], hot, F.col("rep")).select("bucket", "rep", "n", "root"), "open")
    discard(postings)
    sized = comparable(placed, hot, depth, block, block_shingles)
    more = materialize(confirm_blocks(own, sized, k, percent, broadcast_limit), "links")
    joined = lambda links, roots: components(links.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    if not more.isEmpty():
        roots = joined(more, roots)
    wide = open_buckets(placed, block, block_shingles).where("sb > 1").select("bucket")
    if depth and not wide.isEmpty():
        inside = salted_join(placed, wide, ["bucket"], hot, F.col("rep")).groupBy("rep").agg(F.max("n").alias("n"))
        inside = inside.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        rest = materialize(confirm_rest(own, materialize(inside, "wide"), k, percent, block, block_shingles, broadcast_limit), "links")
        if not rest.isEmpty():
            roots = joined(rest, roots)
    discard(placed)
    labelled = labels.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*equal, F.coalesce("root", "rep").alias("root"))
    found = salted_join(inked.drop("bands"), labelled, equal, hot_sets, F.col("id"))
    alone = signed.where("not (n_shingles > 0 and id is not null)").select("id", "n_shingles", F.col("id").alias("root"))
    return found.select("id", "n_shingles", "root").unionByName(alone).select(
        F.col("id").alias(key), "n_shingles", F.col("root").alias("component_id"), F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept")
    )
