"""WARC archives written and read as Spark text, with boundary-chain verification.

Writing: one record per row, payloads of equal content once (the row with the smallest id is the response, the others
are revisits). Only digests, sizes and ids are shuffled to find repeated contents; these come back to the rows by a
broadcast of at most ``broadcast_rows`` digests (about 100 bytes each), so no payload moves. With more of them the rows
are joined by shuffle, hot digests in parts. Spark's text writer puts the record's closing line ends.

Reading splits files at every occurrence of the version line, wherever it stands, so archives of any size are read in
parallel. Each occurrence is a candidate record: its header gives the offset of its successor. Offsets come from
prefix sums of the pieces' bytes within input blocks and of the blocks' bytes within files. Which candidates are real
records follows from the chain of successors that begins at the start of the file: within a block every candidate's
way out is resolved in one pass, and pointer jumping over the blocks' ways out marks, in a number of rounds that grows
with the logarithm of the blocks in a file, where the chain enters each block. Version lines inside payloads are left
off the chain and put back into the payload that holds them.

Defined cases: a null payload counts as empty; repeated rows of a response are all responses; null ids are kept as
null and never referred to; line ends and blanks in addresses are percent-coded; an empty table makes an archive
without records; extra columns are ignored; a chain that breaks (a truncated file) ends there; a very long text is one
record, held whole by the task that writes or reads it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemill.llm.skew import hot_keys, salted_join
from telemill.session import discard, materialize, scratch_path

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_of_hex(digest: Column, size: int = 40) -> Column:
    """Bare upper-case base32 of a hexadecimal digest whose length is a multiple of five."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, size + 1, 5)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", broadcast_rows: int = 200_000) -> None:
    """Write one record per row to text files under ``path``."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(key).cast("string").alias("id"), F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"),
        F.octet_length(body).alias("size"), base32_of_hex(F.sha1(body.cast("binary"))).alias("digest"),
    )
    same = ["digest", "size"]
    repeated = materialize(rows.groupBy(*same).agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "warc-repeated")
    if repeated.count() <= broadcast_rows:
        joined = rows.join(F.broadcast(repeated.drop("n")), same, "left")
    else:
        joined = salted_join(rows, repeated.drop("n"), same, hot_keys(repeated, same, "n"), F.col("key"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")) & (F.col("size") >= min_revisit_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    plain = F.regexp_replace(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), " ", "%20")
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("key"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", plain),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("first")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), (F.when(revisit, 0).otherwise(F.col("size")) + len(HTTP)).cast("string"), F.lit(GAP), F.lit(HTTP),
        F.when(revisit, "").otherwise(F.col("body")),
    )
    joined.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, f"(?i)(?:^|\n){name}: *([^\r\n]*)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each version line: file, block, off, succ, tight, header fields, and the payload's size and digest where tight."""
    value = F.col("value")
    head = F.substring_index(value, GAP, 1)
    size = F.octet_length(value)
    length = F.when(head.rlike("(?i)(^|\n)content-length: *[0-9]{1,18}\r?(\n|$)") & F.contains(value, F.lit(GAP)), _field(head, "Content-Length").cast("long"))
    parsed = _pieces(spark, path).select(
        "file", "block", "at", size.cast("long").alias("len"), F.xxhash64(value).alias("h"), F.octet_length(head).alias("head_len"), length.alias("length"),
        *[_field(head, n).alias(a) for n, a in (("WARC-Type", "type"), ("WARC-Record-ID", "id"), ("WARC-Refers-To", "refers"), ("WARC-Payload-Digest", "told_digest"), ("X-Payload-Length", "told_bytes"))],
        value,
    )
    span = F.col("head_len") + 4 + F.col("length") + 4
    tight = F.coalesce(span == F.col("len"), F.lit(False))
    content = F.substring(F.col("value").cast("binary"), F.col("head_len") + 5, F.col("length").cast("int"))
    rows = parsed.withColumn("tight", tight).withColumn("payload", F.when(F.col("tight"), _payload(content)))
    rows = rows.select(
        "file", "block", "at", "len", "h", "head_len", "length", "type", "id", "refers", "told_digest", "told_bytes", "tight",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("tight"), base32_of_hex(F.sha1("payload"))).alias("payload_digest"),
    )
    rows = materialize(rows, "warc-pieces")
    step = F.col("len") + len(MAGIC)
    blocks = rows.groupBy("file", "block").agg(F.sum(step).alias("n"))
    before = blocks.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    within = F.sum(step).over(Window.partitionBy("file", "block").orderBy("at")) - step
    placed = rows.withColumn("within", within).join(before, ["file", "block"]).withColumn("start", F.col("before") + F.col("within"))
    found = placed.where("start > 0").withColumn("off", F.col("start") - len(MAGIC)).withColumn("succ", F.col("start") + F.col("head_len") + 4 + F.col("length") + 4)
    out = materialize(found.drop("before", "within", "start"), "warc-candidates")
    discard(rows)
    return out


def _payload(content: Column) -> Column:
    """What follows the HTTP header of a record's content (all of it where there is none), as bytes."""
    cut = F.octet_length(F.substring_index(content.cast("string"), GAP, 1))
    whole = F.octet_length(content)
    is_http = F.startswith(content.cast("string"), F.lit("HTTP/")) & (cut < whole)
    return F.when(is_http, F.substring(content, cut + 5, whole)).otherwise(content)


def _ways_out(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a block leaves the block; -1 where it breaks."""
    pdf = pdf.sort_values("off")
    last = int(pdf["off"].iloc[-1])
    out: dict[int, int] = {}
    for off, succ in zip(pdf["off"].tolist()[::-1], pdf["succ"].tolist()[::-1], strict=True):
        out[off] = -1 if succ != succ else int(succ) if succ > last else out.get(int(succ), -1)
    return pd.DataFrame({"file": pdf["file"], "off": pdf["off"], "out": [out[x] for x in pdf["off"]]})


def _on_chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that the chain passes, from the block's entry on."""
    entry = pdf["entry"].iloc[0]
    succ = dict(zip(pdf["off"].tolist(), pdf["succ"].tolist(), strict=True))
    seen = set()
    while entry == entry and entry in succ and entry not in seen:
        seen.add(entry)
        entry = succ[entry]
    return pd.DataFrame({"file": pdf["file"], "off": pdf["off"], "real": [x in seen for x in pdf["off"]]})


def verify_chain(found: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The candidates with ``real``: whether the chain from the start of their file reaches them."""
    slim = found.select("file", "block", "off", F.col("succ").cast("double").alias("succ"))
    ways = materialize(slim.groupBy("file", "block").applyInPandas(_ways_out, "file string, off long, out long"), "warc-ways")
    targets = ways.where("out >= 0").select("file", F.col("out").alias("off")).distinct().unionByName(ways.where("off = 0").select("file", "off")).distinct()
    jump = materialize(ways.join(targets, ["file", "off"]).select("file", "off", F.col("out").alias("to")), "warc-jump")
    discard(ways)
    reached = materialize(jump.where("off = 0").select("file", "off"), "warc-reached")
    for _ in range(max_rounds):
        step = jump.join(reached, ["file", "off"], "left_semi").select("file", F.col("to").alias("off")).join(jump.select("file", "off"), ["file", "off"], "left_semi")
        more = step.join(reached, ["file", "off"], "left_anti").distinct()
        wider = materialize(reached.unionByName(more), "warc-reached")
        grown = wider.count() > reached.count()
        discard(reached)
        reached = wider
        if not grown:
            break
        ahead = jump.select("file", F.col("off").alias("to"), F.col("to").alias("next"))
        further = materialize(jump.join(ahead, ["file", "to"], "left").select("file", "off", F.coalesce("next", "to").alias("to")), "warc-jump")
        discard(jump)
        jump = further
    else:
        raise RuntimeError(f"a chain isn't resolved after {max_rounds} rounds")
    entries = slim.join(reached, ["file", "off"], "left_semi").groupBy("file", "block").agg(F.min("off").alias("entry"))
    marked = slim.join(entries, ["file", "block"], "left").withColumn("entry", F.col("entry").cast("double"))
    real = marked.groupBy("file", "block").applyInPandas(_on_chain, "file string, off long, real boolean")
    out = materialize(found.join(real, ["file", "off"]), "warc-real")
    for old in (jump, reached, found):
        discard(old)
    return out


def _spread_payloads(spark: SparkSession, path: str, marked: DataFrame) -> DataFrame:
    """file, off, payload_bytes, payload_digest of real records whose payload holds version lines."""
    rare = marked.where("not real or not tight").select("file", "block", "off", "len", "h", "real", "head_len", "length")
    owner = F.last(F.when(F.col("real"), F.col("off")), True).over(Window.partitionBy("file").orderBy("off"))
    owned = rare.withColumn("owner", owner).where("owner is not null")
    wanted = owned.select("file", "block", "h", "len").distinct()
    texts = _pieces(spark, path).withColumn("h", F.xxhash64("value")).withColumn("len", F.octet_length("value").cast("long")).join(wanted, ["file", "block", "h", "len"])
    bodies = texts.groupBy("file", "block", "h", "len").agg(F.first("value").alias("value"))
    parts = F.sort_array(F.collect_list(F.struct("off", "value")))
    whole = owned.join(bodies, ["file", "block", "h", "len"]).groupBy("file", "owner").agg(
        parts.alias("parts"), F.max(F.when(F.col("off") == F.col("owner"), F.col("head_len"))).alias("head_len"), F.max(F.when(F.col("off") == F.col("owner"), F.col("length"))).alias("length")
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(F.lit(MAGIC), p["value"])), "").cast("binary")
    content = F.substring(text, F.lit(len(MAGIC) + 5) + F.col("head_len"), F.col("length").cast("int"))
    return whole.withColumn("content", content).withColumn("payload", _payload(F.col("content"))).select(
        "file", F.col("owner").alias("off"), F.octet_length("payload").cast("long").alias("b"), base32_of_hex(F.sha1("payload")).alias("d")
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per real record: id, record_type, refers_to, payload_bytes, payload_digest, verified.

    Bytes and digest of a response are measured from its content and compared with its header (verified); those of a
    revisit are what its header says of the full payload.
    """
    marked = verify_chain(candidates(spark, path))
    if not marked.where("not real or not tight").isEmpty():
        spread = _spread_payloads(spark, path, marked)
        marked = marked.join(spread, ["file", "off"], "left").withColumn("payload_bytes", F.coalesce("b", "payload_bytes")).withColumn("payload_digest", F.coalesce("d", "payload_digest"))
    told = F.regexp_replace("told_digest", "^sha1:", "")
    is_visit = F.col("type") == "revisit"
    number = lambda c: F.nullif(F.regexp_extract(c, "urn:page:([^>]*)>", 1), F.lit(""))
    return marked.where("real").select(
        number("id").alias("id"), F.col("type").alias("record_type"), number("refers").alias("refers_to"),
        F.when(is_visit, F.col("told_bytes").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(is_visit, told).otherwise(F.col("payload_digest")).alias("payload_digest"),
        (is_visit | ((F.col("payload_digest") == told) & (F.col("payload_bytes") == F.col("told_bytes").cast("long")))).alias("verified"),
    )
