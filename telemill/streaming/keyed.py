"""A table of the newest row per key that a stream of changes keeps up to date.

Keys are dealt to buckets by hash. A merge reads and rewrites the buckets that its batch touches and leaves the others
where they are; a commit file then names the folder of every bucket. The commit is the one step that counts: what a
failed merge has written before it is never read, and a batch whose number is committed already is left out. All of it
lies in one folder, so a new driver goes on from there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedTable:
    """The newest row (by ``order``) of each ``key`` under ``path``; a null key is a key too."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: tuple[str, ...], buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path, schema, key, order, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: object):
        return self._hadoop.Path("/".join([self.path, *map(str, parts)]))

    def last_commit(self) -> int:
        """The number of the last batch that counts, or -1."""
        top = self._at("commits")
        if not self._fs.exists(top):
            return -1
        names = [f.getPath().getName() for f in self._fs.listStatus(top)]
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def folders(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        last = self.last_commit()
        if last < 0:
            return {}
        stream = self._fs.open(self._at("commits", last))
        try:
            return {int(b): folder for b, folder in json.loads(bytes(stream.readAllBytes()).decode()).items()}
        finally:
            stream.close()

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def rows(self) -> DataFrame:
        return self._read(list(self.folders().values()))

    def merge(self, batch: DataFrame, number: int) -> list[int]:
        """Take in a batch; the buckets that were rewritten (none if ``number`` is committed already)."""
        if number <= self.last_commit():
            return []
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        changes = batch.select(*self.schema.names).withColumn("_bucket", bucket)
        touched = sorted(r["_bucket"] for r in changes.select("_bucket").distinct().collect())
        held = self.folders()
        old = self._read([held[b] for b in touched if b in held]).withColumn("_bucket", bucket)
        rest = [c for c in self.schema.names if c != self.key]
        newest = old.unionByName(changes).groupBy("_bucket", self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_x"))
        folder = f"rows/{number}-{uuid.uuid4().hex}"
        newest.select("_bucket", self.key, "_x.*").select("_bucket", *self.schema.names).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        held |= {b: f"{folder}/_bucket={b}" for b in touched}
        self._commit(held, number)
        return touched

    def _commit(self, folders: dict[int, str], number: int) -> None:
        """Write the commit beside its place and move it there, which either happens or doesn't."""
        draft = self._at("commits", f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(json.dumps(folders).encode())
        out.close()
        if not self._fs.rename(draft, self._at("commits", number)):
            self._fs.delete(draft, False)
            raise RuntimeError(f"batch {number} was committed by another run")

    def vacuum(self) -> int:
        """Delete the folders of batches that no bucket is in any more; how many."""
        used = {f.split("/")[1] for f in self.folders().values()}
        top, gone = self._at("rows"), 0
        for f in self._fs.listStatus(top) if self._fs.exists(top) else []:
            if f.getPath().getName() not in used:
                gone += bool(self._fs.delete(f.getPath(), True))
        return gone
