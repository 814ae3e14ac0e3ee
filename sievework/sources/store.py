"""A keyed progress store: an append log of field values, compacted, read by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions


class ProgressStore:
    """Rows by ``key``, in which each field has the last value that is not null.

    Writers append parts (``schema`` tells key and fields); a part counts once the
    manifest names it. :meth:`append` with a stream's name and batch number takes a
    batch once, however often it is repeated, which is what ``foreachBatch`` needs to
    resume after a killed job. :meth:`compact` replaces base and log by one part with
    the same content. Of one key's rows within a part the later one in the part wins."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, tries: int = 50):
        self.spark, self.key, self.tries = spark, key, tries
        self.versions = Versions(spark, path)
        self.fields = [c for c in spark.createDataFrame([], schema).columns if c != key]
        self.schema = schema

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Whether the rows were taken: a batch that already counts is passed over."""
        if self._known(self.versions.current()[1], stream, batch):
            return False
        name = self.versions.new("part")
        rows.select(self.key, *self.fields).withColumn("_n", F.monotonically_increasing_id()).write.parquet(f"{self.versions.path}/{name}")
        for _ in range(self.tries):
            at, manifest = self.versions.current()
            if self._known(manifest, stream, batch):
                return False
            manifest = manifest or {"parts": [], "batches": {}}
            batches = manifest["batches"] | ({stream: batch} if stream is not None else {})
            if self.versions.commit(at, {"parts": [*manifest["parts"], name], "batches": batches}):
                return True
        raise RuntimeError("other writers were always first")

    @staticmethod
    def _known(manifest: dict | None, stream: str | None, batch: int | None) -> bool:
        return stream is not None and manifest is not None and manifest["batches"].get(stream, -1) >= batch

    def snapshot(self, version: int | None = None) -> DataFrame:
        """One row a key, of the newest version or an older one that is still there."""
        manifest = self.versions.current()[1] if version is None else self.versions.read(version)
        return self._folded(manifest["parts"] if manifest else [])

    def _folded(self, parts: list[str]) -> DataFrame:
        every = self.spark.createDataFrame([], f"{self.schema}, _n long").withColumn("_v", F.lit(0))
        kind = every.drop("_v").schema
        for v, name in enumerate(parts):
            every = every.unionByName(self.spark.read.schema(kind).parquet(f"{self.versions.path}/{name}").withColumn("_v", F.lit(v)))
        at = F.struct("_v", "_n")
        return every.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in self.fields])

    def pending(self, keys: DataFrame, *done: str) -> DataFrame:
        """The rows of ``keys`` whose ``done`` fields are not all set yet."""
        have = self.snapshot().filter(" AND ".join(f"`{c}` IS NOT NULL" for c in done)).select(self.key)
        return keys.join(have, self.key, "left_anti")

    def compact(self) -> bool:
        """Replace the parts by one; what others append meanwhile stays behind it."""
        _, manifest = self.versions.current()
        if not manifest or len(manifest["parts"]) < 2:
            return False
        old, name = manifest["parts"], self.versions.new("part")
        self._folded(old).withColumn("_n", F.lit(0).cast("long")).write.parquet(f"{self.versions.path}/{name}")
        for _ in range(self.tries):
            at, now = self.versions.current()
            if now["parts"][: len(old)] != old:  # another compaction was first
                return False
            if self.versions.commit(at, {"parts": [name, *now["parts"][len(old) :]], "batches": now["batches"]}):
                return True
        raise RuntimeError("other writers were always first")

    def vacuum(self, keep: int = 1) -> list[str]:
        return self.versions.vacuum(lambda m: m["parts"], keep)

    def sink(self, stream: DataFrame, name: str, checkpoint: str, parts: int = 20, **trigger):
        """Write a stream into the store, compacting after every ``parts`` parts."""

        def step(df: DataFrame, i: int) -> None:
            self.append(df, name, i)
            manifest = self.versions.current()[1]
            if manifest and len(manifest["parts"]) > parts:
                self.compact()

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
