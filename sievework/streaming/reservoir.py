"""A weighted reservoir over a stream: mergeable, the same after any restart.

Every row has a clock, an exponential variate of rate ``weight`` that a hash of its key
gives, and the ``k`` rows whose clocks ring first are the sample: without replacement,
by weight. So samples of parts merge into that of all, the order of rows and batches
does not matter, and once ``k`` rows are held most rows are passed over by comparing
their clock with the last one held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions


def clock(key: str, weight: Column | None, seed: int = 42) -> Column:
    """When a row's clock rings; null for a weight of 0 or less, or none."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return F.when(w > 0, -F.log((digits + 0.5) / float(16**13)) / w)


class Reservoir:
    """The sample of what streams have brought so far, below ``path``.

    With ``most`` rows seen it stops early: later batches are passed over."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, k: int, weight: str | None = None, seed: int = 42, most: int | None = None):
        self.spark, self.versions, self.key, self.k, self.seed, self.most = spark, Versions(spark, path), key, k, seed, most
        self.columns = spark.createDataFrame([], schema).columns
        self.kind = spark.createDataFrame([], f"{schema}, _clock double").schema
        self.weight = F.col(weight) if weight else None

    def _state(self) -> tuple[int, dict]:
        at, manifest = self.versions.current()
        return at, manifest or {"part": None, "batches": {}, "seen": 0, "last": None}

    def _held(self, state: dict) -> DataFrame:
        empty = self.spark.createDataFrame([], self.kind)
        return self.spark.read.schema(self.kind).parquet(f"{self.versions.path}/{state['part']}") if state["part"] else empty

    def _put(self, rows: DataFrame, at: int, state: dict) -> None:
        name = self.versions.new("sample")
        rows.orderBy("_clock", self.key).limit(self.k).write.parquet(f"{self.versions.path}/{name}")
        held, last = self.spark.read.parquet(f"{self.versions.path}/{name}").agg(F.count("*"), F.max("_clock")).first()
        if not self.versions.commit(at, {**state, "part": name, "last": last if held == self.k else None}):
            raise RuntimeError("another job writes this sample")

    def add(self, rows: DataFrame, stream: str, batch: int) -> bool:
        """Whether the batch was taken; one that was taken before, or comes after an early
        stop, is passed over."""
        at, state = self._state()
        if state["batches"].get(stream, -1) >= batch or (self.most is not None and state["seen"] >= self.most):
            return False
        rung = rows.select(*self.columns).withColumn("_clock", clock(self.key, self.weight, self.seed))
        near = rung.filter(F.col("_clock").isNotNull() & (F.col("_clock") <= state["last"] if state["last"] is not None else F.lit(True)))
        self._put(self._held(state).unionByName(near), at, {**state, "batches": state["batches"] | {stream: batch}, "seen": state["seen"] + rows.count()})
        return True

    def merge(self, other: "Reservoir") -> None:
        """Take the sample of other rows in."""
        at, state = self._state()
        theirs = other._state()[1]
        self._put(self._held(state).unionByName(other._held(theirs)), at, {**state, "seen": state["seen"] + theirs["seen"]})

    def sample(self) -> DataFrame:
        return self._held(self._state()[1]).drop("_clock")

    def sink(self, stream: DataFrame, name: str, checkpoint: str, **trigger):
        """Sample a stream; a killed query goes on where it was."""
        return stream.writeStream.foreachBatch(lambda df, i: self.add(df, name, i)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
