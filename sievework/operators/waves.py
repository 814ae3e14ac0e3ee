"""Precomputed model outputs in waves: each wave is committed by the manifest, a killed
job resumes with the next one."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Versions
from .records import cache_mismatch


def model_map(rows: DataFrame, name: str, make: Callable[[], object], run: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run(model, rows)`` of every batch. A worker process makes the model once, however
    many tasks it works on."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sys.modules.setdefault("sievework_models", types.ModuleType("sievework_models"))
        if not hasattr(held, name):
            setattr(held, name, make())
        for f in frames:
            yield run(getattr(held, name), f)

    return rows.mapInPandas(each, schema)


class Waves:
    """A cache of ``map_(rows)`` by waves of a hash of ``key``, below ``path``.

    ``about`` describes what the outputs depend on; a cache that was made otherwise is an
    error, unless it is begun anew."""

    def __init__(self, spark, path: str, about: dict, n: int, key: str = "id"):
        self.spark, self.versions, self.about, self.n, self.key = spark, Versions(spark, path), about, n, key

    def _state(self) -> tuple[int, dict]:
        at, manifest = self.versions.current()
        return at, manifest or {"about": self.about, "waves": {}, "n": self.n, "of": 0}

    def run(self, rows: DataFrame, map_: Callable[[DataFrame], DataFrame], anew: bool = False) -> int:
        """Make the waves that are missing; how many were made. A row's wave depends on its
        key alone, so it does not matter how far an earlier job came."""
        at, state = self._state()
        differs = cache_mismatch(state["about"], self.about) + (["n"] if state["n"] != self.n else [])
        if differs and not anew:
            raise ValueError(f"the cache was made with other values of {differs}")
        if anew:
            state = {"about": self.about, "waves": {}, "n": self.n, "of": 0}
        made = 0
        for i in range(self.n):
            if str(i) in state["waves"]:
                continue
            name = self.versions.new(f"wave-{i}")
            part = rows.filter(F.pmod(F.xxhash64(self.key), F.lit(self.n)) == i)
            map_(part).write.parquet(f"{self.versions.path}/{name}")
            count = self.spark.read.parquet(f"{self.versions.path}/{name}").count()
            state = {**state, "waves": {**state["waves"], str(i): {"folder": name, "rows": count}}, "of": state["of"] + count}
            if not self.versions.commit(at, state):
                raise RuntimeError("another job writes this cache")
            at, made = at + 1, made + 1
        return made

    def describe(self) -> dict:
        """samples, waves made and wanted, and what the cache was made of."""
        _, state = self._state()
        return {"samples": state["of"], "waves": len(state["waves"]), "of": state["n"], "about": state["about"]}

    def read(self) -> DataFrame:
        """All committed waves."""
        _, state = self._state()
        if not state["waves"]:
            raise ValueError("the cache is empty")
        return self.spark.read.parquet(*[f"{self.versions.path}/{w['folder']}" for w in state["waves"].values()])

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose key the cache lacks."""
        _, state = self._state()
        return rows.join(self.read().select(self.key).distinct(), self.key, "left_anti") if state["waves"] else rows
