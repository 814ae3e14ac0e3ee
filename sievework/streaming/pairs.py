"""A bounded, weighted queue of pairs over streams of several sources.

Rows wait in state, at most ``capacity`` of them in all places together. What comes
beyond makes room first: a source is picked by its weight among those that have rows
waiting, so an exhausted source hands its share on, and a random row of it leaves.
A row thus leaves in shuffled order and exactly once: state and output are committed
by batch, and a batch that is repeated draws the same rows, as the draws depend on
the place's own counter. When no row has come for ``idle`` milliseconds, a timer hands
out what waits, ``step`` rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: The state store that list state and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Line:
    """The rows that wait at one place, by source; ``turn`` counts those handed out."""

    def __init__(self, rows: list[tuple[str, tuple]], turn: int, weights: dict[str, float], seed: tuple):
        self.by: dict[str, list[tuple]] = {}
        for source, row in rows:
            self.by.setdefault(source, []).append(row)
        self.size, self.turn, self.weights, self.seed = len(rows), turn, weights, seed

    def put(self, source: str, row: tuple) -> None:
        self.by.setdefault(source, []).append(row)
        self.size += 1

    def take(self) -> tuple[int, str, tuple]:
        rng = np.random.default_rng((*self.seed, self.turn))
        names = sorted(s for s, rows in self.by.items() if rows)
        w = np.array([max(0.0, self.weights.get(s, 0.0)) for s in names])
        source = names[int(rng.choice(len(names), p=w / w.sum()) if w.sum() > 0 else rng.integers(len(names)))]
        rows = self.by[source]
        at = int(rng.integers(len(rows)))
        rows[at], rows[-1] = rows[-1], rows[at]
        self.turn, self.size = self.turn + 1, self.size - 1
        return self.turn, source, rows.pop()

    def rows(self) -> list[tuple[str, tuple]]:
        return [(s, r) for s in sorted(self.by) for r in self.by[s]]


class PairQueue(StatefulProcessor):
    def __init__(self, columns: list[str], kinds: str, source: str, weights: dict[str, float], capacity: int, idle: int, step: int, seed: int):
        self.columns, self.kinds, self.source, self.weights, self.capacity = columns, kinds, source, weights, capacity
        self.idle, self.step, self.seed = idle, step, seed

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)
        self.turn = handle.getValueState("turn", "turn long")

    def _load(self, place: int) -> Line:
        at = self.columns.index(self.source)
        rows = [tuple(r) for r in self.waiting.get()]
        return Line([(r[at] or "", r) for r in rows], self.turn.get()[0] if self.turn.exists() else 0, self.weights, (self.seed, place))

    def _save(self, line: Line) -> None:
        rows = [r for _, r in line.rows()]
        self.waiting.put(rows) if rows else self.waiting.clear()
        self.turn.update((line.turn,))

    def _out(self, place: int, taken: list[tuple[int, str, tuple]]) -> Iterator[pd.DataFrame]:
        if taken:
            out = pd.DataFrame([r for _, _, r in taken], columns=self.columns)
            out.insert(0, "turn", [t for t, _, _ in taken])
            out.insert(0, "place", np.int32(place))
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        place, at = int(key[0]), self.columns.index(self.source)
        line, taken = self._load(place), []
        for frame in rows:
            for row in frame[self.columns].astype(object).where(frame[self.columns].notna(), None).itertuples(index=False, name=None):
                line.put(row[at] or "", row)
                if line.size > self.capacity:
                    taken.append(line.take())
            yield from self._out(place, taken)
            taken = []
        self._save(line)
        self._wake(timerValues)

    def _wake(self, timers) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        line = self._load(int(key[0]))
        taken = [line.take() for _ in range(min(self.step, line.size))]
        self._save(line)
        if line.size:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)
        yield from self._out(int(key[0]), taken)

    def close(self) -> None:
        pass


def pair_queue(stream: DataFrame, key: str, source: str, weights: dict[str, float], capacity: int = 1000, places: int = 1, idle: int = 60_000, step: int = 1000, seed: int = 42) -> DataFrame:
    """The stream's rows in the order in which the queue hands them out: (place, turn,
    the stream's columns). ``places`` queues of ``capacity`` / ``places`` rows work side
    by side, rows being dealt to them by a hash of ``key``. The session's state store
    must be ``STORE``. While rows wait their timers do, so ``availableNow`` never ends the
    query: stop it when enough is handed out; a later start goes on from there."""
    columns = stream.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    out = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("turn", T.LongType()), *stream.schema.fields])
    work = PairQueue(columns, kinds, source, weights, max(1, capacity // places), idle, step, seed)
    dealt = stream.withColumn("_place", F.pmod(F.xxhash64(key), F.lit(places)).cast("int"))
    return dealt.groupBy("_place").transformWithStateInPandas(work, out, "Append", "ProcessingTime")
