"""Stateful streams: an exponential mean, a bounded bank, and a bounded pair queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.quality import ranked
from ..operators.sampling import hash_key


def moving_mean(stream: DataFrame, key: str, value: str, order: str, momentum: float = 0.99) -> DataFrame:
    """(key, n, mean): the first value initialises, later ones blend in, in the
    order of ``order`` within a micro-batch."""
    kind = stream.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        for v in pd.concat(list(frames)).sort_values(order)[value]:
            mean = v if n == 0 else momentum * mean + (1 - momentum) * v
            n += 1
        state.update((n, float(mean)))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [float(mean)]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, mean double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)


def bank(stream: DataFrame, key: str, value: str, order: str, capacity: int = 128) -> DataFrame:
    """(key, bank): the last ``capacity`` values of each key, oldest first."""
    kind = stream.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held = (held + [float(v) for v in pd.concat(list(frames)).sort_values(order)[value]])[-capacity:]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "bank": [held]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, bank array<double>", "bank array<double>", "update", GroupStateTimeout.NoTimeout)


def queue(stream: DataFrame, key: str, size: int, take: Callable[[DataFrame, int], None], checkpoint: str, seed: int = 42):
    """Feed ``take`` ``size`` rows a micro-batch, in hash order of those that wait.

    Rows that are not handed out wait in ``checkpoint/held``, a table per batch, and
    come first in line with the next batch; :func:`drain` hands out what waits when
    the stream is over. A batch that is repeated reads the same table again, so none
    is lost; ``take`` gets the batch's number and must accept a repeat."""
    held = f"{checkpoint}/held"

    def step(df: DataFrame, i: int) -> None:
        every = df if not i else df.unionByName(_waiting(df.sparkSession, f"{held}/{i - 1}", df))
        _hand_out(every, key, size, seed, f"{held}/{i}", lambda part: take(part, i))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _waiting(spark, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def _hand_out(rows: DataFrame, key: str, size: int, seed: int, rest: str, take: Callable[[DataFrame], None]) -> int:
    """``size`` rows to ``take``, the others to the table ``rest``; how many those are."""
    line = ranked(rows.withColumn("_order", hash_key(seed, key)), "_order", key).drop("_order")
    line.filter(F.col("rank") > size).drop("rank").write.mode("overwrite").parquet(rest)
    take(line.filter(F.col("rank") <= size).drop("rank"))
    return rows.sparkSession.read.parquet(rest).limit(1).count()


def drain(spark, like: DataFrame, key: str, size: int, take: Callable[[DataFrame, int], None], checkpoint: str, last: int, seed: int = 42) -> None:
    """Hand out what waits after batch ``last``, ``size`` rows a call with numbers
    from ``last + 1`` on."""
    more = True
    while more:
        waiting = _waiting(spark, f"{checkpoint}/held/{last}", like)
        last += 1
        more = bool(_hand_out(waiting, key, size, seed, f"{checkpoint}/held/{last}", lambda part, i=last: take(part, i)))


def tumbling(stream: DataFrame, ts: str, span: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window with a watermark (an extra beyond the reference's own operators)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, span), *keys).count()
