"""Calls to outside services from tasks: limits, backoff, deadlines, a queue with attempts."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """``in_flight`` calls at once and ``rate`` calls a second, over all tasks together;
    ``tries`` of a batch, waiting ``pause`` seconds, doubled each time, between; ``timeout``
    seconds for a call and ``deadline`` for all tries of a batch."""

    in_flight: int = 4
    rate: float | None = None
    tries: int = 3
    pause: float = 0.5
    timeout: float = 60.0
    deadline: float = 300.0


def limited(call: Callable, argument, seconds: float):
    """The call's answer, or an error after ``seconds``: a stalled call is left behind."""
    box: list = []

    def run() -> None:
        try:
            box.append((True, call(argument)))
        except Exception as e:  # noqa: BLE001  # any failure of the service counts
            box.append((False, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimeoutError(f"no answer in {seconds} s")
    ok, value = box[0]
    if not ok:
        raise value
    return value


def ask(items: list[tuple], call: Callable[[list[tuple]], dict], limits: Limits, wait: Callable[[], None] = lambda: None, seed: int = 0) -> dict:
    """{key: (answer or None, tries, error)} of items (key, text). ``call`` answers a dict by
    key, in any order and perhaps not for all; what it left out, or refused together, is
    asked again, one by one after the first failure."""
    rng, end = random.Random(seed), time.monotonic() + limits.deadline
    out = {k: (None, 0, "not asked") for k, _ in items}
    groups = [items]
    for turn in range(limits.tries):
        left = []
        for group in groups:
            if time.monotonic() >= end:
                return {k: (a, n, e if a is not None else "deadline") for k, (a, n, e) in out.items()}
            wait()
            try:
                got, error = limited(call, group, min(limits.timeout, max(0.01, end - time.monotonic()))), "no answer"
            except Exception as e:  # noqa: BLE001
                got, error = {}, f"{type(e).__name__}: {e}"[:200]
            for k, text in group:
                n = out[k][1] + 1
                out[k] = (got[k], n, None) if got.get(k) is not None else (None, n, error)
                if out[k][0] is None:
                    left.append((k, text))
        if not left:
            break
        groups = [[item] for item in left]
        if turn + 1 < limits.tries:
            time.sleep(min(limits.pause * 2**turn * rng.uniform(0.5, 1.0), max(0.0, end - time.monotonic())))
    return out


def external_calls(rows: DataFrame, key: str, text: str, call: Callable[[list[tuple]], dict], batch: int = 8, limits: Limits = Limits()) -> DataFrame:
    """(key, answer, tries, error) of every row. As many tasks as calls may be in flight
    ask one batch after the other; each keeps its part of the rate."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames):
        gap, last = (limits.in_flight / limits.rate if limits.rate else 0.0), [0.0]

        def wait() -> None:
            time.sleep(max(0.0, last[0] + gap - time.monotonic()))
            last[0] = time.monotonic()

        for f in frames:
            items = list(zip(f[key].tolist(), f[text].tolist()))
            for a in range(0, len(items), batch):
                got = ask(items[a : a + batch], call, limits, wait, a)
                yield pd.DataFrame([(k, *v) for k, v in got.items()], columns=[key, "answer", "tries", "error"])

    dealt = rows.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).dropDuplicates([key]).repartition(limits.in_flight)
    return dealt.mapInPandas(run, f"`{key}` {kind}, answer string, tries int, error string")


def external_map(rows: DataFrame, column: str, out: str, call: Callable[[list[str]], list[str]], offline: Callable[[str], str], batch: int = 8, tries: int = 3, limits: Limits | None = None) -> DataFrame:
    """``out`` from ``call`` over batches of distinct values; what has no answer after all
    tries is filled offline."""
    limits = limits or Limits(tries=tries, pause=0.0)

    def by_key(items: list[tuple]) -> dict:
        got = call([t for _, t in items])
        return dict(zip((k for k, _ in items), got)) if len(got) == len(items) else {}

    def fill(frames):
        for f in frames:
            f[out] = [offline(t) if not isinstance(a, str) else a for t, a in zip(f[column], f["answer"])]
            yield f[[column, out]]

    asked = external_calls(rows.select(F.col(column), F.col(column).alias("_text")), column, "_text", by_key, batch, limits)
    return rows.join(asked.mapInPandas(fill, f"{column} string, {out} string"), column, "left")


class ExternalQueue:
    """Texts that wait for a service, with their attempts, in a progress store.

    The store's rows are (key, ``field`` string, attempts int, error string). A turn asks
    at most ``cap`` of the rows without an answer and under ``most`` attempts, those with
    the fewest first, and appends what came of it; what is not asked waits. A job that
    is killed loses the turn's answers only."""

    def __init__(self, store, field: str = "answer", most: int = 3):
        self.store, self.field, self.most = store, field, most

    def waiting(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, text) that are still to ask, with their attempts."""
        key = self.store.key
        state = self.store.snapshot().select(key, self.field, F.coalesce("attempts", F.lit(0)).alias("attempts"))
        known = rows.join(state, key, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
        return known.filter(F.col(self.field).isNull() & (F.col("attempts") < self.most)).drop(self.field)

    def turn(self, rows: DataFrame, text: str, call: Callable, cap: int, batch: int = 8, limits: Limits = Limits()) -> int:
        """Ask one round; how many rows were asked."""
        from ..sources.scratch import written

        key = self.store.key
        asked = written(self.waiting(rows).orderBy("attempts", F.xxhash64(key), key).limit(cap), "asked")
        got = external_calls(asked, key, text, call, batch, limits).join(asked.select(key, "attempts"), key)
        n = asked.count()
        if n:
            self.store.append(got.select(key, F.col("answer").alias(self.field), (F.col("attempts") + 1).cast("int").alias("attempts"), "error"))
        return n

    def answered(self, rows: DataFrame, text: str, offline) -> DataFrame:
        """``rows`` with the answer, by key, and how: external, waiting, or offline where
        all attempts are used up (``offline`` makes a column of the text's)."""
        key = self.store.key
        out = rows.join(self.store.snapshot().select(key, self.field, F.coalesce("attempts", F.lit(0)).alias("_n")), key, "left")
        how = F.when(F.col(self.field).isNotNull(), "external").when(F.coalesce("_n", F.lit(0)) >= self.most, "offline").otherwise("waiting")
        return out.withColumn("how", how).withColumn(self.field, F.when(F.col("how") == "offline", offline(F.col(text))).otherwise(F.col(self.field))).drop("_n")
