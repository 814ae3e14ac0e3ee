"""A service that fails, stalls, leaves out and answers out of order; waves that are killed."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions.external import ExternalQueue, Limits, ask, external_calls
from sievework.operators import records, waves
from sievework.sources.store import ProgressStore

QUICK = Limits(in_flight=2, tries=3, pause=0.01, timeout=0.3, deadline=5)


def test_ask_goes_on_until_all_have_answers():
    calls = []

    def service(items):
        calls.append([k for k, _ in items])
        if len(calls) == 1:
            raise ConnectionError("down")
        return {k: t.upper() for k, t in reversed(items) if k != 3}

    got = ask([(i, f"t{i}") for i in range(5)], service, QUICK)
    assert {k: a for k, (a, _, _) in got.items()} == {0: "T0", 1: "T1", 2: "T2", 3: None, 4: "T4"}
    assert got[3] == (None, 3, "no answer") and got[0][1] == 2 and calls[0] == [0, 1, 2, 3, 4] and all(len(c) == 1 for c in calls[1:])


def test_stalls_and_deadlines():
    start = time.monotonic()
    got = ask([(1, "a")], lambda items: time.sleep(30), Limits(tries=2, pause=0.01, timeout=0.2, deadline=5))
    assert got[1][0] is None and got[1][2].startswith("TimeoutError") and time.monotonic() - start < 3
    got = ask([(i, "a") for i in range(50)], lambda items: time.sleep(30), Limits(tries=9, pause=0.01, timeout=0.2, deadline=0.5))
    assert {e for _, _, e in got.values()} == {"deadline"} and time.monotonic() - start < 6


def test_rate_is_shared_by_tasks(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "id long, text string")
    start = time.monotonic()
    got = external_calls(rows, "id", "text", lambda items: {k: t[::-1] for k, t in items}, batch=1, limits=Limits(in_flight=2, rate=8.0)).collect()
    assert {(r.id, r.answer) for r in got} == {(i, f"t{i}"[::-1]) for i in range(12)} and time.monotonic() - start > 1.0


def test_queue_counts_attempts_and_resumes(spark, tmp_path):
    store = ProgressStore(spark, str(tmp_path / "s"), "id", "id long, answer string, attempts int, error string")
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(10)] + [(99, None)], "id long, text string")
    queue = ExternalQueue(store, most=2)
    service = lambda items: {k: t.upper() for k, t in items if k % 5}  # noqa: E731  0 and 5 never have an answer
    assert queue.turn(rows.filter("text IS NOT NULL"), "text", service, cap=6, limits=QUICK) == 6
    again = ExternalQueue(ProgressStore(spark, str(tmp_path / "s"), "id", "id long, answer string, attempts int, error string"), most=2)  # another job
    turns = [again.turn(rows.filter("text IS NOT NULL"), "text", service, cap=6, limits=QUICK) for _ in range(4)]
    assert turns[-1] == 0 and sum(turns) <= 8
    got = {r.id: (r.answer, r.how) for r in again.answered(rows, "text", lambda t: F.concat(F.lit("offline "), t)).collect()}
    assert got == {i: (f"TEXT {i}", "external") if i % 5 else (f"offline text {i}", "offline") for i in range(10)} | {99: (None, "waiting")}


ABOUT = {"hf_dataset": "d", "split": "train", "seed": 1, "image_size": 8, "vision_phase": 2}


def test_waves_resume_after_a_kill(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "id long, text string")
    cache = waves.Waves(spark, str(tmp_path / "w"), ABOUT, 4)

    def embed(part, fail=None):
        def run(model, f):
            assert model == [3]
            return pd.DataFrame({"id": f["id"], "v": [[float(len(t)), model[0]] for t in f["text"]]})

        if fail is not None and cache.describe()["waves"] == fail:
            raise KeyboardInterrupt
        return waves.model_map(part, "three", lambda: [3], run, "id long, v array<double>")

    with pytest.raises(ValueError):
        cache.read()
    with pytest.raises(KeyboardInterrupt):
        cache.run(rows, lambda part: embed(part, fail=2))
    assert cache.describe()["waves"] == 2 and 0 < cache.missing(rows).count() < 200
    resumed = waves.Waves(spark, str(tmp_path / "w"), ABOUT, 4)
    assert resumed.run(rows, embed) == 2 and resumed.run(rows, embed) == 0 and resumed.missing(rows).count() == 0
    got = {r.id: r.v for r in resumed.read().collect()}
    assert got == {i: [float(len(f"t{i}")), 3.0] for i in range(200)} and resumed.describe()["samples"] == 200
    gate = spark.createDataFrame([(resumed.describe()["samples"],)], "n long").select(records.cache_gate(F.col("n"), 100).alias("g")).first().g
    assert (gate.status, gate.warnings) == ("ok", "few")
    other = waves.Waves(spark, str(tmp_path / "w"), ABOUT | {"seed": 2}, 4)
    with pytest.raises(ValueError, match="seed"):
        other.run(rows, embed)
    assert other.run(rows.limit(20), embed, anew=True) == 4 and other.describe()["samples"] == 20
