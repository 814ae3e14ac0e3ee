"""The pair queue over files: nothing lost or repeated through restarts, weights, bounds."""

import json
import time
from collections import Counter

import pytest

from sievework.streaming import pairs


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, pairs.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set(key, old)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_line_is_weighted_and_hands_on():
    def order(turn=0):
        line = pairs.Line([("a", (i,)) for i in range(300)] + [("b", (i,)) for i in range(300)] + [("c", (i,)) for i in range(5)], turn, {"a": 3.0, "b": 1.0}, (1, 0))
        return [line.take() for _ in range(605)]

    got = order()
    share = Counter(s for _, s, _ in got[:200])
    assert 120 < share["a"] < 180 and 20 < share["b"] < 80 and not share["c"]
    assert Counter(s for _, s, _ in got) == {"a": 300, "b": 300, "c": 5} and {s for _, s, _ in got[-5:]} == {"c"}  # no weight: last
    assert got == order() and [r for _, s, r in got if s == "a"] != [(i,) for i in range(300)]


def test_queue_survives_a_restart(spark, store, tmp_path):
    source, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    source.mkdir()
    put = lambda name, ids: (source / name).write_text("\n".join(json.dumps({"id": i, "src": "ab"[i % 2], "anchor": f"a{i}", "positive": None if i % 7 == 0 else f"p{i}"}) for i in ids))

    def run(until, idle=3_600_000):
        stream = spark.readStream.schema("id long, src string, anchor string, positive string").option("maxFilesPerTrigger", 1).json(str(source))
        line = pairs.pair_queue(stream, "id", "src", {"a": 2.0, "b": 1.0}, capacity=40, places=2, idle=idle, step=60)
        q = line.writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(check)).trigger(processingTime="0 seconds").start()
        end = time.time() + 120
        while time.time() < end and len(got()) < until:
            time.sleep(1)
        q.stop()

    def got():
        return spark.read.schema("id long, src string, anchor string, positive string, place int, turn long").json(str(out)).collect() if (out / "_spark_metadata").exists() else []

    put("1.json", range(60))
    put("2.json", range(60, 100))
    run(until=60)
    first = got()
    assert 60 <= len(first) < 100 and len({r.id for r in first}) == len(first)  # at most 40 wait
    put("3.json", range(100, 130))
    run(until=130, idle=1000)  # then the timers hand out the rest
    rows = got()
    assert sorted(r.id for r in rows) == list(range(130)) and {tuple(r) for r in first} <= {tuple(r) for r in rows}
    for place in (0, 1):
        assert sorted(r.turn for r in rows if r.place == place) == list(range(1, 1 + sum(r.place == place for r in rows)))
    assert all(r.anchor == f"a{r.id}" and r.positive == (None if r.id % 7 == 0 else f"p{r.id}") for r in rows)
