"""The streamed reservoir: one sample whatever the batches, restarts and merges."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.streaming.reservoir import Reservoir, clock

SCHEMA = "id long, w double"


def ids(df):
    return sorted(r.id for r in df.collect())


def test_batches_merges_and_early_stop(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 4)) for i in range(300)] + [(None, None)], SCHEMA).filter("id IS NOT NULL")
    want = ids(rows.withColumn("c", clock("id", F.col("w"))).filter("c IS NOT NULL").orderBy("c").limit(20))
    new = lambda name, **kw: Reservoir(spark, str(tmp_path / name), "id", SCHEMA, 20, "w", **kw)
    a, b, c = new("a"), new("b"), new("c")
    assert a.sample().count() == 0
    for i in range(5):
        assert a.add(rows.filter(F.col("id") % 5 == i), "s", i) and not new("a").add(rows, "s", i)
    assert b.add(rows.filter("id < 100"), "s", 0) and c.add(rows.filter("id >= 100"), "s", 0)
    b.merge(c)
    assert ids(a.sample()) == ids(b.sample()) == want and all(i % 4 for i in want)
    d = new("d", most=150)
    assert d.add(rows.filter("id < 150"), "s", 0) and not d.add(rows.filter("id >= 150"), "s", 1) and max(ids(d.sample())) < 150


def test_weights_are_met(spark):
    rows = spark.range(40_000).select("id", (1 + F.col("id") % 2 * 2).cast("double").alias("w"))
    got = Counter(i % 2 for i in ids(rows.orderBy(clock("id", F.col("w"))).limit(2000)))
    assert 1400 < got[1] < 1600  # three to one


def test_a_stream_restarts_into_the_same_sample(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put = lambda name, part: (source / name).write_text("\n".join(json.dumps({"id": i, "w": 1.0}) for i in part))
    r = Reservoir(spark, str(tmp_path / "r"), "id", SCHEMA, 10, "w")
    run = lambda: r.sink(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source)), "in", str(tmp_path / "c")).awaitTermination()
    put("1.json", range(50))
    run()
    keep, r.add = r.add, lambda *a: (keep(*a), 1 / 0)
    put("2.json", range(50, 90))
    with pytest.raises(Exception):
        run()
    r.add = keep
    put("3.json", range(90, 120))
    run()
    rows = spark.createDataFrame([(i, 1.0) for i in range(120)], SCHEMA)
    assert ids(r.sample()) == ids(rows.orderBy(clock("id", F.col("w"))).limit(10))
