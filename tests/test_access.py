"""Ordinals and ragged batches against lists."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievework.operators import ragged
from sievework.sources import ordinals


@pytest.fixture
def data(tmp_path):
    rows, at = [], 0
    for name, n, size in (("a", 250, 40), ("b", 0, 10), ("c", 33, 33), ("d", 1, 5), ("e", 90, 7)):
        part = [(at + i, f"t{at + i}" if i % 9 else None) for i in range(n)]
        pq.write_table(pa.table({"id": pa.array([r[0] for r in part], pa.int64()), "extra": pa.array([0] * n, pa.int64()), "text": pa.array([r[1] for r in part], pa.string())}), tmp_path / f"{name}.parquet", row_group_size=size)
        rows, at = rows + part, at + n
    return str(tmp_path), rows


def test_ordinals_find_their_rows(spark, data):
    path, rows = data
    index = ordinals.row_groups(spark, path)
    assert index.count() == 7 + 1 + 1 + 13 and index.agg(F.max(F.col("base") + F.col("n"))).first()[0] == len(rows)
    asked = [0, 249, 250, 282, 283, 284, 373, -1, -374, 17, 17]
    wanted = spark.createDataFrame(list(enumerate(asked)), "place long, ordinal long")
    opened = spark.sparkContext.accumulator(0)
    got = ordinals.rows_at(index, wanted, "id long, text string", opened).collect()
    got.sort(key=lambda r: r.place)
    assert [(r.id, r.text) for r in got] == [rows[o] for o in asked] and opened.value == 6
    with pytest.raises(Exception, match="no row 374"):
        ordinals.rows_at(index, spark.createDataFrame([(0, 374)], "place long, ordinal long"), "id long").collect()
    some = ordinals.sampled(index, 50, "id long").orderBy("place").collect()
    assert len({r.id for r in some}) == 50 and [r.id for r in some] != sorted(r.id for r in some)
    assert ordinals.sampled(index, 1000, "id long").select("id").distinct().count() == len(rows)


def test_batches_by_hand(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 5, 16, 17, 40, 200])) for i in range(203)]
    df = spark.createDataFrame(sizes, "id long, n long")
    line = sorted((n, i) for i, n in sizes if n)
    got = {r.id: r for r in ragged.batches(df, "id", "n", 8).collect()}
    for k, (n, i) in enumerate(line):
        batch = line[k // 8 * 8 : k // 8 * 8 + 8]
        assert (got[i].batch, got[i].row, got[i].width, got[i].start) == (k // 8, k % 8, batch[-1][0], sum(m for m, _ in batch[: k % 8]))
    assert len(got) == len(line) and ragged.batches(df, "id", "n", 8, drop_last=True).count() == len(line) // 8 * 8
    full: dict = {}
    for r in ragged.packed(df, "id", "n", 100).collect():
        full.setdefault((r.width, r.batch), []).append(r)
        assert r.width % 16 == 0 and 0 <= r.width - r.n < 16
    assert sum(map(len, full.values())) == len(line)
    for (width, _), batch in full.items():
        assert len(batch) <= max(1, 100 // width) and sorted(r.row for r in batch) == list(range(len(batch)))
    for width in {w for w, _ in full}:
        assert sum(len(b) < max(1, 100 // width) for (w, _), b in full.items() if w == width) <= 1
    x, mask = ragged.collated("t")
    r = spark.createDataFrame([([7, 8], 4), ([7, 8, 9], 2)], "t array<int>, width long").select(x.alias("x"), mask.alias("m")).collect()
    assert [(a.x, a.m) for a in r] == [([7, 8, 0, 0], [1, 1, 0, 0]), ([7, 8], [1, 1])]


def test_sizes_of_ragged_rows_are_made_once(spark):
    from pyspark.sql import functions as F

    from sievework.operators import ragged

    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def size(i):
        calls.add(1)
        return i % 5

    rows = spark.range(50).select("id", size("id").alias("n"))
    got = {r.id: (r.batch, r.row, r.width, r.start) for r in ragged.batches(rows, "id", "n", 16).collect()}
    assert calls.value == 50 and len(got) == 40 and got[1] == (0, 0, 2, 0) and got[49] == (2, 7, 4, 28)
    assert ragged.packed(rows, "id", "n", 64).count() == 40 and calls.value == 100
