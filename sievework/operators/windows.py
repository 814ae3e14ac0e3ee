"""Windows over long groups: rows are ranked by ranges of the whole table, so that a
group with a large share of all rows is no task's work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .quality import ranked

#: Ranks of a block.
BLOCK = 4096


def over_last(rows: DataFrame, key: str, order: str, width: int, **columns: Callable[[WindowSpec], Column]) -> DataFrame:
    """Adds ``columns`` of the ``width`` rows before each row of its key. Each is a
    function of the window. A block's last rows also stand, unseen, before the next."""
    width_, block = F.lit(width), max(BLOCK, width)
    line = ranked(rows, key, order).withColumn("_block", F.floor(F.col("rank") / block))
    near = F.when(F.col("rank") % block >= block - width_, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = line.withColumn("_step", F.explode(near)).withColumn("_block", F.col("_block") + F.col("_step"))
    w = Window.partitionBy(key, "_block").orderBy("rank").rowsBetween(-width, -1)
    return dealt.withColumns({name: f(w) for name, f in columns.items()}).filter("_step = 0").drop("rank", "_block", "_step")


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds i: the place, from 0, of each row within its key."""
    line = ranked(rows, key, order)
    first = line.groupBy(key).agg(F.min("rank").alias("_first")).withColumnRenamed(key, "_key")
    return line.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn("i", F.col("rank") - F.col("_first")).drop("rank", "_first", "_key")
