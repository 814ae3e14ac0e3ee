"""Ragged rows in batches of like length: rows, widths, ranges and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written
from .quality import ranked


def batches(rows: DataFrame, id: str, n: str, size: int, drop_last: bool = False) -> DataFrame:
    """Rows with n over 0 in batches of ``size`` in the order of (n, id): adds batch, row (its
    place there), width (the batch's greatest n) and start (the n of the rows before it
    in the batch, where the rows lie end to end). ``drop_last`` leaves a last batch out
    that is not full. The rows are written first: the filter, the sample of the ranges and the
    ranges themselves each would make ``n`` again."""
    line = ranked(written(rows, "sizes").filter(F.col(n) > 0), n, id)
    out = line.withColumn("batch", F.expr(f"(rank - 1) div {size}")).withColumn("row", (F.col("rank") - 1) % size).drop("rank")
    return _placed(out, n, ["batch"], size if drop_last else 0)


def packed(rows: DataFrame, id: str, n: str, budget: int, step: int = 16, drop_last: bool = False) -> DataFrame:
    """As :func:`batches`, with as many rows a batch as ``budget`` padded entries allow:
    lengths are rounded up to a multiple of ``step``, and rows of one such width share
    batches (width, batch). A row over the budget is a batch of its own."""
    sized = written(rows, "sizes").filter(F.col(n) > 0).withColumn("width", (F.ceil(F.col(n) / step) * step).cast("long"))
    line = ranked(sized, "width", id)
    first = line.groupBy("width").agg(F.min("rank").alias("_first"))  # a row per width
    line = line.join(first, "width").withColumn("_i", F.col("rank") - F.col("_first")).withColumn("_rows", F.greatest(F.floor(F.lit(budget) / F.col("width")), F.lit(1)))
    out = line.withColumn("batch", F.floor(F.col("_i") / F.col("_rows"))).withColumn("row", F.col("_i") % F.col("_rows"))
    full = Window.partitionBy("width", "batch")
    if drop_last:
        out = out.withColumn("_c", F.count("*").over(full)).filter(F.col("_c") == F.col("_rows")).drop("_c")
    starts = F.sum(n).over(full.orderBy("row")) - F.col(n)
    return out.withColumn("start", starts).drop("rank", "_first", "_i", "_rows")


def _placed(rows: DataFrame, n: str, by: list[str], full: int) -> DataFrame:
    w = Window.partitionBy(*by)
    out = rows.withColumns({"width": F.max(n).over(w), "start": F.sum(n).over(w.orderBy("row")) - F.col(n)})
    return out.withColumn("_c", F.count("*").over(w)).filter(F.col("_c") == full).drop("_c") if full else out


def collated(tokens: str, width: str = "width", fill=0) -> tuple[Column, Column]:
    """A row's entries filled to its batch's width, and the mask of its own ones."""
    x, w = F.slice(F.col(tokens), F.lit(1), F.col(width).cast("int")), F.col(width).cast("int")
    rest = F.greatest(w - F.size(x), F.lit(0))
    return F.concat(x, F.array_repeat(F.lit(fill), rest)), F.concat(F.array_repeat(F.lit(1), F.size(x)), F.array_repeat(F.lit(0), rest))
