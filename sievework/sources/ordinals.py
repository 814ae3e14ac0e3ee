"""Access by ordinal: which row group of which file has the n-th row of a dataset.

The index has a row per row group, read from the files' footers; files count in the
order of their paths, row groups and rows in that of the file. A read of some ordinals
opens their row groups only, each once, and takes the wanted columns of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import written

GROUPS = "path string, grp int, n long"


def _open(path: str):
    """A parquet file of any store that pyarrow knows."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    uri = "s3" + path[3:] if path.startswith("s3a:") else path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    fs, at = FileSystem.from_uri(uri)
    return pq.ParquetFile(fs.open_input_file(at))


def row_groups(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """The written index of a folder or file: (path, grp, n, base), ``base`` being the
    ordinal of the group's first row. Footers are read by tasks; the sums of ranges of
    files are all that is put in one line."""

    def footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p in f["path"]:
                meta = _open(p).metadata
                rows += [(p, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
            yield pd.DataFrame(rows, columns=["path", "grp", "n"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path")
    groups = files.repartition("path").mapInPandas(footers, GROUPS).filter("n > 0")
    parts = written(groups.repartitionByRange("path", "grp").withColumn("_p", F.spark_partition_id()), "row-groups")
    sums = parts.groupBy("_p").agg(F.sum("n").alias("_n"))  # a row per range
    before = sums.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    own = F.sum("n").over(Window.partitionBy("_p").orderBy("path", "grp")) - F.col("n")
    return written(parts.withColumn("_own", own).join(F.broadcast(before), "_p").select("path", "grp", "n", (F.col("_before") + F.col("_own")).alias("base")), "row-groups")


def located(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(place, ordinal, path, grp, at) of ``wanted`` (place, ordinal). Negative ordinals
    count from the end; one beyond the data ends the job.

    Ordinals and groups meet by numbers of equal stretches, of which a group covers two
    at most."""
    total, most = index.agg(F.sum("n"), F.max("n")).first()
    total, most = total or 0, most or 1
    o = F.when(F.col("ordinal") < 0, F.col("ordinal") + total).otherwise(F.col("ordinal"))
    beyond = F.raise_error(F.concat(F.lit("no row "), F.col("ordinal").cast("string"))).cast("long")
    asked = wanted.select("place", F.when((o >= 0) & (o < total), o).otherwise(beyond).alias("ordinal")).withColumn("_s", F.floor(F.col("ordinal") / most))
    covered = index.withColumn("_s", F.explode(F.sequence(F.floor(F.col("base") / most), F.floor((F.col("base") + F.col("n") - 1) / most))))
    near = asked.join(covered, "_s").filter((F.col("ordinal") >= F.col("base")) & (F.col("ordinal") < F.col("base") + F.col("n")))
    return near.select("place", "ordinal", "path", "grp", (F.col("ordinal") - F.col("base")).alias("at"))


def rows_at(index: DataFrame, wanted: DataFrame, schema: str, opened=None) -> DataFrame:
    """(place, ordinal, the columns of ``schema``) of the wanted ordinals (place,
    ordinal; a place may repeat an ordinal). ``opened``, an accumulator, counts the row
    groups that were read."""
    kinds = index.sparkSession.createDataFrame([], schema).schema
    names = kinds.names

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, g, wants in zip(f["path"], f["grp"], f["wants"]):
                rows = _open(p).read_row_group(int(g), columns=names)
                if opened is not None:
                    opened.add(1)
                out = rows.take([int(w["at"]) for w in wants]).to_pandas()[names]
                out.insert(0, "ordinal", [w["ordinal"] for w in wants])
                out.insert(0, "place", [w["place"] for w in wants])
                yield out

    # A group's list is no longer than the places that name its rows.
    by_group = located(index, wanted).groupBy("path", "grp").agg(F.collect_list(F.struct("place", "ordinal", "at")).alias("wants"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
    return by_group.mapInPandas(read, f"place long, ordinal long, {columns}")


def sampled(index: DataFrame, k: int, schema: str, seed: int = 42, opened=None) -> DataFrame:
    """``k`` different rows (all, if there are fewer), uniform, in a shuffled order: the
    ordinals are drawn, then only their row groups are read."""
    import random

    spark = index.sparkSession
    total = index.agg(F.sum("n")).first()[0] or 0
    drawn = random.Random(seed).sample(range(total), min(k, total))
    return rows_at(index, spark.createDataFrame(list(enumerate(drawn)), "place long, ordinal long"), schema, opened)
