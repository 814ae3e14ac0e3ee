"""Readers: metadata lines, CSV, parquet splits, listings, and what may be collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..schema import META
from .versions import Versions

#: Rows that a guarded read may bring to the driver.
MATERIALISE = 512


def metadata(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Metadata lines with defaults for missing fields; a missing id or domain is an error."""
    rows = spark.read.schema(META).json(path)
    need = lambda c: F.coalesce(c, F.raise_error(F.lit(f"metadata row without {c}")).cast("string"))
    rows = rows.select(
        *[need(c).alias(c) for c in ("id", "domain")], F.coalesce("source", F.lit("")).alias("source"), F.coalesce("captions", F.array().cast("array<string>")).alias("captions"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("query", "unrelated_query", "file_name")], "split",
    )
    return rows.limit(max_rows) if max_rows else rows


def json_lines(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    rows = spark.read.json(path)
    return rows.limit(max_rows) if max_rows else rows


def caption_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with filepath, title, title_multi_objects."""
    return spark.read.csv(path, header=True, mode="PERMISSIVE", multiLine=True, escape='"', encoding="UTF-8")


def split(spark: SparkSession, directory: str, name: str = "all") -> DataFrame:
    """Shards of one split, or all, with the split's name, of the newest export; shards
    that no manifest names are left out."""
    versions = Versions(spark, directory)
    rows = spark.read.parquet(f"{versions.path}/{versions.current()[1]['shards']}")
    return rows if name == "all" else rows.filter(F.col("split") == name)


def listing(spark: SparkSession, *roots: str) -> DataFrame:
    """basename, path, length of files; for equal names the first root wins."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(r).select(F.lit(i).alias("rank"), "path", "length") for i, r in enumerate(roots)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("basename", F.element_at(F.split("path", "/"), -1))
    w = Window.partitionBy("basename").orderBy("rank", "path")
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "rank")


def resolve(rows: DataFrame, files: DataFrame, column: str = "filepath") -> tuple[DataFrame, DataFrame]:
    """Rows whose file is listed (with its path), and those whose is not."""
    named = rows.withColumn("basename", F.element_at(F.split(column, "/"), -1))
    return named.join(files, "basename"), named.join(files, "basename", "left_anti")


def guarded(rows: DataFrame, most: int = MATERIALISE) -> list:
    """Collect, but refuse more than ``most`` rows."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    return got


def query_cache(spark: SparkSession, path: str) -> DataFrame:
    """Caption cache in which later lines win: later files by name, then later places
    in a file."""
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("_at"))
    entry = lines.select(F.from_json("value", "caption string, related_query string, unrelated_query string").alias("e"), "_at").select("e.*", "_at").filter("caption IS NOT NULL")
    return entry.withColumn("caption", strip(F.col("caption"))).groupBy("caption").agg(F.max_by(F.struct("related_query", "unrelated_query"), "_at").alias("q")).select("caption", "q.*")


def flagged_rows(spark: SparkSession, directory: str, rows: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(id, codes) of rows with a wanted code: from the audit's flag lines if there are
    any, else by an audit of ``rows``."""
    from ..operators import quality, records

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/flags")
    written = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    found = spark.read.schema("id string, codes array<string>").json(f"{directory}/flags") if written else quality.flags(rows).select("id", "codes")
    return records.with_codes(found.select("id"), found, wanted)


def first_source(*sources) -> tuple[str, DataFrame]:
    """(name, rows) of the first of (name, reader) pairs whose reader gives a row; what
    fails or is empty is logged and passed over, and if all are, that is an error."""
    import logging

    tried = []
    for name, reader in sources:
        try:
            rows = reader()
            if rows.limit(1).count():
                return name, rows
            tried.append(f"{name}: empty")
        except Exception as e:  # noqa: BLE001  # any source may give way to the next
            tried.append(f"{name}: {type(e).__name__}")
        logging.getLogger(__name__).warning("source passed over, %s", tried[-1])
    raise ValueError("no source has rows; " + "; ".join(tried))
