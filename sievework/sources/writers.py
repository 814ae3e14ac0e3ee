"""Writers: sharded export, metadata lines, audit files, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import META
from .versions import Versions


def export(rows: DataFrame, directory: str, shard_rows: int = 4096, check: bool = False) -> dict:
    """Parquet by split, at most ``shard_rows`` a file; returns the manifest.

    The shards are written beside, listed with length and hash, and count once the next
    version's manifest names them: a crash at any step leaves the last export readable,
    and its files stay until :func:`drop_old_exports`. Splits share one write, so none
    lands in another. An empty table is an error, and with ``check`` so is a row that
    breaks a rule of ``quality.reasons``. ``info.json`` repeats the counts."""
    if rows.limit(1).count() == 0:
        raise ValueError("nothing to export")
    if check:
        from ..operators.quality import reasons

        bad = {r.reason: r["count"] for r in reasons(rows).filter("reason IS NOT NULL").groupBy("reason").count().collect()}  # a row per rule
        if bad:
            raise ValueError(f"rows that break a rule: {bad}")
    rows = rows if "split" in rows.columns else rows.withColumn("split", F.lit("train"))
    spark, versions = rows.sparkSession, Versions(rows.sparkSession, directory)
    name = versions.new("shards")
    at = f"{versions.path}/{name}"
    rows.write.option("maxRecordsPerFile", shard_rows).partitionBy("split").parquet(at)
    counts = spark.read.parquet(at).groupBy("split", "domain").count().collect()  # splits x domains rows
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(at)
    files.select(F.regexp_extract("path", f"{name}/(.*)$", 1).alias("file"), "length", F.md5("content").alias("md5")).write.json(f"{at}/_files")
    manifest = {"shards": name, "rows": sum(r["count"] for r in counts), "splits": {s: {r["domain"]: r["count"] for r in counts if r["split"] == s} for s in sorted({r["split"] for r in counts})}}
    if not versions.commit(versions.current()[0], manifest):
        raise RuntimeError("another export was first")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/info.json")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
    stream.close()
    return manifest


def shard_files(spark, directory: str) -> DataFrame:
    """(file, length, md5) of the newest export."""
    versions = Versions(spark, directory)
    return spark.read.schema("file string, length long, md5 string").json(f"{versions.path}/{versions.current()[1]['shards']}/_files")


def drop_old_exports(spark, directory: str, keep: int = 1) -> list[str]:
    return Versions(spark, directory).vacuum(lambda m: [m["shards"]], keep)


def metadata_lines(rows: DataFrame, path: str) -> None:
    """Metadata rows as JSON lines with all keys in a fixed order."""
    name = F.concat(F.lit("images/"), F.col("domain"), F.lit("/"), F.col("id"), F.lit(".jpg"))
    have = rows.columns
    values = [F.coalesce(F.col(f.name), F.lit("")) if f.name in have and f.dataType.simpleString() == "string" else F.col(f.name) if f.name in have else F.lit("") for f in META.fields]
    out = rows.select(*[(F.coalesce(F.nullif(v, F.lit("")), name) if f.name == "file_name" else v).alias(f.name) for f, v in zip(META.fields, values)])
    out.write.mode("overwrite").json(path)


def audit(flagged: DataFrame, directory: str) -> None:
    """Flag lines, and a file per code that each flagged row's codes name."""
    some = flagged.filter(F.size("codes") > 0)
    some.write.mode("overwrite").json(f"{directory}/flags")
    some.withColumn("code", F.explode("codes")).write.mode("overwrite").partitionBy("code").json(f"{directory}/flags_by_code")


def pending_uploads(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Files (path, length) that the remote lacks or has in another size, small first."""
    return local.join(remote, ["path", "length"], "left_anti").orderBy(F.col("length") > 1 << 20, "path")
