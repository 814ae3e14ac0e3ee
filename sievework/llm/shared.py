"""What the operators of this subpackage share: the shared folder and word rules."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java's and DuckDB's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share.

    The cluster names the parent in ``spark.checkpoint.dir``; only where that is
    unset (tests on one machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="sievework-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sievework/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A key with more than one in ``HOT`` of all counted rows is joined apart.
HOT = 1000


def join_counted(rows: DataFrame, counts: DataFrame, on: list[str], c: str) -> DataFrame:
    """Inner join of ``rows`` with ``counts``: a written table, one line a key, whose
    column ``c`` counts the key's rows.

    Keys with over 1 / ``HOT`` of all rows are fewer than ``HOT`` by that count, so
    they can be broadcast at any size, and their rows stay where they are; the
    other keys are hashed, none of which can fill a task.
    """
    least = (counts.agg(F.sum(c)).first()[0] or 0) // HOT
    hot = F.broadcast(counts.filter(F.col(c) > least))
    others = rows.join(hot.select(*on), on, "left_anti").join(counts.filter(F.col(c) <= least), on)
    return rows.join(hot, on).unionByName(others)


def join_salted(rows: DataFrame, others: DataFrame, on: list[str], salts: int = 64) -> DataFrame:
    """Inner join of ``rows``, a written table, with ``others``, of which a key may
    have several. A key with over 1 / ``HOT`` of all rows is dealt to ``salts``
    places, to each of which its few other rows go, so that none can fill a task."""
    least = rows.count() // HOT
    key = F.xxhash64(*on)
    hot = [r.k for r in rows.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > least).select(key.alias("k")).collect()]  # under HOT rows
    salt = fresh([*rows.columns, *others.columns], "salt")
    many = F.lit(least > 0) & key.isin(hot) if hot else F.lit(False)
    dealt = rows.withColumn(salt, F.when(many, F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(F.lit(0).cast("long")))
    met = others.withColumn(salt, F.explode(F.when(many, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return dealt.join(met, [*on, salt]).drop(salt)


def worker_cache(name: str, make):
    """What a worker process keeps from task to task, in a module of its own (the
    functions that use it are shipped by value, and their globals with them)."""
    cache = sys.modules.setdefault("sievework_worker_cache", types.ModuleType("sievework_worker_cache"))
    if name not in cache.__dict__:
        setattr(cache, name, make())
    return getattr(cache, name)


def forget(name: str) -> None:
    """Give up what the worker process has kept under ``name`` for another operator."""
    cache = sys.modules.get("sievework_worker_cache")
    if cache is not None:
        cache.__dict__.pop(name, None)


def fresh(columns: list[str], name: str) -> str:
    """``name``, prefixed until it clashes with no column (names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
