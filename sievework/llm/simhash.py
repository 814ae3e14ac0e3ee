"""SimHash near-duplicates, found through pivot distance tables.

Distinct fingerprints get a table of Hamming distances to reference fingerprints
(pivots). Fingerprints at most 2 bits apart agree in two of four 16-bit blocks,
so candidates share one of six keys; a pair whose coordinates differ by more than
2 in any pivot is discarded by the triangle inequality, survivors are verified.
A key with more than ``BUCKET`` fingerprints pairs nothing: its fingerprints link
through the values one bit away (two are at most 2 bits apart exactly if such a
value is common to both), 65 rows each and at most 65 fingerprints a value.

Defined results: a text without words, or null, has fingerprint 0 and links like
any other; a null id keeps its row and never names a component (a component of
null ids alone has a null name); repeated rows each give a row; an empty table
gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import forget, fresh, join_counted, table

SEED = 42
BITS = 2
BUCKET = 32
N_PIVOTS = 12


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = zip(words, words[1:], words[2:]) if len(words) > 2 else [words]
    n, counts = 0, np.zeros(64, np.int64)
    block: list[int] = []
    for s in shingles:
        block.append(xxh64_intdigest(b" ".join(s), SEED))
        if len(block) == 1 << 16:
            counts, n, block = counts + _bit_counts(block), n + len(block), []
    counts, n = counts + _bit_counts(block), n + len(block)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints, spread at random, as signed numbers."""
    from xxhash import xxh64_intdigest

    return [int(np.uint64(xxh64_intdigest(b"pivot %d" % i, SEED)).astype(np.int64)) for i in range(n)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per document; fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget("pieces")
        for t in texts:
            yield pd.Series(np.array([fingerprint(x if isinstance(x, str) else None) for x in t], np.uint64).astype(np.int64))

    return docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("fp"))


def _keys(fp: Column) -> Column:
    """The six keys of a fingerprint: its block pairs with their number."""
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i)]
    return F.array(*[(F.lit(k) * 65536 + block[i]) * 65536 + block[j] for k, (i, j) in enumerate(pairs)])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` at most 2 bits
    apart (a star's centre may be a value that no text has)."""
    coords = {f"d{i}": F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for i, p in enumerate(pivots())}
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = table(keyed.join(crowded, "key").withColumns(coords), "simhash-buckets")
    pairs = shared.filter(F.col("n") <= bucket)
    a, b = pairs.alias("a"), pairs.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    for d in coords:  # the pivot table: coordinates of near fingerprints differ by 2 at most
        near &= F.abs(F.col(f"a.{d}") - F.col(f"b.{d}")) <= BITS
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= BITS
    found = a.join(b, near).filter(verified).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    one_bit = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    stars = (
        shared.filter(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(one_bit).alias("z"))
        .groupBy("z").agg(F.collect_list("fp").alias("all")).filter("size(all) > 1")  # at most 65 fingerprints
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    )
    return found.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, fp, component (the least id that links reach)."""
    prints = table(fingerprints(docs, id_col, text_col), "simhash")
    own = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(own.select("fp")))
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = table(named, "simhash-roots")
    component = named.groupBy("root").agg(F.min("least").alias("component"))
    by_print = named.join(component, "root").select("fp", "component")
    return prints.join(by_print, "fp").select("id", "fp", "component")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """:func:`near_duplicates` over all documents."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that with the least id, nulls last. Rows are told
    apart by hashes of id and text, so equal or null ids are no matter; of rows
    equal in both one stays."""
    key, size = fresh(docs.columns, "row_key"), fresh(docs.columns, "row_chars")
    keyed = docs.withColumns({key: F.xxhash64(F.col(f"`{text_col}`"), F.col(f"`{id_col}`")), size: F.coalesce(F.length(f"`{text_col}`"), F.lit(-1))})
    whole = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(key).alias("key"), F.col(size).alias("size"))
    prints = table(fingerprints(keyed.select(whole.alias("row"), F.col(f"`{text_col}`").alias("text")), "row", "text"), "simhash-rows")
    own = prints.groupBy("fp").agg(F.min("id").alias("row"))
    roots = components(links(own.select("fp")))
    first = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias("row")).select(F.col("row.key").alias(key), F.col("row.size").alias(size))
    counts = prints.groupBy(F.col("id.key").alias(key), F.col("id.size").alias(size)).agg(F.count("*").alias("n"))
    n = fresh([*docs.columns, key, size], "n_rows")
    kept = table(counts.withColumnRenamed("n", n).join(first.distinct(), [key, size]), "simhash-kept")
    out = join_counted(keyed, kept, [key, size], n)
    one = out.filter(F.col(n) == 1)
    if kept.filter(F.col(n) > 1).limit(1).count():
        one = one.unionByName(out.filter(F.col(n) > 1).dropDuplicates([key, size]))
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])
