"""Splits, samples and mixtures by hash order: reproducible and order-free."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written


#: Groups whose cuts are broadcast.
FEW = 100_000


def hash_key(seed, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def first_by_hash(rows: DataFrame, most, seed=42, key: str = "id", group: str | None = None, *parts: str) -> DataFrame:
    """Of each group the first rows in the order of a hash of ``parts`` (the key, if
    none), then of the key. ``most`` makes the number of a group from columns (group, n).

    The hash's first 16 bits are counted, which tells the place where a group is cut;
    only the rows of that place are put in order. So no task sorts a group, and no
    row comes to the driver, however many are taken. A null group is one of its own."""
    names = rows.columns
    keyed = rows.withColumns({"_h": hash_key(seed, *(parts or (key,))), "_g": F.struct((F.col(group) if group else F.lit(0)).alias(group or "all"))}).withColumn("_b", F.substring("_h", 1, 4))
    w = Window.partitionBy("_g")
    places = keyed.groupBy("_g", "_b").agg(F.count("*").alias("_c")).withColumns({"_n": F.sum("_c").over(w), "_to": F.sum("_c").over(w.orderBy("_b"))})
    wanted = F.least(most(F.col(f"_g.{group}") if group else F.lit(0), F.col("_n")), F.col("_n"))
    cut = places.withColumn("_need", wanted - F.col("_to") + F.col("_c")).filter((F.col("_need") > 0) & (F.col("_need") <= F.col("_c"))).select("_g", F.col("_b").alias("_cut"), "_need")
    # A row a group: rows stay where they are unless there are very many groups.
    cut = written(cut, "cuts")
    cut = F.broadcast(cut) if cut.count() <= FEW else cut
    near = keyed.join(cut, "_g").filter(F.col("_b") <= F.col("_cut"))
    edge = near.filter(F.col("_b") == F.col("_cut")).withColumn("_r", F.row_number().over(w.orderBy("_h", key))).filter(F.col("_r") <= F.col("_need"))
    return near.filter(F.col("_b") < F.col("_cut")).select(*names).unionByName(edge.select(*names))


def official_split(rows: DataFrame, seed: int = 42, denom: int = 16) -> DataFrame:
    """Adds split: per domain the first n div denom ids in hash order are test. Rows of
    one id share their split; a null domain is one of its own, a null id a train row."""
    if denom < 2:
        raise ValueError("denom must be at least 2")
    ids = rows.select("domain", "id").distinct()
    test = first_by_hash(ids, lambda g, n: F.floor(n / denom), seed, "id", "domain", "domain", "id").select(F.col("domain").alias("_domain"), F.col("id").alias("_id"), F.lit("test").alias("_split"))
    joined = rows.drop("split").join(test, F.col("domain").eqNullSafe(F.col("_domain")) & (F.col("id") == F.col("_id")), "left")
    return joined.withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_domain", "_id", "_split")


def official_split_exact(rows: DataFrame, seed: int = 42, denom: int = 16) -> DataFrame:
    """As :func:`official_split`, by Python's seeded shuffle of each domain's ids (ids only)."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["id"]))
        random.Random(f"{seed}:{pdf['domain'].iloc[0]}").shuffle(ids)
        test = set(ids[: len(ids) // denom])
        return pd.DataFrame({"domain": pdf["domain"].iloc[0], "id": ids, "split": ["test" if i in test else "train" for i in ids]})

    if denom < 2:
        raise ValueError("denom must be at least 2")
    return rows.select("domain", "id").distinct().groupBy("domain").applyInPandas(split, "domain string, id string, split string")


def keep_or_split(rows: DataFrame, force: bool = False) -> DataFrame:
    """Existing splits stay only if every row has a valid one."""
    if not force and "split" in rows.columns and rows.agg(F.bool_and(F.coalesce(F.col("split").isin("train", "test"), F.lit(False)))).first()[0]:
        return rows
    return official_split(rows.drop("split"))


def reservoir(rows: DataFrame, k: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly k rows (all, if there are fewer), uniform by hash order."""
    return first_by_hash(rows, lambda g, n: F.lit(k), seed, key)


def per_group(rows: DataFrame, group: str, quota: dict, seed: int = 42) -> DataFrame:
    """The first quota[g] rows of each group in hash order; others go."""
    return first_by_hash(rows.filter(F.col(group).isin(*quota)), lambda g, n: F.coalesce(*[F.when(g == name, k) for name, k in quota.items()], F.lit(0)), seed, "id", group)


def balanced(rows: DataFrame, most: int | None, fraction: float, seed: int = 42) -> DataFrame:
    """round(most * fraction) satellite rows and the rest general, no back-fill."""
    both = rows.filter(F.col("domain").isin("general", "satellite"))
    if most is None:
        return both
    n = round(most * fraction)
    return per_group(both, "domain", {"satellite": n, "general": most - n}, seed)


def mixed(a: DataFrame, b: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """2 * min(|a|, |b|) rows, a share ``fraction`` of them from a; one side empty: the other."""
    na, nb = a.count(), b.count()
    if not na or not nb:
        return a if na else b
    total = 2 * min(na, nb)
    ka = round(total * fraction)
    return reservoir(a, ka, seed).unionByName(reservoir(b, total - ka, seed))


def weighted_pick(key: Column, weights: dict[str, float], seed: int = 42) -> Column:
    """A source by weight from a uniform hash of ``key`` (24 bits)."""
    r = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 6), 16, 10).cast("double") / float(1 << 24) * sum(weights.values())
    out, acc = None, 0.0
    for name, w in weights.items():
        acc += w
        out = F.when(r <= acc, name) if out is None else out.when(r <= acc, name)
    return out.otherwise(list(weights)[-1])
