"""Token lists (id, tok, vec) thinned for conditioning: shuffle, cap, dropout, merge to one.

Order and choice come from hashes of seed, id and token, so they are the same in every
run. An id's tokens are as many as its encoder makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import hash_key
from .vectors import dot


def _seeded(seed: int, step: str) -> str:
    return f"{seed}:{step}"


def shuffled(tokens: DataFrame, seed: int = 42) -> DataFrame:
    """The tokens of each id numbered anew, in a random order."""
    w = Window.partitionBy("id").orderBy(hash_key(_seeded(seed, "shuffle"), "id", "tok"), "tok")
    return tokens.withColumn("tok", (F.row_number().over(w) - 1).cast("long"))


def dropped(tokens: DataFrame, p: float = 0.2, seed: int = 42) -> DataFrame:
    """A random choice of round(n (1 - p)) tokens of each id (half to even, 1 at least), in
    their order and with their numbers. With p of 0 or less all stay."""
    if p <= 0:
        return tokens
    w = Window.partitionBy("id").orderBy(hash_key(_seeded(seed, "drop"), "id", "tok"), "tok")
    ranked = tokens.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("id"))})
    return ranked.filter(F.col("_r") <= F.greatest(F.bround(F.col("_n") * (1 - min(p, 1 - 1e-6))), F.lit(1))).drop("_r", "_n")


def coin(p: float, seed: int) -> Column:
    """Whether an id's coin falls within ``p``."""
    return F.conv(F.substring(hash_key(_seeded(seed, "merge"), "id"), 1, 13), 16, 10).cast("double") / float(16**13) < p


def merged_to_one(tokens: DataFrame, p: float = 0.05, seed: int = 42) -> DataFrame:
    """With probability ``p`` an id's tokens become one, their normalised mean; else they
    are numbered in order."""
    own = tokens.select("id", "tok", F.transform("vec", lambda x: x.cast("double")).alias("vec")).withColumn("_one", coin(p, seed) if p > 0 else F.lit(False))
    many = own.filter(~F.col("_one")).withColumn("tok", (F.row_number().over(Window.partitionBy("id").orderBy("tok")) - 1).cast("long")).drop("_one")
    each = own.filter("_one").select("id", F.posexplode("vec").alias("i", "x")).groupBy("id", "i").agg(F.avg("x").alias("x"))
    mean = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    unit = F.transform("vec", lambda x: x / F.greatest(F.sqrt(dot(F.col("vec"), F.col("vec"))), F.lit(1e-12)))
    return many.unionByName(mean.select("id", F.lit(0).cast("long").alias("tok"), unit.alias("vec")))


def condition_tokens(tokens: DataFrame, most: int = 64, drop: float = 0.2, merge: float = 0.05, seed: int = 42) -> DataFrame:
    """Shuffled, cut to ``most`` (a random choice, after the shuffle), thinned, and now and
    then merged to one."""
    some = shuffled(tokens, seed)
    some = some.filter(F.col("tok") < most) if most > 0 else some
    return merged_to_one(dropped(some, drop, seed), merge, seed)
