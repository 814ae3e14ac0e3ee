"""Text pairs, positives and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


# The keys of each side by row shape, in their order; then second-chance keys of ``pair``.
KEYS = {
    "triplet": (("anchor", "premise", "sentence1", "caption1", "text"), ("positive", "hypothesis", "sentence2", "caption2", "simplified")),
    "pair": (("caption1", "anchor", "sentence1", "text", "premise", "sent1"), ("caption2", "positive", "sentence2", "simplified", "hypothesis", "sent2")),
    "pair-class": (("premise", "sentence1", "anchor"), ("hypothesis", "sentence2", "positive")),
}
SECOND_KEYS = (("sentence_a", "s1"), ("sentence_b", "s2"))


def first_of(columns: list[str], *names: str) -> Column:
    """The first non-null of the columns that exist, normalised."""
    return T.norm_train(F.coalesce(*[F.col(c) for c in names if c in columns], F.lit(None).cast("string")))


def text_pairs(rows: DataFrame, config: str = "triplet", seed: int = 42) -> DataFrame:
    """(anchor, positive, negative) by row shape; empty and equal pairs go.

    A row with ``text`` and ``paraphrases`` pairs the text with one of those that
    differ, chosen by hash, without a negative; with none it is read by ``config``:
    ``triplet`` may have a negative, unless equal to either side; ``pair-class`` keeps
    label 0 or null; ``pair`` has second-chance keys for a side that is empty."""
    config = {"default": "pair", "": "pair"}.get(config.lower(), config.lower())
    config = config if config in KEYS else "triplet"
    c = rows.columns
    a, b = (first_of(c, *names) for names in KEYS[config])
    if config == "pair":
        lacks = (a == "") | (b == "")
        a, b = (F.when(lacks & (x == ""), first_of(c, *names)).otherwise(x) for x, names in zip((a, b), SECOND_KEYS))
    n = F.nullif(first_of(c, "negative"), F.lit("")) if config == "triplet" else F.lit(None).cast("string")
    ok = F.coalesce(F.col("label").cast("int") == 0, F.lit(True)) if config == "pair-class" and "label" in c else F.lit(True)
    if "text" in c and "paraphrases" in c:
        text = T.norm_train(F.col("text"))
        listed = F.col("paraphrases") if rows.schema["paraphrases"].dataType.typeName() == "array" else T.text_list(F.col("paraphrases"))
        others = F.filter(F.transform(listed, T.norm_train), lambda p: (p != "") & (p != text))
        has = F.coalesce(F.col("text").isNotNull() & (text != "") & (F.size(others) > 0), F.lit(False))
        at = F.pmod(F.xxhash64("text", F.lit(seed)), F.greatest(F.size(others), F.lit(1)))
        a, b, n, ok = F.when(has, text).otherwise(a), F.when(has, F.get(others, at.cast("int"))).otherwise(b), F.when(~has, n), has | ok
    out = rows.filter(ok).select(a.alias("anchor"), b.alias("positive"), n.alias("negative")).filter("anchor <> '' AND positive <> '' AND anchor <> positive")
    return out.withColumn("negative", F.when((F.col("negative") != F.col("anchor")) & (F.col("negative") != F.col("positive")), F.col("negative")))


def positives(captions: Column, query: Column, most: int = 4) -> Column:
    return F.slice(F.array_distinct(F.filter(F.concat(F.transform(captions, T.norm_train), F.array(T.norm_train(query))), lambda t: t != "")), 1, most)


def batch_gate(pairs: DataFrame, batch: str = "batch") -> DataFrame:
    """Negatives stay only in batches where every pair has one."""
    full = pairs.groupBy(batch).agg(F.bool_and(F.col("negative").isNotNull()).alias("_full"))
    return pairs.join(full, batch).withColumn("negative", F.when(F.col("_full"), F.col("negative"))).drop("_full")
