"""Filter interaction audit: what each filter removes in every order of filters.

Every document gets a mask with a bit per filter that it fails. Masks are counted
by part, which leaves at most 2^k counts a part, and a subset-zeta transform (one
pass an array and bit) turns them into the survivors of every subset of filters.
All else is read from those: a step of an order is the difference between two
neighbouring subsets, so no order is ever applied to documents, and the same holds
for the counts of labelled documents. The Shapley sum weighs each subset by the
orders that reach it.

A filter that compares documents (here: a copy of a smaller id) is decided before
the audit and is a bit like any other.

Defined results: a null text is empty; a null part is the empty string, together
with parts of that name; documents with null or repeated ids count one by one, a
null id is smaller than none and greater than all others; of several labels of an
id any that is 1 counts, and documents without labels lose none; a null condition
does not fail; ties cannot arise, as no order of rows enters; a very long text is
read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

#: Filters at most: rows of the result grow with the number of their orders.
MOST = 7


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]"), "")


def text_filters(text: str, words: str) -> dict[str, Column]:
    """The conditions that a document's own text fails by; ``words`` holds its words."""
    t, n = F.col(text), F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 5 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def copies(rows: DataFrame, id_col: str, digest: str, out: str) -> DataFrame:
    """Adds ``out``: whether a row with a smaller id has the same digest.

    The least ids are joined by digest and id, so that a large group of copies is
    spread by its ids and only its one least row meets the other side."""
    least = rows.groupBy(digest).agg(F.min(id_col).alias("_least")).withColumnRenamed(digest, "_digest")
    same = F.col(digest).eqNullSafe(F.col("_digest")) & F.col(id_col).eqNullSafe(F.col("_least"))
    first = least.withColumn("_first", F.lit(True))
    return rows.join(first, same, "left").withColumn(out, F.col("_first").isNull()).drop("_digest", "_least", "_first")


def zeta(counts: str, k: int) -> str:
    """SQL for the subset-zeta transform of an array by mask: pass by pass, each mask
    with a bit gets the number of the mask without it."""
    return f"aggregate(sequence(0, {k - 1}), {counts}, (at, b) -> transform(at, (x, i) -> IF(i & shiftleft(1, b) <> 0, x + at[i ^ shiftleft(1, b)], x)))"


def orders(names: list[str]) -> list[dict]:
    """Every order and step: its filter's number and the mask of those before."""
    bit = {f: 1 << i for i, f in enumerate(names)}
    return [
        {"filter_order": "".join(order), "step": i + 1, "filter": names.index(f), "before": sum(bit[x] for x in order[:i])}
        for order in itertools.permutations(names) for i, f in enumerate(order)
    ]


def audit(masks: DataFrame, names: list[str], measures: dict[str, Column], part: str = "part", mask: str = "mask") -> DataFrame:
    """A row per part, order of ``names`` and step. ``masks`` has a row per document;
    ``measures`` (conditions by name) tells whose losses are counted besides."""
    if len(names) > MOST:
        raise ValueError(f"over {MOST} filters")
    k, full = len(names), (1 << len(names)) - 1
    by_mask = masks.groupBy(part, mask).agg(F.count("*").alias("_n"), *[F.count_if(c).alias(f"_{m}") for m, c in measures.items()])
    lists = by_mask.groupBy(part).agg(F.map_from_entries(F.collect_list(F.struct(F.col(mask), F.struct("_n", *[f"_{m}" for m in measures])))).alias("_at"))  # 2^k entries at most
    counts = lambda m: F.expr(f"transform(sequence(0, {full}), i -> coalesce(try_element_at(_at, i)._{m}, 0L))")
    sums = lists.select(part, counts("n").alias("_only"), *[counts(m).alias(f"_{m}") for m in measures]).withColumn("_n", F.col("_only"))
    # Survivors of the filters s are the documents whose masks lie within the others.
    sums = sums.withColumns({c: F.expr(f"reverse({zeta(c, k)})") for c in ("_n", *[f"_{m}" for m in measures])})
    weights = ", ".join(str(math.factorial(n) * math.factorial(k - 1 - n)) + "L" for n in range(k))
    gain = f"IF(s & shiftleft(1, f) = 0, array({weights})[bit_count(s)] * (_n[s] - _n[s | shiftleft(1, f)]), 0L)"
    sums = sums.withColumn("_shapley", F.expr(f"transform(sequence(0, {k - 1}), f -> aggregate(sequence(0, {full}), 0L, (sum, s) -> sum + {gain}))"))
    steps = F.from_json(F.lit(json.dumps(orders(names))), "array<struct<filter_order:string,step:int,filter:int,before:int>>")
    rows = sums.withColumn("_s", F.explode(steps)).select(part, "_s.*", *[c for c in sums.columns if c != part])
    rows = rows.withColumn("_bit", F.expr("shiftleft(1, filter)")).withColumn("_after", F.expr("before | _bit")).withColumn("removed", F.expr("_n[before] - _n[_after]"))
    return rows.select(
        part, "filter_order", "step", F.expr("_n[_after]").alias("kept"), "removed", F.expr("_n[0] - _n[_bit] - removed").alias("redundant"), F.expr("_only[_bit]").alias("unique_fails"),
        *[F.expr(f"_{m}[before] - _{m}[_after]").alias(f"{m}_lost") for m in measures], F.expr("_shapley[filter]").alias("shapley"),
    )


def document_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A written row (id, part, mask) per document: bit i for the i-th of ABCDE."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", word_array(F.col("text")))
    own = sum(F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_filters("text", "words").values()))
    rows = table(rows.select("id", "part", own.alias("own"), F.unhex(F.md5("text")).alias("digest")), "audit-rows")
    return copies(rows, "id", "digest", "copy").select("id", "part", (F.col("own") + F.when(F.col("copy"), 16).otherwise(0)).alias("mask"))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by source."""
    masks = document_masks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    one = lambda c: F.max(F.col(c) == 1).alias(c)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("id")).agg(one("quality"), one("toxic"))
    return audit(masks.join(labels, "id", "left"), list("ABCDE"), {"good": F.col("quality"), "toxic": F.col("toxic")})


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS q, max(CAST(toxic = 1 AS INT)) AS x FROM labels GROUP BY doc_id),
m AS (SELECT part, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(least < w.doc_id, least IS NOT NULL AND w.doc_id IS NULL) AS INT) AS mask, l.q, l.x FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
f AS (SELECT part, mask, count(*) AS n, count(*) FILTER (q = 1) AS g, count(*) FILTER (x = 1) AS x FROM m GROUP BY part, mask),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM c a, c b, c d, c e, c h WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
s AS (SELECT filter_order, step, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS b, 1 << (ascii(filter_order[step]) - 65) AS bit FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (b | bit) = 0) AS kept, sum(n) FILTER (mask & b = 0 AND mask & bit <> 0) AS removed, sum(n) FILTER (mask & b <> 0 AND mask & bit <> 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails, sum(g) FILTER (mask & b = 0 AND mask & bit <> 0) AS good_lost, sum(x) FILTER (mask & b = 0 AND mask & bit <> 0) AS toxic_lost
  FROM f, (SELECT filter_order, step, CAST(coalesce(b, 0) AS INT) AS b, CAST(bit AS INT) AS bit FROM s) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM r
"""
