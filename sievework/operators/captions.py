"""Plain-text search of captions by posting lists, exactly, without comparing all pairs.

A caption that holds the query as a substring scores 1 plus the share of its length
that the query fills, any other the Jaccard similarity of the words (over 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.scratch import written

#: Letters of the grams by which substrings are looked up; shorter queries have shorter ones.
GRAM = 3


def grams(text: Column, n: Column) -> Column:
    """The distinct runs of ``n`` characters of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.filter(F.transform(at, lambda i: F.substr(text, i, n)), lambda g: F.length(g) == n))


def _substrings(queries: DataFrame, captions: DataFrame, postings: DataFrame) -> DataFrame:
    """(q, row, score) of the captions that hold a query. The inner words of a query of
    three or more are whole words of such a caption, so those with the rarest one are
    looked at; for shorter queries, those with the rarest gram."""
    parts = F.split(F.lower("t"), r"\s+")
    inner = queries.select("q", "t", F.explode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))).alias("word"))
    near = _rarest(inner, postings, "word").join(captions.select("row", "c"), "row").filter(F.contains("c", "t"))
    short = queries.filter(F.size(parts) < 3).select("q", "t", F.least(F.length("t"), F.lit(GRAM)).alias("n"))
    sizes = [r.n for r in short.select("n").distinct().collect()]  # GRAM at most
    if sizes:
        asked = written(short.select("q", "t", F.explode(grams(F.col("t"), F.col("n"))).alias("gram")), "grams")
        has = F.array_distinct(F.concat(*[grams(F.col("c"), F.lit(n)) for n in sizes]))
        held = written(captions.select("row", F.explode(has).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi"), "postings")
        near = near.unionByName(_rarest(asked, held, "gram").join(captions.select("row", "c"), "row").filter(F.contains("c", "t")))
    return near.select("q", "row", (1 + F.least(F.length("t") / F.length("c"), F.lit(1.0))).alias("score"))


def _rarest(asked: DataFrame, postings: DataFrame, part: str) -> DataFrame:
    """(q, t, row) of the postings of each query's rarest part; of equal ones the least."""
    counted = asked.join(postings.groupBy(part).agg(F.count("*").alias("df")), part, "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = counted.groupBy("q", "t").agg(F.min_by(part, F.struct("df", part)).alias(part))
    return rarest.join(postings.select(part, "row"), part).select("q", "t", "row")


def _overlaps(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(q, row, score): at least the ``k`` captions of each query with the most similar
    words.

    The captions with a query's rarest word give a k-th score first. One that is as
    similar shares so many words with the query that it has one of the rarest ones up
    to a place that this score tells, and its number of words is bounded by it; only
    such captions are compared."""
    asked = queries.select("q", F.size("words").alias("n"), F.explode("words").alias("word"))
    counted = asked.join(postings.groupBy("word").agg(F.count("*").alias("df")), "word")
    ranked = written(counted.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("df", "word"))), "words")
    first = _scored(ranked, ranked.filter("place = 1").join(postings, "word").select("q", "row"), postings)
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "row"))).filter(F.col("r") == k)
    least = ranked.select("q").distinct().join(best.select("q", F.col("score").alias("least")), "q", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    # Rounding must not leave out a caption that ties.
    need = F.greatest(F.ceil(F.col("n") * F.col("least") - 1e-9), F.lit(1))
    bounded = ranked.join(least, "q").filter(F.col("place") <= F.col("n") - need + 1)
    fits = (F.col("m") >= F.col("n") * F.col("least") - 1e-9) & (F.col("m") * F.col("least") <= F.col("n") + 1e-9)
    return _scored(ranked, bounded.join(postings, "word").filter(fits).select("q", "row"), postings)


def _scored(words: DataFrame, pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """(q, row, score) of the pairs (q, row), by the words that they share."""
    both = words.select("q", "n", "word").join(pairs.distinct(), "q").join(postings, ["row", "word"]).groupBy("q", "row").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("m").alias("m"))
    return both.select("q", "row", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("score"))


def caption_top_k(queries: DataFrame, captions: DataFrame, k: int, keys: list[str], query: str = "item_id", text: str = "text") -> DataFrame:
    """(``query``, ``keys``, rank, score): the ``k`` best captions of each query (columns
    ``query`` and ``text``). Equal scores rank by keys, then by the caption's text.
    Null and empty queries and captions find nothing and are not found; repeated
    captions rank each; query rows equal in id and text count once."""
    form = lambda df, name, *keep: df.select(*keep, T.norm_train(F.col(text)).alias(name)).filter(F.col(name) != "").withColumn("words", T.word_set(F.col(name)))
    asked = written(form(queries, "t", query).dropDuplicates([query, "t"]).withColumn("q", F.monotonically_increasing_id()), "queries")
    own = [F.col(c).alias(f"key_{i}") for i, c in enumerate(keys)]
    rows = written(form(captions, "c", *own).withColumn("row", F.monotonically_increasing_id()), "captions")
    wanted = asked.select(F.explode("words").alias("word")).distinct()
    postings = written(rows.select("row", F.size("words").alias("m"), F.explode("words").alias("word")).join(wanted, "word", "left_semi"), "postings")
    hits = written(_substrings(asked, rows, postings), "hits")
    found = hits.unionByName(_overlaps(asked, postings, k).join(hits, ["q", "row"], "left_anti"))
    order = [F.desc("score"), *[f"key_{i}" for i in range(len(keys))], "c"]
    # Those that tie with the k-th are told apart by their keys, so all of them are met with these.
    close = found.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= k)
    full = close.join(rows.drop("words"), "row").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)
    return full.join(asked.select("q", query), "q").select(query, *[F.col(f"key_{i}").alias(c) for i, c in enumerate(keys)], "rank", "score")
