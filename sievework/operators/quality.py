"""Quality flags, audit figures and repair rules over metadata rows.

A metadata row has id, domain, source, captions (array), query, unrelated_query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written

# Domains, severities by code, codes that ask for a repair.
DOMAINS = ("general", "satellite")
SEVERITY = {
    "empty_field": 100, "bad_domain": 100, "captions_not_diverse": 90, "offline_unrelated": 85, "query_eq_caption": 80, "query_near_caption": 70,
    "generic_unrelated": 65, "unrelated_eq_query": 90, "unrelated_eq_caption": 85, "query_too_short": 60, "query_too_long": 40, "query_boilerplate": 45,
    "caption_too_short": 55, "domain_style_mismatch": 35, "duplicate_query_frequent": 50, "duplicate_unrelated_frequent": 55,
}
QUERY_CODES = ("query_eq_caption", "query_near_caption", "query_too_short", "query_too_long", "query_boilerplate", "duplicate_query_frequent", "empty_field")
UNRELATED_CODES = ("offline_unrelated", "generic_unrelated", "unrelated_eq_query", "unrelated_eq_caption", "duplicate_unrelated_frequent", "empty_field")
CAPTION_CODES = ("captions_not_diverse", "caption_too_short")
# The codes that the report's estimates count, which differ from those above.
ESTIMATES = {
    "query": ("query_eq_caption", "query_near_caption", "query_too_short", "query_boilerplate", "duplicate_query_frequent", "empty_field"),
    "unrelated": ("offline_unrelated", "generic_unrelated", "unrelated_eq_query", "unrelated_eq_caption", "duplicate_unrelated_frequent", "empty_field"),
    "captions": ("captions_not_diverse", "caption_too_short", "empty_field"),
}


def reasons(rows: DataFrame) -> DataFrame:
    """Adds reason: why a row is no valid record, null if it is one. The first
    broken rule counts; nulls are missing values, hence empty."""
    blank = lambda c: F.coalesce(T.strip(F.col(c).cast("string")) == "", F.lit(True))
    reason = F.when(~F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False)), "domain").when(F.coalesce(F.size("captions"), F.lit(0)) < 2, "captions")
    for c in ("id", "source", "query", "unrelated_query"):
        reason = reason.when(blank(c), c)
    return rows.withColumn("reason", reason)


def export_check(rows: DataFrame) -> DataFrame:
    """One row: n, empty_query, empty_unrelated, publishable (two rows, none empty)."""
    empty = lambda c: F.count_if(F.coalesce(T.strip(F.col(c)), F.lit("")) == "")
    counts = rows.agg(F.count("*").alias("n"), empty("query").alias("empty_query"), empty("unrelated_query").alias("empty_unrelated"))
    return counts.withColumn("publishable", F.expr("n >= 2 AND empty_query = 0 AND empty_unrelated = 0"))


def fill_from_cache(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows (id, captions, query) with blank queries from the cache (caption,
    related_query) by the first caption, else by the earliest other that is cached;
    ``origin`` tells own, first, other or missing."""
    blank = F.coalesce(T.strip(F.col("query")), F.lit("")) == ""
    asks = rows.filter(blank).select("id", F.posexplode("captions").alias("at", "caption"))
    hits = asks.join(cache.select("caption", "related_query"), "caption").groupBy("id").agg(F.min_by("related_query", "at").alias("_found"), F.min("at").alias("_at"))
    origin = F.when(~blank, "own").when(F.col("_at") == 0, "first").when(F.col("_at") > 0, "other").otherwise("missing")
    return rows.join(hits, "id", "left").withColumn("origin", origin).withColumn("query", F.when(blank, F.col("_found")).otherwise(F.col("query"))).drop("_found", "_at")


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    """Counts of a column's normal form, empties left out: norm, n."""
    return rows.select(T.norm_quality(F.col(column)).alias("norm")).filter("norm <> ''").groupBy("norm").agg(F.count("*").alias("n"))


def with_frequencies(rows: DataFrame) -> DataFrame:
    """Adds query_n and unrelated_n by joins to the counts; the counts' sides are
    aggregated first, and adaptive execution splits a frequent value's rows."""
    for column, name in (("query", "query_n"), ("unrelated_query", "unrelated_n")):
        counts = frequencies(rows, column).withColumnRenamed("n", name)
        rows = rows.withColumn("_norm", T.norm_quality(F.col(column))).join(counts.withColumnRenamed("norm", "_norm"), "_norm", "left").drop("_norm")
    return rows


def flags(rows: DataFrame, query_threshold: int = 15, unrelated_threshold: int = 100, overlap: float = 0.85, min_query: int = 8, max_query: int = 120, min_caption: int = 12) -> DataFrame:
    """Adds flags (code, severity), codes, max_severity. Null captions are none.

    Normal forms and token sets are columns of a step of their own, so that pairs of
    captions compare what is already there."""
    form = lambda c: F.struct(c.alias("t"), T.norm_quality(c).alias("n"), T.token_set(c).alias("k"))
    trimmed = F.filter(F.transform(F.coalesce("captions", F.array().cast("array<string>")), T.strip), lambda c: c != "")
    names = ("_cap", "_q", "_u")
    rows = with_frequencies(rows).withColumn("_cap", F.transform(trimmed, form)).withColumns({"_q": form(T.strip(F.col("query"))), "_u": form(T.strip(F.col("unrelated_query")))})
    cap, q, u, nq, nu = F.col("_cap"), F.col("_q.t"), F.col("_u.t"), F.col("_q.n"), F.col("_u.n")
    flag = lambda code: F.struct(F.lit(code).alias("code"), F.lit(SEVERITY.get(code, 10)).alias("severity"))
    on = lambda cond, code: F.when(cond, flag(code))
    share = lambda c: F.when(F.size("_q.k") > 0, F.size(F.array_intersect(F.col("_q.k"), c["k"])) / F.size("_q.k")).otherwise(0.0)
    hit = F.try_element_at(F.filter(F.transform(cap, lambda c: F.when(c["n"] == nq, "query_eq_caption").when(share(c) >= overlap, "query_near_caption")), lambda x: x.isNotNull()), F.lit(1))
    pair = F.exists(F.sequence(F.lit(1), F.size(cap)), lambda i: F.exists(F.slice(cap, i + 1, F.size(cap)), lambda b: T.near_forms(F.try_element_at(cap, i), b)))
    several = F.transform(F.filter(cap, lambda c: F.length(c["t"]) < min_caption), lambda c: flag("caption_too_short"))
    one = F.array(
        on(~F.coalesce(F.col("domain"), F.lit("")).isin(*DOMAINS), "bad_domain"),
        *[on(F.coalesce(T.strip(F.col(c)), F.lit("")) == "", "empty_field") for c in ("source", "query", "unrelated_query")],
        on(F.size(cap) < 2, "empty_field"),
        on((F.size(cap) == 1) | pair, "captions_not_diverse"),  # two or more without a near pair are all distinct
        on((q != "") & (F.length(q) < min_query), "query_too_short"),
        on(F.length(q) > max_query, "query_too_long"),
        on(q.rlike("(?i)" + T.BOILERPLATE), "query_boilerplate"),
        on((q != "") & (hit == "query_eq_caption"), "query_eq_caption"),
        on((q != "") & (hit == "query_near_caption"), "query_near_caption"),
        on((u != "") & (nu == T.OFFLINE_UNRELATED), "offline_unrelated"),
        on((u != "") & (nu != T.OFFLINE_UNRELATED) & T.is_generic(u), "generic_unrelated"),
        on((nq != "") & (nq == nu), "unrelated_eq_query"),
        on((nu != "") & F.exists(cap, lambda c: c["n"] == nu), "unrelated_eq_caption"),
        on((F.col("domain") == "general") & T.aerialish(q), "domain_style_mismatch"),
        on(F.coalesce("query_n", F.lit(0)) >= query_threshold, "duplicate_query_frequent"),
        on(F.coalesce("unrelated_n", F.lit(0)) >= unrelated_threshold, "duplicate_unrelated_frequent"),
    )
    out = rows.withColumn("flags", F.concat(F.array_compact(one), several)).drop(*names)
    return out.withColumns({"codes": F.array_sort(F.array_distinct(F.col("flags.code"))), "max_severity": F.coalesce(F.array_max(F.col("flags.severity")), F.lit(0))})


def needs(codes: Column, wanted) -> Column:
    return F.arrays_overlap(codes, F.array(*[F.lit(c) for c in wanted]))


def fields_to_repair(codes: Column) -> Column:
    return F.array_compact(F.array(F.when(needs(codes, QUERY_CODES), "query"), F.when(needs(codes, UNRELATED_CODES), "unrelated_query"), F.when(needs(codes, CAPTION_CODES), "captions")))


def repair_query(flagged: DataFrame, overlap: float = 0.85) -> DataFrame:
    """Adds new_query and how: kept, local_strip, local_keywords, or external for
    rows that no local rule mends."""
    q = F.col("query")
    bare = T.strip_boilerplate(q)
    only_strip = F.col("codes") == F.array(F.lit("query_boilerplate"))
    words = F.col("_words")  # a step of its own: within the captions' lambda the query would be made for each
    good = (F.length(words) >= 8) & ~F.exists("captions", lambda c: T.overlap_ratio(words, c) >= overlap)
    rewrite = needs(F.col("codes"), [c for c in QUERY_CODES if c not in ("query_boilerplate", "duplicate_query_frequent")])
    how = F.when(~needs(F.col("codes"), QUERY_CODES), "kept").when(only_strip & (bare != q) & (bare != ""), "local_strip").when(rewrite & good, "local_keywords").otherwise("external")
    rows = flagged.withColumn("_words", T.keyword_query(F.col("captions"))).withColumn("how", how)
    return rows.withColumn("new_query", F.when(F.col("how") == "local_strip", bare).when(F.col("how") == "local_keywords", words).when(F.col("how") == "kept", q)).drop("_words")


# Codes besides which a frequent query is still mended here, and those that ask for a new query.
MENDED_HERE = ("query_eq_caption", "query_near_caption", "query_boilerplate", "query_too_short", "empty_field")
NEW_QUERY = ("query_eq_caption", "query_near_caption", "query_too_short", "duplicate_query_frequent", "empty_field")


def repair_query_by_caption(flagged: DataFrame, overlap: float = 0.85) -> DataFrame:
    """Adds new_query and how: kept, local, or external for rows that the rule leaves to
    an outside service.

    A query that only needs it loses its prefix; others get :func:`T.search_query`,
    unless that is short, mostly repeats a caption, or is the query again. A row
    whose only fault is a frequent query goes to the service."""
    codes, q = F.col("codes"), T.strip(F.coalesce("query", F.lit("")))
    asks = needs(codes, [c for c in QUERY_CODES if c != "empty_field"]) | (q == "")
    bare = F.when((q == "") | F.array_contains(codes, "query_boilerplate"), T.strip_boilerplate(q)).otherwise(q)
    fresh_ = needs(codes, NEW_QUERY) | (bare == "")
    again = T.strip_boilerplate(bare)
    texts = F.filter(F.coalesce("captions", F.array().cast("array<string>")), lambda c: F.coalesce(T.strip(c), F.lit("")) != "")
    rows = flagged.withColumn("_words", T.search_query(F.col("captions"), F.col("domain")))
    words = F.col("_words")
    good = (F.length(words) >= 8) & ~F.exists(texts, lambda c: T.overlap_ratio(words, c) >= overlap) & (T.norm_quality(words) != T.norm_quality(bare))
    made = F.when(fresh_, F.when(good, words)).when(again != bare, again)
    frequent = F.array_contains(codes, "duplicate_query_frequent") & ~needs(codes, MENDED_HERE)
    how = F.when(~asks, "kept").when(frequent | made.isNull(), "external").otherwise("local")
    return rows.withColumn("how", how).withColumn("new_query", F.when(F.col("how") == "local", made).when(F.col("how") == "kept", F.col("query"))).drop("_words")


def overlay(rows: DataFrame, progress: DataFrame, key: str, column: str) -> DataFrame:
    """Non-empty values of ``progress`` over those of ``rows``."""
    p = progress.select(key, F.col(column).alias("_p"))
    return rows.join(p, key, "left").withColumn(column, F.coalesce(F.nullif("_p", F.lit("")), F.col(column))).drop("_p")


def latest(log: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """The last write of each key."""
    return log.groupBy(key).agg(F.max_by(value, version).alias(value))


def assign_unrelated(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Give each row (id) its own bank phrase: ranks of one meet ranks of the other,
    and rows beyond the bank's size have a null phrase; ``repair_unrelated`` is the
    whole repair, with a bank that is large enough.

    Ranks come from ranges and their offsets, so that no single task orders all
    rows."""
    return ranked(rows.select("id"), "id").join(ranked(bank.select("phrase"), "phrase"), "rank", "left").select("id", "phrase")


# The vocabularies of the distractor bank.
SUBJECTS = (
    "copper kettle", "paper lantern", "granite quarry", "tram depot", "rowing boat", "market awning", "grain silo", "telescope mirror", "loom workshop", "salt cellar",
    "brick chimney", "stone mill wheel", "violin maker", "beekeeper suit", "ice cream cart", "tin whistle", "chess tournament", "fishing trawler", "glass blower", "rubber duck",
    "puppet theatre", "cable car cabin", "apple press", "pinball machine", "garden gnome", "suspension bridge", "wicker basket", "drum kit", "fossil cabinet", "candle mould",
)
SETTINGS = (
    "before sunrise", "in heavy rain", "behind a picket fence", "under a tin roof", "beside a frozen pond", "in a tiled courtyard", "on a gravel path", "below a viaduct",
    "at a village fair", "inside an old barn", "on a stone quay", "near a lock gate", "in a narrow alley", "among tall reeds", "on a checked cloth", "at the end of a pier",
)
STYLES = ("grainy picture", "low angle view", "overhead shot", "soft focus picture", "long exposure", "panorama", "pencil sketch", "faded postcard", "studio portrait", "split tone print")


def distractor_bank(spark, n: int) -> DataFrame:
    """n different phrases (phrase): the product of three vocabularies, then numbered
    variants of it, without end."""
    i, at = F.col("id"), 1
    part = {}
    for name, words in (("subject", SUBJECTS), ("setting", SETTINGS), ("style", STYLES)):
        part[name] = F.element_at(F.array(*map(F.lit, words)), (F.floor(i / at) % len(words) + 1).cast("int"))
        at *= len(words)
    again = F.floor(i / at)
    phrase = F.concat(part["style"], F.lit(" of "), part["subject"], F.lit(" "), part["setting"], F.when(again > 0, F.concat(F.lit(", take "), again.cast("string"))).otherwise(""))
    return spark.range(n).select(phrase.alias("phrase"))


def repair_unrelated(flagged: DataFrame, bank: DataFrame | None = None, least: int = 80_000) -> DataFrame:
    """(id, unrelated_query, how) for every row: kept, local_bank with a phrase of its
    own, or failed where every phrase left is the row's query or one of its captions.

    A row asks by any code of ``UNRELATED_CODES``, empty_field only if this is the
    empty field. Phrases in use in the corpus, generic ones and those under 12
    characters go from the bank. Rows and phrases meet by rank in rounds: who cannot
    take each other meet others in the next, in another order, until a count of the
    pairs that cannot meet tells that no other are left. Without ``bank`` one of
    ``least`` phrases or two for each row that asks is built."""
    spark = flagged.sparkSession
    u = T.strip(F.coalesce("unrelated_query", F.lit("")))
    asks = needs(F.col("codes"), [c for c in UNRELATED_CODES if c != "empty_field"]) | (u == "")
    banned = F.array_distinct(F.transform(F.concat(F.coalesce("captions", F.array().cast("array<string>")), F.array("query")), T.norm_quality))
    rows = written(flagged.select(F.monotonically_increasing_id().alias("_row"), "id", "unrelated_query", banned.alias("banned"), asks.alias("asks")), "asking")
    used = rows.select("unrelated_query").filter(~F.coalesce(T.is_generic(F.col("unrelated_query")), F.lit(True))).select(T.norm_quality(F.col("unrelated_query")).alias("norm")).distinct()
    left = rows.filter("asks").select("_row", "banned")
    n = left.count()
    if bank is None:
        bank = distractor_bank(spark, max(least, 2 * n + used.count()))
    free = bank.withColumn("norm", T.norm_quality(F.col("phrase"))).filter((F.length("phrase") >= 12) & ~T.is_generic(F.col("phrase")))
    free = written(free.groupBy("norm").agg(F.min("phrase").alias("phrase")).join(used, "norm", "left_anti"), "phrases")
    m, taken, turn = free.count(), None, 0
    while n and m:
        turn += 1
        shuffled = lambda df, c: ranked(df.withColumn("_o", F.xxhash64(c, F.lit(turn))), "_o", c).drop("_o")  # noqa: B023, E731
        met = shuffled(left, "_row").join(shuffled(free, "norm"), "rank").filter(~F.coalesce(F.array_contains("banned", F.col("norm")), F.lit(False)))
        now = written(met.select("_row", "phrase", "norm"), "assigned")
        taken = now if taken is None else taken.unionByName(now)
        left, free = written(left.join(now, "_row", "left_anti"), "asking"), written(free.join(now, "norm", "left_anti"), "phrases")
        n, m = left.count(), free.count()
        if n and m and left.select(F.explode("banned").alias("norm")).join(free, "norm").count() == n * m:
            break
    if taken is None:
        taken = spark.createDataFrame([], "_row long, phrase string")
    how = F.when(~F.col("asks"), "kept").when(F.col("phrase").isNotNull(), "local_bank").otherwise("failed")
    return rows.join(taken.select("_row", "phrase"), "_row", "left").select("id", F.when(F.col("asks"), F.col("phrase")).otherwise(F.col("unrelated_query")).alias("unrelated_query"), how.alias("how"))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Adds rank, from 1, over the whole table: rows are numbered within ranges of the
    order, after the counts of the ranges before. The rows are written once, range by
    range, so counts and numbers agree however often computed; there are as many ranges
    as shuffle partitions, and equal values are spread over them by a hash of the row."""
    from pyspark.sql.window import Window

    keyed = df.withColumn("_tie", F.xxhash64(*df.columns))
    parts = written(keyed.repartitionByRange(*order, "_tie").withColumn("_p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per range
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    numbered = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order, "_tie")))
    return numbered.join(F.broadcast(before), "_p").withColumn("rank", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before", "_tie")


#: Ranks of one block of :func:`moving_mean`: weights within it stay far from zero.
BLOCK = 512


def moving_mean(rows: DataFrame, key: str, order: str, value: str, momentum: float = 0.99) -> DataFrame:
    """(key, n, mean): the exponential moving mean of each key in order, the first value
    as it is. Null values are left out.

    A value's weight depends on its distance from the key's last value alone, so sums
    by block of ranks, then of blocks, give the mean; a hot key fills no task."""
    line = ranked(rows.filter(F.col(value).isNotNull()).select(key, order, value), key, order).withColumn("_block", F.floor(F.col("rank") / BLOCK))
    decay = lambda d: F.pow(F.lit(momentum), d)
    last = (F.col("_block") + 1) * BLOCK
    blocks = line.groupBy(key, "_block").agg(
        F.sum(F.col(value) * (1 - momentum) * decay(last - F.col("rank"))).alias("_sum"), F.min("rank").alias("_from"), F.max("rank").alias("_to"), F.min_by(value, "rank").alias("_v")
    )
    ends = blocks.groupBy(key).agg(F.min("_from").alias("_first"), F.max("_to").alias("_last"), F.min_by("_v", "_from").alias("_initial"))
    total = blocks.select(key, "_block", "_sum").join(ends, key).groupBy(key, "_first", "_last", "_initial").agg(F.sum(F.col("_sum") * decay(F.col("_last") - last)).alias("_sum"))
    return total.select(key, (F.col("_last") - F.col("_first") + 1).alias("n"), (F.col("_sum") + momentum * F.col("_initial") * decay(F.col("_last") - F.col("_first"))).alias("mean"))
