"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are cut by a hash of id and text into blocks of about ``BLOCK`` words,
which are thereby a random partition of their source. A source's target fixes how
many draws of blocks it gives: whole epochs, then blocks of one more epoch, the
last of them down to the word. The tree halves the output shards again and again
and draws, at each node, how many of every source's draws go left; a shard then
has a run of each source's draws. A draw is a place in an epoch, and a seeded
permutation of each epoch tells which block has that place. What the mix takes of
a document is read from these drawn blocks.

Everything grows with the number of blocks and is a table: targets come from
aggregates over the sources, the tree goes down ``LEVELS`` levels a pass, each
pass a group per node and range of sources.

Defined results: a null text has size 0; a null source is one source, ordered
last; null ids hash as one value; rows equal in id and text share the cut in
proportion, so repeated rows get equal shares; a very long text is a block of its
own at most; empty tables and tables without words take nothing; other columns are
carried by :func:`mix` and their names may be any.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SPACE, fresh, join_counted, n_words, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Words of a block and of a shard.
BLOCK, SHARD = 20_000, 2_000_000
#: Levels of the tree that one pass goes down, and sources of a group.
LEVELS, RANGE = 6, 4096
#: Numpy's bound of a population, and standard deviations summed beyond it.
NUMPY_MOST, WIDE = 10**9, 12
#: Rows of a table of sources or draws that may be broadcast; larger ones are joined.
SMALL = 200_000
# Primes above any number of blocks: multiplied by one, the places of an epoch are permuted.
PRIMES = (2147483647, 2147483629, 2147483587)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A written row (none, name, id, size, h) per document: the source is ``name``,
    or null where ``none``."""
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    key = [source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")]
    return table(docs.select(*key, F.col(f"`{id_col}`").alias("id"), n_words(text).alias("size"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("h")), "mix-sizes")


SOURCE = ["none", "name"]


def targets(rows: DataFrame, share: float = SHARE, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """A written row per source of ``rows``: none, name, sno (its number by code
    point, null last), n (rows), source_size, weight, target.

    By weight, at most ``cap`` times the size; the excess goes to the others by
    weight until none is above. A source is above if its size by weight is under a
    bound, which rises from round to round, so a round is one aggregate."""
    sums = table(rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    from ..operators.quality import ranked

    numbered = ranked(sums, *SOURCE).withColumn("sno", F.col("rank") - 1).drop("rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.col("sno") % len(weights) + 1).cast("int"))
    numbered = table(numbered.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight")), "mix-numbered")
    size, left_weight = numbered.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * (size or 0)
    left, bound = total, -1.0
    while left_weight and left / (cap * left_weight) > bound:
        bound = left / (cap * left_weight)
        over, left_weight = numbered.agg(F.sum(F.when(F.col("ratio") < bound, F.col("source_size"))), F.sum(F.when(F.col("ratio") >= bound, F.col("weight")))).first()
        left = total - cap * (over or 0)
    per_weight = left / left_weight if left_weight else 0.0
    goal = F.when(F.col("ratio") < bound, cap * F.col("source_size")).otherwise(per_weight * F.col("weight"))
    return table(numbered.withColumn("target", goal.cast("double")).drop("ratio"), "mix-targets")


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with their source's columns; a source with a large share of all rows
    does not move them."""
    if sources.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(sources), SOURCE)
    return join_counted(rows, sources, SOURCE, "n")


def place(block: Column, blocks: Column, sno: Column, epoch: Column, seed: int) -> Column:
    """The place of a block in the order of an epoch."""
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(F.xxhash64(sno, epoch, F.lit(seed)), F.lit(len(PRIMES))) + 1).cast("int"))
    return F.pmod((prime % blocks) * block + F.pmod(F.xxhash64(epoch, sno, F.lit(seed)), blocks), blocks)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good. Numpy draws from populations
    under 10^9; beyond, the distribution is summed around its mode, ``WIDE`` standard
    deviations to either side, from the ratios of neighbouring values."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    sd = math.sqrt(n * (good / (good + bad)) * (bad / (good + bad)) * max(1, good + bad - n) / (good + bad)) + 1
    a, b = max(low, mode - int(WIDE * sd)), min(high, mode + int(WIDE * sd))
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log = np.concatenate([[0.0], np.cumsum(ratio)])
    weight = np.cumsum(np.exp(log - log.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], "right"))


def draw(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``n``, colour by colour."""
    left = int(colours.sum())
    if left < NUMPY_MOST:
        return rng.multivariate_hypergeometric(colours, n, method="marginals") if len(colours) else colours
    out = np.zeros_like(colours)
    for i, c in enumerate(colours.tolist()):
        left -= c
        out[i] = hypergeometric(rng, c, left, n) if left else n
        n -= int(out[i])
    return out


def lefts(total: int, shards: int) -> list[int]:
    """Of a node's subtree, in heap order from 1, how many draws go left at each node:
    a share by the halves' shards."""
    out, now = [0] * (1 << LEVELS), {1: (total, shards)}
    for i in range(1, 1 << LEVELS):
        n, s = now.pop(i, (0, 1))
        if s > 1:
            out[i] = n * (s // 2) // s
            now[2 * i], now[2 * i + 1] = (out[i], s // 2), (n - out[i], s - s // 2)
    return out


def deal(draws: np.ndarray, shards: int, left: list[int], rng: np.random.Generator):
    """(what goes left of each item at each node of the subtree; its leaves as (number,
    first shard, shards, starts, draws)). At every node the items' draws that go left
    are drawn together and sum to ``left``."""
    gone = np.zeros((len(draws), 1 << LEVELS), np.int64)
    now, leaves = {1: (0, shards, np.zeros_like(draws), draws)}, []
    for i in range(1, 2 << LEVELS):
        if i not in now:
            continue
        low, s, start, own = now.pop(i)
        if s == 1 or i >= 1 << LEVELS:
            leaves.append((i, low, s, start, own))
            continue
        gone[:, i] = mine = draw(rng, own, left[i])
        now[2 * i], now[2 * i + 1] = (low, s // 2, start, mine), (low + s // 2, s - s // 2, start + mine, own - mine)
    return gone, leaves


NODE = "node string, low long, shards long, sno long, start long, draws long"


def _ranges(seed: int, height: int):
    """Cuts (node, item, left) of one node's items with one parent."""

    def cuts(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("item")
        gone, _ = deal(f["draws"].to_numpy(), int(f["shards"].iat[0]), _left(f), _rng(f, seed, height))
        return pd.DataFrame({"node": f["node"].iat[0], "item": f["item"].to_numpy(), "left": list(gone)})

    return cuts


def _sources(seed: int):
    """The leaves, as rows of ``NODE``, of one node's sources of one range."""

    def down(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("item")
        _, leaves = deal(f["draws"].to_numpy(), int(f["shards"].iat[0]), _left(f), _rng(f, seed, 0))
        node, begin, base = f["node"].iat[0], f["start"].to_numpy(), int(f["low"].iat[0])
        out = [pd.DataFrame({"node": f"{node}.{i}", "low": base + low, "shards": s, "sno": f["item"].to_numpy(), "start": begin + start, "draws": own})[own > 0] for i, low, s, start, own in leaves]
        return pd.concat(out, ignore_index=True)

    return down


def _left(f: pd.DataFrame) -> list[int]:
    given = f["left"].iat[0]
    return lefts(int(f["draws"].sum()), int(f["shards"].iat[0])) if given is None else [int(x) for x in given]


def _rng(f: pd.DataFrame, seed: int, height: int) -> np.random.Generator:
    return np.random.default_rng((seed, height, int(f["low"].iat[0]), int(f["shards"].iat[0]), int(f["parent"].iat[0])))


def splitting_tree(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, sno, start, draws): which run of each source's ``draws`` a shard has,
    of ``quotas`` (sno, draws). A level's rows are at most as many as all draws.

    A node's sources are dealt in ranges of ``RANGE``, these in ranges of ranges: first
    how many draws of each range go left, then, given these, how many of each source
    within. So a group has ``RANGE`` rows at most, and the draw is that of all
    sources together."""
    now = quotas.filter("draws > 0").select(F.lit("1").alias("node"), F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("shards"), "sno", F.lit(0).cast("long").alias("start"), "draws")
    most, heights = (quotas.agg(F.max("sno")).first()[0] or 0) + 1, 1
    while RANGE**heights < most:
        heights += 1
    for _ in range(0, math.ceil(math.log2(shards)) if shards > 1 else 0, LEVELS):
        cuts = None
        for h in reversed(range(heights)):
            items = now.withColumn("item", F.floor(F.col("sno") / RANGE**h))
            if h:
                items = items.groupBy("node", "low", "shards", "item").agg(F.sum("draws").alias("draws"))
            items = items.withColumn("parent", F.floor(F.col("item") / RANGE))
            items = items.withColumn("left", F.lit(None).cast("array<long>")) if cuts is None else items.join(cuts.withColumnRenamed("item", "parent"), ["node", "parent"])
            group = items.groupBy("node", "parent")
            if h:
                cuts = table(group.applyInPandas(_ranges(seed, h), "node string, item long, left array<long>"), "mix-cuts")
            else:
                now = table(group.applyInPandas(_sources(seed), NODE), "mix-nodes")
    return now.select(F.col("low").alias("shard"), "sno", "start", "draws")


def plan(rows: DataFrame, block_words: int = BLOCK, shard_words: int = SHARD, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Of the sizes ``rows``: the sources (none, name, sno, n, source_size, target,
    epochs, blocks, and the cut of the last block drawn: hashes below ``cut`` are
    whole, at ``cut`` ``num / den`` of the words), and the draws (sno, block, epoch,
    shard, partial: whether that block is cut), both written."""
    goals = targets(rows)
    words = goals.agg(F.sum("target")).first()[0] or 0.0
    want, size = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    epochs = F.least(F.expr("2L"), F.floor(F.col("want") / size))
    sources = goals.withColumn("want", want).withColumns({"epochs": epochs.cast("int"), "blocks": F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1))})
    sources = table(sources.withColumn("rest", F.col("want") - F.col("epochs") * F.col("source_size")).drop("want", "weight"), "mix-plan")

    blocked = with_source(rows.filter("size > 0"), sources.select(*SOURCE, "n", "sno", "epochs", "blocks", "rest")).select("sno", "h", "size", "epochs", "blocks", "rest", block_of().alias("block"))
    blocks = table(blocked.groupBy("sno", "block", "epochs", "blocks", "rest").agg(F.sum("size").alias("words")), "mix-blocks")
    # The block in which the last epoch's words end: by ranges of places, then by place, then by hash.
    last = blocks.filter("rest > 0").withColumn("place", place(F.col("block"), F.col("blocks"), F.col("sno"), F.col("epochs"), seed)).withColumn("range", F.expr("place * 1024 div blocks"))
    ranges = _crossing(last.groupBy("sno", "rest", "range").agg(F.sum("words").alias("words")), "range", "rest")
    inside = last.drop("rest").join(F.broadcast(ranges.select("sno", "range", F.col("need").alias("rest"))), ["sno", "range"]) if _few(ranges) else last.drop("rest").join(ranges.select("sno", "range", F.col("need").alias("rest")), ["sno", "range"])
    ends = _crossing(inside.select("sno", "rest", "place", "block", "words"), "place", "rest", "block")
    cutting = ends.select("sno", "block", "place", F.col("need").alias("rest"))
    hashes = blocked.select("sno", "block", "h", "size").join(F.broadcast(cutting) if _few(cutting) else cutting, ["sno", "block"])
    cuts = _crossing(hashes.groupBy("sno", "rest", "place", "h").agg(F.sum("size").alias("words")), "h", "rest", "place")
    cuts = cuts.select("sno", F.col("place").alias("_place"), F.col("h").alias("_h"), F.col("need").alias("_num"), F.col("words").alias("_den"))
    sources = table(
        sources.join(cuts, "sno", "left")
        .withColumns({"cut": F.coalesce("_h", F.lit(-(2**63))), "num": F.coalesce("_num", F.lit(0).cast("long")), "den": F.coalesce("_den", F.lit(1).cast("long"))})
        .withColumn("quota", F.col("epochs") * F.col("blocks") + F.coalesce(F.col("_place") + 1, F.lit(0))).withColumn("cutting", F.col("_place").isNotNull())
        .drop("_place", "_h", "_num", "_den", "rest"),
        "mix-sources",
    )
    shards = max(1, math.ceil(words / shard_words))
    leaves = splitting_tree(sources.select("sno", F.col("quota").alias("draws")), shards, seed)
    drawn = leaves.select("shard", "sno", F.explode(F.expr("sequence(start, start + draws - 1)")).alias("draw"))  # a shard's blocks
    own = sources.select("sno", "epochs", "blocks", "quota", "cutting")
    drawn = drawn.join(F.broadcast(own) if _few(own) else own, "sno").select(
        "sno", "shard", F.expr("cast(draw div blocks AS int)").alias("epoch"), F.expr("draw % blocks").alias("place"), (F.col("cutting") & (F.col("draw") == F.col("quota") - 1)).alias("partial")
    )
    places = blocks.select("sno", "block", "blocks", F.explode(F.sequence(F.lit(0), F.col("epochs"))).alias("epoch"))
    places = places.withColumn("place", place(F.col("block"), F.col("blocks"), F.col("sno"), F.col("epoch"), seed))
    return sources, table(drawn.join(places, ["sno", "epoch", "place"]).select("sno", "block", "epoch", "shard", "partial"), "mix-draws")


def _few(df: DataFrame) -> bool:
    return df.limit(SMALL + 1).count() <= SMALL


def _crossing(parts: DataFrame, order: str, rest: str, *keep: str) -> DataFrame:
    """Of each source's parts in order, that in which ``rest`` words are exceeded or
    met, with ``need``: how many of its words belong to them."""
    ahead = Window.partitionBy("sno").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = parts.withColumn("upto", F.sum("words").over(ahead)).withColumn("need", F.col(rest) - F.col("upto") + F.col("words"))
    return table(upto.filter((F.col("need") > 0) & (F.col("need") <= F.col("words"))).select("sno", order, "need", "words", *keep), "mix-crossing")


def block_of() -> Column:
    return F.pmod(F.col("h"), F.col("blocks"))


def cut_words() -> Column:
    """Words of a row that the cut of its block leaves."""
    part = F.when(F.col("h") < F.col("cut"), F.col("size")).when(F.col("h") == F.col("cut"), F.expr("size * num div den"))
    return part.otherwise(F.lit(0).cast("long"))


def with_draws(rows: DataFrame, sources: DataFrame, draws: DataFrame, how: str) -> DataFrame:
    """``rows`` with their source's columns and the draws of their block."""
    known = with_source(rows, sources.drop("quota", "cutting")).withColumn("block", block_of())
    return known.join(F.broadcast(draws) if _few(draws) else draws, ["sno", "block"], how)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each: read from the drawn blocks."""
    rows = sized(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    sources, draws = plan(rows)
    drawn = table(draws.groupBy("sno", "block").agg(F.count_if(~F.col("partial")).alias("times"), F.max("partial").alias("partial")), "mix-drawn")
    taken = F.coalesce("times", F.lit(0).cast("long")) * F.col("size") + F.when(F.col("partial"), cut_words()).otherwise(F.lit(0).cast("long"))
    return with_draws(rows, sources, drawn, "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """The sources' sizes and targets."""
    goals = targets(sized(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source"))
    return goals.select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size", F.round("target", 3).alias("target"))


TARGETS_SQL = f"""
WITH RECURSIVE s AS (SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n FROM documents GROUP BY source),
o AS (SELECT source, n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s),
t AS (SELECT {SHARE} * sum(n) AS total FROM o),
b AS (SELECT 0 AS i, -1.0::DOUBLE AS last, (SELECT total FROM t) / ({CAP} * (SELECT sum(w) FROM o)) AS bound
  UNION ALL SELECT i + 1, bound, ((SELECT total FROM t) - {CAP} * coalesce((SELECT sum(n) FROM o WHERE n / w < b.bound), 0)) / ({CAP} * (SELECT sum(w) FROM o WHERE n / w >= b.bound))
  FROM b WHERE bound > last AND (SELECT sum(w) FROM o WHERE n / w >= b.bound) IS NOT NULL),
e AS (SELECT max(bound) AS bound FROM b)
SELECT source, n AS source_size, round(CASE WHEN n / w < e.bound THEN {CAP} * n ELSE e.bound * {CAP} * w END, 3) AS target FROM o, e
"""


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, shard_col: str | None = None, order_col: str | None = None) -> DataFrame:
    """The mix itself: each document as often as it is drawn, dealt to shards and
    shuffled within them. Of a document that is cut the first words stay, joined
    by single spaces. ``shard_col`` and ``order_col`` add the shard's number and the
    order within it."""
    sources, draws = plan(sized(docs, id_col, text_col, source_col), seed=seed)
    names = list(docs.columns)
    all_ = fresh([*names, "id"], "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(all_))
    text, source = F.col(f"{all_}.`{text_col}`"), F.col(f"{all_}.`{source_col}`").cast("string")
    flat = packed.select(all_, source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"), n_words(text).alias("size"), F.xxhash64(F.col(f"{all_}.`{id_col}`"), text).alias("h"))
    taken = with_draws(flat.filter("size > 0"), sources, draws, "inner").withColumn("words", F.when(F.col("partial"), cut_words()).otherwise(F.col("size"))).filter("words > 0")
    cut = F.array_join(F.slice(F.filter(F.split(text, SPACE), lambda w: w != ""), 1, F.col("words").cast("int")), " ")
    kept = F.when(F.col("words") < F.col("size"), cut).otherwise(text)
    dealt = taken.select("shard", F.xxhash64("h", "epoch", F.lit(seed)).alias("order"), *[(kept if c == text_col else F.col(f"{all_}.`{c}`")).alias(f"c{i}") for i, c in enumerate(names)])
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "order")
    extra = [F.col(c).alias(name) for c, name in (("shard", shard_col), ("order", order_col)) if name]
    return dealt.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *extra)
