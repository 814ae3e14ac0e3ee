"""Contrastive losses over score tables (q, d, score), in long form, and their masks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import dedup, vectors
from .quality import ranked
from .sampling import hash_key


def prefix_dims(dims, full: int) -> list[int]:
    """Strict prefixes of a vector of ``full`` numbers, each once, in the order given."""
    return list(dict.fromkeys(int(d) for d in dims if 0 < int(d) < full))


def non_negatives(texts: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame] | None:
    """What a batch must not push apart: pairs (a, b, jaccard) of similar token sets of
    one batch, between class representatives, and membership (id, rep); a text is
    always its own. ``texts`` is (batch, id, tokens). None for a threshold of 0 or less.

    The batch is part of every token, so that the join by prefixes meets no text of
    another batch."""
    if threshold <= 0:
        return None
    own = texts.select("id", F.transform("tokens", lambda t: F.concat(F.col("batch").cast("string"), F.lit(" "), t)).alias("tokens"))
    return dedup.similarity_join(own, threshold)


def softmax_loss(scores: DataFrame, labels: DataFrame, excluded: DataFrame | None = None, tau: float = 1.0) -> DataFrame:
    """(q, loss): cross entropy of each query's label (q, d). Pairs (q, d) of
    ``excluded`` leave the denominator, but never the label."""
    marked = scores.join(labels.withColumn("_label", F.lit(True)), ["q", "d"], "left")
    if excluded is not None:
        marked = marked.join(excluded.select("q", "d").distinct().withColumn("_out", F.lit(True)), ["q", "d"], "left").filter("_label OR _out IS NULL")
    marked = marked.withColumn("_s", F.col("score") / tau).withColumn("_m", F.max("_s").over(Window.partitionBy("q")))
    label = F.max(F.when(F.col("_label"), F.col("_s")))
    return marked.groupBy("q").agg((F.max("_m") + F.log(F.sum(F.exp(F.col("_s") - F.col("_m")))) - label).alias("loss"))


def one_way_loss(scores: DataFrame, labels: DataFrame, excluded: DataFrame | None = None, tau: float = 0.07, gap_weight: float = 1.0, margin: float = 0.0) -> DataFrame:
    """One row (ce, gap, loss): text to text. Documents are positives, distractors and
    bank alike; the gap's hinge is that of the scaled scores."""
    scaled = scores.withColumn("score", F.col("score") / tau)
    ce = softmax_loss(scaled, labels, excluded).agg(F.avg("loss").alias("ce"))
    gap = vectors.score_gap(scaled, labels, margin).agg(F.avg("hinge").alias("gap"))
    return ce.crossJoin(gap).withColumn("loss", F.col("ce") + F.lit(float(gap_weight)) * F.col("gap"))  # a row each


def bidirectional_loss(forward: DataFrame, backward: DataFrame, labels: DataFrame, tau: float = 0.07, gap_weight: float = 1.0, margin: float = 0.0, excluded: DataFrame | None = None) -> DataFrame:
    """One row (ce, gap, loss): half of each direction. ``forward`` scores queries
    against documents and a bank of more, ``backward`` the labelled documents (as q)
    against queries; ``labels`` is (q, d)."""
    flip = lambda t: None if t is None else t.select(F.col("d").alias("q"), F.col("q").alias("d"))
    two = one_way_loss(forward, labels, excluded, tau, gap_weight, margin).unionByName(one_way_loss(backward, flip(labels), flip(excluded), tau, gap_weight, margin))
    return two.agg(*[F.avg(c).alias(c) for c in ("ce", "gap", "loss")])


def weighted_mean(losses: list[tuple[DataFrame, float]]) -> DataFrame:
    """One row (loss): the weighted mean of one-row losses; weights of 0 or less are left out."""
    active = [(d, float(w)) for d, w in losses if w > 0]
    if not active:
        raise ValueError("no loss has a positive weight")
    rows = [d.select((F.col("loss") * (w / sum(w for _, w in active))).alias("loss")) for d, w in active]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.agg(F.sum("loss").alias("loss"))


def matryoshka_loss(queries: DataFrame, docs: DataFrame, labels: DataFrame, dims, full: int, weight: float = 1.0, **kw) -> DataFrame:
    """One row (loss): the bidirectional loss of whole vectors and ``weight`` times the
    mean of that of normalised prefixes, over 1 + ``weight``."""

    def of(q: DataFrame, d: DataFrame) -> DataFrame:
        live = d.join(labels.select(F.col("d").alias("id")).distinct(), "id", "left_semi")
        return bidirectional_loss(vectors.maxsim(q, d), vectors.maxsim(live, q), labels, **kw).select("loss")

    cut = lambda t, n: t.withColumn("vec", vectors.prefix_normalize(F.col("vec"), n))
    prefixes = [(of(cut(queries, n), cut(docs, n)), 1.0) for n in prefix_dims(dims, full)]
    whole = of(queries, docs)
    return weighted_mean([(whole, 1.0), (weighted_mean(prefixes), weight)]) if prefixes and weight > 0 else whole


def mined(scores: DataFrame, positives: DataFrame, hard: int, random: int = 0, margin: float = 0.0, seed: int = 42) -> DataFrame:
    """(q, d, score, kind): of the bank entries below the positive's score less
    ``margin`` the ``hard`` best, and ``random`` others by hash order; ``hard`` of 0
    or less keeps all."""
    below = vectors.hard_negatives(scores, positives, 0, margin)
    if hard <= 0:
        return below.select("q", "d", "score", F.lit("all").alias("kind"))
    other = F.col("rank") > hard
    w = Window.partitionBy("q", other).orderBy(hash_key(seed, "q", "d"), "d")
    return below.withColumn("_r", F.row_number().over(w)).filter(~other | (F.col("_r") <= random)).select("q", "d", "score", F.when(other, "random").otherwise("hard").alias("kind"))


#: Rows of the pairwise term of :func:`geometry`, taken at even steps of the id order.
UNIFORM_ROWS = 256


def geometry(rows: DataFrame, dim: int, var_ratio: float = 0.5, abs_ratio: float = 4.0, floor: float = 0.05, t: float = 2.0) -> DataFrame:
    """One row of isotropy figures of vectors (id, vec) after normalisation: center,
    var, vec_mean, uniformity, mag_floor, max_abs and their weighted sum, total.

    The pairwise term is over ``UNIFORM_ROWS`` rows at most (the sample is the term's
    definition), so its pairs are bounded; all others are over all rows."""
    unit = rows.select("id", vectors.prefix_normalize(F.col("vec"), dim).alias("v"), F.sqrt(vectors.dot(F.col("vec"), F.col("vec"))).alias("norm"))
    target, most = var_ratio / math.sqrt(dim), abs_ratio / math.sqrt(dim)
    hinge = lambda c: F.pow(F.greatest(F.lit(0.0), c), F.lit(2.0))
    each = unit.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    by_dim = each.agg(F.sum(F.col("m") * F.col("m")).alias("center"), (F.avg(hinge(target - F.col("s"))) + F.max(hinge(target - F.col("s")))).alias("var"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    peak = F.array_max(F.transform("v", F.abs))
    by_row = unit.agg(F.avg(F.pow(total(F.col("v")) / dim, F.lit(2.0))).alias("vec_mean"), F.avg(hinge(floor - F.col("norm"))).alias("mag_floor"), F.avg(hinge(peak - most)).alias("max_abs"), F.count("*").alias("n"))
    at = F.col("rank") - 1
    k = F.expr(f"((rank - 1) * {UNIFORM_ROWS - 1} + n - 2) div greatest(n - 1, 1)")
    few = ranked(unit, "id").crossJoin(F.broadcast(by_row.select("n"))).filter((F.col("n") <= UNIFORM_ROWS) | (F.floor(k * (F.col("n") - 1) / (UNIFORM_ROWS - 1)) == at)).select("rank", "v")
    a, b = few.select(F.col("rank").alias("a"), F.col("v").alias("va")), few.select(F.col("rank").alias("b"), F.col("v").alias("vb"))
    near = a.join(F.broadcast(b), F.col("a") != F.col("b")).agg(F.avg(F.exp(-t * F.greatest(F.lit(0.0), 2 - 2 * vectors.dot(F.col("va"), F.col("vb"))))).alias("uniformity"))
    out = by_dim.crossJoin(by_row.drop("n")).crossJoin(near).withColumn("uniformity", F.coalesce(F.greatest("uniformity", F.lit(1e-8)), F.lit(0.0)))  # a row each
    # The weights of the terms.
    weights = {"center": 2.0, "var": 4.0, "vec_mean": 0.25, "uniformity": 1.0, "mag_floor": 0.1, "max_abs": 0.1}
    return out.withColumn("total", sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)))


def grid_affinity(queries: DataFrame, patches: DataFrame, pairs: DataFrame, height: int, width: int) -> DataFrame:
    """(q, d, row, col, affinity): for the pairs (q, d) each patch's best similarity to
    the query's tokens, at its place in a raster of ``height`` x ``width``; a patch
    beyond the raster is an error."""
    t = pairs.join(queries.select(F.col("id").alias("q"), F.col("vec").alias("_qv")), "q").join(patches.select(F.col("id").alias("d"), "tok", F.col("vec").alias("_pv")), "d")
    best = t.groupBy("q", "d", "tok").agg(F.max(vectors.dot(F.col("_qv"), F.col("_pv"))).alias("affinity"))
    inside = F.when((F.col("tok") >= 0) & (F.col("tok") < height * width), F.col("tok")).otherwise(F.raise_error(F.lit("a patch beyond the raster")).cast("long"))
    return best.select("q", "d", F.floor(inside / width).alias("row"), F.pmod(inside, F.lit(width)).cast("long").alias("col"), "affinity")


def jet(t: Column) -> Column:
    """red, green, blue (0 to 255) of a heat from 0 to 1: blue, cyan, yellow, red in
    quarters, linear between."""
    x = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * 4
    ramp = lambda up, down: F.least(F.greatest(F.least(up, down), F.lit(0.0)), F.lit(1.0))
    byte = lambda c: F.bround(c * 255).cast("int")
    return F.struct(byte(ramp(x - 2, F.lit(1.0))).alias("red"), byte(ramp(x, 4 - x)).alias("green"), byte(ramp(2 - x, F.lit(1.0))).alias("blue"))


def earlier_top_k(entries: DataFrame, k: int = 2) -> DataFrame:
    """The k most similar of the entries (id, tok, vec) stored before each (smaller ids)."""
    return vectors.maxsim_top_k(entries, entries, k, earlier=True)


def dequantised(codes: Column, scale: Column) -> Column:
    """Row-scaled 8-bit integers as doubles: a row's scale is its greatest magnitude."""
    return F.transform(codes, lambda c: c.cast("double") * scale.cast("double") / 127.0)


def learning_rate(step: Column, base: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine."""
    done = (step - warmup) / max(total - warmup, 1)
    return F.when(step < warmup, base * (step + 1) / max(warmup, 1)).otherwise(base * 0.5 * (1 + F.cos(F.lit(math.pi) * done)))
