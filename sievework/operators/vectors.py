"""Late interaction, Matryoshka prefixes, and contrastive figures in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .maxsim import affinity, best_tokens_maxsim, maxsim, maxsim_top_k, soft_maxsim, token_maxsim  # noqa: F401  # part of this module's functions
from .spread import merged_onto_seeds

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def prefix_normalize(v: Column, dim: int) -> Column:
    p = F.transform(F.slice(v, 1, dim), lambda x: x.cast("double"))
    return F.transform(p, lambda x: x / F.greatest(F.sqrt(dot(p, p)), F.lit(1e-12)))


def top_k(scores: DataFrame, k: int, by: str = "q", order: str = "score", tie: str = "d") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(order), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def soft_max(s: Column, tau: float, over) -> Column:
    """tau * logsumexp(s / tau), stable; ``over`` is a window."""
    m = F.max(s).over(over)
    return m + tau * F.log(F.sum(F.exp((s - m) / tau)).over(over))


def mid_rank(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """(q, rank): mid-rank of the positive among finite scores."""
    p = scores.join(positives, ["q", "d"]).select("q", F.col("score").alias("pos"))
    return scores.join(p, "q").groupBy("q").agg((F.count_if(F.col("score") > F.col("pos")) + (F.count_if(F.col("score") == F.col("pos")) + 1) / 2).alias("rank"))


def score_gap(scores: DataFrame, positives: DataFrame, margin: float = 1.0) -> DataFrame:
    """(q, gap, hinge): positive minus mean negative, and the hinge of the gap."""
    marked = scores.join(positives.withColumn("pos", F.lit(True)), ["q", "d"], "left")
    g = marked.groupBy("q").agg(F.max(F.when(F.col("pos"), F.col("score"))).alias("p"), F.sum(F.when(F.col("pos").isNull(), F.col("score"))).alias("n"), F.count_if(F.col("pos").isNull()).alias("k"))
    return g.select("q", (F.col("p") - F.coalesce("n", F.lit(0.0)) / F.greatest("k", F.lit(1))).alias("gap")).withColumn("hinge", F.greatest(F.lit(0.0), F.lit(margin) - F.col("gap")))


def multi_positive_loss(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """(q, loss): log Z minus logsumexp over positives."""
    marked = scores.join(positives.withColumn("pos", F.lit(True)), ["q", "d"], "left").withColumn("m", F.max("score").over(Window.partitionBy("q")))
    e = F.exp(F.col("score") - F.col("m"))
    return marked.groupBy("q").agg((F.log(F.sum(e)) - F.log(F.sum(F.when(F.col("pos"), e)))).alias("loss"))


def hard_negatives(scores: DataFrame, positives: DataFrame, k: int, margin: float = 0.0) -> DataFrame:
    """Per query the k best bank entries below the positive's score less ``margin``;
    those not below count as false negatives and go. k <= 0 keeps all."""
    p = scores.join(positives, ["q", "d"]).select("q", F.col("score").alias("pos"))
    kept = scores.join(positives, ["q", "d"], "left_anti").join(p, "q").filter(F.col("score") < F.col("pos") - margin).drop("pos")
    return top_k(kept, k) if k > 0 else kept.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d")))


def heatmap_peak(scores: DataFrame, by: str, tau: float = 0.06, gamma: float = 1.0) -> DataFrame:
    """Adds heat: exp((s - max) / tau) ** gamma, all zero where the spread is under 1e-4."""
    w = Window.partitionBy(by)
    top, low = F.max("score").over(w), F.min("score").over(w)
    return scores.withColumn("heat", F.when(top - low < 1e-4, 0.0).otherwise(F.pow(F.exp((F.col("score") - top) / tau), gamma)))


def heatmap_percentile(scores: DataFrame, by: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Adds heat: linear between two interpolated percentiles of each ``by``, clamped
    to 0..1; equal percentiles give way to the least and greatest score."""
    p = F.percentile("score", F.array(F.lit(low), F.lit(high)))
    ends = scores.groupBy(by).agg(p.alias("p"), F.min("score").alias("least"), F.max("score").alias("most"))
    ok = F.get("p", F.lit(1)) > F.get("p", F.lit(0))
    lo, hi = F.when(ok, F.get("p", F.lit(0))).otherwise(F.col("least")), F.when(ok, F.get("p", F.lit(1))).otherwise(F.col("most"))
    ends = ends.select(by, lo.alias("lo"), F.when(hi > lo, hi).otherwise(lo + 1e-6).alias("hi"))
    return scores.join(ends, by).withColumn("heat", F.least(F.greatest((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))).drop("lo", "hi")


def keep_top_tokens(tokens: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Of each id's tokens the ``ratio`` (rounded half to even, 1 at least) with the
    greatest L2 norm; equal norms by token number."""
    v = F.col("vec")
    ranked = tokens.withColumn("norm", F.sqrt(dot(v, v))).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("norm"), "tok")))
    return ranked.filter(F.col("rank") <= F.greatest(F.bround(F.col("n") * ratio), F.lit(1))).drop("norm", "n", "rank")


def centred(tokens: DataFrame) -> DataFrame:
    """Token vectors less the mean of all, normalised. The mean is one row of as many
    numbers as a vector has, hence broadcast."""
    each = tokens.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_mean"))
    less = tokens.crossJoin(F.broadcast(mean)).withColumn("vec", F.zip_with("vec", "_mean", lambda x, m: x.cast("double") - m)).drop("_mean")
    return less.withColumn("vec", F.transform("vec", lambda x: x / F.greatest(F.sqrt(dot(F.col("vec"), F.col("vec"))), F.lit(1e-12))))


def sparsity_entropy(scores: DataFrame, by: str, tau: float = 0.07) -> DataFrame:
    """(by, entropy): softmax entropy over ln n."""
    w = Window.partitionBy(by)
    e = F.exp((F.col("score") - F.max("score").over(w)) / tau)
    p = scores.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w))
    return p.groupBy(by).agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)) / F.log(F.greatest(F.count("*"), F.lit(2)).cast("double"))).alias("entropy"))


def merge_consecutive(tokens: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Greedy merge of consecutive tokens into the running mean of their group."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tok")
        groups: list[tuple[np.ndarray, int]] = []
        for v in pdf["vec"]:
            v = np.asarray(v, np.float64)
            v = v / max(np.linalg.norm(v), 1e-12)
            if groups:
                mean = groups[-1][0] / groups[-1][1]
                if mean @ v / max(np.linalg.norm(mean), 1e-12) >= threshold:
                    groups[-1] = (groups[-1][0] + v, groups[-1][1] + 1)
                    continue
            groups.append((v, 1))
        unit = [(s / n) / max(np.linalg.norm(s / n), 1e-12) for s, n in groups]
        return pd.DataFrame({"id": pdf["id"].iloc[0], "tok": range(len(groups)), "n": [n for _, n in groups], "vec": [u.tolist() for u in unit]})

    return tokens.groupBy("id").applyInPandas(merge, "id long, tok long, n long, vec array<double>")


def farthest_points(tokens: DataFrame, k: int = 8, tau: float = 0.05) -> DataFrame:
    """k seeds by farthest-point sampling; tokens assigned by softmax; weighted sums."""
    return merged_onto_seeds(tokens, k, tau)
