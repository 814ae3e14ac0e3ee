"""URL filter: host rules first, gradient-boosted trees on lexical features else.

Built-in functions only. The trees are histogram trees: a level of a tree is one
aggregation over (node, feature, bin), the driver sees those few sums, and the
fitted model is a CASE expression that scores inside code generation.

Defined results: a null url, or one without ``://``, has empty host and path and
is judged by the model; with no labelled url, or one class only, the model is a
constant (allow when there is none). Repeated rows each give a row; an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, table

# Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "labels", "hyphens", "suffix_rate", "suffix_share")
#: Places of the suffix statistics, and folds whose labels a training row does not see.
BUCKETS, FOLDS = 4096, 5


def parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    return df.withColumn("host", F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))).withColumn(
        "path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its text, its verdict), null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def lexical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the lexical features of a url (with host and path) as doubles."""
    u = F.coalesce(F.col(url_col), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    count = lambda c, rx: F.regexp_count(c, F.lit(rx)).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    entropy = F.aggregate(
        F.when(F.length(u) > 0, chars).otherwise(F.array().cast("array<string>")), F.lit(0.0),
        lambda a, c: a - (F.length(u) - F.length(F.replace(u, c))) / n * F.log2((F.length(u) - F.length(F.replace(u, c))) / n),
    )
    return df.withColumns({
        "length": F.length(u).cast("double"), "depth": count(F.col("path"), "/"), "digit_ratio": count(u, "[0-9]") / n, "entropy": F.round(entropy, 6),
        "params": count(F.regexp_extract(u, r"\?([^#]*)", 1), "[^&]+"), "labels": count(F.col("host"), "[^.]+"), "hyphens": count(F.col("host"), "-"),
        "suffix": F.substring_index("host", ".", -1),
    })


@dataclass
class Model:
    """Thresholds by feature and trees as nested tuples (feature, threshold, left, right) or leaf values."""

    prior: float = 0.0
    trees: list = field(default_factory=list)
    suffixes: DataFrame | None = None

    def margin(self) -> Column:
        def walk(t) -> Column:
            return F.lit(float(t)) if not isinstance(t, tuple) else F.when(F.col(t[0]) <= t[1], walk(t[2])).otherwise(walk(t[3]))

        out = F.lit(float(self.prior))
        for t in self.trees:
            out = out + walk(t)
        return out


def bucket(suffix: str = "suffix") -> Column:
    """A suffix's place in the statistics: a hash, so that their table is bounded."""
    return F.pmod(F.xxhash64(suffix), F.lit(BUCKETS)).cast("int")


def fold(url: str = "url") -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(url)), F.lit(FOLDS)).cast("int")


def suffix_statistics(df: DataFrame, suffixes: DataFrame, own_fold: bool = False) -> DataFrame:
    """Adds a suffix's smoothed block rate and its share of the labelled urls. The
    table has at most ``BUCKETS`` times ``FOLDS`` rows, hence broadcast. With
    ``own_fold`` a row's rate and share leave the urls of its own fold out, so that no
    row's label is in its features."""
    sums = suffixes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    every = suffixes.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    out = df.withColumns({"bucket": bucket(), "fold": fold()}).join(F.broadcast(sums), "bucket", "left").crossJoin(F.broadcast(every))
    n, ones, total = F.coalesce("n", F.lit(0)), F.coalesce("ones", F.lit(0)), F.col("all")
    if own_fold:
        mine = suffixes.select("bucket", "fold", F.col("n").alias("own_n"), F.col("ones").alias("own_ones"))
        size = suffixes.groupBy("fold").agg(F.sum("n").alias("own_all"))
        out = out.join(F.broadcast(mine), ["bucket", "fold"], "left").join(F.broadcast(size), "fold", "left")
        n, ones, total = n - F.coalesce("own_n", F.lit(0)), ones - F.coalesce("own_ones", F.lit(0)), total - F.coalesce("own_all", F.lit(0))
    return out.withColumns({"suffix_rate": (ones + 1) / (n + 2), "suffix_share": n / F.greatest(total, F.lit(1))}).select(*df.columns, "suffix_rate", "suffix_share")


def fit(labelled: DataFrame, sample: int = 20_000, trees: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.5) -> Model:
    """Boosted trees for the logistic loss on rows of ``url`` and ``y`` (0/1).

    A url counts once, with the share of its labels that are 1, however often it is
    repeated. Suffix statistics are of all labelled urls; at most ``sample`` urls train
    the trees, those with the smallest hash. Sums are of integers, so that fits agree
    whatever the order of rows.
    """
    urls = table(labelled.groupBy("url").agg((F.sum("y") / F.count("*")).alias("y")), "urls")
    stats = lexical(parts(urls)).withColumns({"bucket": bucket(), "fold": fold()}).groupBy("bucket", "fold").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("y") * 1e6).cast("long")) / 1e6).alias("ones"))
    model = Model(suffixes=table(stats.coalesce(1), "url-suffixes"))
    rows = table(suffix_statistics(lexical(parts(urls.orderBy(F.xxhash64("url"), "url").limit(sample).repartition(4))), model.suffixes, True).select("y", *FEATURES), "url-sample")
    total = rows.agg(F.count("*").alias("n"), (F.sum(F.round(F.col("y") * 1e6).cast("long")) / 1e6).alias("y")).first()
    if not total.n:
        return model
    model.prior = math.log((total.y + 1) / (total.n - total.y + 1))
    if total.y in (0, total.n):
        return model
    cuts = rows.agg(*[F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(cuts[f])) for f in FEATURES}
    binned = table(rows.withColumns({f"b{i}": sum((F.col(f) > e).cast("int") for e in edges[f]) for i, f in enumerate(FEATURES)}), "url-bins")
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        work = binned.withColumns({"g": F.round((F.col("y") - p) * 1e6).cast("long"), "h": F.round(p * (1 - p) * 1e6).cast("long")})
        node, splits = F.lit(0), {}
        frontier = [0]
        for _level in range(depth):
            stack = ", ".join(f"{i}, b{i}" for i in range(len(FEATURES)))
            sums = (
                work.withColumn("node", node).filter(F.col("node").isin(frontier))
                .select("node", "g", "h", F.expr(f"stack({len(FEATURES)}, {stack}) AS (f, b)"))
                .groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            )  # fmt: skip  # at most nodes x features x bins rows
            frontier = []
            for k in sorted({r.node for r in sums}):
                best = _best_split([r for r in sums if r.node == k], edges)
                if best:
                    splits[k] = best
                    frontier += [2 * k + 1, 2 * k + 2]
            for k in sorted(splits):
                f, e, _ = splits[k]
                if 2 * k + 1 in frontier:
                    node = F.when(node != k, node).when(F.col(f) <= e, 2 * k + 1).otherwise(2 * k + 2)
            if not frontier:
                break
        if not splits:
            break
        leaves = {r.node: r.g / (r.h + 1e6) for r in work.groupBy(node.alias("node")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
        build = lambda k: (splits[k][0], splits[k][1], build(2 * k + 1), build(2 * k + 2)) if k in splits else rate * leaves.get(k, 0.0)  # noqa: B023, E731
        model.trees.append(build(0))
    return model


def _best_split(rows: list, edges: dict) -> tuple | None:
    """The split of one node with the most gain: feature, threshold, gain."""
    best = None
    for i, f in enumerate(FEATURES):
        own = {r.b: (r.g / 1e6, r.h / 1e6) for r in rows if r.f == i}
        tg, th = (sum(x[j] for x in own.values()) for j in (0, 1))
        g = h = 0.0
        for b, e in enumerate(edges[f]):
            g, h = g + own.get(b, (0, 0))[0], h + own.get(b, (0, 0))[1]
            gain = g * g / (h + 1) + (tg - g) ** 2 / (th - h + 1) - tg * tg / (th + 1)
            if h > 0.5 and th - h > 0.5 and gain > 1e-6 and (best is None or gain > best[2] + 1e-9):
                best = (f, e, gain)
    return best


def labels(ruled: DataFrame) -> DataFrame:
    """The labelled urls (url, y): those that a rule decides."""
    return ruled.filter("ruled IS NOT NULL").select("url", (F.col("ruled") == "block").cast("int").alias("y"))


def held_out(labelled: DataFrame, sample: int = 20_000) -> DataFrame:
    """One row (n, right, blocked): over the different urls of one fold, how many the
    model that was fitted to the others judges by their label, and how many block."""
    model = fit(labelled.filter(fold() != 0), sample)
    urls = labelled.filter(fold() == 0).groupBy("url").agg((F.avg("y") > 0.5).alias("y"))
    judged = suffix_statistics(lexical(parts(urls)), model.suffixes).withColumn("m", model.margin() > 0)
    return judged.agg(F.count("*").alias("n"), F.count_if(F.col("m") == F.col("y")).alias("right"), F.count_if("y").alias("blocked"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = 20_000) -> DataFrame:
    """A row per page: id, host, path, rule, verdict, score (block probability).

    Urls that a rule decides are the labelled ones; the trees judge the rest.
    """
    df = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = lexical(df.withColumns({"rule": text, "ruled": verdict}))
    model = fit(labels(df), sample)
    score = 1 / (1 + F.exp(-model.margin()))
    out = suffix_statistics(df, model.suffixes).withColumn("score", score)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """:func:`url_filter` over all pages."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
