"""Late interaction with both sides as tables: whole score tables, and pruned top-k.

A query's score of a document is the mean over its tokens of the best dot product
with any token of the document. Both sides are (id, tok, vec); rows without a vector
are left out. Queries are hashed into blocks and documents into parts of bounded size,
and a task gets one block and one part, so neither side passes through the driver and
what a task holds does not grow. A document's tokens stay together: they are as many as
its encoder makes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

#: Tokens of a block of queries, of a part of documents, numbers of a task's matrices, and about the rows that a block and a part give.
BLOCK, PART, CELLS, ROWS = 4096, 65_536, 1_000_000, 1_000_000
#: Digits of a score that ranking looks at: equal documents must tie, however they are summed.
DIGITS = 12


def _none(**kinds: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=k) for c, k in kinds.items()})


def _stack(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted array and where each begins."""
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return ids[first], first


def _parts(n: int, spark) -> int:
    """So many parts that each is small and every core has some."""
    return max(1, math.ceil(n / PART), min(spark.sparkContext.defaultParallelism, n // 1024))


def _grid(queries: DataFrame, docs: DataFrame, score: Callable, schema: str) -> DataFrame:
    """``score(query rows, document rows)`` of every block and part. The block's rows go
    to each part and the part's to each block. A task's rows are as many as its query tokens
    by its documents at most, and are made before the first is handed on, so parts are
    also so many that these stay about ``ROWS``."""
    queries, docs = (t.filter("vec IS NOT NULL").select("id", "tok", "vec") for t in (queries, docs))
    asked, (n, whole) = queries.count(), docs.agg(F.count("*"), F.count_distinct("id")).first()
    blocks = max(1, math.ceil(asked / BLOCK))
    parts = max(_parts(n, docs.sparkSession), min(whole, math.ceil(math.ceil(asked / blocks) * whole / ROWS)))
    deal = lambda t, own, n, other, m: t.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left, right = deal(queries, "b", blocks, "p", parts), deal(docs, "p", parts, "b", blocks)
    return left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(score, schema)


def _best(q: pd.DataFrame, d: pd.DataFrame):
    """(queries' rows by id, documents, matrix rows x documents of the best dot products),
    by slices of documents."""
    q, d = q.sort_values(["id", "tok"]), d.sort_values(["id", "tok"])
    m, x = _stack(q["vec"]), _stack(d["vec"])
    ids, first = _runs(d["id"].to_numpy())
    ends = np.r_[first[1:], len(x)]
    most, a = max(1, CELLS // len(m)), 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(ends, first[a] + most, "right")))
        yield q, ids[a:b], np.maximum.reduceat(m @ x[first[a] : ends[b - 1]].T, first[a:b] - first[a], axis=1)
        a = b


def token_maxsim(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, qt, d, s): for each query token its best similarity among a document's
    tokens, for every document: as many rows as the scores that are asked for."""

    def score(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.repeat(q["id"].to_numpy(), len(ids)), "qt": np.repeat(q["tok"].to_numpy(), len(ids)), "d": np.tile(ids, len(q)), "s": s.ravel()}) for q, ids, s in (_best(q, d) if len(q) and len(d) else ())]
        return pd.concat(out) if out else _none(q="int64", qt="int64", d="int64", s="float64")

    return _grid(queries, docs, score, "q long, qt long, d long, s double")


def _mean(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(s, first, axis=0) / np.diff(np.r_[first, len(s)])[:, None]


def _most(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(s, first, axis=0)


def _pooled(queries: DataFrame, docs: DataFrame, **figures: Callable) -> DataFrame:
    """(q, d, ``figures``) of every query and document, each figure of the similarities of
    all the query's tokens. A query's tokens lie in one block, so they are pooled in the
    task: it hands on a row a query and document, which no other task has."""

    def score(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, ids, s in _best(q, d) if len(q) and len(d) else ():
            own, first = _runs(rows["id"].to_numpy())
            out.append(pd.DataFrame({"q": np.repeat(own, len(ids)), "d": np.tile(ids, len(own))} | {c: f(s, first).ravel() for c, f in figures.items()}))
        return pd.concat(out) if out else _none(q="int64", d="int64", **dict.fromkeys(figures, "float64"))

    return _grid(queries, docs, score, ", ".join(["q long", "d long", *(f"{c} double" for c in figures)]))


def maxsim(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, d, score) of every query and document; tokens are averaged in the task."""
    return _pooled(queries, docs, score=_mean)


def affinity(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, d, mx, mean) of every query and document: the best and the mean of what
    ``token_maxsim`` gives for the query's tokens, without its rows."""
    return _pooled(queries, docs, mx=_most, mean=_mean)


def best_tokens_maxsim(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(q, d, score) of every query and document: the mean of the query's ``k`` tokens
    (all, if fewer) with the best similarities."""

    def best(s: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.stack([np.sort(own, axis=0)[-k:].mean(axis=0) for own in np.split(s, first[1:])])

    return _pooled(queries, docs, score=best)


def soft_maxsim(queries: DataFrame, docs: DataFrame, tau: float) -> DataFrame:
    """(q, d, soft) of every query and document: tau * logsumexp(s / tau), stable, over
    the query's tokens."""

    def soft(s: np.ndarray, first: np.ndarray) -> np.ndarray:
        m = _most(s, first)
        less = s - np.repeat(m, np.diff(np.r_[first, len(s)]), axis=0)
        return m + tau * np.log(np.add.reduceat(np.exp(less / tau), first, axis=0))

    return _pooled(queries, docs, soft=soft)


# ---- top-k with bounds

#: Tokens of the sample that the centroids are fitted on; the table itself has all tokens.
SAMPLE = 20_000


def centroids(docs: DataFrame, n: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means over the ``SAMPLE`` tokens of the least hashes."""
    sample = docs.filter("vec IS NOT NULL").orderBy(F.xxhash64("id", "tok"), "id", "tok").limit(SAMPLE).select("vec").collect()
    if not sample:
        return np.zeros((0, 0))
    x = _unit(_stack([r.vec for r in sample]))[0]
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, _unit(sums)[0], c)
    return c


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(x, axis=1)
    return x / np.maximum(norm, 1e-12)[:, None], norm


CELL = "array<struct<c:int,low:double,high:double,norm:double>>"


def token_table(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """A written row (d, n, vecs, cells, lead, p) per document: its vectors, the cells of
    the centroids that its tokens are nearest to, each with the least and greatest angle
    to the centroid and the greatest norm, the leading cell, and the part: documents
    of one leading cell, which are dealt to several parts where they are many."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(centres)

    def assign(frames):
        c = shared.value
        for f in frames:
            rows = []
            for d, vecs in zip(f["d"], f["vecs"]):
                x = _stack(vecs)
                unit, norm = _unit(x)
                cos = unit @ c.T
                near = cos.argmax(1)
                angle = np.arccos(np.clip(cos[np.arange(len(x)), near], -1, 1))
                cells = [{"c": int(k), "low": angle[near == k].min(), "high": angle[near == k].max(), "norm": norm[near == k].max()} for k in np.unique(near)]
                rows.append((d, len(x), x.tobytes(), cells, int(np.bincount(near).argmax())))
            yield pd.DataFrame(rows, columns=["d", "n", "vecs", "cells", "lead"])

    together = docs.filter("vec IS NOT NULL").groupBy(F.col("id").alias("d")).agg(F.transform(F.array_sort(F.collect_list(F.struct("tok", "vec"))), lambda x: x["vec"]).alias("vecs"))
    rows = written(together.mapInPandas(assign, f"d long, n int, vecs binary, cells {CELL}, lead int"), "tokens")
    return written(rows.withColumn("p", _place(rows, "d", len(centres), PART)), "tokens")


def _place(rows: DataFrame, key: str, centres: int, most: int) -> Column:
    """A name for rows (key, lead, n tokens) of one leading cell, with about ``most``
    tokens at most."""
    sizes = {r.lead: max(1, math.ceil(r.n / most)) for r in rows.groupBy("lead").agg(F.sum("n").alias("n")).collect()}  # a row per centroid
    splits = F.get(F.array(*[F.lit(sizes.get(k, 1)) for k in range(centres)]), F.col("lead"))
    return F.concat_ws("/", "lead", F.pmod(F.xxhash64(key), splits))


def _blocked(queries: DataFrame, shared, centres: int) -> DataFrame:
    """A written row (id, tok, vec, b) per query token: a block holds queries of one
    leading cell, so that they want the same parts."""

    @F.pandas_udf("int")
    def lead(vecs: pd.Series) -> pd.Series:
        return pd.Series([int((_unit(_stack(v))[0].mean(0) @ shared.value.T).argmax()) for v in vecs], dtype="int32")

    each = written(queries.groupBy("id").agg(F.collect_list("vec").alias("vecs")).select("id", lead("vecs").alias("lead"), F.size("vecs").alias("n")), "queries")
    return written(queries.join(each.select("id", _place(each, "id", centres, BLOCK).alias("b")), "id"), "queries")


def _upper(affinity: np.ndarray, norms: np.ndarray, first_q: np.ndarray, cells: list, first_d: np.ndarray) -> np.ndarray:
    """No score of a query (rows) with a document (columns) exceeds this. The angle of two
    vectors is at least the difference of their angles to a third, the centroid."""
    c = np.array([x["c"] for x in cells])
    low, high, norm = (np.array([x[k] for x in cells]) for k in ("low", "high", "norm"))
    at = affinity[:, c]
    gap = np.maximum(0.0, np.maximum(at - high, low - at))
    each = norms[:, None] * norm * np.maximum(np.cos(gap), 0.0)
    best = np.maximum.reduceat(each, first_d, axis=1)
    return np.add.reduceat(best, first_q, axis=0) / np.diff(np.r_[first_q, len(norms)])[:, None] + 1e-9


def _queries(q: pd.DataFrame, centres: np.ndarray):
    q = q.sort_values(["id", "tok"])
    own, first = _runs(q["id"].to_numpy())
    m = _stack(q["vec"])
    unit, norms = _unit(m)
    return own, first, m, norms, np.arccos(np.clip(unit @ centres.T, -1, 1)), q["least"].to_numpy()[first], q["seen"].to_numpy()[first]


def _lists(cells) -> tuple[list, np.ndarray]:
    sizes = np.array([len(x) for x in cells])
    return [y for x in cells for y in x], np.cumsum(sizes) - sizes


def maxsim_top_k(queries: DataFrame, docs: DataFrame, k: int, cells: int | None = None, first: int = 2, earlier: bool = False, scored=None) -> DataFrame:
    """(q, d, rank, score): the k best documents of each query, exactly; equal scores by
    document.

    Tokens lie in cells around centroids, documents in parts by their leading cell.
    Each query first visits the ``first`` parts with its highest bounds, which gives it a
    k-th score. Parts whose bound no query of the block reaches
    are not sent to it at all, and of the others only the documents whose own bound
    reaches the running k-th score are scored. ``cells`` is the number of centroids
    (by default one for 4,096 tokens, 256 at most); with ``earlier`` only documents of
    smaller ids than the query's count, before the top k are taken; ``scored``, an accumulator, counts
    the scored pairs."""
    queries = queries.filter("vec IS NOT NULL").select("id", "tok", "vec")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "d")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("q", "d", "rank", "score")
    if cells is None:
        cells = min(256, max(1, docs.count() // 4096))
    centres = centroids(docs, cells) if cells > 1 else np.zeros((1, 0))
    if len(centres) <= 1:  # one part, or no documents: nothing to leave out
        every = maxsim(queries, docs).withColumn("score", F.round("score", DIGITS))
        return top(every.filter("d < q") if earlier else every)
    table = token_table(docs, centres)
    shared = docs.sparkSession.sparkContext.broadcast(centres)  # 256 vectors at most
    asked = _blocked(queries, shared, len(centres)).withColumns({"least": F.lit(float("-inf")), "seen": F.array().cast("array<string>")})
    by_cell = table.select("p", F.explode("cells").alias("x")).groupBy("p", "x.c").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.max("x.norm").alias("norm"))
    bounds = written(by_cell.groupBy("p").agg(F.collect_list(F.struct("c", "low", "high", "norm")).alias("cells")), "bounds")  # a row a part, an entry a centroid
    chunks = max(1, math.ceil(bounds.count() / 4096))

    def bounded(q: pd.DataFrame, d: pd.DataFrame):
        """By how much parts' bounds exceed what each query needs, some parts at a time."""
        own, at, _, norms, affinity, least, _ = _queries(q, shared.value) if len(q) else (None,) * 7
        for r in range(0, len(d) if len(q) else 0, 64):
            part = d.iloc[r : r + 64]
            yield own, part["p"].to_numpy(), _upper(affinity, norms, at, *_lists(part["cells"])) - least[:, None]

    def nearest(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": np.repeat(own, len(p)), "p": np.tile(p, len(own)), "slack": slack.ravel()}) for own, p, slack in bounded(q.assign(least=0.0), d)]
        return pd.concat(out).sort_values(["slack", "p"], ascending=False).groupby("id").head(first) if out else _none(id="int64", p="object", slack="float64")

    def wanted(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"b": q["b"].iloc[0], "p": p, "slack": slack.max(0)}) for _, p, slack in bounded(q, d)]
        return pd.concat(out) if out else _none(b="object", p="object", slack="float64")

    def visit(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return _none(q="int64", d="int64", score="float64")
        own, at, m, norms, affinity, least, seen = _queries(q, shared.value)
        least = np.where([q["p"].iat[0] in x for x in seen], np.inf, least)  # a part that the query has visited
        count = np.diff(np.r_[at, len(m)])[:, None]
        kept, out = np.full((len(own), k), -np.inf), []
        step = max(1, CELLS // len(m) // max(1, int(d["n"].max())))
        for r in range(0, len(d), step):
            part = d.iloc[r : r + step]
            alive = _upper(affinity, norms, at, *_lists(part["cells"])) >= least[:, None]
            if earlier:
                alive &= part["d"].to_numpy() < own[:, None]
            part, alive = part[alive.any(0)], alive[:, alive.any(0)]
            if not len(part):
                continue
            x = np.concatenate([np.frombuffer(v).reshape(n, -1) for v, n in zip(part["vecs"], part["n"])])
            begin = np.cumsum(part["n"].to_numpy()) - part["n"].to_numpy()
            score = np.round(np.add.reduceat(np.maximum.reduceat(m @ x.T, begin, axis=1), at, axis=0) / count, DIGITS)
            if scored is not None:
                scored.add(int(alive.sum()))
            score[~alive] = -np.inf
            kept = np.partition(np.concatenate([kept, score], axis=1), -k, axis=1)[:, -k:]
            least = np.maximum(least, kept[:, 0])
            i, j = np.nonzero(alive & (score >= least[:, None]))
            out.append((i, part["d"].to_numpy()[j], score[i, j]))
        rows = [pd.DataFrame({"q": own[i][s >= least[i]], "d": d[s >= least[i]], "score": s[s >= least[i]]}) for i, d, s in out]
        return pd.concat(rows) if rows else _none(q="int64", d="int64", score="float64")

    def run(known: DataFrame) -> DataFrame:
        """Visit the parts that the query rows name."""
        parts = table.join(known.select(F.col("b").alias("_b"), "p").distinct(), "p").select("_b", F.col("p").alias("_p"), "d", "n", "vecs", "cells")
        return written(known.groupBy("b", "p").cogroup(parts.groupBy("_b", "_p")).applyInPandas(visit, "q long, d long, score double"), "found")

    def with_bounds(known: DataFrame, f: Callable, schema: str) -> DataFrame:
        """``f`` of every block of queries and chunk of parts' bounds."""
        left = known.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        each = known.select(F.col("b").alias("_b")).distinct().withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        right = bounds.withColumn("_chunk", F.pmod(F.xxhash64("p"), F.lit(chunks)).cast("int")).join(each, "_chunk")
        return left.groupBy("chunk", "b").cogroup(right.groupBy("_chunk", "_b")).applyInPandas(f, schema)

    near = with_bounds(asked, nearest, "id long, p string, slack double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("slack"), "p"))).filter(F.col("r") <= first)
    near = written(near.select("id", "p"), "pairs")
    found = run(asked.join(near, "id"))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d")))
    kth = ranked.filter(F.col("r") == k).select(F.col("q").alias("id"), F.col("score").alias("least"))
    seen = near.groupBy("id").agg(F.collect_list("p").alias("seen"))  # ``first`` parts
    known = written(asked.drop("least", "seen").join(seen, "id").join(kth, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "queries")
    pairs = written(with_bounds(known, wanted, "b string, p string, slack double").filter("slack >= 0").select("b", "p"), "pairs")
    rest = run(known.join(pairs, "b"))
    return top(found.unionByName(rest))
