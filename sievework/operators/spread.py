"""Farthest points of vector groups of any size, and the groups' merge onto them.

Points are picked greedily: the first token, then the one farthest (by 1 - cosine) from
those picked. A group of over ``PART`` tokens is picked within parts and then among
the picks: every token is then within four times the least possible radius of a pick,
where picking over the whole group at once ensures twice (the two-round result
for greedy k-centre, by Euclidean distance of unit vectors).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Tokens that are picked among at once, and tokens of a Python call.
PART, CALL = 4096, 50_000


def pick(u: np.ndarray, k: int, again: bool = False) -> list[int]:
    """Places of the ``k`` picks among unit rows; equal distances go to the first. With
    ``again`` fewer rows are picked repeatedly."""
    off = lambda i: np.round(1 - np.einsum("ij,j->i", u, u[i]), 12)  # noqa: E731  # by row: equal rows are equally far
    seeds, far = [0], off(0)
    while len(seeds) < (k if again else min(k, len(u))):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, off(seeds[-1]))
    return seeds


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def farthest_seeds(tokens: DataFrame, k: int = 8, again: bool = False) -> DataFrame:
    """(id, seed, tok, vec): the picks of each id (id, tok, vec), in their order. An id of
    fewer tokens has as many picks, or with ``again`` ``k`` all the same: once all are
    picked, the first is the farthest."""
    now = written(tokens.filter("vec IS NOT NULL").select("id", "tok", "vec"), "points")

    def picked(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in f.groupby(["id", "_part"], sort=False):
            g = g.sort_values("tok")
            at = pick(_unit(g["vec"]), k, again and last)
            out.append(pd.DataFrame({"id": g["id"].iat[0], "seed": range(len(at)), "tok": g["tok"].to_numpy()[at], "vec": [g["vec"].iat[i] for i in at]}))
        return pd.concat(out, ignore_index=True)

    while True:
        sizes = now.groupBy("id").agg(F.count("*").alias("_n"))
        total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
        last = (most or 0) <= max(PART, k)
        part = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("tok"), F.ceil(F.col("_n") / max(PART, 2 * k)))
        dealt = now.join(sizes, "id").withColumn("_part", part).withColumn("_call", F.pmod(F.xxhash64("id", "_part"), F.lit(max(1, math.ceil((total or 0) / CALL)))))
        found = dealt.select("id", "tok", "vec", "_part", "_call").groupBy("_call").applyInPandas(picked, "id long, seed int, tok long, vec array<double>")
        now = written(found, "points")
        if last:
            return now
        now = now.drop("seed")


def merged_onto_seeds(tokens: DataFrame, k: int = 8, tau: float = 0.05) -> DataFrame:
    """(id, tok, vec): for each of an id's ``k`` picks (tok is its number) the sum of the
    id's tokens, each token dealt to the picks by a softmax of the cosines over ``tau``.
    Sums are made by batch and added up, so an id's tokens never have to be together."""
    seeds = farthest_seeds(tokens, k).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "vec"))), lambda s: s["vec"]).alias("seeds"))  # k a row

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, g in f.groupby("id", sort=False):
                x, s = np.stack([np.asarray(v, np.float64) for v in g["vec"]]), _unit(g["seeds"].iat[0])
                score = _unit(g["vec"]) @ s.T / tau
                w = np.exp(score - score.max(1, keepdims=True))
                sums = (w / w.sum(1, keepdims=True)).T @ x
                yield pd.DataFrame({"id": i, "tok": np.repeat(np.arange(len(s)), x.shape[1]), "i": np.tile(np.arange(x.shape[1]), len(s)), "x": sums.ravel()})

    parts = tokens.filter("vec IS NOT NULL").select("id", "vec").join(seeds, "id").mapInPandas(dealt, "id long, tok long, i int, x double")
    sums = parts.groupBy("id", "tok", "i").agg(F.sum("x").alias("x"))
    return sums.groupBy("id", "tok").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
