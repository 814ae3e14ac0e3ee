"""Similarity join by prefix filter: an equi-join instead of all pairs, exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Hash places that tokens are counted by, sizes for which one more token has to be shared, 64-bit words of a set's parities.
COUNTS, STEP, WORDS = 1 << 22, 64, 4


def _key() -> Column:
    """A digest of the sorted tokens, none of which holds a zero character."""
    return F.unhex(F.sha2(F.array_join(F.array_sort("tokens"), "\0"), 256))


def classes(rows: DataFrame) -> DataFrame:
    """(id, rep): the least id with an equal token set, for every ``id`` with ``tokens``.
    Sets are compared by digests, so that no shuffle carries them."""
    keyed = written(rows.filter(F.size("tokens") > 0).select("id", _key().alias("key")), "classes")
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("rep")), "key").select("id", "rep")


def similarity_join(rows: DataFrame, threshold: float = 0.72) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, jaccard) of similar token sets (``id``, ``tokens``), and membership (id, rep)."""
    return similar(rows, threshold), classes(rows)


def similar(rows: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Pairs (a, b, jaccard) of similar token sets (``id``, ``tokens``), equal ones once, by
    their least id.

    Tokens are 64-bit hashes, ordered by rarity, as counts of hash places tell it: any order
    that all sets share will do. Of sets that share m tokens, the first l shared ones are
    among the first n - m + l of each; l is 1, and 1 more for each ``STEP`` tokens of the smaller
    set. So only tokens of these places are joined, counted by pair, and pairs
    with l of them are compared. A joined row has its set's parities: how many tokens, odd or even,
    have each of 64 ``WORDS`` hashes. No more of them differ than tokens do,
    which leaves most pairs out before they are shuffled.
    """
    hashed = rows.filter(F.size("tokens") > 0).select("id", _key().alias("key"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    sets = written(hashed.groupBy("key").agg(F.min("id").alias("rep"), F.first("h").alias("h")).select("rep", "h"), "sets")
    pairs = compared(sets, threshold)
    full = pairs.join(sets.select(F.col("rep").alias("a"), F.col("h").alias("ta")), "a").join(sets.select(F.col("rep").alias("b"), F.col("h").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return full.select("a", "b", (both / (F.size("ta") + F.size("tb") - both)).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def compared(sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of hashed sets (rep, h) that may be similar."""
    counts = sets.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(COUNTS - 1).cast("int").alias("at")).agg(F.count("*").alias("n")).toArrow()  # COUNTS rows at most
    levels = np.zeros(COUNTS, np.uint8)
    levels[counts["at"].to_numpy()] = np.ceil(4 * np.log2(counts["n"].to_numpy()))
    shared = sets.sparkSession.sparkContext.broadcast(levels)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            out: list[tuple] = []
            for h in f["h"]:
                h, k = np.asarray(h, np.int64), len(h)
                level = shared.value[h & (COUNTS - 1)]
                top = np.lexsort((h, level))[: k - int(np.ceil(k * threshold - 1e-9)) + 1 + k // STEP]
                at = np.flatnonzero(level[top])  # a token of level 0 is in no other set
                bit = (h >> 40) % (64 * WORDS)
                one = np.uint64(1) << (bit % 64).astype(np.uint64)
                parity = [np.bitwise_xor.reduce(one[bit // 64 == w], initial=np.uint64(0)) for w in range(WORDS)]
                out.append((k, at, h[top[at]], parity))
            n = [len(at) for _, at, _, _ in out]
            words = np.array([p for *_, p in out], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pd.DataFrame({"rep": np.repeat(f["rep"].to_numpy(), n), "k": np.repeat([x[0] for x in out], n), "i": np.concatenate([x[1] for x in out]), "h": np.concatenate([x[2] for x in out]), **{f"s{w}": np.repeat(words[:, w], n) for w in range(WORDS)}})

    prefix = written(sets.mapInPandas(first, "rep long, k int, i int, h long, " + ", ".join(f"s{w} long" for w in range(WORDS))), "prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    size = F.col("a.k") + F.col("b.k")
    most = F.ceil(size * (threshold / (1 + threshold)) - 1e-9)  # that a pair must share at least
    more = F.least("a.k", "b.k") / STEP
    differ = sum((F.bit_count(F.col(f"a.s{w}").bitwiseXOR(F.col(f"b.s{w}"))) for w in range(WORDS)), F.lit(0))
    early = [F.col(f"{x}.i") <= F.col(f"{x}.k") - most + F.floor(more) for x in "ab"]
    length = (F.col("a.k") >= F.col("b.k") * threshold - 1e-9) & (F.col("b.k") >= F.col("a.k") * threshold - 1e-9)
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.rep") < F.col("b.rep")) & length & early[0] & early[1] & (differ <= size - 2 * most))
    return met.groupBy(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.floor(more).alias("_more")).agg(F.count("*").alias("_n")).filter("_n > _more").select("a", "b")
