"""Substring dedup: words covered by a repeated window of ``WINDOW`` words go.

A window's anchor is the least hash among its runs of ``GRAM`` words; equal windows
have equal anchors, so documents are cut into segments of windows that share one
anchor occurrence, and only segments whose anchor occurs again can hold a
repeat. Each distinct segment of such an anchor goes once, with the number of its
copies, to the anchor's shard. The shard's FM-index gives the matching statistics
of its segments, and windows that it holds twice, copies counted, are repeats. The
index decides every window whose anchor occurs again; hashes only bring together
what may be equal.

An anchor with more than ``CROWD`` distinct segments would make a shard grow with
one passage. Its segments are cut once more by second anchors, and those still
crowded into single windows, which are their own anchors; the same index decides.

Defined results: null and short texts lose nothing; repeated rows are documents
of their own, hence repeats of one another; null ids are kept; very long texts are
cut like others, whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import join_counted, join_salted, remove, shared_dir, table

WINDOW = 35
GRAM = 6
CROWD = 500
#: Segments of one FM-index shard, about.
SHARD = 4000
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)


def word_hashes(text) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(h: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Polynomial hashes (mod 2^64, then mixed) of the runs of words at ``start``."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(PRIME, len(h)), dtype=np.uint64)])
    x = (sums[start + size] - sums[start]) * _powers(INVERSE, len(h) + 1)[start]
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def segments(h: np.ndarray, window: int = WINDOW, mask: int = 0) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor and content hash of each segment.
    Another ``mask`` orders the anchors otherwise."""
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams = run_hashes(h, np.arange(len(h) - GRAM + 1), GRAM) ^ np.uint64(mask)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1)
    pos = np.concatenate([view[k : k + 65536].argmin(1) + np.arange(k, min(n, k + 65536)) for k in range(0, n, 65536)])
    first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    count = np.diff(np.append(first, n))
    return first, count, grams[pos[first]].astype(np.int64), run_hashes(h, first, count + window - 1).astype(np.int64)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for k in range(0, len(f), 500):
            part = f[k : k + 500]
            found = [segments(word_hashes(t)) for t in part["text"]]
            times = [len(x[0]) for x in found]
            cols = [np.concatenate([x[i] for x in found]) for i in range(4)]
            yield pd.DataFrame({
                "id": part["id"].repeat(times), "th": np.repeat(part["th"].to_numpy(np.int64), times),
                "start": cols[0], "n": cols[1], "anchor": cols[2], "body": cols[3],
            })


UNIT = "anchor long, body long, c long, n int, words binary"


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of wanted segments, as the bytes of their hashes."""
    for f in frames:
        out: dict[str, list] = {k: [] for k in ("anchor", "body", "c", "n", "crowd", "words")}
        for t, want in zip(f["text"], f["want"]):
            h = word_hashes(t)
            for w in want:
                for k in ("anchor", "body", "c", "n", "crowd"):
                    out[k].append(w[k])
                out["words"].append(h[w["start"] : w["start"] + w["n"] + WINDOW - 1].tobytes())
        yield pd.DataFrame(out)


SECOND = 0xFFFFFFFFFFFFFFFF
#: A part of a segment (anchor0, body0) from its window ``off`` on, as a unit of its own.
PART = f"anchor0 long, body0 long, off int, {UNIT}"


def _again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Crowded segments, cut once more by the greatest hash of their windows; the
    new anchor stands for both."""
    for f in frames:
        out: dict[str, list] = {k: [] for k in ("anchor0", "body0", "off", "anchor", "body", "c", "n", "words")}
        for r in f.itertuples(index=False):
            h = np.frombuffer(r.words, np.uint64)
            for first, n, anchor, body in zip(*(x.tolist() for x in segments(h, WINDOW, SECOND))):
                both = (r.anchor * PRIME + anchor) % (1 << 64)
                for k, v in zip(out, (r.anchor, r.body, first, both - (both >> 63 << 64), body, r.c, n, h[first : first + n + WINDOW - 1].tobytes())):
                    out[k].append(v)
        yield pd.DataFrame(out)


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of units that are crowded still, as a unit of its own."""
    for f in frames:
        out: dict[str, list] = {k: [] for k in ("anchor0", "body0", "off", "anchor", "body", "c", "n", "words")}
        for r in f.itertuples(index=False):
            h = np.frombuffer(r.words, np.uint64)
            for i, w in enumerate(run_hashes(h, np.arange(r.n), WINDOW).astype(np.int64).tolist()):
                for k, v in zip(out, (r.anchor, r.body, i, w, w, r.c, 1, h[i : i + WINDOW].tobytes())):
                    out[k].append(v)
        yield pd.DataFrame(out)


FOUND = "anchor long, body long, off int, run int"


def _search(shard: pd.DataFrame) -> pd.DataFrame:
    """Runs of repeated windows of the shard's units."""
    parts = [np.frombuffer(w, np.uint64) for w in shard["words"]]
    sizes, c = np.array([len(p) for p in parts]), shard["c"].to_numpy()
    values, ids, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    held = np.bincount(ids, np.repeat(c, sizes)) if len(ids) else count
    some = held > 1  # words held once match nothing: symbol 0, as the separators after segments
    symbol = np.where(some, np.cumsum(some), 0)
    at = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    text[np.arange(len(ids)) + np.repeat(np.arange(len(parts)), sizes)] = symbol[ids]
    index = FMIndex(text, int(sizes.max()), np.repeat(c, sizes + 1))
    owner, off, n = index.repeats(text, at, sizes, WINDOW)
    return pd.DataFrame({"anchor": shard["anchor"].to_numpy()[owner], "body": shard["body"].to_numpy()[owner], "off": off, "run": n})


RUN = "id long, th long, start int, n int"


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(id, th, start, n): runs of n repeated windows of the documents with that
    id and text hash. ``docs``: id (not null), th (a hash of the text), text."""
    spark = docs.sparkSession
    first = shared_dir(spark, "segments")
    docs.mapInPandas(_scan, f"{RUN}, anchor long, body long").write.parquet(first)
    runs = spark.read.schema(f"{RUN}, anchor long, body long").parquet(first)
    again = runs.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1")
    again = table(again, "anchors-again")
    maybe = table(join_counted(runs, again, ["anchor"], "c").drop("c"), "segments-again")
    remove(spark, first)  # both tables made of it are written
    bodies = table(maybe.groupBy("anchor", "body").agg(F.count("*").alias("c"), F.min(F.struct("id", "th", "start", "n")).alias("at")), "segment-bodies")
    anchors = table(bodies.groupBy("anchor").agg(F.count("*").alias("bodies")), "segment-anchors")
    wanted = (
        join_counted(bodies, anchors, ["anchor"], "bodies")
        .select("at.id", "at.th", F.struct("at.start", "at.n", "anchor", "body", "c", (F.col("bodies") > CROWD).alias("crowd")).alias("w"))
        .groupBy("id", "th").agg(F.collect_list("w").alias("want"))  # segments of one document
    )
    cut = docs.alias("d").join(wanted.alias("w"), (F.col("d.id") == F.col("w.id")) & (F.col("d.th") == F.col("w.th"))).select("d.*", "want")
    cut = table(cut.dropDuplicates(["id", "th"]).select("text", "want").mapInPandas(_cut, "anchor long, body long, c long, n int, crowd boolean, words binary"), "segment-words")
    found = _sharded(cut.filter("NOT crowd"))
    # Crowded anchors: the same by second anchors, then by windows.
    parts, units, crowded = _parts(cut.filter("crowd").mapInPandas(_again, PART), "crowded")
    found = found.unionByName(_to_parents(_sharded(units), parts))
    windows, units, rest = _parts(crowded.mapInPandas(_windows, PART), "windows")
    units = units.unionByName(rest)  # a window is its own anchor: one unit, or several whose hashes collide
    found = found.unionByName(_to_parents(_to_parents(_sharded(units), windows), parts))
    counts = bodies.select("anchor", "body", "c")
    found = found.groupBy("anchor", "body").agg(F.collect_set(F.struct("off", "run")).alias("runs"))  # within one segment
    found = table(found.join(counts, ["anchor", "body"]), "segment-repeats")
    return join_counted(maybe.drop("n"), found, ["anchor", "body"], "c").select("id", "th", "start", F.explode("runs").alias("r")).select("id", "th", (F.col("start") + F.col("r.off")).alias("start"), F.col("r.run").alias("n"))


def _parts(cut: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts of segments (``PART``), written without their words; the distinct units
    among them whose anchor occurs again, with the number of their copies: those
    that an index may hold, and those of crowded anchors."""
    cut = table(cut, f"{name}-parts")
    units = cut.groupBy("anchor", "body").agg(F.sum("c").alias("c"), F.first("n").alias("n"), F.first("words").alias("words"))
    units = table(units, f"{name}-units")
    anchors = table(units.groupBy("anchor").agg(F.count("*").alias("bodies"), F.sum("c").alias("all")).filter("all > 1"), f"{name}-anchors")
    units = table(join_counted(units, anchors, ["anchor"], "bodies").drop("all"), f"{name}-again")
    return cut.select("anchor0", "body0", "off", "anchor", "body"), units.filter(F.col("bodies") <= CROWD), units.filter(F.col("bodies") > CROWD)


def _to_parents(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Runs found in units as runs of the segments that they are parts of."""
    met = join_salted(parts.withColumnRenamed("off", "_from"), found, ["anchor", "body"])
    return met.select(F.col("anchor0").alias("anchor"), F.col("body0").alias("body"), (F.col("_from") + F.col("off")).alias("off"), "run")


def _sharded(units: DataFrame) -> DataFrame:
    """Runs of repeated windows of units (with their words), by an FM-index a shard."""
    shards = max(1, units.count() // SHARD)
    units = units.select("anchor", "body", "c", "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return units.groupBy("shard").applyInPandas(_search, FOUND)


def _strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out: dict[str, list] = {k: [] for k in ("id", "none", "n_words", "n_removed", "kept")}
        for d, none, t, runs in zip(f["id"], f["none"], f["text"], f["runs"]):
            words = t.encode("utf-8", "surrogatepass").split() if isinstance(t, str) else []
            change = np.zeros(len(words) + 1, np.int64)
            if runs is not None:
                for r in runs:
                    change[r["start"]] += 1
                    change[r["start"] + r["n"] + WINDOW - 1] -= 1
            gone = np.cumsum(change)[:-1] > 0
            kept = [w for w, g in zip(words, gone) if not g] if gone.any() else words
            out["id"].append(d), out["none"].append(none), out["n_words"].append(len(words)), out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_words, n_removed, kept (the text that is left)."""
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rows = docs.select(F.coalesce(own, F.lit(0).cast("long")).alias("id"), own.isNull().alias("none"), F.xxhash64(text, own.isNull()).alias("th"), text.alias("text"))
    runs = repeated_windows(rows.drop("none")).groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("runs"))  # runs of one document
    joined = rows.alias("d").join(runs.alias("r"), (F.col("d.id") == F.col("r.id")) & (F.col("d.th") == F.col("r.th")), "left")
    out = joined.select("d.id", "none", "text", "runs").mapInPandas(_strip, "id long, none boolean, n_words long, n_removed long, kept string")
    return out.select(F.when(~F.col("none"), F.col("id")).alias("id"), "n_words", "n_removed", "kept")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """:func:`substring_dedup` over all documents, with the kept text's hash."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT rid, unnest(range(1, len(w) - {WINDOW} + 2)) AS i, w FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT rid, i, sha256(array_to_string(w[i:i + {WINDOW} - 1], ' ')) AS k FROM s),
r AS (SELECT rid, i FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT DISTINCT rid, i + unnest(range(0, {WINDOW})) AS p FROM r),
x AS (SELECT rid, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT x.rid, count(*) AS n_kept, string_agg(v, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN g ON x.rid = g.rid AND x.p = g.p WHERE g.p IS NULL GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
