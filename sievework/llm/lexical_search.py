"""Ranked lexical search by windowed bucket scoring over an inverted index.

Every input partition is a segment of the index: its documents are numbered in
the order of the scan and cut into windows of ``WINDOW`` numbers, and a window's
postings are one row, by term, with all terms of its documents. A search takes a
window at a time: the postings of a query's terms are scatter-added into an array
with a bucket per document, which stays in the processor's cache, a bitset tells
which buckets were touched, and these are harvested into a heap of the k best. A
task's heaps are all that leaves it, and they are merged by query.

Windows do not depend on each other, so a lost task reads its windows again; the
queries go to the tasks in blocks of at most ``BLOCK_TERMS`` terms, and any number
of blocks is searched one after the other. Numbers of documents and terms come
from the index, so all tables count whole.

Defined results: a null or empty text, or one without terms, is no document and no
hit; a null or empty query has no rows; query rows equal in id and text count once;
repeated documents count and rank each; equal scores rank by ascending id, null
ids last; a text of any length is one document, its window is closed early
(``POSTINGS``); an empty table of documents or queries gives no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import table

#: Documents of a window (buckets of 8 bytes: 32 kB) and postings that close it.
WINDOW, POSTINGS = 4096, 1_500_000
#: Distinct terms of the queries of one block.
BLOCK_TERMS = 500_000
#: Places in which a query's heaps are merged before they meet.
MERGES = 64
# UTF-8 bytes: A-Z lower-cased; a term is ASCII letters, digits and all that is not ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "docs long, total long, ids array<long>, lengths array<long>, terms array<binary>, df array<int>, slots binary, tf binary"


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the batches' documents, a row each."""

    def reset():
        number = defaultdict()
        number.default_factory = number.__len__
        return [], [], number, array("i"), array("I"), array("i")

    def row():
        t = np.frombuffer(at, np.int32)
        order = np.argsort(t, kind="stable")  # by term, within it by document
        slots = np.repeat(np.arange(len(ids), dtype="<u2"), np.frombuffer(distinct, np.int32))[order]
        tf = np.frombuffer(times, np.uint32)[order].astype("<u4")
        values = [len(ids), sum(lengths), ids, lengths, list(number), np.bincount(t, minlength=len(number)).tolist(), slots.tobytes(), tf.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, KINDS)], names=NAMES)

    ids, lengths, number, at, times, distinct = reset()
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = terms(text) if text else None
                if not found:
                    continue
                counts = Counter(found)
                ids.append(i)
                lengths.append(len(found))
                at.extend(map(number.__getitem__, counts))
                times.extend(counts.values())
                distinct.append(len(counts))
                if len(ids) == WINDOW or len(at) >= POSTINGS:
                    yield row()
                    ids, lengths, number, at, times, distinct = reset()
    if ids:
        yield row()


NAMES = [f.split()[0] for f in INDEX.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index: a row per window."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return table(rows.mapInArrow(_index, INDEX), "search-index")


def weights(index: DataFrame, wanted: list[bytes], documents: int) -> dict[bytes, int]:
    """Weights of the ``wanted`` terms, at most a block's, that any document has."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(t,) for t in wanted], T.StructType([T.StructField("term", T.BinaryType())]))
    each = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = each.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1))) for r in df.toLocalIterator()}


def _search(shared, documents: int, total: int, k: int):
    """A task's k best documents of each query of the block ``shared``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weight, queries = shared.value
        heaps = [[] for _ in queries]
        buckets = np.zeros(WINDOW, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths, words, df, slots, tf = (c[0].as_py() for c in batch.slice(i, 1).columns)
                local = np.array([number.get(t, -1) for t in words], np.int64)
                df = np.array(df, np.int64)
                mine = np.repeat(local >= 0, df)
                if not mine.any():
                    continue
                known = np.flatnonzero(local >= 0)
                v, df = local[known], df[known]
                end = np.cumsum(df)
                slots = np.frombuffer(slots, "<u2")[mine].astype(np.int64)
                tf = np.frombuffer(tf, "<u4")[mine].astype(np.int64)
                norm = 25 + 75 * np.array(lengths, np.int64) * documents // total
                impact = np.repeat(weight[v], df) * (1_000_000_000 * tf // (1000 * tf + 8 * norm[slots]))
                # Bitsets by term: postings are ordered by term and slot, so equal words adjoin.
                word = np.repeat(np.arange(len(v)) * (WINDOW // 64), df) + (slots >> 6)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                bits = np.zeros(len(v) * (WINDOW // 64), np.uint64)
                bits[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), first)
                bits = bits.reshape(len(v), -1)
                at = np.full(len(weight), -1)
                at[v] = np.arange(len(v))
                for heap, (_, asked, times) in zip(heaps, queries):
                    rows = at[asked]
                    here = np.flatnonzero(rows >= 0)
                    if not len(here):
                        continue
                    rows = rows[here]
                    for r, c in zip(rows.tolist(), times[here].tolist()):
                        a, b = end[r] - df[r], end[r]
                        buckets[slots[a:b]] += impact[a:b] if c == 1 else c * impact[a:b]
                    touched = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[rows], axis=0).view(np.uint8), bitorder="little"))
                    scores = buckets[touched]
                    buckets[touched] = 0
                    harvest(heap, touched, scores, ids, k)
        out = [(q, None if e[1] else -e[2], e[0]) for q, heap in enumerate(heaps) for e in heap]
        items = [queries[q][0] for q, _, _ in out]
        columns = [pa.array([q for q, _, _ in out], pa.int64()), pa.array(items, pa.int64()), pa.array([d for _, d, _ in out], pa.int64()), pa.array([s for _, _, s in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["q", "item", "doc", "score"])

    return search


def harvest(heap: list, touched: np.ndarray, scores: np.ndarray, ids: list, k: int) -> None:
    """Take a window's buckets into a heap of the k best: (score, whether the id is
    null as 0 or -1, -id), least first."""
    least = heap[0][0] if len(heap) == k else 1
    ok = np.flatnonzero(scores >= least)
    if len(ok) > k:
        kth = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        ok = ok[scores[ok] >= kth]
    found = ((int(scores[j]), -int(ids[touched[j]] is None), -(ids[touched[j]] or 0)) for j in ok.tolist())
    for entry in heapq.nlargest(k, found):
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def _blocks(queries: DataFrame, most: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """The queries with terms, in blocks; only one is on the driver at a time."""
    block, seen = [], set()
    for r in queries.toLocalIterator():
        counts = Counter(terms(bytes(r.text))) if r.text else None
        if not counts:
            continue
        if block and len(seen | counts.keys()) > most:
            yield block
            block, seen = [], set()
        block.append((r.item, counts))
        seen |= counts.keys()
    if block:
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query."""
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    documents, total = index.agg(F.sum("docs"), F.sum("total")).first()
    asked = queries.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("binary").alias("text")).distinct()
    best = spark.createDataFrame([], "b int, q long, item long, doc long, score long")
    for b, block in enumerate(_blocks(asked, block_terms) if documents else ()):
        weight = weights(index, sorted(set().union(*(c for _, c in block))), documents)
        number = {t: i for i, t in enumerate(weight)}
        known = [(item, [(number[t], n) for t, n in c.items() if t in number]) for item, c in block]
        shared = spark.sparkContext.broadcast((
            number, np.array(list(weight.values()), np.int64), [(item, np.array([t for t, _ in c], np.int64), np.array([n for _, n in c], np.int64)) for item, c in known],
        ))
        found = index.select("ids", "lengths", "terms", "df", "slots", "tf").mapInArrow(_search(shared, documents, total, k), "q long, item long, doc long, score long")
        best = best.unionByName(table(found.select(F.lit(b).alias("b"), "*"), "search-heaps"))
        shared.unpersist()
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    place = F.pmod(F.xxhash64("doc", "score"), F.lit(MERGES))
    merged = best.withColumn("r", F.row_number().over(Window.partitionBy("b", "q", place).orderBy(*order))).filter(F.col("r") <= k).drop("r")
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("b", "q").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) AS c, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT c FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * (SELECT c FROM s)) // (SELECT l FROM s)))) AS impact FROM p JOIN w USING (term)),
r AS (SELECT item_id, doc_id, CAST(sum(q.c * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
