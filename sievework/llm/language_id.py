"""Language ID by string kernels: Nyström landmarks and kernel ridge regression.

The kernel is the blended spectrum of n-gram presence: texts share n-grams of 1
to 3 characters (lower-cased, hashed to ``BUCKETS``), normalised to 1 for equal
sets. Landmarks are training texts; features are K(x, landmarks) W^-1/2; one
ridge regression per language is fitted one against the rest. Since the kernel is
linear in a text's presence row, all matrices but that row fold into one, and a
batch of texts is scored by one matrix product.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
rows with null lang or null id do not train; with no training rows all are
``und``; ties between languages go to the first in code point order; repeated
rows each give a row; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import forget, fresh

BUCKETS = 1 << 16
#: Sharpness of the softmax over ridge outputs (which lie near -1 and 1).
SHARP = 4.0


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Sorted bucket numbers of the whole text's n-grams, n from 1 to 3."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    seen = np.zeros(BUCKETS, bool)
    code = np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        if len(c) < n:
            break
        code = code[: len(c) - n + 1] * np.uint64(0x110000) + c[n - 1 :]
        seen[((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)] = True
    return np.flatnonzero(seen)


class Classifier:
    """languages, and the folded matrix (buckets x languages) with its intercept."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        """Ridge outputs (texts x languages) by one matrix product a block."""
        out = np.zeros((len(texts), len(self.languages)))
        block = 64
        rows = np.zeros((block, BUCKETS), np.float32)
        for k in range(0, len(texts), block):
            sets = [presence(t) for t in texts[k : k + block]]
            for row, s in zip(rows, sets):
                row[s] = 1 / np.sqrt(max(1, len(s)))
            out[k : k + block] = rows[: len(sets)] @ self.weights + self.bias
            for row, s in zip(rows, sets):
                row[s] = 0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        if at:
            s = self.scores([texts[i] for i in at])
            best = s.argmax(1)
            p = np.exp(SHARP * (s - s.max(1, keepdims=True)))
            for i, b, top in zip(at, best, 1 / p.sum(1)):
                lang[i], score[i] = self.languages[b], round(float(top), 6)
        return lang, score


def train(rows: list[tuple[str, str]], landmarks: int = 160, ridge: float = 1e-3) -> Classifier:
    """Fit on (text, lang) rows, every ``len / landmarks``-th of which is a landmark."""
    rows = [(t, g) for t, g in rows if t and has_letter(t)]
    languages = sorted({g for _, g in rows})
    if not rows:
        return Classifier([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    sets = [presence(t) for t, _ in rows]
    picked = sorted({round(i) for i in np.linspace(0, len(rows) - 1, min(landmarks, len(rows)))})
    marks = np.zeros((BUCKETS, len(picked)), np.float32)
    for j, i in enumerate(picked):
        marks[sets[i], j] = 1 / np.sqrt(len(sets[i]))
    k = np.stack([marks[s].sum(0, dtype=np.float64) / np.sqrt(len(s)) for s in sets])
    value, vector = np.linalg.eigh(k[picked])
    ok = value > 1e-8 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    x = k @ root
    y = np.where(np.array([[g == lang for lang in languages] for _, g in rows]), 1.0, -1.0)
    mean, centre = y.mean(0), x.mean(0)
    xc = x - centre
    beta = np.linalg.solve(xc.T @ xc + ridge * len(rows) * np.eye(xc.shape[1]), xc.T @ (y - mean))
    return Classifier(languages, (marks.astype(np.float64) @ (root @ beta)).astype(np.float32), mean - centre @ beta)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


#: Ids ranked for each that is wanted: about 1,200 for 300, hence never too few.
SPARE = 4


def training_rows(docs: DataFrame, per_language: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """A bounded sample of labelled rows that are not held out: ``per_language``
    of each, those whose id hashes lowest. Ids are ranked first, without texts;
    of a language with n ids (about), only those whose hash is among the lowest
    ``SPARE * per_language / n`` of all hashes are, so that few ids move."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id")
    )
    counts = usable.groupBy("lang").agg(F.approx_count_distinct("id").alias("n"))
    # A row per language, of which the model itself has a column each.
    share = SPARE * per_language / F.greatest(F.col("n"), F.lit(1))
    limits = counts.select("lang", F.when(share >= 1, 2.0**63).otherwise(share * 2.0**64 - 2.0**63).alias("most"))
    hashed = usable.select("id", "lang", F.xxhash64("id").alias("h")).join(F.broadcast(limits), "lang").filter(F.col("h") <= F.col("most"))
    lowest = Window.partitionBy("lang").orderBy("h", "id")
    ids = hashed.select("id", "lang", "h").distinct().withColumn("n", F.row_number().over(lowest)).filter(F.col("n") <= per_language).select("id", "lang")
    rows = usable.join(F.broadcast(ids), ["id", "lang"]).filter(F.col("text").isNotNull())
    return [(r.text, r.lang) for r in sorted(rows.select("id", "text", "lang").collect(), key=lambda r: (r.lang, r.id, r.text))]


def fit(docs: DataFrame, per_language: int = 300) -> Classifier:
    return train(training_rows(docs, per_language))


def language_id(docs: DataFrame, model: Classifier, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score appended."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias))  # buckets x languages floats

    @F.pandas_udf("l string, s double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget("pieces")
        model = Classifier(*shared.value)
        for t in texts:
            lang, score = model.predict([x if isinstance(x, str) else None for x in t])
            yield pd.DataFrame({"l": lang, "s": score})

    name = fresh([*docs.columns, lang_out, score_out], "judged")
    out = docs.withColumn(name, judge(F.col(text_col)))
    return out.withColumns({lang_out: out[name]["l"], score_out: out[name]["s"]}).drop(name)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return language_id(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
