"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Text is folded first: letters to lower case and compatible forms, look-alikes of
other scripts and digits to the letters that they stand for (``l`` and ``1`` to
``i``), invisible characters away, all else to one space. Marks on letters stay, as
languages need them; a word that is an entry only without its marks counts as well.
The lexicon holds beginnings of
words and whole words with weights, and exceptions: words and phrases within which
a match does not count. An automaton of all of them runs over a document once; at
each word the longest entry counts. The summed weight, by length, is turned into a
probability.

All of it is learned from the labelled rows that are not held out. Words of their
distinct texts are counted by label in Spark (of near copies, rows that share a
least five-word shingle, one counts), beginnings are sums over words, and an entry
is taken where its log-likelihood ratio exceeds what the number of candidates lets
expect by chance. Among entries that stand for the same words the longest is
taken. Exceptions are longer words of clean texts and, around matches, phrases of
clean texts, besides those given (``EXCEPTIONS``). The probability is fitted on
rows that the lexicon did not see: each half of the rows is scored by the lexicon
of the other half, and counts in a grid of cells go to a logistic regression.

Bounds: ``MOST`` entries (those of the greatest ratio) and as many exceptions; the
counts, the fit and the scores cover all rows.

Defined results: a null or empty text, or one without words, has weight and length
zero and the score that goes with it; a null id is not held out and has no label;
of several labels of an id any that is 1 counts, null labels do not train; without
training rows of both labels all scores are 0; repeated rows each give a row; ties
between entries go to the longer; a very long text is folded and matched whole; an
empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import remove, shared_dir, table

#: Entries of a lexicon at most, and letters of the beginnings that are counted.
MOST, SHORTEST, LONGEST = 20_000, 3, 9
#: What an entry's ratio must exceed, besides the logarithm of the candidates' number.
SURE = 3.0
#: An entry is this many times as frequent in toxic texts as expected, at least.
TIMES = 2.5
#: Words added to a text's length, and cells of a side of the grid.
PRIOR, CELLS = 20.0, 60
PREDICTED = 0.7
#: Phrases in which no match counts, in folded spelling or not.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "scum of algae", "pond scum")

# Letters of other scripts that look like a Latin one, and digits and signs that stand for one.
LOOKS = dict(zip("абвгеёзиклмнопрстухіјѕґԁԛԝһαβγεηικνορτυχωıøłđħ", "a6breesuklmhonpctyxijsrdqwhabyenikvoptuxwioldh"))
STANDS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i", "6": "b"}


class Folds(dict):
    """The folded form of a code point, made when first met."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKC", chr(code).lower()):
            c = LOOKS.get(c, c)
            c = STANDS.get(c, c)
            kind = unicodedata.category(c)
            out += c if c.isalnum() else "" if kind in ("Mn", "Me", "Cf") else " "
        self[code] = out
        return out


FOLDS = Folds()


def fold(text: str | None) -> str:
    """The folded words, each between single spaces; a space if there are none."""
    words = text.translate(FOLDS).split() if isinstance(text, str) else ()
    return f" {' '.join(words)} " if words else " "


def signatures(folded: str, bins: int = 4) -> list[int]:
    """The least hash of five-word shingles in each of ``bins`` residues."""
    words = folded.split()
    least: dict[int, int] = {}
    for i in range(max(1, len(words) - 4)):
        h = zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass"))
        if h < least.get(h % bins, 1 << 32):
            least[h % bins] = h
    return [h * bins + b for b, h in least.items()]


class Bare(dict):
    """A letter without its marks, if that is one letter."""

    def __missing__(self, code: int) -> int:
        base = unicodedata.normalize("NFD", chr(code))[0]
        self[code] = ord(STANDS.get(base, base))
        return self[code]


BARE = Bare()


class Lexicon:
    """weights of entries: " x" a beginning, " x " a word, with further spaces a
    phrase; exceptions are such entries without weight."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, w in [*weights.items(), *((e, 0.0) for e in exceptions)]:
            self.automaton.add_word(entry, (len(entry), w, entry.strip().count(" ")))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(place, weight) of each word that an entry matches; the place is that of
        the space before it."""
        if self.empty:
            return []
        best: dict[int, tuple[int, float]] = {}
        spans = []
        for end, (size, w, phrase) in self.automaton.iter(folded):
            at = end - size + 1
            if phrase:
                spans.append((at, end))
            elif at not in best or size > best[at][0]:
                best[at] = (size, w)
        if not folded.isascii():
            for end, (size, w, phrase) in self.automaton.iter(folded.translate(BARE)):
                if not phrase and w and folded[end] == " " and folded[end - size + 1] == " " and size > 2:
                    best.setdefault(end - size + 1, (size, w))
        return [(at, w) for at, (_, w) in best.items() if w and not any(a <= at < e for a, e in spans)]


def features(folded: str, lexicon: Lexicon) -> tuple[float, float]:
    """The summed weight by length and the summed weight, both on a log scale."""
    total = sum(w for _, w in lexicon.matches(folded))
    return math.log1p(1000 * total / (folded.count(" ") - 1 + PRIOR)), math.log1p(total)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """A written row (id, half, toxic, folded, own) per labelled document that is not
    held out; ``own`` is false for all but one of near copies with the same label."""

    @F.pandas_udf("folded string, sigs array<long>")
    def folding(texts: pd.Series) -> pd.DataFrame:
        folded = [fold(t) for t in texts]
        return pd.DataFrame({"folded": folded, "sigs": [signatures(f) for f in folded]})

    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col) == 1).alias("toxic"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.col("id").isNotNull() & ~held_out("id"))
    # Labels grow as documents do, so they are never broadcast.
    rows = rows.join(known.hint("merge"), "id").withColumn("x", folding("text")).select("id", (F.crc32(F.col("id").cast("string")) % 3 == 0).alias("half"), "toxic", "x.folded", "x.sigs")
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "toxicity-folded")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    least = rows.select("id", "toxic", F.explode("sigs").alias("sig")).groupBy("toxic", "sig").agg(F.min("id").alias("id"))
    firsts = least.groupBy("id").agg(F.count("*").alias("_n"))
    marked = rows.join(firsts.hint("merge"), "id", "left").withColumn("own", F.coalesce(F.col("_n") == F.size("sigs"), F.lit(False)))
    out = table(marked.drop("_n", "sigs"), "toxicity-rows")
    remove(spark, path)
    return out


HALVES = {"first": ("p0", "n0"), "second": ("p1", "n1"), "whole": ("p", "n")}


def candidates(rows: DataFrame) -> DataFrame:
    """A written row per entry that occurs: how many words of distinct texts it has, by
    label and half (p0, n0, p1, n1) and in all (p, n)."""
    count = lambda toxic, half: F.count_if((F.col("toxic") == toxic) & (F.col("half") == half))
    each = rows.filter("own").select("toxic", "half", F.explode(F.array_distinct(F.split(F.trim("folded"), " "))).alias("word")).filter("word <> ''")
    by_word = each.groupBy("word").agg(*[count(t, h).alias(f"{'np'[t]}{int(not h)}") for t in (True, False) for h in (True, False)])
    begin = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda k: F.concat(F.lit(" "), F.substr(F.col("word"), F.lit(1), k)))
    entries = F.concat(F.when(F.length("word") >= SHORTEST, begin).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit(" "), "word", F.lit(" "))))
    sums = by_word.select(F.explode(entries).alias("entry"), "p0", "n0", "p1", "n1").groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("p0", "n0", "p1", "n1")])
    return table(sums.withColumns({"p": F.col("p0") + F.col("p1"), "n": F.col("n0") + F.col("n1")}), "toxicity-entries")


def learn(found: DataFrame, totals: dict[str, int], part: str, most: int = MOST) -> dict[str, float]:
    """The entries of one of ``HALVES`` with their weights."""
    p, n = (F.col(c) for c in HALVES[part])
    a, b = (totals[c] for c in HALVES[part])
    if not a or not b:
        return {}
    expected = (p + n) * (a / (a + b))
    side = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = side(p, expected) + side(n, p + n - expected)
    seen = found.filter(p + n > 0)
    bar = math.log(max(1, seen.count())) + SURE
    weight = F.log((p + 0.5) / (a + 1.0)) - F.log((n + 0.5) / (b + 1.0))
    taken = seen.withColumns({"g": ratio, "w": weight}).filter((p > TIMES * expected) & (F.col("g") > bar)).orderBy(F.desc("g"), "entry").limit(most)
    rows = {r.entry: (r[HALVES[part][0]], r.w) for r in taken.collect()}
    # A beginning goes where a longer entry has nearly all its toxic words.
    shadowed = {e[:k] for e, (count, _) in rows.items() for k in range(2, len(e)) if e[:k] in rows and count >= 0.95 * rows[e[:k]][0]}
    return {e: w for e, (_, w) in rows.items() if e not in shadowed}


def clean_words(found: DataFrame, totals: dict[str, int], entries: list[str], most: int = MOST) -> list[str]:
    """Longer entries than one of ``entries`` that are rarer in toxic texts than
    expected: exceptions to it."""
    if not entries:
        return []
    spark = found.sparkSession
    share = totals["p"] / max(1, totals["p"] + totals["n"])
    known = F.broadcast(spark.createDataFrame([(e,) for e in entries], "head string"))  # MOST at most
    clean = found.filter((F.col("n") >= 5) & (F.col("p") < share * (F.col("p") + F.col("n"))))
    heads = F.transform(F.sequence(F.lit(2), F.length("entry") - 1), lambda k: F.substr(F.col("entry"), F.lit(1), k))
    longer = clean.filter(F.length("entry") > 2).select("entry", "n", F.explode(heads).alias("head")).join(known, "head").groupBy("entry").agg(F.max("n").alias("n"))
    return [r.entry for r in longer.orderBy(F.desc("n"), "entry").limit(most).collect()]


def clean_phrases(rows: DataFrame, lexicon: Lexicon, weights: dict[str, float], exceptions: list[str], most: int = MOST) -> list[str]:
    """Pairs of words around matches that clean texts have and toxic ones hardly do."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, exceptions))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(*shared.value)
        for f in frames:
            out: set[tuple] = set()
            for toxic, own, text in zip(f["toxic"], f["own"], f["folded"]):
                for at, _ in lexicon.matches(text) if own else ():
                    end = text.index(" ", at + 1)
                    before, after = text.rfind(" ", 0, at), text.find(" ", end + 1)
                    out |= {(toxic, len(out), text[a : b + 1]) for a, b in ((before, end), (at, after)) if a >= 0 and b > 0}
            yield pd.DataFrame([(t, p) for t, _, p in out], columns=["toxic", "phrase"])

    counted = rows.select("toxic", "own", "folded").mapInPandas(pairs, "toxic boolean, phrase string").groupBy("phrase").agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("n"))
    return [r.phrase for r in counted.filter((F.col("n") >= 5) & (F.col("p") * 20 < F.col("n"))).orderBy(F.desc("n"), "phrase").limit(most).collect()]


def _cells(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of the grid's cells; features are under 15 by far."""
    at = lambda v: np.minimum((v * 8).astype(np.int64), 2 * CELLS - 1)
    return at(x) * 2 * CELLS + at(y)


def fit_score(cells: list[tuple[int, int, int]]) -> tuple[float, float, float]:
    """Weights (constant, by length, sum) of a ridge logistic regression on counts
    (cell, toxic, clean)."""
    at = np.array([c for c, _, _ in cells], np.int64)
    x = np.stack([np.ones(len(at)), (at // (2 * CELLS)) / 8, (at % (2 * CELLS)) / 8], axis=1)
    x[:, 1:] += np.where(x[:, 1:] > 0, 1 / 16, 0)
    p, n = (np.array([c[k] for c in cells], np.float64) for k in (1, 2))
    beta = np.zeros(3)
    for _ in range(50):
        mean = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - (p + n) * mean) - 0.05 * beta
        step = np.linalg.solve((x * ((p + n) * mean * (1 - mean))[:, None]).T @ x + 0.05 * np.eye(3), gradient)
        beta = beta + np.clip(step, -3, 3)
    return tuple(beta.tolist())


class Model:
    def __init__(self, weights: dict[str, float], exceptions: list[str], beta: tuple[float, float, float] | None):
        self.weights, self.exceptions, self.beta = weights, exceptions, beta
        self.lexicon = Lexicon(weights, exceptions)

    def score(self, text: str | None) -> float:
        if self.beta is None:
            return 0.0
        x, y = features(fold(text), self.lexicon)
        z = self.beta[0] + self.beta[1] * x + self.beta[2] * y
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 6)


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, most: int = MOST) -> Model:
    """The model of all labelled rows that are not held out."""
    rows = training_rows(docs, labels)
    given = [fold(e) for e in exceptions]
    found = candidates(rows)
    words = found.filter(F.col("entry").endswith(" "))
    totals = {c: n or 0 for c, n in words.agg(*[F.sum(c).alias(c) for c in ("p0", "n0", "p1", "n1", "p", "n")]).first().asDict().items()}
    parts = {part: learn(found, totals, part, most) for part in HALVES}
    shared = rows.sparkSession.sparkContext.broadcast((parts["first"], parts["second"], given))

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second, given = shared.value
        other = {True: Lexicon(second, given), False: Lexicon(first, given)}
        for f in frames:
            xy = np.array([features(t, other[bool(h)]) for h, t in zip(f["half"], f["folded"])]).reshape(-1, 2)
            yield pd.DataFrame({"cell": _cells(xy[:, 0], xy[:, 1]), "toxic": f["toxic"]})

    grid = rows.select("half", "toxic", "folded").mapInPandas(cells, "cell long, toxic boolean").groupBy("cell").agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("n")).collect()  # a row per cell
    if not sum(r.p for r in grid) or not sum(r.n for r in grid):
        return Model({}, [], None)
    weights = parts["whole"]
    known = clean_words(found, totals, list(weights), most)
    known = [e for e in known if e not in weights]
    phrases = clean_phrases(rows, Lexicon(weights, known), weights, known, most)
    return Model(weights, known + phrases + given, fit_score([(r.cell, r.p, r.n) for r in grid]))


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of each text as a column."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.exceptions, model.beta))

    @F.pandas_udf("double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(*shared.value)
        for t in texts:
            yield pd.Series([model.score(x) for x in t], dtype="float64")

    return judge(F.col(f"`{text_col}`"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled ones that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))
