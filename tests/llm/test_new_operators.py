"""Lexical search, toxicity and the filter audit against brute force on odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import filter_audit, language_id, lexical_search, mixing, registry, toxicity

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def best(docs, items, k=10):
    """The ranking by hand: {item: [(doc_id, score)]}."""
    found = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total, df = len(found), sum(c.total() for _, c in found), Counter(t for _, c in found for t in c)
    out = {}
    for item, text in items:
        asked, scores = Counter(TERM.findall(lower(text))), []
        for i, c in found:
            m = 25 + 75 * c.total() * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            scores += [(i, s)] if s > 0 else []
        out[item] = sorted(scores, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    return out


@pytest.mark.parametrize("window,postings,block", [(4096, 1_500_000, 500_000), (64, 300, 20)])
def test_search_by_brute_force(spark, docs, rows, monkeypatch, window, postings, block):
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    items = [(i, t) for i, t in enumerate({r[1] for r in rows})] + [(900, "One two ONE"), (901, "zzzz"), (None, "words one")]
    got: dict = {}
    for r in lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), block_terms=block).orderBy("rank").collect():
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert len(got[r.item_id]) == r["rank"]
    want = {i: x for i, x in best([(r[0], r[1]) for r in rows], items).items() if x}
    assert got == want and len(want) > 20


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame([(1, "one"), (2, None), (3, "")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(docs, items.filter("item_id > 1")).count() == 0
    again = lexical_search.search(docs, items.union(items))
    assert again.count() == lexical_search.search(docs, items).count() == again.select("rank").distinct().count()


def test_search_windows_are_closed_early_and_hold_everything(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lexical_search, "POSTINGS", 50)
    index = lexical_search.build_index(docs)
    assert index.agg(F.sum("docs")).first()[0] == sum(bool(TERM.search(t or "")) for _, t, *_ in rows)
    assert index.count() > 20 and index.agg(F.sum("total")).first()[0] == sum(len(TERM.findall(t or "")) for _, t, *_ in rows)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_filter_audit"])
def test_new_sql_agrees(spark, tmp_path, rows, name):
    docs = spark.createDataFrame([(i, r[1], r[2], r[3]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(0, len(rows), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[20][1]), (2, "one two"), (3, None), (4, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall())


def test_audit_by_applying_every_order(spark, docs, rows):
    """Filters applied one after the other to the documents themselves."""

    def fails(i, t):
        t, words = t or "", (t or "").encode().split()
        smaller = any(r[0] is not None and (i is None or r[0] < i) and (r[1] or "") == t for r in rows)
        return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller}

    each = [(r[3] or "", fails(r[0], r[1]), r[0]) for r in rows]
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(filter_audit.document_masks(docs).withColumn("odd", F.col("id") % 2 == 1), list("ABCDE"), {"odd": F.col("odd")}).collect()}
    parts = {p for p, *_ in each}
    assert len(got) == 600 * len(parts)
    shapley = Counter()
    for part in parts:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in each if x[0] == part]
            everything = left
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                r = got[part, "".join(order), step]
                failing = [x for x in everything if x[1][f]]
                assert (r.kept, r.removed, r.redundant) == (len(left), len(gone), len(failing) - len(gone))
                assert r.unique_fails == sum(sum(x[1].values()) == 1 for x in failing) and r.odd_lost == sum(x[2] is not None and x[2] % 2 == 1 for x in gone)
                shapley[part, f] += len(gone)
    assert all(r.shapley == shapley[part, order[step - 1]] for (part, order, step), r in got.items())


def test_audit_of_nothing_and_of_too_many(spark, none):
    assert filter_audit.audit(filter_audit.document_masks(none), list("ABCDE"), {}).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(none, list("ABCDEFGH"), {})


def test_folding():
    assert toxicity.fold("1DI0T, trásh​can іdiоt ｓｃｕｍ!") == " idiot tráshcan idiot scum "
    assert toxicity.fold(None) == toxicity.fold(" .,") == " " and toxicity.fold("a") == " a "


def test_matches_by_brute_force():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    weights = {" " + w: 1.0 + k for k, w in enumerate(words[:6])} | {f" {w} ": 20.0 + k for k, w in enumerate(words[6:12])}
    phrases = [f" {a} {b} " for a, b in zip(words[:4], words[8:12])]
    lexicon = toxicity.Lexicon(weights, phrases)
    for _ in range(300):
        text = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))))
        want = set()
        for at in (m.start() for m in re.finditer(" (?=.)", text)):
            hits = [e for e in weights if text.startswith(e, at)]
            covered = any(text.startswith(p, a) and a <= at < a + len(p) - 1 for p in phrases for a in range(len(text)))
            want |= {(at, weights[max(hits, key=len)])} if hits and not covered else set()
        assert set(lexicon.matches(text)) == want


def toxic_corpus(n=900):
    rng = random.Random(7)
    plain = ["".join(rng.choice("aeiourstnm") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    bad = ["blarg", "snivelo", "grumth"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        elif i % 5 == 1:
            words += ["grumth", "tree"] if i % 2 else ["the", "snivelor"]
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return docs, labels


def test_toxicity_is_learned_and_disguises_are_seen(spark):
    docs, labels = toxic_corpus()
    d, la = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, la)
    said = {r.doc_id: r.s for r in d.select("doc_id", toxicity.toxicity(d, model).alias("s")).collect()}
    held = [(y, said[i] >= 0.7) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p for y, p in held if y]) > 0.95 and np.mean([p for y, p in held if not y]) < 0.02
    assert model.score("blarg, you snivelo grumth") > 0.7 and model.score("8lаrg, you 5NIVEL0 grumth") > 0.7 and model.score("blárg you snívelo") > 0.7
    assert model.score("grumth tree and grumth tree") < 0.3 and model.score("") < 0.3 and model.score(None) == model.score("...")
    assert model.score("blarg " * 50_000) > 0.7 and model.score("tree " * 50_000 + "blarg") < toxicity.PREDICTED


def test_copies_count_once_in_the_lexicon(spark):
    rng = random.Random(9)
    docs, labels = toxic_corpus(300)
    base = [f"rareword{k}" for k in range(60)]
    docs += [(1000 + i, " ".join(base[:rng.randrange(55, 60)])) for i in range(200)]
    labels += [(1000 + i, 0, 1) for i in range(200)]
    d, la = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(d, la)
    assert rows.filter("own AND id >= 1000").count() <= 12
    assert rows.count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in docs)


def test_toxicity_on_odd_rows(spark, docs, rows, none):
    la = spark.createDataFrame([(5, 0, 1), (5, 0, None), (6, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (la, la.limit(0), la.filter("doc_id = 6")):
        model = toxicity.fit(docs, labels)
        got = docs.select("doc_id", toxicity.toxicity(docs, model).alias("s")).collect()
        assert len(got) == len(rows) and all(0 <= r.s <= 1 for r in got)
    assert toxicity.fit(none, la).score("x") == 0.0
    assert none.select(toxicity.toxicity(none, model)).count() == 0
    ids = [r[0] for r in docs.select(toxicity.held_out()).collect()]
    assert ids == [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]


def test_number_signs_are_no_letters(spark):
    model = language_id.train([("hello there world", "en"), ("bonjour le monde", "fr")] * 3)
    lang, score = model.predict(["5 ½ ²", "Ⅷ ③ ٣", "_ -", "½ a", "ª", None, ""])
    assert lang[:3] == ["und"] * 3 and score[:3] == [0.0] * 3 and "und" not in lang[3:5] and lang[5:] == ["und"] * 2


@pytest.mark.parametrize("height", [3, 4096])
def test_ranges_of_sources_deal_every_draw(spark, monkeypatch, height):
    monkeypatch.setattr(mixing, "RANGE", height)
    q = [1000, 70, 0, 333, *range(1, 40)]
    quotas = spark.createDataFrame(list(enumerate(q)), "sno long, draws long")
    t = mixing.splitting_tree(quotas, 150, 1).collect()
    for s, n in enumerate(q):
        own = sorted((r.start, r.draws, r.shard) for r in t if r.sno == s)
        assert sum(d for _, d, _ in own) == n and [r[2] for r in own] == sorted({r[2] for r in own})
        assert all(a + d == b for (a, d, _), (b, _, _) in zip(own, own[1:]))
    per = Counter()
    for r in t:
        per[r.shard] += r.draws
    assert len(per) == 150 and max(per.values()) - min(per.values()) <= 1 + math.log2(150)
    assert sorted(map(tuple, t)) == sorted(map(tuple, mixing.splitting_tree(quotas, 150, 1).collect()))


def test_a_million_sources(spark):
    quotas = spark.range(1_000_000).select(F.col("id").alias("sno"), (1 + F.pmod(F.xxhash64("id"), F.lit(3))).alias("draws"))
    t = mixing.splitting_tree(quotas, 40)
    assert t.agg(F.sum("draws")).first()[0] == quotas.agg(F.sum("draws")).first()[0]
    per = [r.n for r in t.groupBy("shard").agg(F.sum("draws").alias("n")).collect()]
    assert len(per) == 40 and max(per) - min(per) <= 7


def test_draws_beyond_numpy(monkeypatch):
    """The own sampler has the distribution of numpy's, and takes populations over 10^9."""
    rng = np.random.default_rng(1)
    good, bad, n = 300, 700, 200
    want = np.array([rng.hypergeometric(good, bad, n) for _ in range(4000)])
    big = [rng.hypergeometric(40, 60, 30) for _ in range(4000)]
    monkeypatch.setattr(mixing, "NUMPY_MOST", 10)
    got = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)])
    assert abs(got.mean() - want.mean()) < 0.5 and abs(got.std() / want.std() - 1) < 0.05
    own = [mixing.hypergeometric(rng, 40, 60, 30) for _ in range(4000)]
    assert np.abs(np.bincount(own, minlength=31) - np.bincount(big, minlength=31)).sum() < 900
    v = mixing.draw(rng, np.array([5, 0, 7, 30]), 20)
    assert v.sum() == 20 and (v <= [5, 0, 7, 30]).all() and mixing.hypergeometric(rng, 12, 0, 12) == 12 and mixing.hypergeometric(rng, 0, 12, 5) == 0
    monkeypatch.undo()
    huge = np.array([4 * 10**9, 10, 0, 10**10], np.int64)
    v = mixing.draw(rng, huge, 5 * 10**9)
    assert v.sum() == 5 * 10**9 and (v <= huge).all() and abs(v[0] / huge.sum() * 2.8 - 4 / 14) < 1e-4
