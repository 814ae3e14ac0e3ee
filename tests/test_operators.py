import json
import math

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.external import external_map
from sievework.operators import dedup, maxsim, pairs, quality, sampling, vectors
from sievework.sources import readers, writers
from sievework.streaming import state


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col).first()[0]


@pytest.mark.parametrize("captions, kept", [(["A dog.", "a dog.", "A cat."], 2), (["a tram waits at the depot", "A tram waits at the depot.", "tram waits at the depot"], 1), (["green kite above a hill", "three spoons on a tray"], 2), (["", " "], 0)])
def test_greedy_captions(spark, captions, kept):
    df = spark.createDataFrame([(captions,)], "c array<string>")
    assert len(df.select(T.greedy_distinct(F.col("c"))).first()[0]) == kept


def test_text_rules(spark):
    assert one(spark, T.norm_quality(F.col("x")), x="  A  B.. ") == "a b"
    assert one(spark, T.is_generic(F.col("x")), x="Food recipe")
    assert one(spark, T.strip_boilerplate(F.col("x")), x="Photo of a barn.") == "a barn"
    assert one(spark, T.aerialish(F.col("x")), x="a Top-down view")
    assert one(spark, T.text_list(F.col("x")), x="['A', ' b ', '']") == ["a", "b"]
    assert one(spark, T.text_list(F.col("x")), x='["it\'s a dog", \'say "b"\', \'c\\\'d\']') == ["it's a dog", 'say "b"', "c'd"]
    assert one(spark, T.text_list(F.col("x")), x="[not a list") == ["[not a list"] and one(spark, T.text_list(F.col("x")), x="[]") == []


def test_official_split_sizes_and_exact_mode(spark):
    rows = spark.createDataFrame([(f"{d[0]}-{i:04d}", d) for d in ("general", "satellite") for i in range(32)], "id string, domain string")
    for f in (sampling.official_split, sampling.official_split_exact):
        got = f(rows).collect()
        assert sum(r.split == "test" for r in got) == 4 and sorted(map(tuple, got)) == sorted(map(tuple, f(rows).collect()))
    with pytest.raises(ValueError):
        sampling.official_split(rows, denom=1)


def test_flags(spark):
    same = [("%d" % i, "general", "s", ["a green kite above a hill", "three spoons on a tray"], "the same query", "some other thing") for i in range(20)]
    odd = [("x", "general", "s", ["a green kite above a hill", "three spoons on a tray"], "a green kite above a hill", T.OFFLINE_UNRELATED)]
    rows = spark.createDataFrame(same + odd, "id string, domain string, source string, captions array<string>, query string, unrelated_query string")
    got = {r.id: r.codes for r in quality.flags(rows, query_threshold=10).collect()}
    assert got["3"] == ["duplicate_query_frequent"] and got["x"] == ["offline_unrelated", "query_eq_caption"]
    fixed = {r.id: (r.how, r.new_query) for r in quality.repair_query(quality.flags(rows)).collect()}
    assert fixed["x"][0] == "local_keywords" and fixed["3"][0] == "external"  # frequent queries go to the external queue


def test_rows_without_captions_are_flagged(spark):
    rows = spark.createDataFrame([("a", "general", "s", None, "a long enough query", "some other thing"), ("b", None, None, [None, ""], None, None)], "id string, domain string, source string, captions array<string>, query string, unrelated_query string")
    got = {r.id: (r.codes, r.max_severity) for r in quality.flags(rows).collect()}
    assert got == {"a": (["empty_field"], 100), "b": (["bad_domain", "empty_field"], 100)}


def test_ranks_and_assignment_lose_no_row(spark):
    values = [None, *range(0, 3000, 3), *[7] * 5]
    got = sorted((r["rank"], r.v) for r in quality.ranked(spark.createDataFrame([(v,) for v in values], "v long").repartition(3), "v").collect())
    assert [r for r, _ in got] == [*range(1, len(values) + 1)] and [v for _, v in got] == sorted(values, key=lambda v: (v is not None, v or 0))
    rows, bank = spark.createDataFrame([(str(i),) for i in range(5)], "id string"), spark.createDataFrame([("x",), ("y",)], "phrase string")
    assert [(r.id, r.phrase) for r in quality.assign_unrelated(rows, bank).orderBy("id").collect()] == [("0", "x"), ("1", "y"), ("2", None), ("3", None), ("4", None)]


def test_an_empty_export_leaves_the_old_one(spark, tmp_path):
    rows = spark.createDataFrame([("1", "general"), ("2", "general")], "id string, domain string")
    assert writers.export(rows, str(tmp_path / "e")) == json.loads((tmp_path / "e/info.json").read_text())
    with pytest.raises(ValueError):
        writers.export(rows.limit(0), str(tmp_path / "e"))
    assert readers.split(spark, str(tmp_path / "e")).count() == 2


def test_later_cache_lines_win(spark, tmp_path):
    for name, lines in (("a.jsonl", [("x ", "old"), ("y", "kept")]), ("b.jsonl", [("x", "older"), ("\tx", "new"), (None, "n")])):
        (tmp_path / name).write_text("\n".join(json.dumps({"caption": c, "related_query": q}) for c, q in lines) + "\n\n")
    assert {(r.caption, r.related_query) for r in readers.query_cache(spark, str(tmp_path)).collect()} == {("x", "new"), ("y", "kept")}


def test_pair_shapes(spark):
    def got(config, **row):
        kind = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if k == 'label' else 'string'}" for k, v in row.items())
        return [tuple(r) for r in pairs.text_pairs(spark.createDataFrame([tuple(row.values())], kind), config).collect()]

    assert got("triplet", text="A", paraphrases="['a', \"it's b\"]", negative="n") == [("a", "it's b", None)]
    assert got("triplet", text="A", paraphrases=["a", " "], positive="p", negative="n") == [("a", "p", "n")]
    assert got("pair", anchor="x", caption1="y", positive="p", caption2="q") == [("y", "q", None)]
    assert got("pair", anchor="x", s1="y", s2="z") == [("x", "z", None)] and got("default", sentence_a="y", sentence_b="y") == []
    assert got("pair-class", premise="x", hypothesis="y", label=1) == [] and got("pair-class", premise="x", hypothesis="y", label=None) == [("x", "y", None)]
    assert got("triplet", sentence1="x", simplified="y", negative="X") == [("x", "y", None)]


def test_similarity_join_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    sets = [sorted({rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))}) for _ in range(120)]
    near, member = dedup.similarity_join(spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>"))
    rep = {r.id: r.rep for r in member.collect()}
    found = {(r.a, r.b) for r in near.collect()}
    for i in range(120):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            alike = len(a & b) / len(a | b) >= 0.72
            assert alike == (rep[i] == rep[j] or tuple(sorted((rep[i], rep[j]))) in found)


def test_similarity_join_compares_few_pairs_of_large_sets(spark, monkeypatch):
    import random

    rng = random.Random(8)
    words = [f"w{i}" for i in range(1200)]
    sets = [rng.sample(words, rng.randint(60, 300)) for _ in range(150)]
    sets += [[w if rng.random() > 0.12 else rng.choice(words) for w in s] for s in sets[:40]]
    sets = [sorted(set(s)) for s in sets] + [sorted(set(sets[0]))]
    seen = []
    old = dedup.compared
    monkeypatch.setattr(dedup, "compared", lambda *x: seen.append(old(*x)) or seen[-1])
    near = dedup.similar(spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>"))
    want = {}
    for j in range(190):
        for i in range(j):
            a, b = set(sets[i]), set(sets[j])
            if len(a & b) / len(a | b) >= 0.72:
                want[i, j] = len(a & b) / len(a | b)
    assert {(r.a, r.b): r.jaccard for r in near.collect()} == want and 15 < len(want)
    assert seen[0].count() < 2 * len(want)  # of 18,145; by one shared early token nearly all of like size


def test_no_sets_have_no_pairs(spark):
    near, member = dedup.similarity_join(spark.createDataFrame([(1, [])], "id long, tokens array<string>"))
    assert near.count() == 0 == member.count()


def test_membership_makes_no_join_of_pairs(spark, monkeypatch):
    names = []
    old = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: names.append(name) or old(df, name))
    member = dedup.classes(spark.createDataFrame([(4, ["b", "a"]), (2, ["a", "b"]), (3, ["ab"]), (1, [])], "id long, tokens array<string>"))
    assert {tuple(r) for r in member.collect()} == {(4, 2), (2, 2), (3, 3)} and names == ["classes"]


def matrix(spark, rows):
    return spark.createDataFrame([(q, d, float(s)) for q, r in enumerate(rows) for d, s in enumerate(r)], "q long, d long, score double")


def test_ranking_figures(spark):
    ones = matrix(spark, [[1.0] * 132] * 4)
    pos = spark.createDataFrame([(q, q) for q in range(4)], "q long, d long")
    assert {r["rank"] for r in vectors.mid_rank(ones, pos).collect()} == {66.5}
    assert all(abs(r.gap) < 1e-9 for r in vectors.score_gap(ones, pos).collect())
    hard = vectors.hard_negatives(matrix(spark, [[9, 1, 5, 4, 3, 2]]), spark.createDataFrame([(0, 0)], "q long, d long"), 2)
    assert {r.d for r in hard.collect()} == {2, 3}
    heat = [r.heat for r in vectors.heatmap_peak(matrix(spark, [[0.80, 0.82, 0.95, 0.88]]), "q").orderBy("d").collect()]
    assert heat[2] == 1 and heat[0] < 0.15 and heat[3] < 0.5
    assert all(r.heat == 0 for r in vectors.heatmap_peak(matrix(spark, [[0.9] * 8]), "q").collect())


def test_maxsim_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    tok = lambda ids: spark.createDataFrame([(i, t, rng.normal(size=8).tolist()) for i, n in ids for t in range(n)], "id long, tok long, vec array<double>")
    q, d = tok([(0, 2), (1, 5), (2, 1)]), tok([(0, 3), (1, 1), (2, 6), (3, 2)])
    monkeypatch.setattr(maxsim, "BLOCK", 3)
    got = {(r.q, r.d): r.score for r in vectors.maxsim(q, d).collect()}
    qs, ds = ({k: [np.array(r.vec) for r in x.collect() if r.id == k] for k in range(4)} for x in (q, d))
    for (i, j), s in got.items():
        assert math.isclose(s, np.mean([max(a @ b for b in ds[j]) for a in qs[i]]), abs_tol=1e-9)
    assert len(got) == 12
    assert vectors.farthest_points(d, 2).groupBy("id").count().count() == 4


def test_pairs(spark):
    rows = spark.createDataFrame([("A b", "c", "a b"), ("x", "x", "y"), (None, "p", "n"), ("q", "r", "s")], "anchor string, positive string, negative string")
    assert [tuple(r) for r in pairs.text_pairs(rows).orderBy("anchor").collect()] == [("a b", "c", None), ("q", "r", "s")]
    gate = spark.createDataFrame([(0, "n"), (0, None), (1, "m")], "batch int, negative string")
    assert {(r.batch, r.negative) for r in pairs.batch_gate(gate).collect()} == {(0, None), (1, "m")}


def test_record_reasons_and_export(spark):
    rows = [("1", "general", "s", ["a", "b"], "q", "u"), ("2", "sea", "s", ["a", "b"], "q", "u"), ("3", None, "s", ["a", "b"], "q", "u"), ("4", "general", "s", None, "q", "u"), ("5", "general", " ", ["a", "b"], "q", "u"), ("6", "satellite", "s", ["a", "b"], None, "u"), (None, "general", "s", ["a", "b"], "q", "u")]
    df = spark.createDataFrame(rows, "id string, domain string, source string, captions array<string>, query string, unrelated_query string")
    assert [r.reason for r in quality.reasons(df).collect()] == [None, "domain", "domain", "captions", "source", "query", "id"]
    assert quality.export_check(df).first().asDict() == {"n": 7, "empty_query": 1, "empty_unrelated": 0, "publishable": False}
    assert quality.export_check(df.limit(0)).first().n == 0


def test_fill_from_cache(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], "own"), (2, ["a", "b"], ""), (3, ["x", "b", "a"], None), (4, ["x"], " "), (5, None, None)], "id int, captions array<string>, query string")
    cache = spark.createDataFrame([("a", "qa"), ("b", "qb"), (None, "n")], "caption string, related_query string")
    got = {r.id: (r.query, r.origin) for r in quality.fill_from_cache(rows, cache).collect()}
    assert got == {1: ("own", "own"), 2: ("qa", "first"), 3: ("qb", "other"), 4: (None, "missing"), 5: (None, "missing")}


def test_token_choices(spark):
    s = spark.createDataFrame([("a", i, float(i)) for i in range(21)] + [("b", 0, 1.0), ("b", 1, 1.0)], "q string, d int, score double")
    heat = {(r.q, r.d): r.heat for r in vectors.heatmap_percentile(s, "q").collect()}
    assert heat["a", 0] == 0 and heat["a", 20] == 1 and heat["a", 10] == pytest.approx(0.5) and heat["b", 0] == 0
    t = spark.createDataFrame([(1, i, [float(i % 3), 0.0]) for i in range(6)] + [(2, 0, [0.0, 0.0])], "id int, tok int, vec array<double>")
    kept = sorted((r.id, r.tok) for r in vectors.keep_top_tokens(t, 0.75).collect())
    assert kept == [(1, 1), (1, 2), (1, 4), (1, 5), (2, 0)]  # 6 * 0.75 rounds to the even 4
    c = {(r.id, r.tok): r.vec for r in vectors.centred(t.filter("id = 1")).collect()}
    assert c[1, 0] == [-1.0, 0.0] and c[1, 2] == [1.0, 0.0] and c[1, 1] == [0.0, 0.0]
    assert vectors.centred(t.limit(0)).count() == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"id": str(i), "domain": "general", "captions": ["a", "b"], "split": "test" if i % 4 == 0 else "train"}) for i in range(20)) + "\n\n")
    rows = readers.metadata(spark, str(tmp_path / "m.jsonl"))
    assert rows.count() == 20 and rows.first().query == ""
    assert writers.export(rows, str(tmp_path / "e"), 3)["splits"] == {"test": {"general": 5}, "train": {"general": 15}}
    assert readers.split(spark, str(tmp_path / "e"), "test").count() == 5
    writers.metadata_lines(rows, str(tmp_path / "out"))
    assert readers.metadata(spark, str(tmp_path / "out")).first().file_name.startswith("images/general/")
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n')
    with pytest.raises(Exception, match="without domain"):
        readers.metadata(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError):
        readers.guarded(rows, 10)
    for d in ("r1", "r2"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.jpg").write_bytes(d.encode())
    files = readers.listing(spark, str(tmp_path / "r1"), str(tmp_path / "r2"))
    hit, miss = readers.resolve(spark.createDataFrame([("x/a.jpg",), ("b.jpg",)], "filepath string"), files)
    assert hit.first().path.endswith("r1/a.jpg") and miss.count() == 1


def test_external_map_falls_back(spark):
    def call(texts):
        if "bad" in texts:
            raise OSError
        return [t.upper() for t in texts]

    got = external_map(spark.createDataFrame([("a",), ("bad",), ("a",)], "t string"), "t", "o", call, lambda t: "?" + t)
    assert sorted(r.o for r in got.collect()) == ["?bad", "A", "A"]


def test_streams(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([("u", k * 10 + i, float(k * 10 + i)) for i in range(10)], "k string, i long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, i long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    q = state.bank(stream, "k", "v", "i", 4).writeStream.outputMode("update").format("memory").queryName("bank").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert max(spark.table("bank").collect(), key=lambda r: sum(r.bank)).bank == [16.0, 17.0, 18.0, 19.0]
    seen = []
    q = state.queue(stream, "i", 4, lambda df, i: seen.append([r.i for r in df.collect()]), str(tmp_path / "c2"))
    assert q.awaitTermination(120)
    assert [len(s) for s in seen] == [4, 4]
    state.drain(spark, spark.read.parquet(str(tmp_path / "in")), "i", 4, lambda df, i: seen.append([r.i for r in df.collect()]), str(tmp_path / "c2"), 1)
    assert [len(s) for s in seen] == [4, 4, 4, 4, 4] and sorted(sum(seen, [])) == [*range(20)]


def test_similar_members_name_every_text(spark, tmp_path):
    import duckdb

    from sievework.plans import catalogue

    spark.createDataFrame([(1, "A blue tractor, by a hedge"), (2, "by a HEDGE a blue tractor!"), (3, "two boats"), (4, None), (7, "hedge: by a blue tractor"), (8, "a blue tractor by a big hedge"), (9, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "hedge tractor a by blue")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["similar_members"](spark, str(tmp_path)).collect()}
    assert got == {(1, -1), (2, -1), (7, -1), (-1, -1), (3, 3), (8, 8)}
    assert {(r.a, r.b) for r in catalogue.QUERIES["similar_pairs"](spark, str(tmp_path)).collect()} == {(-1, 8)}
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert set(con.sql(catalogue.SQL["similar_members"]).fetchall()) == got


def test_every_row_that_asks_gets_a_phrase(spark):
    schema = "id string, captions array<string>, query string, unrelated_query string, codes array<string>"
    good = [("k", ["a blue tractor", "two boats"], "tractors", "an unrelated thing", [])]
    asks = [(f"a{i}", ["a blue tractor", "first phrase of all"], "second phrase of all", u, [c]) for i, (u, c) in enumerate([(T.OFFLINE_UNRELATED, "offline_unrelated"), ("x y", "duplicate_unrelated_frequent"), ("", "empty_field"), ("tractors", "unrelated_eq_query")])]
    rows = spark.createDataFrame([*good, *asks, ("e", ["one"], "", "still an own phrase", ["empty_field"])], schema)
    got = {r.id: (r.unrelated_query, r.how) for r in quality.repair_unrelated(rows, least=1).collect()}
    assert got["k"] == ("an unrelated thing", "kept") and got["e"] == ("still an own phrase", "kept")
    given = [got[f"a{i}"] for i in range(4)]
    assert {h for _, h in given} == {"local_bank"} and len({p for p, _ in given}) == 4
    words = ["First phrase of all.", "Second phrase of all", "An unrelated thing", "short", "food recipe", "third phrase of all"]
    small = spark.createDataFrame([(w,) for w in words], "phrase string")
    got = [(r.unrelated_query, r.how) for r in quality.repair_unrelated(rows, small).collect() if r.id.startswith("a")]
    assert {p for p, _ in got} <= {None, "third phrase of all"} and all((p is None) == (h == "failed") for p, h in got) and len(got) == 4
    n = len(quality.SUBJECTS) * len(quality.SETTINGS) * len(quality.STYLES) + 500
    bank = quality.distractor_bank(spark, n)
    assert bank.distinct().count() == n and bank.filter(T.is_generic(F.col("phrase")) | (F.length("phrase") < 12)).count() == 0


def test_long_groups_are_windowed_by_blocks(spark, monkeypatch):
    from sievework.operators import windows

    monkeypatch.setattr(windows, "BLOCK", 7)
    events = [(u, i, float(i * (u or 3) % 13)) for u, n in ((1, 60), (2, 3), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(events, "u long, i long, v double")
    got = {(r.u, r.i): (r.n, r.m) for r in windows.over_last(df, "u", "i", 5, n=lambda w: F.count("*").over(w), m=lambda w: F.sum("v").over(w)).collect()}
    for u, i, _ in events:
        before = [v for w, j, v in events if w == u and i - 5 <= j < i]
        assert got[u, i] == (len(before), sum(before) if before else None)
    assert all(r.i == r.place for r in windows.numbered(df.withColumnRenamed("i", "place"), "u", "place").collect()) and len(got) == len(events)
