"""Records, checks, losses: cases that the tables of the driver lack."""

import math

import pytest
from pyspark.sql import functions as F

from sievework.operators import losses, records

META = "id string, domain string, source string, captions array<string>, caption string, query string, unrelated_query string"


def test_records_fall_back(spark):
    rows = spark.createDataFrame([("a", "", None, [" ", "One Kite"], "x", "", None), ("b", "satellite", "s", None, "A Harbour ", None, "Tea"), ("c", "general", "s", ["", None], None, "q", "u"), ("d", "general", "s", ["P", "Q"], None, None, "")], META)
    good, bad = records.normalised(rows)
    got = {r.id: r for r in good.collect()}
    assert (got["a"].caption, got["a"].domain, got["a"].source, got["a"].related_query) == ("one kite", "general", "curated", "")
    assert (got["b"].captions, got["b"].unrelated_query) == (["a harbour"], "tea") and got["d"].related_query == "q"
    assert [r.id for r in bad.collect()] == ["c"] and records.normalised(rows.limit(0))[0].count() == 0
    assert [r.caption for r in records.renamed(rows.filter("id = 'b'"), "id", "caption").collect()] == ["a harbour"]
    with pytest.raises(Exception, match="without a caption"):
        records.renamed(rows, "id", "caption").collect()


def test_repaired_queries_are_looked_at_again(spark):
    schema = "id int, query string, captions array<string>, codes array<string>, done boolean"
    data = [(1, "two kites fly", ["a harbour"], [], False), (2, "kites", ["a harbour"], [], False), (3, "A Harbour.", ["a harbour", None], [], False), (4, "a harbour at", ["At a  harbour, late"], [], False)]
    data += [(5, "two kites fly", None, ["duplicate_query_frequent"], False), (6, "two kites fly", ["x"], ["duplicate_query_frequent"], True), (7, None, [], [], True)]
    bad = records.query_still_bad(F.col("query"), F.col("captions"), F.col("codes"), F.col("done"))
    got = {r.id: r.bad for r in spark.createDataFrame(data, schema).select("id", bad.alias("bad")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: True, 6: False, 7: True}


def test_files_of_rows(spark):
    rows = spark.createDataFrame([("a", "general", ["one kite", "a harbour"], "q", "u", 1), ("b", "general", ["one kite", "One kite."], "q", "u", 1), ("c", "general", ["one kite", "a harbour"], "q", "u", 1), ("d", "x", ["one kite", "a harbour"], " ", "u", 1)], "id string, domain string, captions array<string>, query string, unrelated_query string, _note int")
    files = spark.createDataFrame([("images/general/a.jpg", 5000), ("images/general/b.jpg", 10), ("images/x/d.jpg", 2000)], "path string, length long")
    report = records.sidecar_report(rows, files).first()
    assert (report.checked, report.missing, report.tiny, report.examples) == (4, 1, 1, ["tiny:images/general/b.jpg:10B", "missing:images/general/c.jpg"])
    assert records.sidecar_report(rows.limit(0), files).first().checked == 0
    good, bad = records.build_check(rows, files)
    assert [r.id for r in good.collect()] == ["a"] and "_note" not in good.columns
    assert {r.id: r.reason for r in bad.collect()} == {"b": "captions", "c": "file", "d": "query"}
    with pytest.raises(Exception, match="no file images/general/c.jpg"):
        records.joined_images(rows, files).collect()


def test_captions_are_diversified(spark):
    rows = spark.createDataFrame([("a", "general", ["one kite", "a harbour wall"]), ("b", "satellite", ["one kite", "One kite."]), ("c", "general", None)], "id string, domain string, captions array<string>")
    got = {r.id: r for r in records.diversified(rows, spark.createDataFrame([("c", ["x", "y"])], "id string, captions array<string>")).collect()}
    assert {k: v.how for k, v in got.items()} == {"a": "kept", "b": "offline", "c": "cached"} and got["c"].new_captions == ["x", "y"]
    again = spark.createDataFrame([("b", got["b"].new_captions)], "id string, captions array<string>").withColumn("domain", F.lit("general"))
    assert [r.how for r in records.diversified(again, rows.select("id", "captions").limit(0)).collect()] == ["kept"]


def test_gates_and_checkpoints(spark):
    gate = lambda n, **k: spark.range(1).select(records.cache_gate(F.lit(n), 500, 1, 8, **k).alias("g")).first().g
    assert gate(0).status == "empty" and gate(8).status == "tiny" and gate(8, allow_tiny=True).status == "ok"
    assert gate(8).warnings == "few,repeated" and gate(300).warnings == "" and gate(60).warnings == "few,repeated"
    assert records.cache_mismatch({"seed": 1, "split": "train"}, {"seed": 2, "split": "train"}) == ["seed"]
    paths = [("m/step-9",), ("m/step-100/",), ("m/step-x",), ("m/archive/step-900",), ("m/final",)]
    assert records.latest_checkpoint(spark.createDataFrame(paths, "path string")).first().step == 100
    rows = spark.createDataFrame([(i, "s" if i == 150 else "t" if i == 250 else "g") for i in range(300)], "id int, domain string")
    got = [(r.id, r.domain) for r in records.examples(rows).collect()]
    assert len(got) == 4 and {(0, "g"), (150, "s")} <= set(got) and max(i for i, _ in got) < 200


def test_pieces_and_padding(spark):
    texts = ["", "  kite's 2 wings ", "a", None, "é-b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", records.pieces(F.col("t")).alias("p"))
    for r in df.collect():
        if r.t is None:
            assert r.p is None
        else:
            assert all(r.t[p.at : p.at + len(p.piece)] == p.piece for p in r.p) and "".join(p.piece for p in r.p) == "".join(r.t.split())
    x, mask = records.padded(F.col("x"), 3, "-")
    got = spark.createDataFrame([(["a"],), (["a", "b", "c", "d"],), ([],)], "x array<string>").select(x.alias("x"), mask.alias("m")).collect()
    assert [(r.x, r.m) for r in got] == [(["a", "-", "-"], [1, 0, 0]), (["a", "b", "c"], [1, 1, 1]), (["-"] * 3, [0] * 3)]


def test_losses_by_hand(spark):
    scores = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 0.0), (1, 0, 0.5), (1, 1, 0.5), (1, 2, 3.0)], "q long, d long, score double")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "q long, d long")
    plain = {r.q: r.loss for r in losses.softmax_loss(scores, labels).collect()}
    assert abs(plain[0] - (math.log(math.e + math.e**2 + 1) - 1)) < 1e-9
    out = spark.createDataFrame([(0, 1), (0, 0), (1, 1)], "q long, d long")
    masked = {r.q: r.loss for r in losses.softmax_loss(scores, labels, out).collect()}
    assert abs(masked[0] - (math.log(math.e + 1) - 1)) < 1e-9 and abs(masked[1] - plain[1]) < 1e-9
    one = losses.one_way_loss(scores, labels, tau=0.5, gap_weight=2.0, margin=1.0).first()
    gaps = [2 * (1.0 - 1.0), 2 * (0.5 - 1.75)]
    assert abs(one.gap - sum(max(0, 1 - g) for g in gaps) / 2) < 1e-9 and abs(one.loss - one.ce - 2 * one.gap) < 1e-9
    both = losses.bidirectional_loss(scores, scores.select(F.col("d").alias("q"), F.col("q").alias("d"), "score").filter("q < 2"), labels, tau=1.0).first()
    assert both.loss > 0 and losses.prefix_dims((8, 64, 0, 8, 16), 64) == [8, 16]
    assert losses.weighted_mean([(spark.sql("SELECT 1.0D AS loss"), 1), (spark.sql("SELECT 4.0D AS loss"), 2), (spark.sql("SELECT 9.0D AS loss"), 0)]).first().loss == 3.0
    with pytest.raises(ValueError):
        losses.weighted_mean([])
    assert losses.non_negatives(scores, 0) is None


def test_geometry_of_a_cone_and_a_spread(spark):
    cone = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)], "id long, vec array<double>")
    spread = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(300)], "id long, vec array<double>")
    a, b = losses.geometry(cone, 2).first(), losses.geometry(spread, 2).first()
    assert abs(a.uniformity - 1) < 1e-9 and abs(a.center - 1) < 1e-9 and b.center < 0.01 and b.uniformity < 0.4 and b.total < a.total
    with pytest.raises(Exception, match="beyond the raster"):
        losses.grid_affinity(cone.select("id", F.lit(0).alias("tok"), "vec"), cone.select("id", F.lit(9).alias("tok"), "vec"), spark.createDataFrame([(0, 0)], "q long, d long"), 2, 2).collect()


def test_cuts_by_hash_match_an_order(spark):
    import hashlib

    from sievework.operators import quality, sampling

    ids = [(i, None if i % 5 == 0 else "g" if i % 5 < 4 else "s") for i in range(3000)]
    df = spark.createDataFrame(ids, "id long, domain string")
    key = lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i)
    for k in (0, 1, 700, 3000, 5000):
        assert sorted(r.id for r in sampling.reservoir(df, k).collect()) == sorted(sorted(range(3000), key=key)[:k])
    got = sampling.official_split(df.unionByName(df)).collect()
    assert len(got) == 6000
    for d in (None, "g", "s"):
        own = [i for i, e in ids if e == d]
        first = sorted(own, key=lambda i: (hashlib.md5(":".join(["42", *([d] if d else []), str(i)]).encode()).hexdigest(), i))[: len(own) // 16]
        assert {r.id for r in got if r.domain == d and r.split == "test"} == set(first)
    assert sampling.official_split(df.limit(0)).count() == 0 and sampling.reservoir(df.limit(0), 5).count() == 0
    assert sampling.per_group(df.unionByName(df), "domain", {"g": 3, "s": 10**6, "none": 4}).groupBy("domain").count().orderBy("domain").collect() == [("g", 3), ("s", 1200)]
    values = [(u, i, float((i * 7919) % 101)) for u, n in (("a", 3000), ("b", 1), ("c", 512)) for i in range(n)]
    rows = spark.createDataFrame([*values, ("d", 1, None)], "u string, i long, v double")
    want = {}
    for u, i, v in values:
        want[u] = v if u not in want else 0.99 * want[u] + 0.01 * v
    means = {r.u: r.mean for r in quality.moving_mean(rows, "u", "i", "v").collect()}
    assert means.keys() == want.keys() and all(abs(means[u] - want[u]) < 1e-9 for u in want)


def test_answers_and_settings(spark):
    from sievework.functions import parsing

    one = '{"related_query": " A Kite ", "unrelated_query": "Tea"}'
    fence = "`" * 3
    texts = [one, f"Sure [1: \n{fence}json\n[{one}]\n{fence} bye", f"[{one}, {one}]", "no", None, '{"related_query": "", "unrelated_query": "x"}', "[" * 3000, f"[oops] {one}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", parsing.parsed_answer(F.col("t")).alias("a")).collect()}
    assert [i for i, a in got.items() if a] == [0, 1, 7] and tuple(got[1][0]) == ("a kite", "tea")
    assert len(parsing.query_entries(texts[2], 2)) == 2 and df.limit(0).select(parsing.parsed_answer(F.col("t"))).count() == 0
    assert parsing.source_spec("a, b:2, c:pair-class ,d:x:y,e:x:0.5,", []) == [("a", "pair", 1.0), ("b", "pair", 2.0), ("c", "pair-class", 1.0), ("d", "x", 1.0), ("e", "x", 0.5)]
    assert parsing.source_spec(" mix ", [("z", "pair", 1.0)]) == parsing.source_spec(None, [("z", "pair", 1.0)]) == [("z", "pair", 1.0)]


def test_flags_and_sources_by_precedence(spark, tmp_path):
    from sievework.operators import quality
    from sievework.sources import readers, writers

    rows = spark.createDataFrame([("a", "general", "s", ["one kite aloft here", "a harbour wall in fog"], "kite", "tea leaves in a tin"), ("b", "general", "s", ["one kite aloft here", "a harbour wall in fog"], "kites over a town", "tea leaves in a box")], "id string, domain string, source string, captions array<string>, query string, unrelated_query string")
    live = {r.id: r.codes for r in readers.flagged_rows(spark, str(tmp_path / "none"), rows, ["query_too_short"]).collect()}
    writers.audit(quality.flags(rows), str(tmp_path / "q"))
    read = {r.id: r.codes for r in readers.flagged_rows(spark, str(tmp_path / "q"), rows, ["query_too_short"]).collect()}
    assert live == read == {"a": ["query_too_short"]}
    name, got = readers.first_source(("lost", lambda: spark.read.parquet(str(tmp_path / "lost"))), ("empty", lambda: rows.limit(0)), ("rows", lambda: rows))
    assert name == "rows" and got.count() == 2
    with pytest.raises(ValueError, match="no source"):
        readers.first_source(("empty", lambda: rows.limit(0)))


def test_names_folders_and_staging(spark):
    files = spark.createDataFrame([("a/b/x.jpg", 2000, None), ("a/y.jpg", 10, 10), ("a/b/c/z.jpg", 5000, 4999), ("a/b/w.jpg", 4000, 4000)], "path string, length long, size long")
    assert {r.folder: (r.files, r.bytes) for r in records.folder_sizes(files).collect()} == {"a": (4, 11010), "a/b": (3, 11000), "a/b/c": (1, 5000)}
    assert {r.path: r.ready for r in records.staging_ready(files).collect()} == {"a/b/x.jpg": True, "a/y.jpg": False, "a/b/c/z.jpg": False, "a/b/w.jpg": True}
    rows = spark.createDataFrame([(1, "a/y.jpg"), (2, "elsewhere.png"), (3, None)], "i int, image string")
    assert [r.i for r in records.path_references(rows, "image", files).collect()] == [2]
    r = spark.createDataFrame([("g", 7), ("g", 12345678)], "d string, n long").select(records.padded_id(F.col("d"), F.col("n")).alias("i")).collect()
    assert [x.i for x in r] == ["g-000007", "g-12345678"]
