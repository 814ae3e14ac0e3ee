import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from sievework.llm import decontamination, fm_index, jpeg, language_id, media_column, mixing, registry, secret_scan, simhash, substring_dedup, token_counts, token_files, url_filter


def rowset(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("name", ["op1_secret_scan", "op5_substring_dedup"])
def test_sql_agrees_on_odd_rows(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, sf)
    assert rowset(got, *want.columns) == Counter(want.fetchall())


def test_secret_spans_by_brute_force(spark, docs, rows):
    got = {(r.id, r.kind, r.start, r.end) for r in secret_scan.secret_scan(docs).collect() if r.kind and r.kind != "owned"}
    want = set()
    for i, t, *_ in rows:
        for kind, rx, group, least in secret_scan.KINDS:
            want |= {(i, kind, m.start(), m.end()) for m in re.finditer(rx, t or "") if len(m[group]) >= least}
    assert got == want and any(k == "access" for _, k, *_ in got)


def test_ownership_separates_copied_from_owned(spark):
    shared, own = "token = \"" + "ab12" * 10 + "\"", "key Zk7q9Xw7Rt5Lm3Np1Vb8Hs6"
    df = spark.createDataFrame([(1, shared, "a/x"), (2, shared, "b/y"), (3, own, "c/z"), (4, own, "c/w"), (5, "key Qq7q9Xw7Rt5Lm3Np1Vb8Hs6", "a/x"), (6, "key Qq7q9Xw7Rt5Lm3Np1Vb8Hs6", "b/y")], "doc_id long, text string, source string")
    got = {(r.id, r.kind, r["class"]) for r in secret_scan.secret_scan(df).collect() if r.kind}
    assert {(3, "owned", "owned"), (4, "owned", "owned"), (1, "assign", "copied")} <= got and not {5, 6} & {g[0] for g in got}


def goals(sizes):
    """Targets by hand: round after round, sources above the cap stop at it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, out, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, 1.5 * sum(sizes.values())
    while len(out) < len(order):
        free = [s for s in order if s not in out]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
    return out


def test_mixing(spark, docs, rows, sf, none, tmp_path):
    got = registry.QUERIES["op2_mixing"](spark, sf).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    goal, taken = goals(sizes), Counter()
    source = {i: s for i, _, _, s in rows if i is not None}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        if r.doc_id is not None:
            taken[source[r.doc_id]] += r.taken
            assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - goal[source[r.doc_id]]) < 1e-6
    assert all(abs(taken[s] - goal[s]) <= 10 for s in sizes)
    again = registry.QUERIES["op2_mixing"](spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    out = mixing.mix(docs, shard_col="shard")
    assert out.columns == [*docs.columns, "shard"]
    per = Counter()
    for r in out.collect():
        per[r.source] += len(words(r.text))
    assert all(abs(per[s] - goal[s]) <= 10 for s in sizes)
    for name, df in (("none", none), ("blank", docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, " ")))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        empty = registry.QUERIES["op2_mixing"](spark, f"{tmp_path}/{name}").collect()
        assert len(empty) == df.count() and all((r["size"], r.taken, r.target) == (0, 0, 0.0) for r in empty)
        assert mixing.mix(df).count() == 0


def test_targets_by_hand(spark):
    rng = random.Random(8)
    for _ in range(2):
        sizes = {s: rng.choice([0, 1, 7, 100, 5000]) for s in [None, "", *(f"s{i}" for i in range(rng.randint(1, 9)))]}
        df = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "none boolean, name string, size long")
        got = {None if r.none else r.name: r.target for r in mixing.targets(df).collect()}
        want = goals(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_what_is_taken_is_what_the_tree_draws(spark, docs, monkeypatch):
    rows = mixing.sized(docs, "doc_id", "text", "source")
    sources, draws = mixing.plan(rows, block_words=30, shard_words=300)
    quota = {r.sno: r.quota for r in sources.collect()}
    drawn = draws.collect()
    places = Counter(r.sno for r in drawn)
    assert all(0 < places[s] <= n if n else not places[s] for s, n in quota.items())  # blocks without words have no row
    assert len({r.shard for r in drawn}) > 5 and len({(r.sno, r.block, r.epoch) for r in drawn}) == len(drawn)
    other = mixing.plan(rows, block_words=30, shard_words=300, seed=1)[1].collect()
    assert {tuple(r) for r in other} != {tuple(r) for r in drawn}
    monkeypatch.setattr(mixing, "splitting_tree", lambda quotas, shards, seed=0: quotas.select(F.lit(0).cast("long").alias("shard"), "sno", F.lit(0).cast("long").alias("start"), "draws").limit(0))
    assert mixing.plan(rows)[1].count() == 0


@pytest.mark.parametrize("shards", [1, 7, 200])
def test_splitting_tree_is_exact(spark, shards):
    q = [1000, 70, 0, 333]
    quotas = spark.createDataFrame(list(enumerate(q)), "sno long, draws long")
    t = mixing.splitting_tree(quotas, shards, 1).collect()
    assert sorted(t) == sorted(mixing.splitting_tree(quotas, shards, 1).collect())
    for s, n in enumerate(q):
        own = sorted((r.start, r.draws, r.shard) for r in t if r.sno == s)
        assert sum(d for _, d, _ in own) == n and [r[2] for r in own] == sorted(r[2] for r in own)
        assert all(a + d == b for (a, d, _), (b, _, _) in zip(own, own[1:])) and (not own or own[0][0] == 0)
    per = Counter()
    for r in t:
        per[r.shard] += r.draws
    assert max(per.values()) - min(per.values()) <= 9 and len(per) == shards


def test_media_round_trip(spark, docs, rows):
    got = Counter((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media_column.features(media_column.media_column(docs)).collect())
    want = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert got == want
    t = media_column.rgb_tensors(media_column.media_column(docs)).filter("id = 5").first().tensor
    assert len(t.rgb) == t.height * t.width * 3
    for n in (1, 5000, 600_000):
        p = media_column.pad(np.random.default_rng(n).bytes(n))
        assert media_column.load(media_column.store(p))[0] == p


def test_decoder_reads_fixed_scans_symbol_by_symbol(monkeypatch):
    media = media_column.store(media_column.pad(b"the same bytes by both ways of reading"))
    fast = jpeg.decode(media)
    monkeypatch.setattr(jpeg, "_fixed", lambda *a: False)
    slow = jpeg.decode(media)
    assert all((a.coefs == b.coefs).all() for a, b in zip(fast.components, slow.components))


def test_decoder_reads_runs_and_new_coefficients():
    """A hand-made grey block pair: runs of zeros, an end-of-band run, and a
    coefficient that first appears in a refinement."""
    im = jpeg.Image(16, 8, [jpeg.Component(1, 1, 1)], {0: np.ones(64, np.int32)})
    flat = lambda symbols: (bytes([0] * 7 + [len(symbols)] + [0] * 8), bytes(symbols))
    put = lambda *parts: jpeg._pack(np.array([int(b) for p in parts for b in p], np.uint8))
    sym = lambda i: f"{i:08b}"
    data = jpeg.head(im)
    data += jpeg.scan_head(im, jpeg.Scan([0], 0, 0, 0, 1), *(lambda c: (c[0], c[1]))(flat([2, 1]))) + put(sym(0), "11", sym(1), "0")  # DC 3, then 3 - 1
    data += jpeg.scan_head(im, jpeg.Scan([0], 0, 0, 1, 0), b"", b"") + put("1", "0")
    data += jpeg.scan_head(im, jpeg.Scan([0], 1, 63, 0, 1), *flat([0x21, 0x00])) + put(sym(0), "1", sym(1), sym(1))  # k = 3: +1; end; empty block
    data += jpeg.scan_head(im, jpeg.Scan([0], 1, 63, 1, 0), *flat([0x11, 0x10])) + put(sym(0), "0", sym(1), "1", "1"[:0])  # new -1 at k = 2, then the run of two with k = 3's bit
    data = data[:-1] if False else data
    out = jpeg.decode(data + b"\xff\xd9").components[0].coefs
    assert out[0, :, 0].tolist() == [7, 4]
    assert out[0, 0, 3] in (2, 3) and out[0, 0, 2] == -1
    assert jpeg.rgb(jpeg.decode(data + b"\xff\xd9")).shape == (8, 16, 3)


def test_decontamination(spark, sf, docs, none):
    got = registry.QUERIES["op4_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(20, 2)}
    q = "Question: a farmer named {} has {} apples and sells {} kg of them to a shop near {} for a good price"
    items = spark.createDataFrame([(1, q.format("Anna", "12", "5", "Rome"))], "item_id long, text string")
    other = spark.createDataFrame([(1, "intro words " + q.format("Peter", "99", "7", "Paris") + " and more"), (2, "12 apples and 5 kg in Rome"), (None, q.format("Anna", "12", "5", "Rome")), (3, None)], "doc_id long, text string")
    for bits in (1 << 28, 64):  # a filter that keeps few others, and one that keeps many
        assert [r.id for r in decontamination.leaks(other, items, most_bits=bits).collect()] == [1]
    assert {r.doc_id for r in decontamination.clean(other, items).collect()} == {2, 3}  # by text: the null id's goes as well
    assert decontamination.leaks(none, items).count() == 0 and decontamination.leaks(other, items.limit(0)).count() == 0


def removed(texts):
    seen, n = defaultdict(int), substring_dedup.WINDOW
    ws = [words(t) for t in texts]
    for w in ws:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] += 1
    out = Counter()
    for w in ws:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        out[len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    return out


@pytest.mark.parametrize("crowd", [500, 1, 0])
def test_substring_dedup(docs, rows, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    assert rowset(substring_dedup.substring_dedup(docs), "n_words", "n_removed", "kept") == removed([r[1] for r in rows])


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 6, 800)
    index = fm_index.FMIndex(text, 12)
    got = index.matching(text, np.arange(800), 12)
    s = [tuple(text[i : i + k]) for k in range(13) for i in range(800 - k + 1)]
    count = Counter(s)
    for e in range(0, 800, 7):
        best = max(k for k in range(0, min(12, e + 1) + 1) if k == 0 or count[tuple(text[e - k + 1 : e + 1])] >= 2)
        assert got[e] == best
    # Runs of repeated windows, symbol 0 matching nothing, some sequences held twice.
    for size in (3, 6):
        text = rng.integers(0, 4, 600)
        text[::30] = 0
        weight = np.where(np.arange(600) // 30 % 5 == 0, 2, 1)
        index = fm_index.FMIndex(text, 29, weight)
        first, held = np.arange(1, 600, 30), Counter()
        for i in range(600 - size + 1):
            held[tuple(text[i : i + size])] += weight[i]
        want = {(k, i) for k, a in enumerate(first) for i in range(29 - size + 1) if (w := tuple(text[a + i : a + i + size])) and 0 not in w and held[w] > 1}
        runs = list(zip(*(x.tolist() for x in index.repeats(text, first, np.full(20, 29), size))))
        assert {(k, o + i) for k, o, n in runs for i in range(n)} == want and sum(n for *_, n in runs) == len(want) > 10


def test_the_index_decides_repeats(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_sharded", lambda units: units.sparkSession.createDataFrame([], substring_dedup.FOUND))
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {0}


def test_token_files(spark, docs, rows, none, tmp_path):
    tok = Tokenizer.from_file(token_files.tokenizer_file())
    got = sorted((tuple(r) for r in token_files.token_files(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at, want = 0, Counter()
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for i, start, n, crc in got:
        assert start == at
        at += n
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    assert token_files.token_files(none).count() == 0
    # A reader that knows the folder alone.
    out = f"file://{tmp_path}/files"
    token_files.write_token_files(docs, out, order=[-F.length(F.coalesce("text", F.lit("")))])
    texts, base = [], 0
    for line in token_files.read_manifest(out):
        ids, off, names = token_files.open_part(out, line["part"], line["dtype"])
        assert line["base"] == base and len(ids) == line["tokens"] == off[-1] and len(names) == line["docs"]
        base += line["tokens"]
        texts += [(n, tok.decode(ids[a : b - 1].tolist(), skip_special_tokens=False)) for n, a, b in zip(names, off.tolist(), off[1:].tolist())]
    assert Counter(texts) == Counter((r[0], r[1] or "") for r in rows)
    assert [len(t) for _, t in texts] == sorted((len(r[1] or "") for r in rows), reverse=True)


def test_language_id(spark, none):
    data = [(i, ("le chat et la souris dans la maison " if i % 2 else "the cat and the mouse in the house ") * (1 + i % 3), "fr" if i % 2 else "en") for i in range(200)]
    data += [(900, None, "en"), (901, "123 !!", "fr"), (902, "", None), (None, "the house", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("judged", F.lit(1))
    out = language_id.language_id(df, language_id.fit(df)).collect()
    assert len(out) == len(data) and out[0].judged == 1
    for r in out:
        assert 0 <= r.score <= 1 and r.lang_pred == ("und" if not r.text or "1" in r.text else "fr" if "chat" in r.text else "en")
    assert language_id.language_id(none, language_id.fit(none)).count() == 0
    assert {r.lang_pred for r in language_id.language_id(df, language_id.fit(none)).collect()} == {"und"}


def by_hand(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hs = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(ids, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(docs, rows, none):
    fps = [by_hand(r[1]) for r in rows]
    want = Counter(zip((r[0] for r in rows), (f"{f:016x}" for f in fps), reach([r[0] for r in rows], fps)))
    got = simhash.near_duplicates(docs).select("id", simhash.hex16(F.col("fp")), "component")
    assert Counter(map(tuple, got.collect())) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for c in reach([r[0] for r in rows], fps) if c is not None})
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("bucket", [1, 3, 32])
def test_links_connect_what_is_near(spark, bucket):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(14)})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    root = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket)).collect()}
    label, want = [root.get(f, f) for f in signed], reach(list(range(len(fps))), fps)
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Net/x", "https://m.example.net/en/1?x=1", "http://example.com/de/2", "http://sub.org/fr/", "http://org", "http://net", "http://xnet/", "HTTP://EXAMPLE.COM/DE/", "a://É.example.net/en/#f"]
    urls += [f"http://h{i}.example.{'net' if i % 2 else 'org'}/{'en' if i % 3 else 'fr'}/{i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in url_filter.url_filter(df).collect():
        rest = (urls[r.page_id] or "").partition("://")[2] if "://" in (urls[r.page_id] or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")
    assert url_filter.url_filter(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(df.filter("page_id < 3")).collect()} == {"allow"}


def test_trees_learn(spark):
    data = [(i, f"http://a.example.{'net' if i % 2 else 'org'}/{'en' if i % 4 < 2 else 'fr'}/{i}") for i in range(400)]
    df = url_filter.lexical(url_filter.parts(spark.createDataFrame(data, "page_id long, url string"))).withColumn("y", (F.col("suffix") == "net").cast("int"))
    model = url_filter.fit(df)
    right = url_filter.suffix_statistics(df, model.suffixes).withColumn("m", model.margin()).filter((F.col("m") > 0) == (F.col("y") == 1)).count()
    assert right == 400


def test_trees_learn_beside_a_frequent_url(spark):
    """Repeats of one labelled url fill no sample; a label is not in its own features."""
    data = [(f"http://a.example.{'net' if i % 2 else 'org'}/{'en' if i % 4 < 2 else 'fr'}/{i}", i % 2) for i in range(200)]
    df = spark.createDataFrame(data + [data[0]] * 3000, "url string, y int")
    model = url_filter.fit(df, sample=100)
    sums = {tuple(r) for r in model.suffixes.groupBy("bucket").agg(F.sum("n"), F.sum("ones")).select("sum(n)", "sum(ones)").collect()}
    assert sums == {(100, 0.0), (100, 100.0)}
    held = url_filter.held_out(df).first()
    assert held.n == held.right and 0 < held.blocked < held.n
    lone = url_filter.lexical(url_filter.parts(spark.createDataFrame([("http://b.example.xyz/", 1)], "url string, y int")))
    one = url_filter.fit(lone)
    assert url_filter.suffix_statistics(lone, one.suffixes, True).first().suffix_rate == 0.5
    assert url_filter.suffix_statistics(lone, one.suffixes).first().suffix_rate == 2 / 3


def test_url_filter_null_and_repeated_ids(spark):
    rows = [(None, "http://x.net/"), (None, "http://x.net/"), (1, None), (1, "http://" + "a" * 200_000 + ".org/fr/"), (2, "http://x.com/?" + "k=v&" * 20_000)]
    got = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted(((r.page_id or 0, r.rule or "") for r in got)) == [(0, "net/"), (0, "net/"), (1, ""), (1, "org/fr/"), (2, "")]


def test_token_counts(docs, rows, none):
    tok = Tokenizer.from_file(token_files.tokenizer_file())
    total = Counter()
    for r in token_counts.token_counts(docs).collect():
        total[r.id] += r.n_tokens
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids)
    assert +total == +want and token_counts.token_counts(none).count() == 0
    ids, text = np.array(tok.encode("ab é cd\nef", add_special_tokens=False).ids), "ab é cd\nef"
    got = token_counts.attribute(text, ids, token_counts.token_bytes(token_files.tokenizer_file()), [(1, 4), (5, 8)])
    offsets = tok.encode(text, add_special_tokens=False).offsets
    inside = lambda a, b: sum(a <= s < b for s, _ in offsets)
    assert [g[3] for g in got[:2]] == [inside(1, 4), inside(5, 8)] and sum(g[3] for g in got) == len(ids)


def test_pipeline_stages(spark, docs, none, sf, tmp_path):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, none, sf).count() == 0, name
    assert corpus_pipeline.run(spark, sf).count() > 0
    # The last stage keeps the order of the mix.
    mixing.mix(docs, seed=3).coalesce(2).write.parquet(f"{tmp_path}/mix")
    mixed = spark.read.parquet(f"{tmp_path}/mix")
    want = [r.doc_id for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    got = [r.doc_id for r in corpus_pipeline.tokens(spark, mixed, sf).orderBy("start").collect()]
    assert got == want and want != sorted(want, key=lambda i: (i is not None, i or 0))


def leaking(spark, item, *texts):
    """Numbers of the texts that leak the item."""
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    return sorted(r.id for r in decontamination.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect())


def test_decontamination_scores_each_occurrence(spark):
    q = "a farmer near the river has {} apples and sells {} of them to a shop for {} coins so that {} remain for the winter"
    fruit = "what is more {} apples and {} pears or {} apples and {} pears or {} apples and {} pears or {} apples and {} pears in a basket"
    item, other = q.format(12, 5, 30, 7), q.format(99, 41, 64, 58)
    assert leaking(spark, item, f"{item} then {other}", f"{item} then {other} and {q.format(1, 2, 3, 4)}") == [0, 1]
    assert leaking(spark, fruit.format(*range(3, 11)), "intro " + fruit.format(*range(3, 11)) + " end") == [0]
    # An insertion moves the second half to another diagonal.
    halves = item.split()
    assert leaking(spark, item, " ".join([*halves[:11], "as people say", *halves[11:]])) == [0]


def test_decontamination_slots_agree_both_ways(spark):
    form = "the form asks for a weight of {} and a height of {} and an age of {} and a rent of {} in this order"
    assert leaking(spark, form.format(71, 182, 40, 950), form.format(0, 0, 0, 0), form.format(64, 170, 35, 800)) == [1]
    assert leaking(spark, form.format(0, 0, 0, 0), form.format(71, 182, 40, 950)) == []


def test_decontamination_types_every_slot(spark):
    q = "{0} has {2} apples today. {1} buys {3} of them. {0} keeps the others. {1} then sells {4} to a friend. {0} asks how many apples both have."
    item = q.format("Anna", "Peter", 12, 5, 3)
    assert leaking(spark, item, q.format("Maria", "Paul", 12, 5, 3), q.format("Mary Ann", "Paul", 90, 41, 7), "he read: " + q.format("Maria", "Paul", 9, 4, 2)) == [0, 1, 2]
    # A common word that is a name elsewhere in the text.
    assert leaking(spark, q.format("Will", "Peter", 12, 5, 3) + " Now thank Will for it.", q.format("Maria", "Paul", 90, 41, 7) + " Now thank Maria for it.") == [0]
    far = "a runner covers {}km with a bag of {}lb and jumps {}m over a wall that is {}m high before the end"
    assert leaking(spark, far.format(5, 20, 3, 2), far.format(9, 45, 7, 6), far.format("9 ", "45 ", "7 ", "6 ")) == [0, 1]


def test_decontamination_needs_words_or_values(spark):
    assert leaking(spark, "12 kg", "he had 7 kg of it", "he had 12 kg of it") == [1]
    assert leaking(spark, "Anna Maria Rossi", "then came Tom Sawyer", "then came Anna Maria Rossi") == [1]
    assert leaking(spark, "1 2 3 4 5 6 7 8 9 10", "11 12 13 14 15 16 17 18 19 20", "0 1 2 3 4 5 6 7 8 9 10 11") == [1]
    assert leaking(spark, "5km", "ran 7km", "ran 5km", "ran 5 km") == [1, 2]


def test_rows_without_own_id_are_decided_by_text(spark):
    q = "a farmer near the river has 12 apples and sells 5 of them to a shop for 30 coins in the winter"
    a, b, c = ("one two three four five six", "completely other words are in this one text", "and a third text with its own words only")
    data = [(1, a), (None, a), (None, b), (None, b), (2, b), (7, a), (7, c), (7, c), (None, q), (None, q), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in data], "doc_id long, text string, n string")
    once = [(1, a), (2, b), (7, c), (None, q), (None, None)]
    assert rowset(simhash.keep_one(docs), "doc_id", "text") == Counter(once)
    items = spark.createDataFrame([(1, q)], "item_id long, text string")
    assert rowset(decontamination.clean(docs, items), "doc_id", "text") == Counter(x for x in data if x[1] != q)
