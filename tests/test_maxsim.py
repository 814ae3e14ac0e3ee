"""Pruned late interaction against all pairs, and documents' bounds."""

import numpy as np
import pytest

from sievework.operators import maxsim


def clustered(rng, n, groups, dim, spread):
    """Rows (id, tok, vec): a document's tokens lie near one of ``groups`` directions."""
    centre = rng.normal(size=(groups, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    rows = []
    for i in range(n):
        for t in range(int(rng.integers(1, 6))):
            v = centre[i % groups] + spread * rng.normal(size=dim) / np.sqrt(dim)
            rows.append((i, t, (v * rng.uniform(0.5, 1.5)).tolist()))
    return rows


def by_hand(queries, docs, k, earlier=False):
    group = lambda rows: {i: np.array([r[2] for r in rows if r[0] == i]) for i in {r[0] for r in rows}}
    q, d = group(queries), group(docs)
    out = {}
    for i, m in q.items():
        found = [(-round(float((m @ x.T).max(1).mean()), 9), j) for j, x in d.items() if not earlier or j < i]
        out[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return {i: v for i, v in out.items() if v}


def listed(df):
    out: dict = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append((r.d, round(r.score, 9)))
        assert r["rank"] == len(out[r.q])
    return out


SCHEMA = "id long, tok long, vec array<double>"


@pytest.mark.parametrize("block,part,cells", [(4096, 65536, None), (4096, 65536, 12), (16, 40, 12), (7, 25, 3)])
def test_pruned_equals_all_pairs(spark, monkeypatch, block, part, cells):
    monkeypatch.setattr(maxsim, "BLOCK", block)
    monkeypatch.setattr(maxsim, "PART", part)
    rng = np.random.default_rng(4)
    docs = clustered(rng, 150, 12, 16, 0.5)
    docs += [(i + 1000, t, v) for i, t, v in docs if i < 20]  # equal documents tie
    queries = clustered(rng, 12, 12, 16, 0.5)
    q, d = spark.createDataFrame(queries + [(99, 0, None)], SCHEMA), spark.createDataFrame(docs + [(7, 9, None)], SCHEMA)
    assert listed(maxsim.maxsim_top_k(q, d, 5, cells)) == by_hand(queries, docs, 5)
    assert listed(maxsim.maxsim_top_k(d.filter("id < 40"), d, 3, cells, earlier=True)) == by_hand([r for r in docs if r[0] < 40], docs, 3, True)
    every = {(r.q, r.d): round(r.score, 9) for r in maxsim.maxsim(q, d).collect()}
    assert len(every) == 12 * 170 and all(every[i, j] == s for i, x in by_hand(queries, docs, 5).items() for j, s in x)


def test_clusters_are_skipped(spark):
    rng = np.random.default_rng(5)
    docs = clustered(rng, 3060, 30, 32, 0.2)
    docs, queries = [r for r in docs if r[0] < 3000], [r for r in docs if r[0] >= 3000]
    scored = spark.sparkContext.accumulator(0)
    q, d = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(docs, SCHEMA)
    assert listed(maxsim.maxsim_top_k(q, d, 10, 30, scored=scored)) == by_hand(queries, docs, 10)
    assert scored.value < 0.5 * 60 * 3000
    print("share skipped", 1 - scored.value / (60 * 3000))


def test_bounds_hold():
    rng = np.random.default_rng(6)
    centres = maxsim._unit(rng.normal(size=(5, 8)))[0]
    for _ in range(200):
        m, x = rng.normal(size=(3, 8)), rng.normal(size=(6, 8))
        unit, norm = maxsim._unit(x)
        near = (unit @ centres.T).argmax(1)
        angle = np.arccos(np.clip((unit * centres[near]).sum(1), -1, 1))
        cells = [{"c": int(c), "low": angle[near == c].min(), "high": angle[near == c].max(), "norm": norm[near == c].max()} for c in np.unique(near)]
        mu, mn = maxsim._unit(m)
        upper = maxsim._upper(np.arccos(np.clip(mu @ centres.T, -1, 1)), mn, np.array([0]), cells, np.array([0]))[0, 0]
        assert upper >= (m @ x.T).max(1).mean()


def test_nothing_in_nothing_out(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 0, [1.0, 0.0])], SCHEMA)
    for q, d in ((none, some), (some, none), (none, none)):
        assert maxsim.maxsim_top_k(q, d, 3).count() == maxsim.token_maxsim(q, d).count() == maxsim.maxsim_top_k(q, d, 3, 2).count() == 0


def test_a_task_gives_about_so_many_rows(spark, monkeypatch):
    from sievework.operators import maxsim

    rng = np.random.default_rng(6)
    rows = [(i, t, rng.normal(size=4).tolist()) for i in range(200) for t in range(2)]
    docs = spark.createDataFrame(rows, "id long, tok long, vec array<double>").repartition(2)
    asked = docs.filter("id < 20")
    whole = sorted(tuple(r) for r in maxsim.token_maxsim(asked, docs).collect())
    assert len(whole) == 40 * 200
    sizes = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(maxsim, "ROWS", 400)
    grid = maxsim._grid
    monkeypatch.setattr(maxsim, "_grid", lambda q, d, score, schema: grid(q, d, lambda a, b: (sizes.add(len(score(a, b)) > 1200), score(a, b))[1], schema))
    assert sorted(tuple(r) for r in maxsim.token_maxsim(asked, docs).collect()) == whole and sizes.value == 0


def test_affinity_hands_on_a_row_a_query_and_document(spark, monkeypatch):
    from sievework.plans import catalogue

    rng = np.random.default_rng(7)
    queries, docs = clustered(rng, 9, 5, 8, 0.5), clustered(rng, 60, 5, 8, 0.5)
    q, d = spark.createDataFrame(queries + [(99, 0, None)], SCHEMA), spark.createDataFrame(docs + [(7, 9, None)], SCHEMA)
    handed = spark.sparkContext.accumulator(0)
    grid = maxsim._grid

    def counted(score):
        def f(a, b):
            rows = score(a, b)
            handed.add(len(rows))
            return rows

        return f

    monkeypatch.setattr(maxsim, "_grid", lambda q, d, score, schema: grid(q, d, counted(score), schema))
    monkeypatch.setattr(maxsim, "BLOCK", 6)
    monkeypatch.setattr(maxsim, "ROWS", 50)  # several blocks and parts
    monkeypatch.setattr(catalogue, "tokens", lambda spark, sf_dir: (q, d))
    found = {(r.q, r.d): (r.mx, r["mean"]) for r in catalogue.document_affinity(spark, "").collect()}
    assert handed.value == 9 * 60 == len(found)
    group = lambda rows: {i: np.array([r[2] for r in rows if r[0] == i]) for i in {r[0] for r in rows}}
    for i, m in group(queries).items():
        for j, x in group(docs).items():
            best = (m @ x.T).max(1)
            assert found[i, j] == pytest.approx((best.max(), best.mean()), abs=1e-6)


def test_pooled_queries_hand_on_a_row_a_query_and_document(spark, monkeypatch):
    from sievework.plans import catalogue

    rng = np.random.default_rng(8)
    queries, docs = clustered(rng, 9, 5, 8, 0.5), clustered(rng, 40, 5, 8, 0.5)
    q, d = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(docs, SCHEMA)
    handed = spark.sparkContext.accumulator(0)
    grid = maxsim._grid

    def counted(score):
        def f(a, b):
            rows = score(a, b)
            handed.add(len(rows))
            return rows

        return f

    monkeypatch.setattr(maxsim, "_grid", lambda q, d, score, schema: grid(q, d, counted(score), schema))
    monkeypatch.setattr(catalogue, "tokens", lambda spark, sf_dir: (q, d))
    two = {(r.q, r.d): r.score for r in catalogue.topk_token_maxsim(spark, "").collect()}
    soft = {(r.q, r.d): r.soft for r in catalogue.soft_maxsim(spark, "").collect()}
    assert handed.value == 2 * 9 * 40 and len(two) == len(soft) == 9 * 40
    group = lambda rows: {i: np.array([r[2] for r in rows if r[0] == i]) for i in {r[0] for r in rows}}
    for i, m in group(queries).items():
        for j, x in group(docs).items():
            best = np.sort((m @ x.T).max(1))
            assert two[i, j] == pytest.approx(best[-2:].mean(), abs=1e-6)
            assert soft[i, j] == pytest.approx(0.1 * np.log(np.exp(best / 0.1).sum()), abs=1e-6)
