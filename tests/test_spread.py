"""Farthest points in parts: the same as at once where there is one part, and the stated factor."""

import numpy as np

from sievework.operators import spread, vectors

SCHEMA = "id long, tok long, vec array<double>"


def radius(u, seeds):
    return max(np.min(np.linalg.norm(u[:, None] - u[seeds][None], axis=2), axis=1))


def test_parts_keep_the_factor(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 12))
    rows, units = [], {}
    for g, n in ((1, 700), (2, 5), (3, 90)):
        x = centre[rng.integers(6, size=n)] + 0.1 * rng.normal(size=(n, 12))
        units[g] = x / np.linalg.norm(x, axis=1, keepdims=True)
        rows += [(g, t, v.tolist()) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(2, 9, None)], SCHEMA)

    def got():
        out = {}
        for r in spread.farthest_seeds(df, 6).collect():
            out.setdefault(r.id, {})[r.seed] = r.tok
        return {i: [s[k] for k in range(len(s))] for i, s in out.items()}

    once = got()
    assert once == {g: spread.pick(u, 6) for g, u in units.items()}
    monkeypatch.setattr(spread, "PART", 60)
    monkeypatch.setattr(spread, "CALL", 100)
    parts = got()
    assert parts[2] == once[2] and {g: len(s) for g, s in parts.items()} == {1: 6, 2: 5, 3: 6}
    for g, u in units.items():
        # The least radius is at least half of what picking at once ensures.
        assert len(set(parts[g])) == len(parts[g]) and radius(u, parts[g]) <= 4 * radius(u, once[g]) and radius(u, parts[g]) < 1.0
    assert got() == parts


def test_merge_onto_seeds_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(1, t, v.tolist()) for t, v in enumerate(x)] + [(2, 0, [1.0, 0.0, 0.0, 0.0, 0.0])], SCHEMA).repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    seeds = spread.pick(u, 4)
    w = np.exp(u @ u[seeds].T / 0.05)
    want = (w / w.sum(1, keepdims=True)).T @ x
    got = {(r.id, r.tok): r.vec for r in vectors.farthest_points(df, 4).collect()}
    assert np.allclose([got[1, k] for k in range(4)], want) and got[2, 0] == [1.0, 0.0, 0.0, 0.0, 0.0] and len(got) == 5
    assert vectors.farthest_points(df.limit(0), 4).count() == 0


def test_small_groups_have_as_many_seeds_as_the_sql(spark, tmp_path):
    import duckdb

    from sievework.plans import catalogue, training  # noqa: F401

    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 64))
    rows = [(v, x[v % 8 % 3].tolist()) for v in range(8)] + [(v, rng.normal(size=64).tolist()) for v in (8, 16, 17)]  # copies; one token; two
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["farthest_seeds"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.sql(catalogue.SQL["farthest_seeds"]).fetchall())
    assert [g[1:] for g in got[3:]] == [(0, 0), (1, 0), (2, 0), (0, 0), (1, 1), (2, 0)]
