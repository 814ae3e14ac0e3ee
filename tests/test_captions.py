"""Caption search by postings against comparing everything."""

import random

import pytest

from sievework.operators import captions


def by_hand(queries, rows, k):
    out = {}
    for i, q in queries:
        q, found = (q or "").strip().lower(), []
        for key, c in rows:
            c = (c or "").strip().lower()
            a, b = set(q.split()), set(c.split())
            s = 0 if not q or not c else 1 + min(len(q) / len(c), 1) if q in c else len(a & b) / len(a | b)
            found += [(-round(s, 9), key, c)] if s > 0 else []
        if found:
            out[i] = [(key, -s) for s, key, _ in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("k", [1, 4, 500])
def test_search_equals_all_pairs(spark, k):
    rng = random.Random(k)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    rows = [(i, say(9)) for i in range(150)] + [(200, "Aa bb"), (201, "aa BB"), (202, None), (203, " "), (204, "the the the"), (205, "the")]
    queries = [(i, say(4)) for i in range(25)] + [(50, "a"), (51, "Aa b"), (52, None), (53, ""), (54, "zzz"), (55, "the"), (55, "the")]
    got: dict = {}
    frame = lambda r: spark.createDataFrame(r, "i long, text string")
    for r in captions.caption_top_k(frame(queries), frame(rows), k, ["i"], query="i").toPandas().set_axis(["q", "i", "rank", "score"], axis=1).sort_values(["q", "rank"]).itertuples():
        got.setdefault(r.q, []).append((r.i, round(r.score, 9)))
    assert got == by_hand(queries, rows, k)
    assert captions.caption_top_k(frame(queries), frame(rows).limit(0), k, ["i"], query="i").count() == 0 == captions.caption_top_k(frame(queries).limit(0), frame(rows), k, ["i"], query="i").count()
