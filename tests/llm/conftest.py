import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, judged string, id long, fp string"


def make_texts():
    """Small documents: nulls, empty, long, equal and nearly equal texts, and long shared passages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(60), say(50)
    texts = [None, "", " \t\n", "one", "two words", base, base, base + " tail", say(9000)]
    texts += [f"{say(20)} {passage} {say(25)}" for _ in range(6)] + [say(rng.randint(1, 90)) for _ in range(40)]
    texts += [f"{say(5)} password = \"abcdef{i:08d}\" AKIA{'A1B2' * 5} {'0a1b2c3d' * 3} {say(4)} Zk{i}q9Xw7Rt5Lm3Np1Vb8Hs6" for i in range(4)]
    return texts + ["x \U0001f600 token: short secret=abcdefghijkl", "a\u00a0b c\u2003d"]


@pytest.fixture(scope="session")
def rows():
    texts = make_texts()
    out = [(i, t, ["en", "fr", None, "de"][i % 4], ["s1", "s2", "s3", "s4", None][i % 5]) for i, t in enumerate(texts)]
    out += [out[5], out[9], (None, "null id text", "en", "s1"), (None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "r", "j", 7, "f") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark, docs, tmp_path_factory):
    """A folder with the tables that queries read."""
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{d}/documents.parquet")
    item = docs.filter("doc_id = 20").first().text
    spark.createDataFrame([(1, "Nothing like this 12 kg is in any of the texts of this small table at all"), (2, item), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)
