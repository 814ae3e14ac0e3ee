"""The progress store and the transactional export: upsert, resume, compaction, crashes."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from sievework.sources import readers, versions, writers
from sievework.sources.store import ProgressStore

SCHEMA = "key string, captions array<string>, query string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def listed(df):
    return {r.key: (r.captions, r.query) for r in df.collect()}


def test_fields_are_overlaid_and_versions_stay_readable(spark, tmp_path):
    s = ProgressStore(spark, str(tmp_path / "s"), "key", SCHEMA)
    assert listed(s.snapshot()) == {} and not s.compact()
    s.append(rows(spark, ("a", ["x"], None), ("b", None, "q"), (None, ["n"], "n")))
    s.append(rows(spark, ("a", None, "qa"), ("b", ["y"], None), ("a", None, "qa2")).coalesce(1))
    want = {"a": (["x"], "qa2"), "b": (["y"], "q")}
    assert listed(s.snapshot()) == want and listed(s.snapshot(1)) == {"a": (["x"], None), "b": (None, "q")}
    assert s.compact() and listed(s.snapshot()) == want and len(s.versions.current()[1]["parts"]) == 1
    s.append(rows(spark, ("b", None, "q2"), ("c", ["z"], None)))
    assert listed(s.snapshot()) == want | {"b": (["y"], "q2"), "c": (["z"], None)}
    keys = spark.createDataFrame([("a",), ("c",), ("d",)], "key string")
    assert sorted(r.key for r in s.pending(keys, "captions", "query").collect()) == ["c", "d"]
    assert len(s.vacuum()) == 2 and listed(s.snapshot())["a"] == (["x"], "qa2")


def test_writers_at_once_lose_nothing(spark, tmp_path):
    s = ProgressStore(spark, str(tmp_path / "s"), "key", SCHEMA)
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: s.append(rows(spark, *[(f"{i}-{j}", [str(j)], None) for j in range(5)])), range(8)))
        pool.submit(s.compact).result()
    assert len(listed(s.snapshot())) == 40


def test_a_stream_resumes_without_repeats(spark, tmp_path):
    source, s = tmp_path / "in", ProgressStore(spark, str(tmp_path / "s"), "key", SCHEMA)
    source.mkdir()
    put = lambda i: (source / f"{i}.json").write_text(json.dumps({"key": f"k{i}", "query": f"q{i}"}))
    run = lambda: s.sink(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source)), "in", str(tmp_path / "c"), parts=2)
    put(0), put(1)
    run().awaitTermination()
    # A batch that was appended, but whose end the stream did not live to record.
    assert not s.append(rows(spark, ("k9", None, "again")), "in", 1)
    keep, s.append = s.append, lambda *a: (keep(*a), 1 / 0)
    put(2)
    with pytest.raises(Exception):
        run().awaitTermination()
    s.append = keep
    put(3)
    run().awaitTermination()
    assert listed(s.snapshot()) == {f"k{i}": (None, f"q{i}") for i in range(4)}


def test_a_crash_leaves_the_last_export(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "e")
    first = spark.createDataFrame([(str(i), "general", "train" if i else "test") for i in range(10)], "id string, domain string, split string")
    manifest = writers.export(first, at, shard_rows=4)
    assert manifest["splits"] == {"test": {"general": 1}, "train": {"general": 9}} and readers.split(spark, at, "train").count() == 9
    files = writers.shard_files(spark, at).collect()
    assert len(files) >= 4 and all(f.file.startswith("split=") and f.length > 0 and len(f.md5) == 32 for f in files)
    monkeypatch.setattr(versions.Versions, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        writers.export(first.limit(3), at)
    monkeypatch.undo()
    assert readers.split(spark, at).count() == 10
    monkeypatch.setattr(versions.Versions, "commit", lambda *a: False)  # another export came between
    with pytest.raises(RuntimeError):
        writers.export(first.limit(3), at)
    monkeypatch.undo()
    with pytest.raises(ValueError, match="captions"):
        writers.export(spark.createDataFrame([("1", "general", "s", ["a"], "q", "u")], "id string, domain string, source string, captions array<string>, query string, unrelated_query string"), at, check=True)
    old = readers.split(spark, at)
    writers.export(first.limit(3), at)
    assert readers.split(spark, at).count() == 3 and old.count() == 10  # the old version is still there
    assert len(writers.drop_old_exports(spark, at)) == 3 and readers.split(spark, at).count() == 3
