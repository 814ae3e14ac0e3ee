"""Flags, written lists and the bank's walk on rows that once went wrong."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import quality

META = "id string, domain string, source string, captions array<string>, query string, unrelated_query string"


def test_one_caption_is_not_diverse(spark):
    rows = spark.createDataFrame([
        ("one", "general", "s", ["a lone lighthouse on the cape"], "lighthouse in a storm", "some other thing"), ("two", "general", "s", ["a lone lighthouse on the cape", "six buckets of paint"], "lighthouse in a storm", "some other thing"),
        ("blank", "general", "s", ["a lone lighthouse on the cape", " "], "lighthouse in a storm", "some other thing"), ("none", "general", "s", [], "lighthouse in a storm", "some other thing"),
    ], META)
    flagged = quality.flags(rows)
    got = {r.id: r.codes for r in flagged.collect()}
    assert got == {"one": ["captions_not_diverse", "empty_field"], "two": [], "blank": ["captions_not_diverse", "empty_field"], "none": ["empty_field"]}
    fields = {r.id: r.f for r in flagged.select("id", quality.fields_to_repair(F.col("codes")).alias("f")).collect()}
    assert "captions" in fields["one"] and "captions" in fields["blank"] and "captions" not in fields["none"]


@pytest.mark.parametrize("written, want", [
    (r'["café", "b"]', ["café", "b"]), (r'["\x41"]', ["a"]), (r'["a\\n", "c\nd"]', ["a\\n", "c\nd"]), ("[1, 2]", ["1", "2"]), ("['x', None]", ["x"]), ("['x', ['y']]", ["x", "['y']"]),
    ("  ['A', ' b ', '']", ["a", "b"]), ("[not a list", ["[not a list"]), ("[]", []), ("['a' 'b',]", ["ab"]), ("['x'] tail", ["['x'] tail"]), ("('x', 'y')", ["('x', 'y')"]), ("plain", ["plain"]), (" ", []), (None, None), ("[" * 500, ["[" * 500]),
])
def test_written_lists(spark, written, want):
    assert spark.createDataFrame([(written,)], "x string").select(T.text_list(F.col("x")).alias("t")).first().t == want


def test_the_whole_bank_is_walked(spark):
    """A row whose texts are nearly all of the bank still gets the phrase that is left."""
    phrases = [f"bank phrase number {i}" for i in range(12)]
    rows = [(f"r{i}", "general", "s", [p for j, p in enumerate(phrases) if j != i], "q", T.OFFLINE_UNRELATED) for i in range(12)]
    rows += [("never", "general", "s", phrases, "q", T.OFFLINE_UNRELATED)]
    flagged = spark.createDataFrame(rows, META).withColumn("codes", F.array(F.lit("offline_unrelated")))
    got = {r.id: (r.unrelated_query, r.how) for r in quality.repair_unrelated(flagged, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    assert got == {"never": (None, "failed")} | {f"r{i}": (phrases[i], "local_bank") for i in range(12)}


def test_more_rows_than_phrases(spark):
    rows = spark.createDataFrame([(f"r{i}", "general", "s", ["a", "b"], "q", "") for i in range(40)], META).withColumn("codes", F.array(F.lit("empty_field")))
    got = [r.unrelated_query for r in quality.repair_unrelated(rows, spark.createDataFrame([(f"phrase of the bank {i}",) for i in range(7)], "phrase string")).collect()]
    assert len(got) == 40 and len({p for p in got if p}) == 7 == sum(p is not None for p in got)
    assert quality.repair_unrelated(rows.limit(0)).count() == 0


def test_search_queries_by_hand(spark):
    cases = [
        ("satellite", ["Two boats"], "aerial two boats"), ("general", ["Two boats on the lake", "A crane"], T.NO_QUERY), ("general", [], T.NO_TEXT), ("general", None, T.NO_TEXT), ("general", [" ", "of the"], T.NO_QUERY),
        ("satellite", ["one long row of many small houses beside four wide green fields", "An overhead shot of docks"], "aerial one long row small houses beside four wide"),
        ("satellite", ["aerial docks and cranes", "top-down docks"], T.NO_QUERY),
    ]
    rows = spark.createDataFrame([(i, d, c) for i, (d, c, _) in enumerate(cases)], "i int, domain string, captions array<string>")
    got = {r.i: r.q for r in rows.select("i", T.search_query(F.col("captions"), F.col("domain")).alias("q")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]


def test_codes_are_made_once(spark):
    from sievework.operators import records

    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def codes(i):
        calls.add(1)
        return [["a", "b"], [], ["c"]][i % 3]

    found = spark.range(30).select("id", codes("id").alias("codes"))
    got = records.with_codes(spark.range(30), found, ["a", "c"]).select("id", "codes").collect()
    assert {(r.id, *r.codes) for r in got} == {(i, "a" if i % 3 == 0 else "c") for i in range(30) if i % 3 != 1} and calls.value == 30


def test_keyword_queries_are_made_once(spark):
    from sievework.operators import quality

    flagged = spark.createDataFrame([("x", ["a blue tractor beside tall hedges", "two rowing boats", "granite quarry"], "q", ["query_too_short"])], "id string, captions array<string>, query string, codes array<string>")
    out = quality.repair_query(flagged).select("id", "how", "new_query")
    assert [tuple(r) for r in out.collect()] == [("x", "local_keywords", "blue rowing granite tractor boats quarry beside tall")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 5  # once for the query, four times in the one comparison with a caption
