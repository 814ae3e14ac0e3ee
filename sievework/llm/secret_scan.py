"""Secret scan with corpus-wide ownership frequency. Built-in functions only.

One pass over the texts finds candidate spans. Their hashes are then counted by
distinct repository and owner: a value that many owners hold is a copied
example, a live-looking value of one owner is a credential. Base rules always
report; the ownership rule adds spans of kind ``owned``.

Defined results: a null or empty text has no spans; a null repository counts as
one unknown repository and owner; repeated rows (equal ids included) each give
a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

# Kind, pattern, group of the value, least length of that group.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Long runs of key characters: what the ownership rule looks at beyond the base kinds.
LONG_RUN = ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
SPAN = "struct<k:int,s:int,e:int,v:string>"


def _spans(text: str, k: int, pattern: str, group: int, least: int) -> str:
    """SQL for all leftmost non-overlapping matches: offsets are running sums of
    the lengths of the pieces between matches and of the matches."""
    rx = "r'" + pattern.replace("'", r"\x27") + "'"
    return f"""
    CASE WHEN {text} RLIKE {rx} THEN filter(aggregate(
      arrays_zip(split({text}, {rx}, -1), regexp_extract_all({text}, {rx}, 0), regexp_extract_all({text}, {rx}, {group})),
      struct(0 AS p, cast(array() AS array<{SPAN}>) AS out),
      (a, x) -> struct(
        a.p + length(x.`0`) + coalesce(length(x.`1`), 0) AS p,
        IF(x.`1` IS NULL OR length(x.`2`) < {least}, a.out, concat(a.out, array(struct(
          {k} AS k, a.p + length(x.`0`) AS s, a.p + length(x.`0`) + length(x.`1`) AS e, x.`2` AS v)))) AS out),
      a -> a.out), z -> true)
    ELSE cast(array() AS array<{SPAN}>) END"""


def live_looking(value: Column) -> Column:
    """Letters and digits mixed, at least ten different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """A row per document: row, id, repo, owner and its candidate spans.

    The owner is the part of the repository's name before the first slash.
    """
    text = "text"
    kinds = [*KINDS, LONG_RUN]
    spans = "concat(" + ", ".join(_spans(text, i, p, g, n) for i, (_, p, g, n) in enumerate(kinds)) + ")"
    return (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(repo_col).alias("repo"))
        .select(F.monotonically_increasing_id().alias("row"), "id", "repo", F.substring_index("repo", "/", 1).alias("owner"), F.expr(spans).alias("spans"))
        .withColumn("spans", F.transform("spans", lambda x: F.struct(x.k.alias("k"), x.s.alias("s"), x.e.alias("e"), F.sha2(x.v, 256).alias("h"), live_looking(x.v).alias("live"))))
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: n_owners, n_repos, n_uses. Each level is pre-aggregated, so
    a value that a third of all rows hold reaches a reducer as one row a task."""
    return (
        found.select("repo", "owner", F.explode("spans.h").alias("h"))
        .groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
        .groupBy("h", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
        .groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n_uses"))
    )


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", max_owners: int = 1) -> DataFrame:
    """A row per span: row, id, kind, start, end, h, live, n_owners, n_repos,
    n_uses, class. Each document has one more row, with null kind.

    class is ``owned`` for a live-looking value with at most ``max_owners``
    owners, else ``copied``. A long run (kind ``owned``) stays only if its class
    is ``owned`` and no base span of its document overlaps it.
    """
    found = table(candidates(docs, id_col, text_col, repo_col), "secrets")
    spans = found.select("row", "id", F.explode("spans").alias("x")).select("row", "id", "x.*")
    owners = table(ownership(found), "secret-owners")  # joined from a table, a hot value's spans can be split
    joined = spans.join(owners, "h").withColumn(
        "class", F.when(F.col("live") & (F.col("n_owners") <= max_owners), "owned").otherwise("copied")
    )
    doc = "PARTITION BY row ORDER BY s, e, k ROWS BETWEEN"
    base = f"k < {len(KINDS)}"
    names = F.array(*[F.lit(k[0]) for k in [*KINDS, LONG_RUN]])
    return (
        joined.withColumn("before", F.expr(f"max(IF({base}, e, 0)) OVER ({doc} UNBOUNDED PRECEDING AND CURRENT ROW)"))
        .withColumn("after", F.expr(f"min(IF({base}, s, NULL)) OVER ({doc} CURRENT ROW AND UNBOUNDED FOLLOWING)"))
        .filter(F.expr(base) | ((F.col("class") == "owned") & (F.col("before") <= F.col("s")) & (F.coalesce(F.col("after"), F.col("e")) >= F.col("e"))))
        .unionByName(found.select("row", "id"), allowMissingColumns=True)  # every document keeps a row
        .withColumn("kind", F.get(names, F.col("k")))
        .select("row", "id", "k", "kind", F.col("s").alias("start"), F.col("e").alias("end"), "h", "live", "n_owners", "n_repos", "n_uses", "class")
    )


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`secret_scan`, a row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = F.concat_ws(":", "kind", "start", "end")
    span = F.when(F.col("k").isNotNull(), F.struct("start", "k", at.alias("at")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.at), ",")
    return (
        secret_scan(docs)
        .groupBy("row", "id")
        .agg(*[F.count_if(F.col("kind") == k[0]).alias(f"n_{k[0]}") for k in KINDS],
             F.collect_list(F.when(F.col("k") < len(KINDS), span)).alias("base"), F.collect_list(span).alias("all"),
             F.count_if((F.col("k") < len(KINDS)) & (F.col("class") == "owned")).alias("n_owned"),
             F.count_if((F.col("k") < len(KINDS)) & (F.col("class") == "copied")).alias("n_copied"))
        .select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"), "n_owned", "n_copied")
    )


def _duck_kind(k: int, kind: tuple) -> str:
    name, pattern, group, least = kind
    rx = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, doc_id, source, {k} AS k, '{name}' AS kind, {least} AS least, string_split_regex(t, {rx}) AS gaps,
      regexp_extract_all(t, {rx}) AS ms, regexp_extract_all(t, {rx}, {group}) AS vs FROM r"""


OP1_SQL = f"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(_duck_kind(i, k) for i, k in enumerate([*KINDS, LONG_RUN]))}),
b AS (SELECT rid, doc_id, source, k, kind, least, gaps, ms, unnest(ms) AS m, unnest(vs) AS v, unnest(range(1, len(ms) + 1)) AS i FROM a),
c AS (SELECT rid, doc_id, source, k, kind, v, length(m) AS n,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
      FROM b WHERE length(v) >= least),
o AS (SELECT v, count(DISTINCT coalesce(split_part(source, '/', 1), chr(0))) AS owners FROM c GROUP BY v),
d AS (SELECT c.*, CAST(s AS BIGINT) AS st, CAST(s + n AS BIGINT) AS en,
        (owners <= 1 AND regexp_matches(c.v, '[0-9]') AND regexp_matches(c.v, '[A-Za-z]') AND len(list_distinct(string_split(c.v, ''))) >= 10) AS own
      FROM c JOIN o USING (v)),
e AS (SELECT * FROM d WHERE k < {len(KINDS)} OR (own AND NOT EXISTS (
        SELECT 1 FROM d AS x WHERE x.rid = d.rid AND x.k < {len(KINDS)} AND x.st < d.en AND d.st < x.en))),
f AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k) FILTER (k < {len(KINDS)}) AS base,
        string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, k) AS spans,
        count(*) FILTER (k < {len(KINDS)} AND own) AS n_owned, count(*) FILTER (k < {len(KINDS)} AND NOT own) AS n_copied FROM e GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied
FROM r LEFT JOIN f USING (rid)
"""
