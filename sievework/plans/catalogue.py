"""Queries over the driver's tables, each with its DuckDB SQL.

``meta`` makes metadata rows of conversations: turns are captions, a benchmark
item is the unrelated query. ``tokens`` makes multi-vector documents of 8 vectors
each; every fiftieth vector is a query token, four to a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import captions, dedup, pairs, quality, sampling, vectors, windows
from ..sources import scratch
from ..sources.store import ProgressStore
from ..streaming import reservoir

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- shared inputs

STRIP = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"


def s_train(x):
    return f"lower({STRIP.format(x)})"


def s_norm(x):
    return rf"rtrim(regexp_replace({s_train(x)}, '\s+', ' ', 'g'), '.')"


def s_tokens(x):
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'))"


def s_jaccard(a, b):
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def s_near(a, b):
    na, nb = s_norm(a), s_norm(b)
    return f"""({na} = '' OR {nb} = '' OR {na} = {nb} OR (least(length({na}), length({nb})) >= 12 AND abs(length({na}) - length({nb})) <= 24
      AND (contains({na}, {nb}) OR contains({nb}, {na}))) OR {s_jaccard(s_tokens(a), s_tokens(b))} >= 0.72)"""


META = f"""WITH convs AS (SELECT conv_id, list(text ORDER BY turn, text) AS captions FROM conversations GROUP BY conv_id),
meta AS (SELECT conv_id AS id, CASE conv_id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'satellite' ELSE 'other' END AS domain,
  CASE WHEN conv_id % 13 = 0 THEN '' ELSE 'src' || (conv_id % 5) END AS source, captions,
  CASE conv_id % 5 WHEN 0 THEN captions[1] WHEN 1 THEN 'photo of ' || left(captions[1], 40) WHEN 2 THEN '' WHEN 3 THEN left(captions[1], 6) ELSE 'aerial view of the coast' END AS query,
  CASE WHEN conv_id % 7 = 0 THEN '{T.OFFLINE_UNRELATED}' WHEN conv_id % 11 = 0 THEN captions[1] WHEN conv_id % 17 = 0 THEN 'Mountain landscapes' ELSE b.text END AS unrelated_query
  FROM convs LEFT JOIN benchmark b ON b.item_id = conv_id % (SELECT count(*) FROM benchmark))"""


def meta(spark, sf_dir: str) -> DataFrame:
    convs = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c")).select("conv_id", F.col("c.text").alias("captions"))
    item = read(spark, sf_dir, "benchmark").select((F.col("item_id")).alias("_item"), F.col("text").alias("_text"))
    i, first = F.col("conv_id"), F.get("captions", F.lit(0))
    return convs.crossJoin(F.broadcast(item.agg(F.count("*").alias("_n")))).join(item, F.expr("conv_id % _n") == F.col("_item"), "left").select(
        i.alias("id"),
        F.when(i % 3 == 0, "general").when(i % 3 == 1, "satellite").otherwise("other").alias("domain"),
        F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("src"), (i % 5).cast("string"))).alias("source"),
        "captions",
        F.when(i % 5 == 0, first).when(i % 5 == 1, F.concat(F.lit("photo of "), F.substring(first, 1, 40))).when(i % 5 == 2, "").when(i % 5 == 3, F.substring(first, 1, 6)).otherwise("aerial view of the coast").alias("query"),
        F.when(i % 7 == 0, T.OFFLINE_UNRELATED).when(i % 11 == 0, first).when(i % 17 == 0, "Mountain landscapes").otherwise(F.col("_text")).alias("unrelated_query"),
    )


# ---- text forms and set similarity


@query(f"SELECT doc_id, md5({s_train('text')}) AS train, md5({s_norm('text')}) AS quality FROM documents")
def text_norms(spark, sf_dir):
    """Normal forms of every text, as digests."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm_train(F.col("text"))).alias("train"), F.md5(T.norm_quality(F.col("text"))).alias("quality"))


@query(rf"SELECT doc_id, CAST(len({s_tokens('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> ''))) AS BIGINT) AS n_words FROM documents")
def token_set_sizes(spark, sf_dir):
    """Sizes of the two token sets."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.token_set(t)).cast("long").alias("n_tokens"), F.size(T.word_set(t)).cast("long").alias("n_words"))


@query(META + rf""" SELECT id, {s_norm('unrelated_query')} = '' OR {s_norm('unrelated_query')} = '{T.OFFLINE_UNRELATED}' OR regexp_matches({s_norm('unrelated_query')}, '(?i){"|".join(T.GENERIC_UNRELATED)}') AS generic,
  rtrim({STRIP.format(f"regexp_replace({STRIP.format('query')}, '(?i){T.BOILERPLATE}', '')")}, '.') AS bare, regexp_matches(coalesce(query, ''), '(?i){T.AERIALISH}') AS aerial FROM meta""")
def text_predicates(spark, sf_dir):
    """Generic phrases, boilerplate prefixes and aerial words."""
    return meta(spark, sf_dir).select("id", T.is_generic(F.col("unrelated_query")).alias("generic"), T.strip_boilerplate(F.coalesce("query", F.lit(""))).alias("bare"), T.aerialish(F.col("query")).alias("aerial"))


TURNS = "WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM conversations)"


def turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).filter("b IS NOT NULL")


@query(TURNS + f" SELECT conv_id, turn, round({s_jaccard(s_tokens('a'), s_tokens('b'))}, 6) AS jaccard, round(CASE WHEN len({s_tokens('a')}) = 0 THEN 0.0 ELSE len(list_intersect({s_tokens('a')}, {s_tokens('b')})) / len({s_tokens('a')}) END, 6) AS overlap, {s_near('a', 'b')} AS near FROM p WHERE b IS NOT NULL")
def turn_similarity(spark, sf_dir):
    """Jaccard, overlap ratio and the near-duplicate rule of consecutive turns."""
    a, b = F.col("a"), F.col("b")
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(T.jaccard(a, b), 6).alias("jaccard"), F.round(T.overlap_ratio(a, b), 6).alias("overlap"), T.near_duplicate(a, b).alias("near"))


SETS = f"""WITH t AS (SELECT doc_id AS id, list_sort({s_tokens('text')}) AS s FROM documents UNION ALL SELECT -1 - item_id, list_sort({s_tokens('text')}) FROM benchmark),
g AS (SELECT s, min(id) AS rep, len(s) AS n FROM t WHERE len(s) > 0 GROUP BY s)"""


@query(SETS + """, u AS (SELECT rep, n, unnest(s) AS w FROM g),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.w = b.w AND a.rep < b.rep AND a.n >= 0.72 * b.n AND b.n >= 0.72 * a.n GROUP BY a.rep, b.rep)
SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM p WHERE c >= 0.72 * (na + nb - c)""")
def similar_pairs(spark, sf_dir):
    """Similarity join of documents and items: pairs of class representatives; their
    members are in ``similar_members``."""
    near = dedup.similar(texts_and_items(spark, sf_dir))
    return near.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def texts_and_items(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.token_set(F.col("text")).alias("tokens"))
    items = read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("id"), T.token_set(F.col("text")).alias("tokens"))
    return texts.unionByName(items)


@query(SETS + " SELECT id, rep FROM t JOIN g USING (s)")
def similar_members(spark, sf_dir):
    """The class representative of every document and item with tokens: the texts that
    a pair of ``similar_pairs`` stands for."""
    return dedup.classes(texts_and_items(spark, sf_dir))


@query(META.replace("WITH", "WITH RECURSIVE", 1) + f""", t AS (SELECT id, len(captions)::INT AS n, list_filter(list_transform(captions, lambda c: {STRIP.format('c')}), lambda c: c <> '') AS cap FROM meta),
g AS (SELECT id, n, cap, 1 AS i, []::VARCHAR[] AS acc FROM t UNION ALL SELECT id, n, cap, i + 1, CASE WHEN len(list_filter(acc, lambda k: {s_near('k', 'cap[i]')})) > 0 THEN acc ELSE list_append(acc, cap[i]) END FROM g WHERE i <= len(cap))
SELECT id, n, len(acc)::INT AS kept FROM g WHERE i = len(cap) + 1""")
def greedy_captions(spark, sf_dir):
    """Captions that the order-dependent dedup keeps."""
    return meta(spark, sf_dir).select("id", F.size("captions").alias("n"), F.size(T.greedy_distinct(F.col("captions"))).alias("kept"))


# ---- quality

SEVERITIES = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in quality.SEVERITY.items()) + "}"
OVER = lambda q, c: f"(CASE WHEN len({s_tokens(q)}) = 0 THEN 0.0 ELSE len(list_intersect({s_tokens(q)}, {s_tokens(c)})) / len({s_tokens(q)}) END)"
FLAGGED = META + rf""",
qf AS (SELECT {s_norm('query')} AS k, count(*) AS n FROM meta GROUP BY 1), uf AS (SELECT {s_norm('unrelated_query')} AS k, count(*) AS n FROM meta GROUP BY 1),
m AS (SELECT meta.* EXCLUDE (query, unrelated_query, captions), {STRIP.format('query')} AS q, {STRIP.format('unrelated_query')} AS u, {s_norm('query')} AS nq, {s_norm('unrelated_query')} AS nu,
  list_filter(list_transform(captions, lambda c: {STRIP.format('c')}), lambda c: c <> '') AS cap, captions, query FROM meta),
e AS (SELECT id, unnest(cap) AS c, generate_subscripts(cap, 1) AS i FROM m),
nd AS (SELECT DISTINCT a.id FROM e a JOIN e b ON a.id = b.id AND a.i < b.i WHERE {s_near('a.c', 'b.c')}),
fl AS (SELECT m.*, list_concat(list_filter([
  CASE WHEN domain NOT IN ('general', 'satellite') THEN 'bad_domain' END, CASE WHEN {STRIP.format('source')} = '' THEN 'empty_field' END,
  CASE WHEN q = '' THEN 'empty_field' END, CASE WHEN u = '' THEN 'empty_field' END, CASE WHEN len(cap) < 2 THEN 'empty_field' END,
  CASE WHEN nd.id IS NOT NULL OR len(cap) = 1 THEN 'captions_not_diverse' END, CASE WHEN q <> '' AND length(q) < 8 THEN 'query_too_short' END, CASE WHEN length(q) > 120 THEN 'query_too_long' END,
  CASE WHEN regexp_matches(q, '(?i){T.BOILERPLATE}') THEN 'query_boilerplate' END,
  CASE WHEN q <> '' THEN list_filter(list_transform(cap, lambda c: CASE WHEN {s_norm('c')} = nq THEN 'query_eq_caption' WHEN {OVER('q', 'c')} >= 0.85 THEN 'query_near_caption' END), lambda x: x IS NOT NULL)[1] END,
  CASE WHEN u = '' THEN NULL WHEN nu = '{T.OFFLINE_UNRELATED}' THEN 'offline_unrelated' WHEN nu = '' OR regexp_matches(nu, '(?i){"|".join(T.GENERIC_UNRELATED)}') THEN 'generic_unrelated' END,
  CASE WHEN nq <> '' AND nq = nu THEN 'unrelated_eq_query' END, CASE WHEN nu <> '' AND list_contains(list_transform(cap, lambda c: {s_norm('c')}), nu) THEN 'unrelated_eq_caption' END,
  CASE WHEN domain = 'general' AND regexp_matches(q, '(?i){T.AERIALISH}') THEN 'domain_style_mismatch' END,
  CASE WHEN nq <> '' AND qf.n >= 15 THEN 'duplicate_query_frequent' END, CASE WHEN nu <> '' AND uf.n >= 100 THEN 'duplicate_unrelated_frequent' END], lambda x: x IS NOT NULL),
  list_transform(list_filter(cap, lambda c: length(c) < 12), lambda c: 'caption_too_short')) AS flags
  FROM m LEFT JOIN nd ON nd.id = m.id LEFT JOIN qf ON qf.k = nq LEFT JOIN uf ON uf.k = nu),
f AS (SELECT *, list_sort(list_distinct(flags)) AS codes, CAST(coalesce(list_max(list_transform(flags, lambda c: {SEVERITIES}[c])), 0) AS INTEGER) AS max_severity FROM fl)"""


def flagged(spark, sf_dir):
    """Rows with flags. Fan-outs of them explode outer: a plain explode has a filter of
    its own pushed down, which computes the flags twice."""
    return quality.flags(meta(spark, sf_dir))


@query(FLAGGED + " SELECT id, array_to_string(codes, ',') AS codes, CAST(len(flags) AS BIGINT) AS n_flags, max_severity FROM f")
def flag_rows(spark, sf_dir):
    """Flags of every row."""
    return flagged(spark, sf_dir).select("id", F.array_join("codes", ",").alias("codes"), F.size("flags").cast("long").alias("n_flags"), "max_severity")


@query(FLAGGED + ", x AS (SELECT unnest(flags) AS code FROM f) SELECT code, count(*) AS n FROM x GROUP BY code")
def flag_counts(spark, sf_dir):
    """Flag instances by code."""
    return flagged(spark, sf_dir).select(F.explode_outer("flags.code").alias("code")).filter("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))


@query(FLAGGED + ", x AS (SELECT id, unnest(codes) AS code FROM f) SELECT code, count(*) AS n, min(id) AS first_id FROM x GROUP BY code")
def flags_by_code(spark, sf_dir):
    """The fan-out by code: rows of each code's file."""
    return flagged(spark, sf_dir).select("id", F.explode_outer("codes").alias("code")).filter("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(FLAGGED + " SELECT id, max_severity FROM f ORDER BY max_severity DESC, id LIMIT 100")
def worst_rows(spark, sf_dir):
    """The hundred rows to repair first."""
    return flagged(spark, sf_dir).select("id", "max_severity").orderBy(F.desc("max_severity"), "id").limit(100)


def s_any(codes):
    return "list_has_any(codes, [" + ", ".join(f"'{c}'" for c in codes) + "])"


@query(FLAGGED + """ SELECT count(*) AS n, count(*) FILTER (len(codes) > 0) AS flagged, round(100.0 * count(*) FILTER (len(codes) > 0) / count(*), 2) AS pct,
  count(*) FILTER (list_has_any(codes, ['query_eq_caption', 'query_near_caption', 'query_too_short', 'query_boilerplate', 'duplicate_query_frequent', 'empty_field'])) AS repair_query,
  count(*) FILTER (list_has_any(codes, ['offline_unrelated', 'generic_unrelated', 'unrelated_eq_query', 'unrelated_eq_caption', 'duplicate_unrelated_frequent', 'empty_field'])) AS repair_unrelated,
  count(*) FILTER (list_has_any(codes, ['captions_not_diverse', 'caption_too_short', 'empty_field'])) AS repair_captions,
  round(1.0 - count(DISTINCT nullif(nq, '')) / count(*), 4) AS query_collisions, round(1.0 - count(DISTINCT nullif(nu, '')) / count(*), 4) AS unrelated_collisions FROM f""")
def audit_summary(spark, sf_dir):
    """Counts, repair estimates and collision rates of the audit."""
    f = flagged(spark, sf_dir)
    n = F.count("*")
    unique = lambda c: F.round(1 - F.count_distinct(F.nullif(T.norm_quality(F.col(c)), F.lit(""))) / n, 4)
    some = F.count_if(F.size("codes") > 0)
    return f.agg(n.alias("n"), some.alias("flagged"), F.round(F.try_divide(some * 100.0, n), 2).alias("pct"), *[F.count_if(quality.needs(F.col("codes"), c)).alias(f"repair_{k}") for k, c in quality.ESTIMATES.items()],
        unique("query").alias("query_collisions"), unique("unrelated_query").alias("unrelated_collisions"))


@query(META + f" SELECT {s_norm('query')} AS norm, count(*) AS n FROM meta GROUP BY 1 HAVING {s_norm('query')} <> ''")
def query_frequency(spark, sf_dir):
    """Corpus frequency of queries."""
    return quality.frequencies(meta(spark, sf_dir), "query")


@query(META + f" SELECT {s_norm('unrelated_query')} AS norm, count(*) AS n, min(id) AS first_id FROM meta WHERE {s_norm('unrelated_query')} <> '' GROUP BY 1 ORDER BY n DESC, first_id LIMIT 15")
def top_values(spark, sf_dir):
    """The fifteen most common unrelated queries, ties by first appearance."""
    rows = meta(spark, sf_dir).select("id", T.norm_quality(F.col("unrelated_query")).alias("norm")).filter("norm <> ''")
    return rows.groupBy("norm").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(15)


@query(FLAGGED + f""" SELECT id, array_to_string(list_filter([CASE WHEN {s_any(quality.QUERY_CODES)} THEN 'query' END, CASE WHEN {s_any(quality.UNRELATED_CODES)} THEN 'unrelated_query' END,
  CASE WHEN {s_any(quality.CAPTION_CODES)} THEN 'captions' END], lambda x: x IS NOT NULL), ',') AS fields FROM f""")
def repair_fields(spark, sf_dir):
    """Fields that each row's codes ask to repair."""
    return flagged(spark, sf_dir).select("id", F.array_join(quality.fields_to_repair(F.col("codes")), ",").alias("fields"))


@query()
def repair_queries(spark, sf_dir):
    """Local query repair and what stays for the external queue."""
    return quality.repair_query(flagged(spark, sf_dir)).select("id", "how", "new_query")


STOP = "[" + ", ".join(f"'{w}'" for w in T.SEARCH_STOPWORDS) + "]"
BARE = lambda x: f"rtrim({STRIP.format(f"regexp_replace({STRIP.format(x)}, '(?i){T.BOILERPLATE}', '')")}, '.')"
AERIAL = f"regexp_matches(plain, '(?i){T.AERIALISH}')"


@query(FLAGGED + f""", t AS (SELECT id, domain, list_filter(captions, lambda c: {STRIP.format('c')} <> '') AS texts FROM f),
o AS (SELECT id, domain, unnest(list_concat(list_reverse(texts), texts[1:1])) AS c, unnest(range(0, len(texts) + 1)) AS i FROM t WHERE len(texts) > 0),
p AS (SELECT id, domain, i, unnest(regexp_extract_all(lower(c), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(c), '[a-z0-9]+'), 1) AS pos FROM o),
d AS (SELECT id, domain, i, w, row_number() OVER (PARTITION BY id, i ORDER BY min(pos)) AS r FROM p WHERE length(w) > 2 AND NOT list_contains({STOP}, w) GROUP BY id, domain, i, w),
c AS (SELECT id, i, any_value(domain) AS domain, string_agg(w, ' ' ORDER BY r) FILTER (r <= 8) AS plain, bool_or(w = 'aerial') AS says FROM d GROUP BY id, i),
x AS (SELECT id, i, CASE WHEN domain = 'satellite' AND NOT {AERIAL} AND NOT says THEN 'aerial ' || plain ELSE plain END AS q FROM c),
y AS (SELECT x.id, i, q, list_max(list_transform(texts, lambda c: {OVER('q', 'c')})) AS o FROM x JOIN t ON t.id = x.id),
k AS (SELECT id, coalesce(arg_min(q, i) FILTER (o < 0.75), arg_min(q, (o, i)) FILTER (o < 1.0)) AS q FROM y GROUP BY id),
z AS (SELECT f.id, f.query, codes, q AS own, CASE WHEN q = '' OR list_contains(codes, 'query_boilerplate') THEN {BARE('q')} ELSE q END AS bare, texts,
  CASE WHEN len(texts) = 0 THEN '{T.NO_TEXT}' ELSE coalesce((SELECT k.q FROM k WHERE k.id = f.id), '{T.NO_QUERY}') END AS words FROM f JOIN t ON t.id = f.id),
n AS (SELECT *, CASE WHEN {s_any(quality.NEW_QUERY)} OR bare = '' THEN
    CASE WHEN length(words) >= 8 AND len(list_filter(texts, lambda c: {OVER('words', 'c')} >= 0.85)) = 0 AND {s_norm('words')} <> {s_norm('bare')} THEN words END
  WHEN {BARE('bare')} <> bare THEN {BARE('bare')} END AS made FROM z),
h AS (SELECT *, CASE WHEN NOT ({s_any([c for c in quality.QUERY_CODES if c != 'empty_field'])} OR own = '') THEN 'kept'
  WHEN (list_contains(codes, 'duplicate_query_frequent') AND NOT {s_any(quality.MENDED_HERE)}) OR made IS NULL THEN 'external' ELSE 'local' END AS how FROM n)
SELECT id, how, CASE how WHEN 'local' THEN made WHEN 'kept' THEN query END AS new_query FROM h""")
def caption_query_repairs(spark, sf_dir):
    """Queries repaired from one caption's words, and what is left to a service."""
    return quality.repair_query_by_caption(flagged(spark, sf_dir)).select("id", "how", "new_query")


@query(META + f""", need AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM meta WHERE id % 7 = 0),
bank AS (SELECT phrase, row_number() OVER (ORDER BY phrase) AS r FROM (SELECT DISTINCT {s_norm('text')} AS phrase FROM benchmark WHERE length({s_norm('text')}) >= 12)) SELECT id, phrase FROM need LEFT JOIN bank USING (r)""")
def assigned_phrases(spark, sf_dir):
    """Bank phrases handed out one to a row that has the offline sentinel; rows beyond
    the bank have none."""
    rows = meta(spark, sf_dir).filter(T.norm_quality(F.col("unrelated_query")) == T.OFFLINE_UNRELATED)
    bank = read(spark, sf_dir, "benchmark").select(T.norm_quality(F.col("text")).alias("phrase")).filter(F.length("phrase") >= 12).distinct()
    return quality.assign_unrelated(rows, bank)


@query()
def repaired_unrelated(spark, sf_dir):
    """Unrelated queries of all rows after the local repair by a bank large enough."""
    return quality.repair_unrelated(flagged(spark, sf_dir))


# ---- splits, samples, statistics

IDS = "WITH r AS (SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'general' WHEN 'fr' THEN 'satellite' ELSE lang END AS domain, source, text FROM documents)"


def records(spark, sf_dir):
    domain = F.when(F.col("lang") == "en", "general").when(F.col("lang") == "fr", "satellite").otherwise(F.col("lang"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), domain.alias("domain"), "source", "text")


SPLIT = IDS + """, s AS (SELECT id, domain, CASE WHEN row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || domain || ':' || id), id) <= count(*) OVER (PARTITION BY domain) // 16 THEN 'test' ELSE 'train' END AS split FROM r)"""


@query(SPLIT + " SELECT id, domain, split FROM s")
def official_split(spark, sf_dir):
    """Stratified split by hash order."""
    return sampling.official_split(records(spark, sf_dir).select("id", "domain"))


@query(SPLIT + " SELECT domain, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM s GROUP BY domain")
def split_pivot(spark, sf_dir):
    """Split sizes by domain."""
    return sampling.official_split(records(spark, sf_dir).select("id", "domain")).groupBy("domain").pivot("split", ["train", "test"]).count().na.fill(0)


@query(IDS + """, k AS (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || id), id) AS n FROM r) SELECT id, domain FROM k WHERE (domain = 'satellite' AND n <= 40) OR (domain = 'general' AND n <= 60)""")
def balanced_subset(spark, sf_dir):
    """A domain-balanced sample of 100."""
    return sampling.balanced(records(spark, sf_dir).select("id", "domain"), 100, 0.4)


@query(IDS + " SELECT id FROM r ORDER BY md5('42:' || id), id LIMIT 64")
def hash_reservoir(spark, sf_dir):
    """A uniform sample of 64 by hash order."""
    return sampling.reservoir(records(spark, sf_dir).select("id"), 64)


@query(IDS + """, n AS (SELECT 2 * least(count(*) FILTER (domain = 'satellite'), count(*) FILTER (domain = 'general')) AS t FROM r),
k AS (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || id), id) AS i FROM r WHERE domain IN ('satellite', 'general'))
SELECT id, domain FROM k, n WHERE i <= CASE domain WHEN 'satellite' THEN CAST(t // 2 AS BIGINT) ELSE t - CAST(t // 2 AS BIGINT) END""")
def mixed_sources(spark, sf_dir):
    """Two sources interleaved half and half."""
    r = records(spark, sf_dir).select("id", "domain")
    return sampling.mixed(r.filter("domain = 'satellite'"), r.filter("domain = 'general'"), 0.5)


@query(IDS + """, w AS (SELECT id, ('0x' || left(md5('42:' || id), 6))::BIGINT / 16777216.0 * 4.0 AS r FROM r) SELECT id, CASE WHEN r <= 1.0 THEN 'a' WHEN r <= 2.5 THEN 'b' ELSE 'c' END AS pick FROM w""")
def weighted_source_pick(spark, sf_dir):
    """A source for each row by weight."""
    return records(spark, sf_dir).select("id", sampling.weighted_pick(F.col("id"), {"a": 1.0, "b": 1.5, "c": 1.5}).alias("pick"))


@query("SELECT doc_id FROM documents WHERE n_chars > 0 ORDER BY -ln((('0x' || left(md5('42:' || doc_id), 13))::BIGINT + 0.5) / 4503599627370496.0) / n_chars, doc_id LIMIT 64")
def weighted_reservoir(spark, sf_dir):
    """A sample of 64 documents by length, as three batches of a stream bring them."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    sample = reservoir.Reservoir(spark, scratch.folder(spark, "sample"), "doc_id", "doc_id long, n_chars long", 64, "n_chars")
    for i in range(3):
        sample.add(rows.filter(F.col("doc_id") % 3 == i), "batches", i)
    return sample.sample().select("doc_id")


@query("SELECT conv_id, min(turn) AS first_turn, CAST(len(list_distinct(list(text))) AS BIGINT) AS n_captions FROM conversations WHERE trim(text) <> '' GROUP BY conv_id HAVING len(list_distinct(list(text))) >= 2")
def caption_groups(spark, sf_dir):
    """Groups of at least two distinct captions."""
    c = read(spark, sf_dir, "conversations").filter(F.trim("text") != "")
    return c.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count_distinct("text").alias("n_captions")).filter("n_captions >= 2")


@query("""WITH l AS (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM documents)
SELECT source, count(*) AS n, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(avg(n), 1) AS mean, CAST(max(n) FILTER (i = c // 10) AS BIGINT) AS p10, CAST(max(n) FILTER (i = 9 * c // 10) AS BIGINT) AS p90 FROM l GROUP BY source""")
def length_stats(spark, sf_dir):
    """Length figures by source, percentiles by index, from counts of lengths so
    that a large source is no task's sort."""
    n = read(spark, sf_dir, "documents").select("source", F.length("text").cast("long").alias("n")).groupBy("source", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source").orderBy("n")
    at = n.withColumns({"hi": F.sum("c").over(w), "all": F.sum("c").over(Window.partitionBy("source"))}).withColumn("lo", F.col("hi") - F.col("c"))
    pick = lambda i: F.max(F.when((F.col("lo") <= F.expr(i)) & (F.expr(i) < F.col("hi")), F.col("n")))
    return at.groupBy("source").agg(F.sum("c").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 1).alias("mean"), pick("all div 10").alias("p10"), pick("9 * all div 10").alias("p90"))


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def source_shares(spark, sf_dir):
    """Rows and share of each source."""
    d = read(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query(SPLIT + """ SELECT domain, split, count(*) AS n, min(id) AS first_id, max(id) AS last_id, CAST(sum(id) AS BIGINT) AS id_sum FROM s GROUP BY domain, split""")
def split_manifest(spark, sf_dir):
    """What a manifest of the official split says of each part."""
    split = sampling.official_split(records(spark, sf_dir).select("id", "domain"))
    return split.groupBy("domain", "split").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("id").alias("id_sum"))


# ---- pairs, resume, batches


@query("""WITH r AS (SELECT user_id, event_id % 4 AS part, arg_max(event_type, event_id) AS event_type, CASE WHEN max(event_id) % 3 = 0 THEN arg_max(value, event_id) END AS value FROM events GROUP BY ALL)
SELECT user_id, arg_max(event_type, part) AS event_type, round(arg_max(value, part) FILTER (value IS NOT NULL), 6) AS value FROM r GROUP BY user_id""")
def stored_progress(spark, sf_dir):
    """Four parts of users' last events through the progress store, one compaction between."""
    store = ProgressStore(spark, scratch.folder(spark, "progress"), "user_id", "user_id long, event_type string, value double")
    events = read(spark, sf_dir, "events")
    for part in range(4):
        last = events.filter(F.col("event_id") % 4 == part).groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("e"), F.max("event_id").alias("i"))
        store.append(last.select("user_id", "e.event_type", F.when(F.col("i") % 3 == 0, F.col("e.value")).alias("value")), "parts", part)
        if part == 2:
            store.compact()
    return store.snapshot().withColumn("value", F.round("value", 6))


@query(TURNS + f", q AS (SELECT conv_id, turn, {s_train('a')} AS anchor, {s_train('b')} AS positive FROM p WHERE b IS NOT NULL) SELECT conv_id, turn, anchor, positive FROM q WHERE anchor <> '' AND positive <> '' AND anchor <> positive")
def consecutive_pairs(spark, sf_dir):
    """Text pairs of consecutive turns."""
    t = turns(spark, sf_dir).select("conv_id", "turn", T.norm_train(F.col("a")).alias("anchor"), T.norm_train(F.col("b")).alias("positive"))
    return t.filter("anchor <> '' AND positive <> '' AND anchor <> positive")


@query(f"""WITH p AS (SELECT text AS a, lead(text) OVER w AS b, lead(text, 2) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
q AS (SELECT {s_train('a')} AS anchor, {s_train('b')} AS positive, nullif({s_train('c')}, '') AS n FROM p)
SELECT anchor, positive, CASE WHEN n <> anchor AND n <> positive THEN n END AS negative FROM q WHERE anchor <> '' AND positive <> '' AND anchor <> positive""")
def text_pairs(spark, sf_dir):
    """Pairs of consecutive turns with the turn after them as the negative."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    said = read(spark, sf_dir, "conversations")
    return pairs.text_pairs(said.select(F.col("text").alias("anchor"), F.lead("text").over(w).alias("positive"), F.lead("text", 2).over(w).alias("negative")))


@query(META + f""", l AS (SELECT id, list_filter(list_concat(list_transform(captions, lambda c: {s_train('c')}), [{s_train('query')}]), lambda x: x <> '') AS t FROM meta),
u AS (SELECT id, unnest(t) AS v, generate_subscripts(t, 1) AS i FROM l), d AS (SELECT id, v, min(i) AS i FROM u GROUP BY id, v), k AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY i) AS pos FROM d)
SELECT id, CAST(pos - 1 AS BIGINT) AS pos, md5(v) AS text FROM k WHERE pos <= 4""")
def positives_flat(spark, sf_dir):
    """At most four distinct positives a row, flattened."""
    return meta(spark, sf_dir).select("id", F.posexplode(pairs.positives(F.col("captions"), F.col("query"))).alias("pos", "v")).select("id", F.col("pos").cast("long").alias("pos"), F.md5("v").alias("text"))


@query(TURNS + ", q AS (SELECT conv_id // 8 AS batch, conv_id, turn, a, b FROM p), g AS (SELECT batch, bool_and(b IS NOT NULL) AS f FROM q GROUP BY batch) SELECT batch, count(*) AS n, count(*) FILTER (f AND b IS NOT NULL) AS negatives FROM q JOIN g USING (batch) GROUP BY batch")
def batch_negative_gate(spark, sf_dir):
    """Negatives stay only where a whole batch has them."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = read(spark, sf_dir, "conversations").select(F.expr("conv_id div 8").alias("batch"), F.lead("text").over(w).alias("negative"))
    return pairs.batch_gate(rows).groupBy("batch").agg(F.count("*").alias("n"), F.count("negative").alias("negatives"))


@query(META + f" SELECT id, CASE WHEN {STRIP.format('query')} = '' THEN coalesce(captions[2], captions[1]) ELSE query END AS query FROM meta")
def offline_fill(spark, sf_dir):
    """Blank queries filled from the captions."""
    c = F.col("captions")
    fill = F.coalesce(F.get(c, F.lit(1)), F.get(c, F.lit(0)))
    return meta(spark, sf_dir).select("id", F.when(F.coalesce(T.strip(F.col("query")), F.lit("")) == "", fill).otherwise(F.col("query")).alias("query"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_ids(spark, sf_dir):
    """Documents that no label covers."""
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def overlay_progress(spark, sf_dir):
    """Cached values over the rows' own."""
    done = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("lang"))
    return quality.overlay(read(spark, sf_dir, "documents").select("doc_id", "lang"), done, "doc_id", "lang")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_entries(spark, sf_dir):
    """The last write of each key."""
    return quality.latest(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("WITH o AS (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 8 AS batch FROM benchmark) SELECT batch, count(*) AS n, min(item_id) AS first_id FROM o GROUP BY batch")
def batch_chunks(spark, sf_dir):
    """Rows in batches of eight."""
    r = quality.ranked(read(spark, sf_dir, "benchmark").select("item_id"), "item_id").withColumn("batch", F.expr("(rank - 1) div 8"))
    return r.groupBy("batch").agg(F.count("*").alias("n"), F.min("item_id").alias("first_id"))


def s_blank(x):
    return f"({STRIP.format(x)} = '')"


@query(META + f"""SELECT id, CASE WHEN domain NOT IN ('general', 'satellite') THEN 'domain' WHEN len(captions) < 2 THEN 'captions' WHEN {s_blank("source")} THEN 'source'
  WHEN {s_blank("query")} THEN 'query' WHEN {s_blank("unrelated_query")} THEN 'unrelated_query' END AS reason FROM meta""")
def record_reasons(spark, sf_dir):
    """Validity of each record, or the rule that it breaks."""
    return quality.reasons(meta(spark, sf_dir)).select("id", "reason")


@query(META + f"""SELECT count(*) AS n, count(*) FILTER ({s_blank("query")}) AS empty_query, count(*) FILTER ({s_blank("unrelated_query")}) AS empty_unrelated,
  count(*) >= 2 AND count(*) FILTER ({s_blank("query")} OR {s_blank("unrelated_query")}) = 0 AS publishable FROM meta""")
def export_check(spark, sf_dir):
    """Whether the table can be published."""
    return quality.export_check(meta(spark, sf_dir))


CACHE = "SELECT text AS caption, 'cached ' || min(conv_id) AS related_query FROM conversations WHERE turn % 2 = 1 AND text IS NOT NULL GROUP BY text"


@query(META + f""", cache AS ({CACHE}), a AS (SELECT id, unnest(captions) AS caption, unnest(range(0, len(captions))) AS place FROM meta WHERE {s_blank("query")}),
h AS (SELECT a.id, arg_min(related_query, place) AS found, min(place) AS place FROM a JOIN cache USING (caption) GROUP BY a.id)
SELECT meta.id, CASE WHEN {s_blank("query")} THEN found ELSE query END AS query, CASE WHEN NOT {s_blank("query")} THEN 'own' WHEN place = 0 THEN 'first' WHEN place > 0 THEN 'other' ELSE 'missing' END AS origin
FROM meta LEFT JOIN h ON h.id = meta.id""")
def fill_from_cache(spark, sf_dir):
    """Blank queries from the cache, by the first caption or another."""
    turns = read(spark, sf_dir, "conversations").filter("turn % 2 = 1 AND text IS NOT NULL")
    cache = turns.groupBy(F.col("text").alias("caption")).agg(F.concat(F.lit("cached "), F.min("conv_id").cast("string")).alias("related_query"))
    return quality.fill_from_cache(meta(spark, sf_dir), cache).select("id", "query", "origin")


# ---- vectors

TOK = """WITH d AS (SELECT vec_id // 8 AS d, vec_id % 8 AS t, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id // 200 AS q, vec_id AS t, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
ts AS (SELECT q, q.t AS qt, d, max(list_dot_product(q.v, d.v)) AS s FROM q, d GROUP BY q, q.t, d), sc AS (SELECT q, d, avg(s) AS score FROM ts GROUP BY q, d), pos AS (SELECT DISTINCT q, q * 25 AS d FROM q)"""


def tokens(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return (e.filter(F.col("vec_id") % 50 == 0).select(F.expr("vec_id div 200").alias("id"), F.col("vec_id").alias("tok"), F.col("embedding").alias("vec")),
            e.select(F.expr("vec_id div 8").alias("id"), (F.col("vec_id") % 8).alias("tok"), F.col("embedding").alias("vec")))


def scores(spark, sf_dir):
    q, d = tokens(spark, sf_dir)
    return vectors.maxsim(q, d), q.select(F.col("id").alias("q"), (F.col("id") * 25).alias("d")).distinct()


@query(TOK + ", r AS (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM sc) SELECT q, d, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def maxsim_topk(spark, sf_dir):
    """Ten best documents of each query by mean MaxSim."""
    return vectors.maxsim_top_k(*tokens(spark, sf_dir), 10).select("q", "d", "rank", F.round("score", 6).alias("score"))


@query("WITH p AS (SELECT vec_id, unnest([8, 16, 32]) AS dim, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, dim, round(v[1] / greatest(sqrt(list_dot_product(v[1:dim], v[1:dim])), 1e-12), 6) AS first FROM p")
def prefix_normalize(spark, sf_dir):
    """Normalised Matryoshka prefixes, by their first coordinate."""
    e = read(spark, sf_dir, "embeddings")
    each = [e.select("vec_id", F.lit(n).alias("dim"), F.round(F.get(vectors.prefix_normalize(F.col("embedding"), n), F.lit(0)), 6).alias("first")) for n in (8, 16, 32)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(TOK + ", k AS (SELECT q, d, s, row_number() OVER (PARTITION BY q, d ORDER BY s DESC, qt) AS r FROM ts) SELECT q, d, round(avg(s), 6) AS score FROM k WHERE r <= 2 GROUP BY q, d")
def topk_token_maxsim(spark, sf_dir):
    """Mean of the two best query tokens."""
    return vectors.best_tokens_maxsim(*tokens(spark, sf_dir), 2).withColumn("score", F.round("score", 6))


@query(TOK + ", a AS (SELECT q, d, max(s) AS mx, avg(s) AS mean FROM ts GROUP BY q, d) SELECT q, d, round(mx, 6) AS mx, round(mean, 6) AS mean FROM a")
def document_affinity(spark, sf_dir):
    """Best and mean affinity of documents over query tokens."""
    return vectors.affinity(*tokens(spark, sf_dir)).select("q", "d", F.round("mx", 6).alias("mx"), F.round("mean", 6).alias("mean"))


@query(TOK + ", m AS (SELECT q, d, s, max(s) OVER (PARTITION BY q, d) AS mx FROM ts) SELECT q, d, round(max(mx) + 0.1 * ln(sum(exp((s - mx) / 0.1))), 6) AS soft FROM m GROUP BY q, d")
def soft_maxsim(spark, sf_dir):
    """Soft maximum over query tokens."""
    return vectors.soft_maxsim(*tokens(spark, sf_dir), 0.1).withColumn("soft", F.round("soft", 6))


@query(TOK + ", w AS (SELECT q, d, score, max(score) OVER (PARTITION BY q) AS mx, min(score) OVER (PARTITION BY q) AS mn FROM sc) SELECT q, d, round(CASE WHEN mx - mn < 1e-4 THEN 0.0 ELSE exp((score - mx) / 0.06) END, 6) AS heat FROM w")
def heatmap_peak(spark, sf_dir):
    """Peak-normalised scores."""
    return vectors.heatmap_peak(scores(spark, sf_dir)[0], "q").select("q", "d", F.round("heat", 6).alias("heat"))


@query(TOK + """, e AS (SELECT q, quantile_cont(score, 0.05) AS p5, quantile_cont(score, 0.95) AS p95, min(score) AS mn, max(score) AS mx FROM sc GROUP BY q),
b AS (SELECT q, CASE WHEN p95 > p5 THEN p5 ELSE mn END AS lo, CASE WHEN p95 > p5 THEN p95 WHEN mx > mn THEN mx ELSE mn + 1e-6 END AS hi FROM e)
SELECT q, d, round(least(greatest((score - lo) / (hi - lo), 0.0), 1.0), 6) AS heat FROM sc JOIN b USING (q)""")
def heatmap_percentile(spark, sf_dir):
    """Scores stretched between the 5th and 95th percentile."""
    return vectors.heatmap_percentile(scores(spark, sf_dir)[0], "q").select("q", "d", F.round("heat", 6).alias("heat"))


@query("""WITH d AS (SELECT vec_id // 8 AS id, vec_id % 8 AS tok, (embedding::DOUBLE[])[1:16] AS v FROM embeddings),
r AS (SELECT id, tok, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY sqrt(list_dot_product(v, v)) DESC, tok) AS r FROM d)
SELECT id, tok FROM r WHERE r <= greatest(round_even(n * 0.75, 0), 1)""")
def top_tokens(spark, sf_dir):
    """Three quarters of each document's tokens, by the norm of a prefix."""
    docs = tokens(spark, sf_dir)[1].withColumn("vec", F.slice("vec", 1, 16))
    return vectors.keep_top_tokens(docs).select("id", "tok")


@query("""WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM x GROUP BY i),
y AS (SELECT vec_id, i, x - m AS y FROM x JOIN m USING (i)), n AS (SELECT vec_id, sqrt(sum(y * y)) AS n FROM y GROUP BY vec_id)
SELECT vec_id // 8 AS id, vec_id % 8 AS tok, round(y / greatest(n, 1e-12), 6) AS first FROM y JOIN n USING (vec_id) WHERE i = 0""")
def centred_tokens(spark, sf_dir):
    """Tokens less the mean of all, normalised, by their first coordinate."""
    return vectors.centred(tokens(spark, sf_dir)[1]).select("id", "tok", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@query(TOK + ", p AS (SELECT q, score AS pos FROM sc JOIN pos USING (q, d)), k AS (SELECT sc.q, sc.d, row_number() OVER (PARTITION BY sc.q ORDER BY score DESC, sc.d) AS rank FROM sc JOIN p USING (q) ANTI JOIN pos ON pos.q = sc.q AND pos.d = sc.d WHERE score < pos) SELECT q, d, rank::INT AS rank FROM k WHERE rank <= 5")
def hard_negatives(spark, sf_dir):
    """Five hardest negatives below the positive."""
    return vectors.hard_negatives(*scores(spark, sf_dir), 5).select("q", "d", "rank")


@query(TOK + ", p AS (SELECT q, score AS pos FROM sc JOIN pos USING (q, d)) SELECT q, count(*) FILTER (score > pos) + (count(*) FILTER (score = pos) + 1) / 2 AS rank FROM sc JOIN p USING (q) GROUP BY q")
def mid_rank(spark, sf_dir):
    """Mid-rank of the positive."""
    return vectors.mid_rank(*scores(spark, sf_dir))


@query(TOK + ", g AS (SELECT sc.q, max(score) FILTER (pos.d IS NOT NULL) - coalesce(sum(score) FILTER (pos.d IS NULL), 0) / greatest(count(*) FILTER (pos.d IS NULL), 1) AS gap FROM sc LEFT JOIN pos ON pos.q = sc.q AND pos.d = sc.d GROUP BY sc.q) SELECT q, round(gap, 6) AS gap, round(greatest(0, 1 - gap), 6) AS hinge FROM g")
def score_gap(spark, sf_dir):
    """Gap of positive and mean negative, and its hinge."""
    return vectors.score_gap(*scores(spark, sf_dir)).select("q", F.round("gap", 6).alias("gap"), F.round("hinge", 6).alias("hinge"))


@query(TOK + " SELECT sc.q, round(ln(sum(exp(score))) - ln(sum(exp(score)) FILTER (pos.d IS NOT NULL)), 6) AS loss FROM sc LEFT JOIN pos ON pos.q = sc.q AND pos.d = sc.d GROUP BY sc.q")
def contrastive_loss(spark, sf_dir):
    """Multi-positive cross entropy of each query."""
    return vectors.multi_positive_loss(*scores(spark, sf_dir)).select("q", F.round("loss", 6).alias("loss"))


@query(TOK + ", m AS (SELECT q, score, max(score) OVER (PARTITION BY q) AS mx FROM sc), e AS (SELECT q, exp((score - mx) / 0.07) AS e FROM m), p AS (SELECT q, e / sum(e) OVER (PARTITION BY q) AS p FROM e) SELECT q, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(greatest(count(*), 2)), 6) AS entropy FROM p GROUP BY q")
def sparsity_entropy(spark, sf_dir):
    """Normalised softmax entropy of each query's scores."""
    return vectors.sparsity_entropy(scores(spark, sf_dir)[0], "q").select("q", F.round("entropy", 6).alias("entropy"))


@query("WITH x AS (SELECT unnest(embedding::DOUBLE[]) AS v, unnest(range(0, 64)) AS i FROM embeddings) SELECT i::INT AS i, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM x GROUP BY i")
def embedding_geometry(spark, sf_dir):
    """Mean and deviation of each coordinate."""
    x = read(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    return x.groupBy("i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("v").cast("double")), 6).alias("sd"))


@query("WITH k AS (SELECT vec_id // 8 AS d, vec_id, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY md5('7:' || vec_id), vec_id) AS r, count(*) OVER (PARTITION BY vec_id // 8) AS n FROM embeddings) SELECT d, vec_id FROM k WHERE r <= greatest(1, round_even(n * 0.6, 0))")
def token_dropout(spark, sf_dir):
    """Six tenths of each document's tokens by hash order."""
    e = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("d"), "vec_id")
    w = Window.partitionBy("d").orderBy(sampling.hash_key(7, "vec_id"), "vec_id")
    n = F.count("*").over(Window.partitionBy("d"))
    return e.withColumns({"r": F.row_number().over(w), "n": n}).filter(F.col("r") <= F.greatest(F.lit(1), F.bround(F.col("n") * 0.6, 0))).select("d", "vec_id")


@query("""WITH RECURSIVE u AS (SELECT vec_id // 8 AS id, vec_id % 8 AS t, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS v FROM embeddings),
r AS (SELECT id, t, v AS s, 1 AS n, 0 AS g FROM u WHERE t = 0 UNION ALL
  SELECT id, t, CASE WHEN ok THEN list_transform(list_zip(s, v), lambda z: z[1] + z[2]) ELSE v END, CASE WHEN ok THEN n + 1 ELSE 1 END, CASE WHEN ok THEN g ELSE g + 1 END
  FROM (SELECT u.id, u.t, u.v, r.s, r.n, r.g, list_dot_product(r.s, u.v) / greatest(sqrt(list_dot_product(r.s, r.s)), 1e-12) >= 0.2 AS ok FROM r JOIN u ON u.id = r.id AND u.t = r.t + 1))
SELECT id, g::BIGINT AS tok, max(n)::BIGINT AS n FROM r GROUP BY id, g""")
def merged_tokens(spark, sf_dir):
    """Consecutive similar tokens merged."""
    return vectors.merge_consecutive(tokens(spark, sf_dir)[1], 0.2).select("id", "tok", "n")


LEX_Q = f"WITH q AS (SELECT item_id, {s_train('text')} AS t FROM benchmark WHERE item_id % 50 = 0)"


@query(LEX_Q + rf""", c AS (SELECT q.item_id, conv_id, turn, q.t, {s_train('text')} AS c FROM q, conversations WHERE q.t <> ''),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '')) AS b FROM c),
s AS (SELECT item_id, conv_id, turn, c, CASE WHEN contains(c, t) THEN 1 + least(length(t) / greatest(length(c), 1), 1) ELSE {s_jaccard('a', 'b')} END AS score FROM w),
k AS (SELECT item_id, conv_id, turn, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id, turn, c) AS rank FROM s WHERE score > 0) SELECT item_id, conv_id, turn, rank::INT AS rank, round(score, 6) AS score FROM k WHERE rank <= 5""")
def lexical_topk(spark, sf_dir):
    """Five best turns of each query item: substring first, else word overlap."""
    items = read(spark, sf_dir, "benchmark").filter(F.col("item_id") % 50 == 0)
    found = captions.caption_top_k(items, read(spark, sf_dir, "conversations"), 5, ["conv_id", "turn"])
    return found.withColumn("score", F.round("score", 6))


# ---- state in batch form, and event windows (an extra beyond the reference's own)


@query("SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS n, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)")
def fifo_bank(spark, sf_dir):
    """The last sixteen values before each event of a user."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return windows.over_last(e, "user_id", "event_id", 16, n=lambda w: F.count("*").over(w), mean=lambda w: F.round(F.avg("value").over(w), 6)).select("event_id", "n", "mean")


@query("WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT user_id, i // 8 AS win, count(*) AS n, round(avg(value), 6) AS mean FROM o GROUP BY ALL")
def accumulation_windows(spark, sf_dir):
    """Tumbling windows of eight events of a user."""
    o = windows.numbered(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id").withColumn("win", F.expr("i div 8"))
    return o.groupBy("user_id", "win").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
e AS (SELECT user_id, i, value AS m FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, 0.99 * e.m + 0.01 * o.value FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)
SELECT user_id, round(arg_max(m, i), 6) AS ema FROM e GROUP BY user_id""")
def ema_by_user(spark, sf_dir):
    """Exponential moving mean, initialised by the first value."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return quality.moving_mean(e, "user_id", "event_id", "value").select("user_id", F.round("mean", 6).alias("ema"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_events(spark, sf_dir):
    """Event-time tumbling windows of a day."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


# ---- star-schema smoke queries


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    """Scan, filter and aggregate."""
    x = read(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def orders_by_nation(spark, sf_dir):
    """Join and aggregate."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
