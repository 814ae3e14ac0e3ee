"""Queries of records, repair predicates and checks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality, ragged, records
from ..sources import ordinals
from .catalogue import FLAGGED, META, OVER, STRIP, flagged, meta, query, read, s_any, s_norm, s_train

CAPS = f"list_filter(list_transform(captions, lambda c: {s_train('c')}), lambda c: c <> '')"


@query(META + f""", n AS (SELECT *, {CAPS} AS caps FROM meta) SELECT id::VARCHAR AS id, md5(caps[1]) AS caption, len(caps)::INT AS n, CASE domain WHEN '' THEN 'general' ELSE domain END AS domain,
  coalesce(nullif(source, ''), 'curated') AS source, md5(coalesce(nullif({s_train('query')}, ''), caps[2], '')) AS related, md5({s_train('unrelated_query')}) AS unrelated FROM n WHERE len(caps) > 0""")
def training_records(spark, sf_dir):
    """Rows as training records, texts as digests."""
    good, _ = records.normalised(meta(spark, sf_dir))
    return good.select("id", F.md5("caption").alias("caption"), F.size("captions").alias("n"), "domain", "source", F.md5("related_query").alias("related"), F.md5("unrelated_query").alias("unrelated"))


@query(META + f""", n AS (SELECT *, {CAPS} AS caps FROM meta) SELECT id, md5(coalesce(nullif({s_train('query')}, ''), list_filter(caps, lambda c: c <> caps[1])[1], '')) AS related FROM n""")
def related_queries(spark, sf_dir):
    """The query, or another caption, as the text to search for."""
    rows = meta(spark, sf_dir)
    first = F.coalesce(F.get(F.filter(F.transform("captions", T.norm_train), lambda c: c != ""), F.lit(0)), F.lit(""))
    return rows.select("id", F.md5(records.related_query(F.col("query"), F.col("captions"), first)).alias("related"))


NOT_EMPTY = lambda codes: s_any([c for c in codes if c != "empty_field"])
GENERIC = f"(nu = '' OR nu = '{T.OFFLINE_UNRELATED}' OR regexp_matches(nu, '(?i){'|'.join(T.GENERIC_UNRELATED)}'))"


@query(FLAGGED + f""" SELECT id, {NOT_EMPTY(quality.QUERY_CODES)} OR q = '' AS need_query, {NOT_EMPTY(quality.UNRELATED_CODES)} OR {GENERIC} AS need_unrelated,
  length(q) < 8 OR len(list_filter(cap, lambda c: {s_norm('c')} = nq OR {OVER('q', 'c')} >= 0.85)) > 0 OR list_contains(codes, 'duplicate_query_frequent') AS still_bad FROM f""")
def repair_needs(spark, sf_dir):
    """What each row needs repaired, and whether its query would be rejected again.

    The results are not named ``query``: within a lambda such a name means the result
    beside it, not the input's column."""
    f = flagged(spark, sf_dir)
    bad = records.query_still_bad(F.col("query"), F.col("captions"), F.col("codes"), F.lit(False))
    return f.select("id", records.needs_query(F.col("codes"), F.col("query")).alias("need_query"), records.needs_unrelated(F.col("codes"), F.col("unrelated_query")).alias("need_unrelated"), bad.alias("still_bad"))


@query(META + f""" SELECT id, md5(array_to_string(list_sort(list_filter(list_distinct(list_transform(list_concat([query], captions), lambda c: {s_norm('c')})), lambda c: c <> '')), '|')) AS banned FROM meta""")
def blocklists(spark, sf_dir):
    """Texts that a row's unrelated query must not equal, as a digest."""
    return meta(spark, sf_dir).select("id", F.md5(F.array_join(records.blocklist(F.col("query"), F.col("captions")), "|")).alias("banned"))


@query(FLAGGED + " SELECT id, array_to_string(list_sort(list_filter(codes, lambda c: c IN ('query_too_short', 'query_eq_caption'))), ',') AS codes FROM f WHERE list_has_any(codes, ['query_too_short', 'query_eq_caption'])")
def selected_codes(spark, sf_dir):
    """Rows by the codes that a repair asks for."""
    f = flagged(spark, sf_dir)
    return records.with_codes(f.select("id"), f, ["query_too_short", "query_eq_caption"]).select("id", F.array_join(F.array_sort("codes"), ",").alias("codes"))


FILES = "files AS (SELECT 'images/' || CASE doc_id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'satellite' ELSE 'other' END || '/' || doc_id || '.jpg' AS path, length(text) AS length FROM documents WHERE doc_id % 4 <> 1)"


def files(spark, sf_dir):
    i = F.col("doc_id")
    domain = F.when(i % 3 == 0, "general").when(i % 3 == 1, "satellite").otherwise("other")
    return read(spark, sf_dir, "documents").filter(i % 4 != 1).select(F.concat(F.lit("images/"), domain, F.lit("/"), i.cast("string"), F.lit(".jpg")).alias("path"), F.length("text").cast("long").alias("length"))


SIDE = META + f", {FILES}, s AS (SELECT meta.*, 'images/' || domain || '/' || id || '.jpg' AS file_name FROM meta), c AS (SELECT s.*, files.length, CASE WHEN files.path IS NULL OR files.length IS NULL THEN 'missing' WHEN files.length < 1024 THEN 'tiny' ELSE 'ok' END AS state FROM s LEFT JOIN files ON path = file_name)"


@query(SIDE + """, x AS (SELECT concat_ws(':', state, file_name, length || 'B') AS w, file_name FROM c WHERE state <> 'ok' ORDER BY file_name LIMIT 10)
SELECT count(*) AS checked, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'tiny') AS tiny, (SELECT string_agg(w, ' ' ORDER BY file_name) FROM x) AS examples FROM c""")
def sidecar_report(spark, sf_dir):
    """Image files of the rows that are missing or tiny."""
    return records.sidecar_report(meta(spark, sf_dir), files(spark, sf_dir)).withColumn("examples", F.array_join("examples", " "))


@query(SIDE + " SELECT id, file_name, length FROM c WHERE state <> 'missing'")
def joined_images(spark, sf_dir):
    """Rows that have a file, with it."""
    rows, have = meta(spark, sf_dir), files(spark, sf_dir)
    listed = rows.join(have, records.file_name(rows) == F.col("path"), "left_semi")
    return records.joined_images(listed, have).select("id", "file_name", "length")


@query(f"SELECT CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) < 16 THEN 'tiny' ELSE 'ok' END AS status, concat_ws(',', CASE WHEN count(*) < 256 THEN 'few' END, CASE WHEN 20000.0 / count(*) > 50 AND count(*) < 1000 THEN 'repeated' END) AS warnings, round(20000.0 / count(*), 4)::DOUBLE AS passes FROM labels")
def cache_gate(spark, sf_dir):
    """Whether a cache with as many samples as there are labels may be trained on."""
    return read(spark, sf_dir, "labels").agg(F.count("*").alias("n")).select(records.cache_gate(F.col("n"), 2500, 1, 8).alias("g")).select("g.*")


@query(META + f""" SELECT count(*) AS n, count(DISTINCT domain) AS domains, count(DISTINCT source) AS sources, count(*) FILTER (len(captions) >= 2) AS several_captions, round(sum(len(captions))::DOUBLE / count(*), 2) AS mean_captions,
  round(avg(length(coalesce(query, ''))), 1) AS mean_query, count(DISTINCT nullif({s_norm('query')}, '')) AS unique_queries, count(DISTINCT nullif({s_norm('unrelated_query')}, '')) AS unique_unrelated,
  CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K' ELSE '100K<n<1M' END AS size FROM meta""")
def dataset_stats(spark, sf_dir):
    """Figures of a dataset's card."""
    return records.dataset_stats(meta(spark, sf_dir))


@query(r"""WITH p AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS piece, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]'), 1) AS i FROM benchmark)
SELECT item_id, (i - 1)::INT AS pos, piece FROM p""")
def token_pieces(spark, sf_dir):
    """Pieces of each item in order; each stands at its offset, which is checked here."""
    t = read(spark, sf_dir, "benchmark").select("item_id", "text", F.posexplode(records.pieces(F.col("text"))).alias("pos", "p"))
    return t.filter(F.substr("text", F.col("p.at") + 1, F.length("p.piece")) == F.col("p.piece")).select("item_id", "pos", "p.piece")


@query(r"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark)
SELECT item_id, array_to_string(list_concat(t[1:16], list_transform(range(0, greatest(16 - len(t), 0)), lambda x: '-')), ' ') AS padded, least(len(t), 16)::BIGINT AS held FROM t""")
def padded_tokens(spark, sf_dir):
    """Sixteen tokens of each item, cut or filled."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    x, mask = records.padded(words, 16, "-")
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(x, " ").alias("padded"), F.aggregate(mask, F.lit(0), lambda a, m: a + m).cast("long").alias("held"))


@query("SELECT event_id // 50 AS window_no, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def log_means(spark, sf_dir):
    """Means since the last log line, each of fifty steps."""
    return read(spark, sf_dir, "events").groupBy(F.expr("event_id div 50").alias("window_no")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH o AS (SELECT doc_id, length(text) AS n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS total FROM documents)
SELECT item_id AS place, ordinal, doc_id, n_chars FROM benchmark JOIN o ON ordinal = (item_id * 7919) % total""")
def rows_by_ordinal(spark, sf_dir):
    """Rows of the documents by their ordinals, a stated one for each item."""
    index = ordinals.row_groups(spark, f"{sf_dir}/documents.parquet")
    total = index.agg(F.sum("n").alias("total"))  # a row
    wanted = read(spark, sf_dir, "benchmark").crossJoin(F.broadcast(total)).select(F.col("item_id").alias("place"), ((F.col("item_id") * 7919) % F.col("total")).alias("ordinal"))
    return ordinals.rows_at(index, wanted, "doc_id long, text string").select("place", "ordinal", "doc_id", F.length("text").cast("long").alias("n_chars"))


LENGTHS = "l AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\\s]')) AS n FROM documents)"


@query(f"""WITH {LENGTHS}, r AS (SELECT doc_id, least(n, 512) AS n, row_number() OVER (ORDER BY least(n, 512), doc_id) - 1 AS i FROM l WHERE n > 0),
b AS (SELECT doc_id, n, i // 16 AS batch, i % 16 AS row FROM r), w AS (SELECT batch, max(n) AS width, count(*) AS rows, sum(n) AS held FROM b GROUP BY batch)
SELECT doc_id, batch, CAST(row AS BIGINT) AS row, CAST(n AS BIGINT) AS n, CAST(width AS BIGINT) AS width, CAST(sum(n) OVER (PARTITION BY batch ORDER BY row) - n AS BIGINT) AS start FROM b JOIN w USING (batch) WHERE rows = 16""")
def ragged_batches(spark, sf_dir):
    """Documents' pieces in full batches of sixteen of like length: the row, width and
    start of each in its batch."""
    t = F.coalesce("text", F.lit(""))
    n = F.regexp_count(t, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")).cast("long")
    sized = read(spark, sf_dir, "documents").select("doc_id", F.least(n, F.lit(512).cast("long")).alias("n"))
    return ragged.batches(sized, "doc_id", "n", 16, drop_last=True)


@query("""WITH c AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE trim(coalesce(text, '')) <> ''), f AS (SELECT conv_id, t, min(turn) AS turn FROM c GROUP BY conv_id, t)
SELECT conv_id, min(turn) AS first_turn, md5(string_agg(t, chr(10) ORDER BY turn, t)) AS captions, count(*) AS n FROM f GROUP BY conv_id HAVING count(*) >= 2""")
def caption_lists(spark, sf_dir):
    """Different captions of each group in the order in which they are first seen."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.coalesce("text", F.lit(""))).alias("t")).filter("t <> ''")
    first = c.groupBy("conv_id", "t").agg(F.min("turn").alias("turn"))
    lists = first.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("l"), F.count("*").alias("n")).filter("n >= 2")
    return lists.select("conv_id", "first_turn", F.md5(F.array_join("l.t", "\n")).alias("captions"), "n")


@query("""SELECT 1000 * conv_id + turn AS text_id, conv_id AS image_id, min(1000 * conv_id + turn) OVER (PARTITION BY conv_id) AS primary_text FROM conversations""")
def text_images(spark, sf_dir):
    """The image of each text, and that image's first text."""
    t = read(spark, sf_dir, "conversations").select((1000 * F.col("conv_id") + F.col("turn")).alias("text_id"), F.col("conv_id").alias("image_id"))
    return t.join(t.groupBy("image_id").agg(F.min("text_id").alias("primary_text")), "image_id").select("text_id", "image_id", "primary_text")


@query("SELECT doc_id, lang || '-' || lpad(doc_id::VARCHAR, 6, '0') AS id, replace(replace(source || '/' || lang || ':' || doc_id, '/', '__'), ':', '_') AS safe FROM documents")
def file_ids(spark, sf_dir):
    """Padded ids and names that are safe in paths."""
    number = F.col("doc_id").cast("string")
    return read(spark, sf_dir, "documents").select("doc_id", records.padded_id(F.col("lang"), F.col("doc_id")).alias("id"), records.safe_name(F.concat("source", F.lit("/"), "lang", F.lit(":"), number)).alias("safe"))
