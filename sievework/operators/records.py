"""Metadata rows as training records: fallbacks, repair predicates, checks against
files and caches, dataset figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.scratch import written
from .quality import QUERY_CODES, UNRELATED_CODES, needs

#: Bytes under which an image file counts as broken.
TINY = 1024
#: Names that a report lists at most.
EXAMPLES = 10


def _text(rows: DataFrame, *names: str) -> Column:
    """The first of the columns that exist and are not empty, else an empty text."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in rows.columns], F.lit(""))


def normalised(rows: DataFrame, domain: str = "general", source: str = "curated") -> tuple[DataFrame, DataFrame]:
    """Training records, and the rows that have no caption.

    Captions are normalised and empties go; a row without captions has its ``caption``.
    The related query is related_query, else query, else the second caption; the
    unrelated one is unrelated_query_text, else unrelated_query."""
    c = rows.columns
    listed = F.coalesce("captions", F.array().cast("array<string>")) if "captions" in c else F.array().cast("array<string>")
    raw = F.when(F.size(listed) > 0, listed).otherwise(F.array(_text(rows, "caption")))
    caps = F.filter(F.transform(raw, T.norm_train), lambda t: t != "")
    related = T.norm_train(_text(rows, "related_query", "query"))
    out = rows.withColumn("_caps", caps)
    good = out.filter(F.size("_caps") > 0).select(
        _text(rows, "id").alias("id"), F.get("_caps", F.lit(0)).alias("caption"), F.col("_caps").alias("captions"),
        F.coalesce(F.nullif(_text(rows, "domain"), F.lit("")), F.lit(domain)).alias("domain"), F.coalesce(F.nullif(_text(rows, "source"), F.lit("")), F.lit(source)).alias("source"),
        F.coalesce(F.nullif(related, F.lit("")), F.get("_caps", F.lit(1)), F.lit("")).alias("related_query"), T.norm_train(_text(rows, "unrelated_query_text", "unrelated_query")).alias("unrelated_query"),
    )
    return good, out.filter(F.size("_caps") == 0).drop("_caps")


def renamed(rows: DataFrame, image: str, caption: str) -> DataFrame:
    """(image, caption) with the caption normalised; one that is empty ends the job."""
    text = T.norm_train(F.col(caption))
    return rows.select(F.col(image).alias("image"), F.when(text != "", text).otherwise(F.raise_error(F.lit("a row without a caption")).cast("string")).alias("caption"))


def text_fields(rows: DataFrame) -> DataFrame:
    """The text columns of a row, without its file and split."""
    return rows.select(*[c for c in ("id", "domain", "source", "captions", "query", "unrelated_query") if c in rows.columns])


def needs_query(codes: Column, query: Column) -> Column:
    return needs(codes, [c for c in QUERY_CODES if c != "empty_field"]) | (T.strip(F.coalesce(query, F.lit(""))) == "")


def needs_unrelated(codes: Column, unrelated: Column) -> Column:
    return needs(codes, [c for c in UNRELATED_CODES if c != "empty_field"]) | T.is_generic(unrelated)


def blocklist(query: Column, captions: Column) -> Column:
    """Normal forms that a row's new unrelated query must not equal."""
    texts = F.concat(F.array(query), F.coalesce(captions, F.array().cast("array<string>")))
    return F.array_sort(F.filter(F.array_distinct(F.transform(texts, T.norm_quality)), lambda t: t != ""))


def query_still_bad(query: Column, captions: Column, codes: Column, rewritten: Column, overlap: float = 0.85) -> Column:
    """Whether a repaired query is short, equals or mostly repeats a caption, or had a
    frequent value that no outside service has rewritten."""
    q = T.strip(F.coalesce(query, F.lit("")))
    caps = F.filter(F.coalesce(captions, F.array().cast("array<string>")), lambda c: T.strip(c) != "")
    same = F.exists(caps, lambda c: (T.norm_quality(c) == T.norm_quality(q)) | (T.overlap_ratio(q, c) >= overlap))
    return (F.length(q) < 8) | same | (F.array_contains(codes, "duplicate_query_frequent") & ~rewritten)


def related_query(query: Column, captions: Column, caption: Column) -> Column:
    """The normalised query, else the first caption unlike ``caption``, else empty."""
    other = F.filter(F.transform(F.coalesce(captions, F.array().cast("array<string>")), T.norm_train), lambda t: (t != "") & (t != caption))
    return F.coalesce(F.nullif(T.norm_train(query), F.lit("")), F.get(other, F.lit(0)), F.lit(""))


def offline_captions(primary: Column, domain: Column) -> Column:
    """Three captions of unlike words where no service writes them (own wording)."""
    p = F.rtrim(T.strip(primary), F.lit("."))
    head = F.substring(p, 1, 80)
    seen = F.when(domain == "satellite", F.concat(F.lit("Land cover and built structures in a vertical view; chiefly "), head, F.lit("."))).otherwise(F.concat(F.lit("What the camera shows from eye level, in short: "), head, F.lit(".")))
    setting = F.when(domain == "satellite", "Remote imagery of a site with its roads, plots and roofs.").otherwise("An everyday scene with things near and far.")
    return F.array(F.concat(p, F.lit(".")), setting, seen)


def diversified(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds new_captions and how: cached, kept (already diverse), or offline.

    ``cache`` is (id, captions). Diverse captions are deduplicated in order; others
    get the offline ones, of which an outside service's take the place."""
    own = T.greedy_distinct(F.coalesce("captions", F.array().cast("array<string>")))
    first = F.coalesce(F.get("captions", F.lit(0)), F.lit(""))
    out = rows.join(cache.select("id", F.col("captions").alias("_cached")), "id", "left").withColumn("_own", own)
    how = F.when(F.col("_cached").isNotNull(), "cached").when(F.size("_own") >= 2, "kept").otherwise("offline")
    out = out.withColumn("how", how)
    return out.withColumn("new_captions", F.when(F.col("how") == "cached", F.col("_cached")).when(F.col("how") == "kept", F.col("_own")).otherwise(offline_captions(first, F.col("domain")))).drop("_cached", "_own")


def with_codes(rows: DataFrame, found: DataFrame, wanted: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Rows with the codes (id, codes) that a repair asks for; those without are left
    out. ``most`` keeps the first ids only, as a bound that the caller sets."""
    codes = F.col("codes") if wanted is None else F.array_intersect("codes", F.array(*map(F.lit, wanted)))
    # Written, as a filter would be pushed below what makes the codes and make them once for each of its parts.
    some = written(found.select("id", codes.alias("codes")), "codes").filter(F.size("codes") > 0)
    some = some.orderBy("id").limit(most) if most is not None else some
    return rows.drop("codes").join(some, "id")


def file_name(rows: DataFrame) -> Column:
    """A row's file: its file_name, else images/domain/id.jpg."""
    return F.coalesce(F.nullif(_text(rows, "file_name"), F.lit("")), F.concat(F.lit("images/"), F.col("domain"), F.lit("/"), F.col("id").cast("string"), F.lit(".jpg")))


def sidecars(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with file_name, length and state: ok, missing, or tiny. ``files`` is (path, length)."""
    named = rows.withColumn("_file", file_name(rows)).drop("file_name", "length").withColumnRenamed("_file", "file_name")
    out = named.join(files.select(F.col("path").alias("file_name"), "length"), "file_name", "left")
    return out.withColumn("state", F.when(F.col("length").isNull(), "missing").when(F.col("length") < TINY, "tiny").otherwise("ok"))


def sidecar_report(rows: DataFrame, files: DataFrame) -> DataFrame:
    """One row: checked, missing, tiny, examples (the first ``EXAMPLES`` by name)."""
    s = sidecars(rows, files)
    bad = s.filter("state <> 'ok'").select("file_name", F.concat_ws(":", "state", "file_name", F.concat(F.col("length").cast("string"), F.lit("B"))).alias("what")).orderBy("file_name", "what").limit(EXAMPLES)
    names = bad.agg(F.transform(F.array_sort(F.collect_list(F.struct("file_name", "what"))), lambda x: x["what"]).alias("examples"))
    counts = s.agg(F.count("*").alias("checked"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "tiny").alias("tiny"))
    return counts.crossJoin(F.broadcast(names))  # a row each


def joined_images(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with their files; one that is missing ends the job."""
    s = sidecars(rows, files)
    return s.withColumn("length", F.coalesce("length", F.raise_error(F.concat(F.lit("no file "), F.col("file_name"))).cast("long"))).drop("state")


def build_check(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Built rows that may be written, without internal columns, and the others with
    the reason: no file, captions too alike, or an empty query."""
    s = sidecars(rows, files)
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    alike = F.size(T.greedy_distinct(F.coalesce("captions", F.array().cast("array<string>")))) < 2
    why = F.when(F.col("state") == "missing", "file").when(alike, "captions").when(blank("query"), "query").when(blank("unrelated_query"), "unrelated_query")
    s = s.withColumn("reason", why).drop("state", "length", *[c for c in rows.columns if c.startswith("_")])
    return s.filter("reason IS NULL").drop("reason"), s.filter("reason IS NOT NULL")


def cache_gate(n: Column, steps: int | None, batch: int = 1, accumulation: int = 1, allow_tiny: bool = False) -> Column:
    """status and warnings of a cache of ``n`` samples: empty, tiny (under 16), or ok,
    with few (under 256) and repeated (over 50 passes of under 1000)."""
    passes = F.try_divide(F.lit(steps * max(batch, 1) * max(accumulation, 1) if steps and steps > 0 else None).cast("double"), n)
    status = F.when(n == 0, "empty").when((n < 16) & F.lit(not allow_tiny), "tiny").otherwise("ok")
    warned = F.array_compact(F.array(F.when(n < 256, "few"), F.when((passes > 50) & (n < 1000), "repeated")))
    return F.struct(status.alias("status"), F.array_join(warned, ",").alias("warnings"), F.round(passes, 4).alias("passes"))


#: What of a cache's manifest must be the same.
CACHE_KEYS = ("hf_dataset", "split", "seed", "image_size", "vision_phase")


def cache_mismatch(have: dict, want: dict) -> list[str]:
    """Keys in which a cache's manifest differs from the wanted one."""
    return [k for k in CACHE_KEYS if have.get(k) != want.get(k)]


def dataset_stats(rows: DataFrame) -> DataFrame:
    """One row of a dataset's figures, for its card."""
    caps = F.coalesce("captions", F.array().cast("array<string>"))
    n = F.count("*")
    unique = lambda c: F.count_distinct(F.nullif(T.norm_quality(F.col(c)), F.lit("")))
    size = F.when(n < 1000, "n<1K").when(n < 10_000, "1K<n<10K").when(n < 100_000, "10K<n<100K").otherwise("100K<n<1M")
    return rows.agg(
        n.alias("n"), F.count_distinct("domain").alias("domains"), F.count_distinct("source").alias("sources"), F.count_if(F.size(caps) >= 2).alias("several_captions"),
        F.round(F.try_divide(F.sum(F.size(caps)).cast("double"), n), 2).alias("mean_captions"), F.round(F.avg(F.length(F.coalesce("query", F.lit("")))), 1).alias("mean_query"),
        unique("query").alias("unique_queries"), unique("unrelated_query").alias("unique_unrelated"), size.alias("size"),
    )


def examples(rows: DataFrame, per_domain_of: int = 200, total: int = 4) -> DataFrame:
    """A report's examples: the first row of each domain among the first
    ``per_domain_of`` ids, then others of those by hash order, ``total`` in all."""
    head = rows.orderBy("id").limit(per_domain_of)
    w = Window.partitionBy("domain").orderBy("id")
    lead = head.withColumn("_first", F.row_number().over(w) == 1)
    return lead.orderBy(F.desc("_first"), F.when(F.col("_first"), F.col("id")), F.xxhash64("id"), "id").limit(total).drop("_first")


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """The path with the greatest number of those named step-<digits>; archives are out."""
    name = F.element_at(F.split(F.rtrim("path", F.lit("/")), "/"), -1)
    step = F.regexp_extract(name, r"^step-(\d+)$", 1)
    return files.withColumn("step", F.try_to_number(F.nullif(step, F.lit("")), F.lit("9" * 18)).cast("long")).filter(F.col("step").isNotNull() & ~F.lower("path").contains("archive")).orderBy(F.desc("step"), "path").limit(1)


def pieces(text: Column) -> Column:
    """Words and single marks of a text with their start (from 0): array of (at, piece)."""
    marks = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"), F.lit(0))
    gaps = F.split(text, r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,piece:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        return F.struct((at + F.length(pair["piece"])).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), pair["piece"].alias("piece")))).alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), marks.alias("piece")), lambda p: p["piece"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def padded(x: Column, n: int, fill: str = "") -> tuple[Column, Column]:
    """An array cut or filled to ``n`` entries, and the mask of those that are its own."""
    held = F.least(F.size(x), F.lit(n))
    return F.concat(F.slice(x, 1, n), F.array_repeat(F.lit(fill), n - held)), F.concat(F.array_repeat(F.lit(1), held), F.array_repeat(F.lit(0), n - held))


def padded_id(prefix: Column, number: Column, width: int = 6) -> Column:
    """prefix-000123; a longer number stays whole."""
    digits = number.cast("string")
    return F.concat_ws("-", prefix, F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def safe_name(x: Column) -> Column:
    """A name without the separators of paths."""
    return F.replace(F.replace(x, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))


def path_references(rows: DataFrame, column: str, files: DataFrame) -> DataFrame:
    """Rows whose ``column`` is a text that names none of ``files`` (path): a reference, not
    a file at hand."""
    return rows.filter(F.col(column).isNotNull()).join(files.select(F.col("path").alias(column)), column, "left_anti")


def folder_sizes(files: DataFrame) -> DataFrame:
    """(folder, files, bytes) of a listing (path, length), folders below counted in."""
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select("length", F.explode(above).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def staging_ready(files: DataFrame, least: int = TINY) -> DataFrame:
    """A listing (path, length, size as wanted or null) with whether a staged file is whole."""
    return files.withColumn("ready", F.coalesce((F.col("length") >= least) & (F.col("size").isNull() | (F.col("size") == F.col("length"))), F.lit(False)))
