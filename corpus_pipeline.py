"""The corpus pipeline: five stages, each over all that the one before kept.

Rows with null or equal ids are decided by their texts and by hashes of row and
text. Null, empty and wordless texts have no language and go with the first stage;
of repeated rows and ties the second keeps one; a very long text is read whole by
every stage; an empty table stays empty; other columns are carried, whatever their
names, up to the last stage. The first four stages return the columns of their
input; the last needs a written table, whose files and rows it goes by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontamination, language_id, mixing, simhash, token_files
from sievework.llm.shared import fresh, table

#: Documents whose language is undetermined, or less certain than this, go.
LEAST_SCORE = 0.4

ORACLE_SQL = None  # no stage but the mix's sizes can be said in SQL


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the classifier tells."""
    names = docs.columns
    lang, score = fresh(names, "judged_lang"), fresh(names, "judged_score")
    judged = language_id.language_id(docs, language_id.fit(docs), lang_out=lang, score_out=score)
    return judged.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their targets; documents may come twice."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and report them: doc_id, start, n_tokens, ids_crc32. The
    documents lie in the order of the mix: that of its files and their rows."""
    return token_files.token_files(docs, order=[F.col("_metadata.file_name"), F.col("_metadata.row_index")])


STAGES = [("language ID", languages), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing to target weights", mix), ("token files", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = table(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
