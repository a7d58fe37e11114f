"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but
the last return the columns of documents. Extra columns of docs are left out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import language, mixing, near, packing, substrings
from tessera.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of a language: below it no language is likely.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; lang becomes the predicted one. Texts without a letter and unlikely predictions go."""
    docs = docs.select(*COLUMNS)
    judged = language.identify(docs, docs.filter(~language.held_out()))
    kept = judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of every group of near-duplicates (five-word Jaccard of 0.8 or more), once. Rows without a doc_id stay.

    Different texts under one doc_id are rows of their own.
    """
    docs = docs.select(*COLUMNS)
    groups = near.near_groups(docs).filter("doc_id is not null").groupBy("component")
    least = groups.agg(F.min(F.struct("doc_id", "digest")).alias("row")).select("row.*")
    keyed = docs.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    first = Window.partitionBy("doc_id", "digest").orderBy("lang", "source", "n_chars", "text")
    one = keyed.join(least, ["doc_id", "digest"], "left_semi").withColumn("row_", F.row_number().over(first)).filter("row_ = 1")
    return one.select(*COLUMNS).unionByName(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows, the others joined by one space; a text that loses every word goes."""
    cut = substrings.dedup(docs.select(*COLUMNS)).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order; documents that it doesn't take go. Rows are mixed one by one, whatever their ids."""
    mixed = mixing.mix(docs.select(*COLUMNS), whole=True, carry=("text", "lang", "n_chars"))
    return mixed.withColumn("position_", F.explode("positions")).orderBy("position_", "doc_id").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the learned, hashed and packed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
