"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the docs of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, language, mixing, simhash, substrings
from ledgerlens.llm.common import shield, table, tuned, unshield
from ledgerlens.session import shared_folder

#: A document in some learned language comes nearer to its profile than this; less is no language.
MIN_LANGUAGE_SCORE = 0.05
#: A benchmark item of fewer words, such as an answer of one word, stands in many texts. It tells on a document by its
#: share of the words: at most this part of them is not from such items.
SHORT_ITEM_WORDS, MOST_BESIDE = 5, 0.2
ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _kept(docs: DataFrame, shielded: DataFrame, *names: str) -> DataFrame:
    return unshield(shielded, docs.columns, *names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter, or is far from all profiles. Learned from ``docs`` itself."""
    tuned(spark)
    rows = shield(docs, "doc_id", "text", "lang")
    rows = language.identify(rows, language.train(rows))
    kept = rows.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return _kept(docs, kept, "doc_id", "text", "lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group stays; of repeated rows one does."""
    tuned(spark)
    return _kept(docs, simhash.one_of_each(shield(docs, "doc_id", "text")), "doc_id", "text")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, and with them the white space behind; all else stays as written. Emptied texts go."""
    tuned(spark)
    rows = substrings.remove_repeats(shield(docs, "doc_id", "text"), as_written=True)
    rows = rows.where("n_removed = 0 OR n_removed < n_words")
    rows = rows.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n_chars = f"__c{docs.columns.index('n_chars')}"
        changed = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col(n_chars))
        rows = rows.withColumn(n_chars, changed.cast(docs.schema["n_chars"].dataType))
    return _kept(docs, rows, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a window of a benchmark item, or that short items make up all but MOST_BESIDE of."""
    items = table(spark, sf_dir, "benchmark").withColumn("__words", F.regexp_count("text", F.lit(ITEM_WORD)))
    long, short = items.where(F.col("__words") >= SHORT_ITEM_WORDS), items.where(F.col("__words").between(1, SHORT_ITEM_WORDS - 1))
    rows = decontaminate.decontaminate(shield(docs, "text"), long.drop("__words")).where("n_hit = 0")
    if not short.isEmpty():
        rows = decontaminate.decontaminate(rows.drop("n_words", "n_hit", "item_ids", "spans"), short.drop("__words"))
        rows = rows.where((F.col("n_hit") == 0) | (F.col("n_words") - F.col("n_hit") > F.col("n_words") * MOST_BESIDE))
    return _kept(docs, rows, "text")


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their sources' sizes and targets, and how many copies and words of each the mix takes."""
    tuned(spark)
    return mixing.mix(docs, whole=True)


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
    ("decontamination", decontamination), ("mixing", mixing_to_weights),
]

#: SQL has no twin for language profiles and fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
