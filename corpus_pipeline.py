"""The corpus pipeline: language ID, near-duplicates, repeated substrings, packing; each stage works on all that the one before kept.

Defined results of every stage: nulls, empty texts, repeated rows and empty tables as its operator defines them; columns beyond those
of documents are dropped at the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import langid, packing, simhash, substring
from helixframe.storage import drop_path, new_path, shuffles_dropped, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected without a letter, or if no language has half of the probability.
LEAST_SCORE = 0.5


def _n_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; `lang` is the predicted one."""
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return simhash.drop_similar(docs, shingle=5, similarity=0.8).select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences that repeat an earlier span; what has no words left goes."""
    cleaned = _n_chars(substring.dedup(docs))
    return cleaned.filter(F.col("text").rlike(r"[\p{L}\p{N}]"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_substrings", repeated_substrings), ("packed", packed)]
#: Learned models and similarity groups have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = new_path(spark, name)
        made = stage(spark, docs, sf_dir)
        with shuffles_dropped(spark):
            made.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
