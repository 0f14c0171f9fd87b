"""The corpus pipeline: documents in, encoded training documents out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that the next one takes as ``docs``. All but the last return the
columns of ``documents``; every stage works on all rows that the one before it kept.

No stage can be stated in SQL as a whole (trained bands, MinHash candidates, BPE merges), so
``ORACLE_SQL`` is None; the tests hold each stage against a brute-force version.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm import op1_mix, op3_fertility, op4_bpe, op7_substring_dedup, op10_minhash
from framefold.llm.scratch import stored

SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their tokeniser bands go."""
    return op3_fertility.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Five-word shingles, similarity of 0.8 or more. Rows without id stay.
    """
    gone = op10_minhash.near_duplicates(docs, k=SHINGLE_WORDS).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that start in a document with a smaller id go.

    A text that loses nothing stays as it is; what is left of others is joined by
    spaces, and a document that loses all its words goes.
    """
    found = op7_substring_dedup.remove_repeats(docs).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*[text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents are left out, kept or repeated."""
    return op1_mix.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix and the text that they decode to."""
    done = op4_bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"))
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mix_sources", mixing),
    ("bpe_encoding", encoding),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
