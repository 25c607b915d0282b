"""The corpus pipeline: stages of the training-data operators, applied one after another."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalake.llm import toxicity as toxic
from vocalake.llm.common import stored, table
from vocalake.llm.line_dedup import dedup_lines
from vocalake.llm.near_dedup import near_components
from vocalake.llm.packing import pack, token_pieces
from vocalake.llm.secrets import mask_secrets

#: Similarity of word shingles from which the pipeline takes documents for near copies; op8's own is 85.
NEAR_PERCENT = 80


def with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with the text replaced and its length counted anew."""
    return docs.withColumns({"text": text, "n_chars": F.char_length(text).cast("long")})


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches the operator's threshold."""
    field = toxic.train_on(docs, table(spark, sf_dir, "labels"))
    return toxic.without_toxic(docs, field)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of three-line windows out of the texts; every document stays."""
    cleaned = dedup_lines(docs)
    return with_text(cleaned.select("row.*", F.col("text").alias("_cleaned")), F.col("_cleaned")).drop("_cleaned")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate component."""
    kept = near_components(docs, percent=NEAR_PERCENT).filter("kept").select(F.col("id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every reported span; every document stays."""
    return with_text(mask_secrets(docs), F.col("text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in packed sequences."""
    return pack(token_pieces(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Models, links and token ids are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage reads what its predecessor has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
