"""Row verdicts and table constraints."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.categories import classification_reason
from ..schemas import TABLES
from ..taxonomy import SENTIMENTS


def _with_verdict(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def validate_reviews(df: DataFrame, snippet: str = "snippet", rating: str = "rating") -> DataFrame:
    """Add ``reason`` (first violation or null) and ``is_valid`` to raw reviews."""
    value = F.col(rating)
    reason = (
        F.when(F.col(snippet).isNull(), "missing snippet")
        .when(value.isNotNull() & ~value.between(1, 5), "invalid rating")
    )
    return _with_verdict(df, reason)


def validate_classification(df: DataFrame) -> DataFrame:
    """Add ``reason`` and ``is_valid`` to (sentiment, categories, rationale) records."""
    return _with_verdict(df, classification_reason(F.col("sentiment"), F.col("categories"), F.col("rationale")))


def _violation(table: str, columns: list[str]) -> Column:
    missing = [F.col(f.name).isNull() for f in TABLES[table].fields if not f.nullable and f.name in columns]
    bad = F.lit(False)
    for check in missing:
        bad = bad | check
    if table == "reviews":
        bad = bad | F.coalesce(~F.col("rating").between(0, 5), F.lit(False))
    if table == "classifications":
        bad = bad | F.coalesce(~F.col("sentiment").isin(list(SENTIMENTS)), F.lit(False))
    return bad


def check_constraints(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy NOT NULL and CHECK, rejected rows). A null passes a CHECK, as in SQL."""
    bad = _violation(table, df.columns)
    return df.filter(~bad), df.filter(bad)
