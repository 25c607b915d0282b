"""Expressions over the category list of a review."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..schemas import CATEGORY_ARRAY
from ..taxonomy import (
    CATEGORIES, CATEGORY_COLUMNS, CONFIDENCE_THRESHOLD, FALLBACK_CONFIDENCE, NEGATIVE, NEUTRAL, OTHER_NEGATIVE,
    OTHER_POSITIVE, POSITIVE,
)

MAX_CATEGORIES = 3
MAX_RATIONALE = 300


def _entry(label: str, confidence: float) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))


def no_categories() -> Column:
    return F.array().cast(CATEGORY_ARRAY)


def parse_categories(col: Column) -> Column:
    """JSON text -> array of (label, confidence); null and malformed text -> empty array."""
    return F.coalesce(F.from_json(col, CATEGORY_ARRAY), no_categories())


def filter_categories(
    arr: Column, taxonomy: Iterable[str] = CATEGORIES, threshold: float = CONFIDENCE_THRESHOLD
) -> Column:
    """Known labels whose confidence reaches the threshold (null counts as 0)."""
    labels = list(taxonomy)
    return F.filter(
        arr, lambda c: c["label"].isin(labels) & (F.coalesce(c["confidence"], F.lit(0.0)) >= F.lit(threshold))
    )


def with_fallback(arr: Column, sentiment: Column) -> Column:
    """Give an empty list the "other" label of its sentiment."""
    lowered = F.lower(F.coalesce(sentiment, F.lit("")))
    positive = F.array(_entry(OTHER_POSITIVE, FALLBACK_CONFIDENCE)).cast(CATEGORY_ARRAY)
    negative = F.array(_entry(OTHER_NEGATIVE, FALLBACK_CONFIDENCE)).cast(CATEGORY_ARRAY)
    return (
        F.when(F.size(arr) > 0, arr).when(lowered.contains("positif"), positive)
        .when(lowered.contains("négatif") | lowered.contains("negatif"), negative).otherwise(no_categories())
    )


def categories_json(arr: Column) -> Column:
    return F.to_json(arr)


def label_flags(labels: Column, names: Iterable[str] = CATEGORIES) -> dict[str, Column]:
    """One 0/1 column per label, named by the label; ``labels`` is an array of label texts."""
    return {name: F.coalesce(F.array_contains(labels, name).cast("int"), F.lit(0)) for name in names}


def short_flags(labels: Column) -> dict[str, Column]:
    """One 0/1 column per taxonomy entry, named by its short column."""
    flags = label_flags(labels)
    return {short: flags[label] for short, label in CATEGORY_COLUMNS.items()}


def classification_reason(sentiment: Column, categories: Column, rationale: Column) -> Column:
    """First contract violation of a classification record, null when it is valid."""
    def bad_confidence(c):
        return c["confidence"].isNull() | ~c["confidence"].between(0.0, 1.0)

    return (
        F.when(~F.coalesce(sentiment.isin(POSITIVE, NEUTRAL, NEGATIVE), F.lit(False)), "sentiment")
        .when(categories.isNull(), "categories missing")
        .when(F.size(categories) > MAX_CATEGORIES, "too many categories")
        .when(F.exists(categories, lambda c: ~F.coalesce(c["label"].isin(list(CATEGORIES)), F.lit(False))), "label")
        .when(F.exists(categories, bad_confidence), "confidence")
        .when(rationale.isNull() | (F.length(rationale) > MAX_RATIONALE), "rationale")
    )
