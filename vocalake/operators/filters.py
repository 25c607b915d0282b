"""Row filters. Values travel as literals, never as interpolated SQL."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def filter_reviews(df: DataFrame, limit: int | None = None, **equals) -> DataFrame:
    """Equality filters joined by AND; a filter that is None is left out."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df.limit(limit) if limit else df


def filter_in(df: DataFrame, column: str, values: Iterable, ignore_case: bool = False) -> DataFrame:
    if ignore_case:
        return df.filter(F.lower(column).isin([v.lower() for v in values]))
    return df.filter(F.col(column).isin(list(values)))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows where one of the columns is null or blank."""
    for name in columns:
        df = df.filter(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return df


def brand_filter(df: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Case-insensitive search of a regular expression in the place title."""
    return df.filter(F.col(column).rlike(f"(?iu){pattern}"))


def get_place(places: DataFrame, place_id) -> DataFrame:
    return places.filter(F.col("place_id") == F.lit(place_id))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).dropna().distinct().orderBy(column)
