"""Normalisation of raw reviews."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.dates import month_start, parse_relative_french
from ..functions.numbers import clean_rating, to_number
from ..functions.text import clean_text, fold_ascii
from .columns import first_present

# Accepted names of each kind of column.
RATING_COLUMNS = ("rating", "review_rating")
COORDINATE_COLUMNS = ("lat", "lng", "latitude", "longitude")
DATE_COLUMNS = ("date", "review_date")
TEXT_COLUMNS = ("text", "review_snippet", "review_text")


def normalize_reviews(df: DataFrame, now: datetime) -> DataFrame:
    """Rating, coordinates, ``created_at``, texts, ``month`` and ``city_normalized``."""
    changes = {}
    rating = first_present(df, RATING_COLUMNS)
    if rating:
        changes["rating"] = clean_rating(F.col(rating))
    changes |= {c: to_number(F.col(c)) for c in COORDINATE_COLUMNS if c in df.columns}
    created, date_col = None, first_present(df, DATE_COLUMNS)
    if "created_at" in df.columns:
        created = F.col("created_at").try_cast(T.TimestampType())
    elif date_col:
        created = parse_relative_french(F.col(date_col), now)
    changes |= {c: clean_text(F.col(c)) for c in TEXT_COLUMNS if c in df.columns}
    if "city" in df.columns:
        changes["city_normalized"] = fold_ascii(F.col("city"))
    if created is None:
        return df.withColumns(changes)
    # A layer of its own: the month reads the parsed date instead of parsing again.
    return df.withColumns({**changes, "created_at": created}).withColumn("month", month_start(F.col("created_at")))
