"""Joins between the stored tables."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.text import fold_marks


def with_sentiment(reviews: DataFrame, classifications: DataFrame, *extra: str) -> DataFrame:
    """Reviews with the sentiment (and ``extra`` columns) of their classification, if any.

    The key is unique on both sides, so the join cannot skew; tables written with
    ``write_bucketed`` on the review id join without a shuffle.
    """
    labels = classifications.select(F.col("review_id").alias("id"), "sentiment", *extra)
    return reviews.join(labels, "id", "left")


def reviews_full(reviews: DataFrame, places: DataFrame, classifications: DataFrame) -> DataFrame:
    """The full star view: review, place and classification columns.

    One scan of the reviews: labels join on the review id (without a shuffle where both tables
    are bucketed on it), places on the place id, broadcast while they are small and otherwise
    split by the adaptive planner where a place is hot.
    """
    place_columns = ["region", "latitude", "longitude", "cluster_name", "potential"]
    label_columns = ["categories_json", "rationale", "model_version"]
    labelled = with_sentiment(reviews.drop(*place_columns), classifications, *label_columns)
    full = labelled.join(places.select("place_id", *place_columns), "place_id", "left")
    return full.select(
        F.col("id").alias("review_id"), "place_id", "author", "rating", "text", "review_date", "review_date_parsed",
        "language", "business", "city", "agency_name", *place_columns, "sentiment", *label_columns,
    )


def unclassified(reviews: DataFrame, classifications: DataFrame, limit: int | None = None) -> DataFrame:
    """Reviews without a classification."""
    done = classifications.select(F.col("review_id").alias("id"))
    rest = reviews.join(done, "id", "left_anti")
    return rest.limit(limit) if limit else rest


def orphan_reviews(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """Number of reviews whose place is missing; counted per place before the join."""
    per_place = reviews.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    lost = per_place.join(places.select("place_id"), "place_id", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))


def orphan_classifications(classifications: DataFrame, reviews: DataFrame) -> DataFrame:
    """Number of classifications whose review is missing."""
    lost = classifications.select("review_id").join(
        reviews.select(F.col("id").alias("review_id")), "review_id", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("orphans"))


def integrity_report(reviews: DataFrame, places: DataFrame, classifications: DataFrame) -> DataFrame:
    """(check, orphans) rows."""
    return (
        orphan_reviews(reviews, places).select(F.lit("orphan_reviews").alias("check"), "orphans")
        .unionByName(
            orphan_classifications(classifications, reviews)
            .select(F.lit("orphan_classifications").alias("check"), "orphans"))
    )


def keep_existing(df: DataFrame, reviews: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows whose review id exists."""
    return df.join(reviews.select(F.col("id").alias(key)), key, "left_semi")


def resolve_city(df: DataFrame, aliases: DataFrame, city_col: str = "city") -> DataFrame:
    """Replace city names by their canonical form; unknown and empty names stay.

    Alias keys are folded exactly, so the names are too; only the distinct ones, which are few.
    """
    names = aliases.select(F.col("key").alias("_folded"), F.col("value").alias("_canonical"))
    spelled = df.select(F.col(city_col).alias("_spelled")).filter(F.col("_spelled") != "").distinct()
    found = spelled.withColumn("_folded", fold_marks(F.col("_spelled"), exact=True)).join(names, "_folded")
    joined = df.join(found.select("_spelled", "_canonical"), F.col(city_col) == F.col("_spelled"), "left")
    return joined.withColumn(city_col, F.coalesce("_canonical", city_col)).select(*df.columns)


def search_grid(businesses: Sequence[str], cities: DataFrame, city_col: str = "city") -> DataFrame:
    """Every requested business in every city: each city row carries the request's short list."""
    names = F.array(*[F.lit(b) for b in businesses])
    return cities.select(F.explode(names).alias("business"), city_col)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
