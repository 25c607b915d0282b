"""Datasets behind the dashboard charts.

They read a prepared frame (``prepare_reviews``) and the role mapping of its columns. Averages
and percentages are left unrounded unless the chart itself works on rounded numbers.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import pct, rating_class, ratio, round_to
from ..operators.filters import filter_in
from ..operators.ranking import competition_rank, order_by, top_n, with_group_share
from ..taxonomy import NEGATIVE, POSITIVE

Roles = dict[str, str | None]


def _sentiment_pct(roles: Roles, value: str) -> Column:
    """Share of all rows, rows without sentiment included."""
    return pct(F.count_if(F.col(roles["sentiment"]) == value), F.count(F.lit(1)))


def kpis(df: DataFrame, roles: Roles) -> DataFrame:
    """One row: total, positive and negative share with their distance to 50, average rating."""
    measures = [F.count(F.lit(1)).alias("total_reviews")]
    if roles["sentiment"]:
        positive, negative = _sentiment_pct(roles, POSITIVE), _sentiment_pct(roles, NEGATIVE)
        measures += [
            positive.alias("pct_positive"), (positive - 50).alias("positive_vs_50"),
            negative.alias("pct_negative"), (negative - 50).alias("negative_vs_50"),
        ]
    if roles["rating"]:
        measures.append(F.avg(roles["rating"]).alias("avg_rating"))
    return df.agg(*measures)


def avg_rating_by_business(df: DataFrame, roles: Roles) -> DataFrame:
    rows = df.filter(F.col(roles["business"]).isNotNull()).groupBy(F.col(roles["business"]).alias("business"))
    return order_by(rows.agg(F.avg(roles["rating"]).alias("avg_rating")), "avg_rating", False, "business")


def sentiment_counts(df: DataFrame, roles: Roles) -> DataFrame:
    rows = df.filter(F.col(roles["sentiment"]).isNotNull()).groupBy(F.col(roles["sentiment"]).alias("sentiment"))
    return order_by(rows.agg(F.count(F.lit(1)).alias("count")), "count", True, "sentiment")


def rating_distribution(df: DataFrame, roles: Roles) -> DataFrame:
    """Business x {1..5}: percentage of the business's rated reviews, best average first."""
    rating = F.col(roles["rating"])
    rated = F.count(rating)
    stats = df.filter(F.col(roles["business"]).isNotNull()).groupBy(F.col(roles["business"]).alias("business")).agg(
        *[pct(F.count_if(rating == stars), rated).alias(f"pct_{stars}") for stars in range(1, 6)],
        F.avg(rating).alias("avg_rating"))
    return order_by(stats, "avg_rating", True, "business")


def category_heatmap(df: DataFrame, roles: Roles, categories: Sequence[str], negative: bool = True) -> DataFrame:
    """(category, business): share of the business's reviews (1 decimal), rank, rank scaled to 0..1.

    Rank 1 is best: fewest mentions of a negative category, most of a positive one.
    """
    business = F.col(roles["business"])
    sums = df.filter(business.isNotNull()).groupBy(business.alias("business")).agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in categories])
    cells = sums.unpivot(["business", "n"], [F.col(f"`{c}`") for c in categories], "category", "hits")
    cells = cells.select("category", "business", round_to(pct(F.col("hits"), F.col("n")), 1).alias("percentage"))
    ranked = competition_rank(cells, "category", "percentage", descending=not negative)
    businesses = sums.agg(F.count(F.lit(1)).alias("b")).scalar()
    scaled = (F.col("rank") - 1) / F.greatest(F.lit(1), businesses - 1)
    return ranked.select("category", "business", "percentage", "rank", scaled.alias("rank_normalized"))


def monthly_trend(df: DataFrame, roles: Roles) -> DataFrame:
    rows = df.filter(F.col("_month").isNotNull()).groupBy(F.col("_month").alias("month"))
    trend = rows.agg(F.avg(roles["rating"]).alias("avg_rating"), F.count(F.lit(1)).alias("n_reviews"))
    return order_by(trend, "month", False)


def city_performance(df: DataFrame, roles: Roles, min_reviews: int = 10, top: int = 20) -> DataFrame:
    """The best cities with enough reviews, shown ascending."""
    rows = df.filter(F.col(roles["city"]).isNotNull()).groupBy(F.col(roles["city"]).alias("city"))
    stats = rows.agg(F.avg(roles["rating"]).alias("avg_rating"), F.count(F.lit(1)).alias("n_reviews"))
    best = top_n(stats.filter(F.col("n_reviews") >= min_reviews), "avg_rating", top, "city")
    return order_by(best, "avg_rating", False, "city")


def _business_summary(df: DataFrame, roles: Roles) -> DataFrame:
    rows = df.filter(F.col(roles["business"]).isNotNull()).groupBy(F.col(roles["business"]).alias("business"))
    return rows.agg(
        F.count(F.lit(1)).alias("reviews"), F.avg(roles["rating"]).alias("avg_rating"),
        _sentiment_pct(roles, POSITIVE).alias("pct_positive"), _sentiment_pct(roles, NEGATIVE).alias("pct_negative"))


def competitor_radar(df: DataFrame, roles: Roles, businesses: Sequence[str]) -> DataFrame:
    """Four 0..100 axes for chosen businesses; volume is relative to the biggest of all."""
    summary = _business_summary(df, roles)
    biggest = summary.agg(F.max("reviews").alias("m")).scalar()
    return filter_in(summary, "business", businesses).select(
        "business", (F.col("avg_rating") / 5 * 100).alias("rating_score"), F.col("pct_positive").alias("positive_score"),
        (F.lit(100.0) - F.col("pct_negative")).alias("negative_score"),
        (F.col("reviews") / biggest * 100).alias("volume_score"))


def leaderboard(df: DataFrame, roles: Roles, businesses: Sequence[str]) -> DataFrame:
    return _business_summary(filter_in(df, roles["business"], businesses), roles)


def city_table(df: DataFrame, roles: Roles, top: int = 30) -> DataFrame:
    """Largest cities with reviews, distinct businesses, average rating and positive share."""
    city, business, rating = F.col(roles["city"]), F.col(roles["business"]), F.col(roles["rating"])
    # One row per (city, business) first: the distinct count then works on few rows.
    pairs = df.filter(city.isNotNull()).groupBy(city.alias("city"), business.alias("business")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(rating).alias("stars"), F.count(rating).alias("rated"),
        F.count_if(F.col(roles["sentiment"]) == POSITIVE).alias("pos"))
    stats = pairs.groupBy("city").agg(
        F.sum("n").alias("reviews"), F.count("business").alias("businesses"),
        ratio(F.sum("stars"), F.sum("rated")).alias("avg_rating"), pct(F.sum("pos"), F.sum("n")).alias("pct_positive"))
    return top_n(stats, "reviews", top, "city")


def business_city_matrix(df: DataFrame, roles: Roles, cities: int = 15, min_reviews: int = 3) -> DataFrame:
    """(business, city): mean rating of the pairs in the largest cities, null below the support."""
    city, business, rating = F.col(roles["city"]), F.col(roles["business"]), F.col(roles["rating"])
    pairs = df.filter(city.isNotNull()).groupBy(business.alias("business"), city.alias("city")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(rating).alias("stars"), F.count(rating).alias("rated"))
    sizes = df.filter(city.isNotNull()).groupBy(city.alias("city")).agg(F.count(F.lit(1)).alias("n"))
    biggest = top_n(sizes, "n", cities, "city").select("city")
    mean = F.when(F.col("n") >= min_reviews, round_to(ratio(F.col("stars"), F.col("rated"))))
    # At most ``cities`` rows are broadcast.
    return pairs.filter(F.col("business").isNotNull()).join(F.broadcast(biggest), "city", "left_semi").select(
        "business", "city", mean.alias("avg_rating"))


def pivot_matrix(matrix: DataFrame, cities: Sequence[str]) -> DataFrame:
    """The matrix with the given cities as columns."""
    return matrix.groupBy("business").pivot("city", list(cities)).agg(F.first("avg_rating"))


def monthly_by_business(df: DataFrame, roles: Roles) -> DataFrame:
    rows = df.filter(F.col("_month").isNotNull() & F.col(roles["business"]).isNotNull())
    return rows.groupBy(F.col("_month").alias("month"), F.col(roles["business"]).alias("business")).agg(
        F.avg(roles["rating"]).alias("avg_rating"), F.count(F.lit(1)).alias("n_reviews"))


def sentiment_evolution(df: DataFrame, roles: Roles) -> DataFrame:
    """(month, sentiment, percentage) with a zero for every pair that does not occur.

    Every sentiment found counts, known or not. Reviews are reduced to (month, sentiment) counts
    first; each month is then completed by the list of sentiments that occur anywhere.
    """
    sentiment = F.col(roles["sentiment"])
    counts = df.filter(F.col("_month").isNotNull() & sentiment.isNotNull()).groupBy(
        F.col("_month").alias("month"), sentiment.alias("sentiment")).agg(F.count(F.lit(1)).alias("n"))
    occurring = counts.agg(F.collect_set("sentiment").alias("s")).scalar()
    months = counts.select("month").distinct().withColumn("_all", occurring)
    grid = months.select("month", F.explode("_all").alias("sentiment"))
    cells = grid.join(counts, ["month", "sentiment"], "left").na.fill(0, ["n"])
    return with_group_share(cells, ["month"], "n").select("month", "sentiment", "percentage")


def map_points(df: DataFrame, roles: Roles, lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """Rows with coordinates and the colour of their rating."""
    return df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).withColumn(
        "color", rating_class(F.col(roles["rating"])))


def map_center(df: DataFrame, lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    rows = df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    return rows.agg(F.avg(lat).alias("center_lat"), F.avg(lng).alias("center_lng"))


def collection_stats(reviews: DataFrame) -> DataFrame:
    """Places with reviews and number of reviews."""
    per_place = reviews.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    return per_place.agg(
        F.count("place_id").alias("total_places"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_reviews"))


def resolution_stats(places: DataFrame) -> DataFrame:
    """Rows and rows that were resolved."""
    return places.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("resolve_status") != "unresolved").alias("resolved"))


def region_coverage(df: DataFrame) -> DataFrame:
    """Rows with a region and their share."""
    return df.agg(
        F.count("region").alias("assigned"), F.count(F.lit(1)).alias("total"),
        pct(F.count("region"), F.count(F.lit(1))).alias("percentage"))
