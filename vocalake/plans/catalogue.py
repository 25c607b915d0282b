"""The analytic query catalogue over reviews, places, classifications and category flags.

Shape shared by the statistics: join sentiment on the unique review id, reduce to one row per
(business, city, place) with map-side combine, then aggregate those few rows. Distinct counts
and ratios are taken on the reduced rows, so hot businesses and cities cost nothing extra.
"""
from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.categories import parse_categories
from ..functions.dates import days_ago, period
from ..functions.numbers import pct, ratio, round_to
from ..operators.filters import filter_in, filter_reviews
from ..operators.joins import integrity_report, with_sentiment
from ..operators.ranking import global_rank, order_by, top_n, with_share
from ..taxonomy import (
    CATEGORY_COLUMNS, FLAG_COLUMNS, NEGATIVE, NEGATIVE_FLAGS, NEUTRAL, NEUTRAL_FLAGS, POSITIVE,
    POSITIVE_FLAGS,
)

FLAG_SETS = {"positive": POSITIVE_FLAGS, "negative": NEGATIVE_FLAGS, "neutral": NEUTRAL_FLAGS}
RANKING_METRICS = ("avg_rating", "positive_rate", "total_reviews")


def _tally(df: DataFrame, *keys: str) -> DataFrame:
    """Counts per key: rows, rating sum and count, rows per sentiment."""
    def having(sentiment):
        return F.count_if(F.col("sentiment") == sentiment)

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("stars"), F.count("rating").alias("rated"),
        having(POSITIVE).alias("pos"), having(NEGATIVE).alias("neg"), having(NEUTRAL).alias("neu"),
    )


def _rating_tally(reviews: DataFrame, *keys: str) -> DataFrame:
    """Counts per key that need no sentiment."""
    return reviews.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("stars"), F.count("rating").alias("rated"))


def _avg_rating() -> Column:
    return ratio(F.sum("stars"), F.sum("rated"))


def _rate(count: str) -> Column:
    return round_to(pct(F.sum(count), F.sum("n")))


# Output column -> aggregate over tally rows.
MEASURES = {
    "total_reviews": lambda: F.sum("n"),
    "review_count": lambda: F.sum("n"),
    "branch_count": lambda: F.count_distinct("place_id"),
    "place_count": lambda: F.count_distinct("place_id"),
    "city_count": lambda: F.count_distinct("city"),
    "city_coverage": lambda: F.count_distinct("city"),
    "business_count": lambda: F.count_distinct("business"),
    "avg_rating": lambda: round_to(_avg_rating()),
    "positive_count": lambda: F.sum("pos"),
    "negative_count": lambda: F.sum("neg"),
    "neutral_count": lambda: F.sum("neu"),
    "positive_rate": lambda: _rate("pos"),
    "negative_rate": lambda: _rate("neg"),
}


def _measures(*names: str) -> list[Column]:
    return [MEASURES[n]().alias(n) for n in names]


def _labelled(reviews: DataFrame, classifications: DataFrame, *columns: str) -> DataFrame:
    return with_sentiment(reviews.select("id", "rating", *columns), classifications)


def _branch_tally(reviews: DataFrame, classifications: DataFrame) -> DataFrame:
    return _tally(_labelled(reviews, classifications, "business", "city", "place_id"), "business", "city", "place_id")


def sentiment_distribution(classifications: DataFrame) -> DataFrame:
    counts = classifications.groupBy("sentiment").agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts, "count")


def overview(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """One row of totals. Reviews are reduced per place before they meet the places."""
    per_place = reviews.groupBy("place_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("stars"), F.count("rating").alias("rated"),
        F.min("review_date_parsed").alias("first"), F.max("review_date_parsed").alias("last"))
    known = places.select("place_id", "business", "city", F.lit(1).alias("known"))
    # Places are unique by now, so they are counted; only the few (business, city) pairs need distinct counts.
    pairs = per_place.join(known, "place_id", "left").groupBy("business", "city").agg(
        F.count("known").alias("places"), F.sum("n").alias("n"), F.sum("stars").alias("stars"),
        F.sum("rated").alias("rated"), F.min("first").alias("first"), F.max("last").alias("last"))
    return pairs.agg(
        F.coalesce(F.sum("places"), F.lit(0)).alias("total_places"),
        F.count_distinct("business").alias("total_businesses"),
        F.count_distinct("city").alias("total_cities"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_reviews"),
        _avg_rating().alias("avg_rating"),
        F.min("first").alias("earliest_review"),
        F.max("last").alias("latest_review"),
    )


def business_stats(reviews: DataFrame, classifications: DataFrame, business: str | None = None) -> DataFrame:
    tally = _branch_tally(filter_reviews(reviews, business=business), classifications)
    stats = tally.groupBy("business").agg(*_measures(
        "total_reviews", "branch_count", "city_count", "avg_rating", "positive_count", "negative_count",
        "neutral_count", "positive_rate", "negative_rate"))
    return order_by(stats, "total_reviews", True, "business")


def business_ranking(
    reviews: DataFrame, classifications: DataFrame, metric: str = "avg_rating", top: int = 10, min_reviews: int = 10
) -> DataFrame:
    """Top businesses by a metric; an unknown metric means avg_rating."""
    metric = metric if metric in RANKING_METRICS else "avg_rating"
    if metric == "positive_rate":
        tally = _tally(_labelled(reviews, classifications, "business"), "business")
    else:
        tally = _rating_tally(reviews, "business")
    ranked = tally.groupBy("business").agg(*_measures(metric, "review_count")).filter(
        F.col("review_count") >= min_reviews)
    return top_n(ranked, metric, top, "business")


def city_stats(reviews: DataFrame, classifications: DataFrame, city: str | None = None) -> DataFrame:
    tally = _branch_tally(filter_reviews(reviews, city=city), classifications)
    stats = tally.groupBy("city").agg(*_measures(
        "total_reviews", "branch_count", "business_count", "avg_rating", "positive_count", "negative_count",
        "positive_rate"))
    return order_by(stats, "total_reviews", True, "city")


def best_in_city(
    reviews: DataFrame, classifications: DataFrame, city: str, metric: str = "avg_rating", min_reviews: int = 5
) -> DataFrame:
    tally = _tally(
        _labelled(filter_reviews(reviews, city=city), classifications, "business", "city"), "business", "city")
    stats = tally.groupBy("business", "city").agg(*_measures("avg_rating", "review_count", "positive_rate"))
    return top_n(stats.filter(F.col("review_count") >= min_reviews), metric, 1, "business")


def city_winners(reviews: DataFrame, min_reviews: int = 5) -> DataFrame:
    """Best business of each city by unrounded average; ties go to the first name."""
    pairs = _rating_tally(reviews, "city", "business").filter(F.col("n") >= min_reviews)
    average = ratio(F.col("stars"), F.col("rated"))
    best = F.min_by(
        F.struct("business", round_to(average).alias("avg_rating"), F.col("n").alias("review_count")),
        F.struct(average.isNull(), -average, "business"))
    winners = pairs.groupBy("city").agg(best.alias("w")).select("city", "w.*")
    return order_by(winners, "city", False)


def temporal_trends(
    reviews: DataFrame, classifications: DataFrame, granularity: str = "month", business: str | None = None,
    city: str | None = None,
) -> DataFrame:
    dated = filter_reviews(reviews, business=business, city=city).filter(F.col("review_date_parsed").isNotNull())
    rows = _labelled(dated, classifications, "review_date_parsed").withColumn(
        "period", period(F.col("review_date_parsed"), granularity))
    trend = _tally(rows, "period").groupBy("period").agg(*_measures(
        "review_count", "avg_rating", "positive_count", "negative_count", "positive_rate"))
    return order_by(trend, "period", False)


def recent_reviews(
    reviews: DataFrame, classifications: DataFrame, today: date, days: int = 30, business: str | None = None,
    sentiment: str | None = None,
) -> DataFrame:
    """Reviews of the last days, newest first; ties by id, so the sort splits a crowded day."""
    recent = filter_reviews(reviews, business=business).filter(
        F.col("review_date_parsed") >= days_ago(days, today))
    rows = with_sentiment(recent, classifications, "rationale")
    return filter_reviews(rows, sentiment=sentiment).select(
        "id", "business", "city", "text", "rating", "review_date_parsed", "sentiment", "rationale",
    ).orderBy(F.desc_nulls_last("review_date_parsed"), "id")


def category_distribution(
    reviews: DataFrame, classifications: DataFrame, business: str | None = None, city: str | None = None,
    category_type: str | None = None,
) -> DataFrame:
    """Count and share per label of the JSON lists; ``category_type`` keeps one taxonomy group."""
    chosen = filter_reviews(reviews, business=business, city=city)
    listed = classifications.filter(F.col("categories_json").isNotNull() & (F.col("categories_json") != "[]"))
    parsed = listed.select("review_id", parse_categories(F.col("categories_json"))["label"].alias("labels"))
    known = parsed.join(chosen.select(F.col("id").alias("review_id")), "review_id", "left_semi")
    mine = known.select(F.explode("labels").alias("category")).filter(F.col("category").isNotNull())
    if category_type is not None:
        mine = filter_in(mine, "category", [CATEGORY_COLUMNS[c] for c in FLAG_SETS[category_type]])
    counts = mine.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    return order_by(with_share(counts, "count"), "count", True, "category")


def _flag_sums(reviews: DataFrame, flags: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(label, count) per flag column: one aggregation over all columns, then unpivot."""
    mine = flags.select("review_id", *columns).join(
        reviews.select(F.col("id").alias("review_id")), "review_id", "left_semi")
    sums = mine.agg(*[F.sum(c).alias(CATEGORY_COLUMNS[c]) for c in columns])
    return sums.unpivot([], [F.col(f"`{CATEGORY_COLUMNS[c]}`") for c in columns], label, "count").filter("count > 0")


def category_distribution_flags(
    reviews: DataFrame, flags: DataFrame, business: str | None = None, city: str | None = None
) -> DataFrame:
    chosen = filter_reviews(reviews, business=business, city=city)
    counts = _flag_sums(chosen, flags, FLAG_COLUMNS, "category")
    return order_by(with_share(counts, "count"), "count", True, "category")


def category_by_business(reviews: DataFrame, flags: DataFrame, kind: str = "negative") -> DataFrame:
    """Businesses as rows, the categories of one group as columns."""
    columns = FLAG_SETS["positive" if kind == "positive" else "negative"]
    rows = reviews.select(F.col("id").alias("review_id"), "business").join(
        flags.select("review_id", *columns), "review_id", "left")
    sums = rows.groupBy("business").agg(
        F.count(F.lit(1)).alias("total_reviews"), *[F.sum(c).alias(c) for c in columns])
    return order_by(sums, "business", False)


def top_issues(reviews: DataFrame, flags: DataFrame, business: str | None = None, top: int = 5) -> DataFrame:
    counts = _flag_sums(filter_reviews(reviews, business=business), flags, NEGATIVE_FLAGS, "issue")
    return top_n(counts, "count", top, "issue")


def compare_businesses(reviews: DataFrame, classifications: DataFrame, businesses: Sequence[str]) -> DataFrame:
    tally = _branch_tally(filter_in(reviews, "business", businesses), classifications)
    stats = tally.groupBy("business").agg(*_measures(
        "total_reviews", "avg_rating", "positive_rate", "negative_rate", "branch_count", "city_coverage"))
    return order_by(stats, "avg_rating", True, "business")


def business_rank(reviews: DataFrame, min_reviews: int = 10) -> DataFrame:
    """Rank of every business with enough reviews by unrounded average rating."""
    tally = _rating_tally(reviews, "business").filter(F.col("n") >= min_reviews)
    averages = tally.select("business", ratio(F.col("stars"), F.col("rated")).alias("average"))
    ranked = global_rank(averages, "average", 0.0, 5.0, "rating_rank")
    return ranked.select("business", round_to(F.col("average")).alias("avg_rating"), "rating_rank")


def competitive_position(
    reviews: DataFrame, classifications: DataFrame, business: str, min_reviews: int = 10
) -> DataFrame:
    """One row comparing a business with the market; no row if the business is unknown.

    Everything derives from one row per business; the rank is the number of better averages
    plus one, so no sort over the market is needed.
    """
    per_business = _tally(_labelled(reviews, classifications, "business"), "business").withColumn(
        "average", ratio(F.col("stars"), F.col("rated")))
    mine = F.col("business") == F.lit(business)
    own_tally = _rating_tally(filter_reviews(reviews, business=business), "business")
    own_average = own_tally.select(ratio(F.col("stars"), F.col("rated")).alias("average")).scalar()
    better = F.coalesce(F.col("average") > own_average, F.col("average").isNotNull() & own_average.isNull())
    market = per_business.agg(
        F.max(F.when(mine, F.col("n"))).alias("own_n"),
        F.max(F.when(mine, F.col("pos"))).alias("own_pos"),
        F.max(F.when(mine, F.col("average"))).alias("own_average"),
        round_to(_avg_rating()).alias("market_avg_rating"),
        _rate("pos").alias("market_positive_rate"),
        (F.count_if((F.col("n") >= min_reviews) & better) + 1).alias("rank"),
        F.count("business").alias("businesses"),
    ).filter(F.col("own_n").isNotNull())
    ranked = F.col("own_n") >= min_reviews
    own = market.select(
        F.lit(business).alias("business"), round_to(F.col("own_average")).alias("avg_rating"),
        round_to(pct(F.col("own_pos"), F.col("own_n"))).alias("positive_rate"),
        "market_avg_rating", "market_positive_rate",
        F.when(ranked, F.col("rank")).alias("rating_rank"),
        F.when(ranked, F.col("businesses")).alias("total_businesses"),
    )
    return own.withColumns({
        "rating_vs_market": F.col("avg_rating") - F.col("market_avg_rating"),
        "positive_vs_market": F.col("positive_rate") - F.col("market_positive_rate"),
    })


def business_report(
    reviews: DataFrame, classifications: DataFrame, flags: DataFrame, business: str, today: date
) -> dict[str, DataFrame]:
    """The six datasets of a business report."""
    return {
        "overview": business_stats(reviews, classifications, business),
        "by_city": city_stats(filter_reviews(reviews, business=business), classifications),
        "trends": temporal_trends(reviews, classifications, business=business),
        "top_issues": top_issues(reviews, flags, business),
        "competitive_position": competitive_position(reviews, classifications, business),
        "recent_negative": recent_reviews(reviews, classifications, today, 90, business, NEGATIVE),
    }


def v_business_stats(reviews: DataFrame, classifications: DataFrame) -> DataFrame:
    tally = _tally(_labelled(reviews, classifications, "business"), "business")
    return tally.select(
        "business", F.col("n").alias("total_reviews"), ratio(F.col("stars"), F.col("rated")).alias("avg_rating"),
        F.col("pos").alias("positive_count"), F.col("neg").alias("negative_count"), F.col("neu").alias("neutral_count"),
        round_to(pct(F.col("pos"), F.col("n"))).alias("positive_rate"))


def v_city_stats(reviews: DataFrame, classifications: DataFrame) -> DataFrame:
    return _branch_tally(reviews, classifications).groupBy("city").agg(
        *_measures("total_reviews"), _avg_rating().alias("avg_rating"),
        *_measures("place_count", "business_count", "positive_count", "negative_count"))


def v_temporal_stats(reviews: DataFrame, classifications: DataFrame) -> DataFrame:
    dated = reviews.filter(F.col("review_date_parsed").isNotNull())
    rows = _labelled(dated, classifications, "business", "review_date_parsed").withColumn(
        "month", period(F.col("review_date_parsed"), "month"))
    return _tally(rows, "month", "business").select(
        "month", "business", F.col("n").alias("review_count"),
        ratio(F.col("stars"), F.col("rated")).alias("avg_rating"), F.col("pos").alias("positive_count"),
        F.col("neg").alias("negative_count"),
    )


def table_stats(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(table, rows); a table that does not exist counts 0."""
    spark = next(df for df in tables.values() if df is not None).sparkSession
    counts = None
    for name, df in tables.items():
        row = spark.range(0).agg(F.count("id").alias("rows")) if df is None else df.agg(
            F.count(F.lit(1)).alias("rows"))
        row = row.select(F.lit(name).alias("table"), "rows")
        counts = row if counts is None else counts.unionByName(row)
    return counts


def verify(reviews: DataFrame, places: DataFrame, classifications: DataFrame, **other: DataFrame) -> dict[str, DataFrame]:
    """Row counts, orphan checks and sentiment counts of a store."""
    tables = {"places": places, "reviews": reviews, "classifications": classifications, **other}
    return {
        "table_stats": table_stats(tables),
        "integrity_checks": integrity_report(reviews, places, classifications),
        "sentiment_distribution": classifications.groupBy("sentiment").agg(F.count(F.lit(1)).alias("count")),
    }


