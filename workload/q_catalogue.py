"""Catalogue queries: statistics, rankings, trends, categories, positions."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from vocalake.operators.joins import integrity_report, keep_existing, reviews_full, unclassified, union_all
from vocalake.operators.filters import distinct_sorted, filter_in, filter_reviews, get_place
from vocalake.operators.ranking import with_group_share
from vocalake.operators.sketches import distinct_sketches, estimated, unite
from vocalake.plans import catalogue as c
from vocalake.plans.named import run_query
from vocalake.plans.store import append_rows, load_table, register_frames, save_bucketed
from vocalake.taxonomy import (
    CATEGORY_COLUMNS, NEGATIVE_FLAGS, POSITIVE_FLAGS,
)

from . import roles as b
from .registry import query
from .roles import BUSINESS, BUSINESSES, CITY, NEG, NEU, POS, TODAY, pct_sql, quoted, r, sql


def rc(spark, sf):
    return b.reviews(spark, sf), b.classifications(spark, sf)


IN_BUSINESSES = "(" + ", ".join(quoted(x) for x in BUSINESSES) + ")"
AVG = r("avg(rating)")
POS_RATE, NEG_RATE = r(pct_sql(POS, "count(*)")), r(pct_sql(NEG, "count(*)"))
BUSINESS_STATS = f"""
SELECT business, count(*) AS total_reviews, count(DISTINCT place_id) AS branch_count,
       count(DISTINCT city) AS city_count, {AVG} AS avg_rating, {POS} AS positive_count, {NEG} AS negative_count,
       {NEU} AS neutral_count, {POS_RATE} AS positive_rate, {NEG_RATE} AS negative_rate
FROM rs {{where}} GROUP BY business"""
CITY_STATS = f"""
SELECT city, count(*) AS total_reviews, count(DISTINCT place_id) AS branch_count,
       count(DISTINCT business) AS business_count, {AVG} AS avg_rating, {POS} AS positive_count,
       {NEG} AS negative_count, {POS_RATE} AS positive_rate
FROM rs {{where}} GROUP BY city"""
TREND = f"""
SELECT CAST(date_trunc('{{unit}}', review_date_parsed) AS DATE) AS period, count(*) AS review_count,
       {AVG} AS avg_rating, {POS} AS positive_count, {NEG} AS negative_count, {POS_RATE} AS positive_rate
FROM rs WHERE review_date_parsed IS NOT NULL {{where}} GROUP BY 1"""


@query("overview", sql("""
SELECT count(DISTINCT p.place_id) AS total_places, count(DISTINCT p.business) AS total_businesses,
       count(DISTINCT p.city) AS total_cities, count(*) AS total_reviews, avg(rating) AS avg_rating,
       min(review_date_parsed) AS earliest_review, max(review_date_parsed) AS latest_review
FROM reviews r LEFT JOIN places p ON r.place_id=p.place_id"""))
def _(spark, sf):
    return c.overview(b.reviews(spark, sf), b.places(spark, sf))


SENTIMENT = f"""SELECT sentiment, count(*) AS count, {r("100e0*count(*)/sum(count(*)) OVER ()")} AS percentage
FROM classifications GROUP BY sentiment"""


@query("sentiment_distribution", sql(SENTIMENT))
def _(spark, sf):
    return c.sentiment_distribution(b.classifications(spark, sf))


@query("business_stats", sql(BUSINESS_STATS.format(where="")))
def business_stats(spark, sf):
    return c.business_stats(*rc(spark, sf))


@query("business_stats_stored", sql(BUSINESS_STATS.format(where="")))
def _(spark, sf):
    """The same over a store whose reviews and classifications are bucketed alike on the review id."""
    base = b.scratch(spark)
    reviews, labels = rc(spark, sf)
    append_rows(reviews, base, "reviews")
    append_rows(labels, base, "classifications")
    frames = save_bucketed(spark, base, 8, f"stats_{base[-32:]}")
    return c.business_stats(frames["reviews"], frames["classifications"])


@query("business_stats_one", sql(BUSINESS_STATS.format(where=f"WHERE business='{BUSINESS}'")))
def _(spark, sf):
    return c.business_stats(*rc(spark, sf), business=BUSINESS)


def _ranking(metric, expression):
    @query(f"business_ranking_{metric}", sql(f"""
SELECT business, {expression} AS {metric}, count(*) AS review_count FROM rs GROUP BY business
HAVING count(*)>=10 ORDER BY {metric} DESC NULLS LAST, business LIMIT 3"""))
    def _(spark, sf):
        return c.business_ranking(*rc(spark, sf), metric=metric, top=3)


for _metric, _expression in {
    "avg_rating": AVG, "positive_rate": POS_RATE, "total_reviews": "count(*)",
}.items():
    _ranking(_metric, _expression)


@query("city_stats", sql(CITY_STATS.format(where="")))
def _(spark, sf):
    return c.city_stats(*rc(spark, sf))


@query("city_stats_one", sql(CITY_STATS.format(where=f"WHERE city='{CITY}'")))
def _(spark, sf):
    return c.city_stats(*rc(spark, sf), city=CITY)


@query("best_in_city", sql(f"""
SELECT business, city, {AVG} AS avg_rating, count(*) AS review_count, {POS_RATE} AS positive_rate
FROM rs WHERE city='{CITY}' GROUP BY business, city HAVING count(*)>=5
ORDER BY positive_rate DESC NULLS LAST, business LIMIT 1"""))
def _(spark, sf):
    return c.best_in_city(*rc(spark, sf), CITY, "positive_rate")


CITY_WINNERS = sql(f"""
SELECT city, business, avg_rating, review_count FROM (
  SELECT city, business, {AVG} AS avg_rating, count(*) AS review_count,
         row_number() OVER (PARTITION BY city ORDER BY avg(rating) DESC NULLS LAST, business) AS rn
  FROM reviews GROUP BY city, business HAVING count(*)>=5) WHERE rn=1""")


@query("city_winners", CITY_WINNERS)
def _(spark, sf):
    return c.city_winners(b.reviews(spark, sf))


def _trend(unit):
    @query(f"temporal_trends_{unit}", sql(TREND.format(unit=unit, where="")))
    def _(spark, sf):
        return c.temporal_trends(*rc(spark, sf), granularity=unit)


for _unit in ("day", "week", "month", "quarter", "year"):
    _trend(_unit)


@query("temporal_trends_filtered", sql(TREND.format(
    unit="quarter", where=f"AND business='{BUSINESS}' AND city='{CITY}'")))
def _(spark, sf):
    return c.temporal_trends(*rc(spark, sf), "quarter", BUSINESS, CITY)


def _recent_sql(days, where=""):
    return sql(f"""
SELECT id, business, city, text, rating, review_date_parsed, sentiment, rationale FROM rs
WHERE review_date_parsed >= DATE '{TODAY}' - {days} {where}""")


@query("recent_reviews", _recent_sql(30))
def _(spark, sf):
    return c.recent_reviews(*rc(spark, sf), TODAY, 30)


@query("recent_reviews_stored", _recent_sql(90))
def _(spark, sf):
    """The same over a store, whose reviews lie in folders by month: older months are not read."""
    base = b.scratch(spark)
    reviews, labels = rc(spark, sf)
    append_rows(reviews, base, "reviews")
    append_rows(labels, base, "classifications")
    stored = load_table(spark, base, "reviews", since=TODAY - timedelta(days=90))
    return c.recent_reviews(stored, load_table(spark, base, "classifications"), TODAY, 90)


@query("recent_reviews_filtered", _recent_sql(90, f"AND business='{BUSINESS}' AND sentiment='Négatif'"))
def _(spark, sf):
    return c.recent_reviews(*rc(spark, sf), TODAY, 90, BUSINESS, "Négatif")


def _distribution_sql(where="1=1"):
    return sql(f"""
SELECT label AS category, count(*) AS count, {r("100e0*count(*)/sum(count(*)) OVER ()")} AS percentage
FROM label_pairs p JOIN classifications c ON p.review_id=c.review_id JOIN reviews r ON r.id=c.review_id
WHERE {where} GROUP BY label""")


@query("category_distribution", _distribution_sql())
def _(spark, sf):
    return c.category_distribution(b.reviews(spark, sf), b.labelled(spark, sf))


@query("category_distribution_filtered", _distribution_sql(f"business='{BUSINESS}' AND city='{CITY}'"))
def _(spark, sf):
    return c.category_distribution(b.reviews(spark, sf), b.labelled(spark, sf), BUSINESS, CITY)


@query("category_distribution_negative", _distribution_sql("label_index BETWEEN 7 AND 13 OR label_index=16"))
def _(spark, sf):
    return c.category_distribution(b.reviews(spark, sf), b.labelled(spark, sf), category_type="negative")


def _flag_union(columns, name, where="1=1"):
    return " UNION ALL ".join(
        f"SELECT {quoted(CATEGORY_COLUMNS[x])} AS {name}, CAST(sum({x}) AS BIGINT) AS count "
        f"FROM flags f JOIN reviews r ON f.review_id=r.id WHERE {where}" for x in columns)


@query("category_distribution_flags", sql(f"""
SELECT category, count, {r("100e0*count/sum(count) OVER ()")} AS percentage
FROM ({_flag_union(CATEGORY_COLUMNS, "category")}) WHERE count>0"""))
def _(spark, sf):
    return c.category_distribution_flags(b.reviews(spark, sf), b.flags(spark, sf))


def _by_business(kind, columns):
    sums = ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in columns)

    @query(f"category_by_business_{kind}", sql(f"""
SELECT business, count(*) AS total_reviews, {sums}
FROM reviews r LEFT JOIN flags f ON r.id=f.review_id GROUP BY business"""))
    def _(spark, sf):
        return c.category_by_business(b.reviews(spark, sf), b.flags(spark, sf), kind)


_by_business("positive", POSITIVE_FLAGS)
_by_business("negative", NEGATIVE_FLAGS)


def _issues_sql(where="1=1", top=5):
    return sql(f"""SELECT issue, count FROM ({_flag_union(NEGATIVE_FLAGS, "issue", where)}) WHERE count>0
ORDER BY count DESC, issue LIMIT {top}""")


@query("top_issues", _issues_sql())
def _(spark, sf):
    return c.top_issues(b.reviews(spark, sf), b.flags(spark, sf))


@query("top_issues_business", _issues_sql(f"business='{BUSINESS}'", 3))
def _(spark, sf):
    return c.top_issues(b.reviews(spark, sf), b.flags(spark, sf), BUSINESS, 3)


@query("compare_businesses", sql(f"""
SELECT business, count(*) AS total_reviews, {AVG} AS avg_rating, {POS_RATE} AS positive_rate,
       {NEG_RATE} AS negative_rate, count(DISTINCT place_id) AS branch_count, count(DISTINCT city) AS city_coverage
FROM rs WHERE business IN {IN_BUSINESSES} GROUP BY business"""))
def _(spark, sf):
    return c.compare_businesses(*rc(spark, sf), BUSINESSES)


@query("business_rank", sql(f"""
SELECT business, {AVG} AS avg_rating, rank() OVER (ORDER BY avg(rating) DESC NULLS LAST) AS rating_rank
FROM reviews GROUP BY business HAVING count(*)>=10"""))
def _(spark, sf):
    return c.business_rank(b.reviews(spark, sf))


@query("place_rank", sql(f"""
SELECT place_id AS business, {AVG} AS avg_rating, rank() OVER (ORDER BY avg(rating) DESC NULLS LAST) AS rating_rank
FROM reviews GROUP BY place_id HAVING count(*)>=10"""))
def _(spark, sf):
    by_place = b.reviews(spark, sf).select(F.col("place_id").alias("business"), "rating")
    return c.business_rank(by_place)


POSITION = sql(f"""
, own AS (SELECT {AVG} AS avg_rating, {POS_RATE} AS positive_rate FROM rs WHERE business='{BUSINESS}'),
market AS (SELECT {AVG} AS market_avg_rating, {POS_RATE} AS market_positive_rate FROM rs),
ranks AS (SELECT business, rank() OVER (ORDER BY avg(rating) DESC NULLS LAST) AS rating_rank
          FROM reviews GROUP BY business HAVING count(*)>=10)
SELECT '{BUSINESS}' AS business, avg_rating, positive_rate, market_avg_rating, market_positive_rate,
       avg_rating-market_avg_rating AS rating_vs_market, positive_rate-market_positive_rate AS positive_vs_market,
       rating_rank, (SELECT count(DISTINCT business) FROM reviews) AS total_businesses
FROM own, market, ranks WHERE ranks.business='{BUSINESS}'""")


@query("competitive_position", POSITION)
def _(spark, sf):
    return c.competitive_position(*rc(spark, sf), BUSINESS)


REPORT = {
    "overview": sql(BUSINESS_STATS.format(where=f"WHERE business='{BUSINESS}'")),
    "by_city": sql(CITY_STATS.format(where=f"WHERE business='{BUSINESS}'")),
    "trends": sql(TREND.format(unit="month", where=f"AND business='{BUSINESS}'")),
    "top_issues": _issues_sql(f"business='{BUSINESS}'"),
    "competitive_position": POSITION,
    "recent_negative": _recent_sql(90, f"AND business='{BUSINESS}' AND sentiment='Négatif'"),
}


def _report(part):
    @query(f"business_report_{part}", REPORT[part])
    def _(spark, sf):
        return c.business_report(*rc(spark, sf), b.flags(spark, sf), BUSINESS, TODAY)[part]


for _part in REPORT:
    _report(_part)


@query("v_business_stats", sql(f"""
SELECT business, count(*) AS total_reviews, avg(rating) AS avg_rating, {POS} AS positive_count,
       {NEG} AS negative_count, {NEU} AS neutral_count, {POS_RATE} AS positive_rate FROM rs GROUP BY business"""))
def _(spark, sf):
    return c.v_business_stats(*rc(spark, sf))


V_CITY = f"""
SELECT city, count(*) AS total_reviews, avg(rating) AS avg_rating, count(DISTINCT place_id) AS place_count,
       count(DISTINCT business) AS business_count, {POS} AS positive_count, {NEG} AS negative_count
FROM rs GROUP BY city"""


@query("v_city_stats", sql(V_CITY))
def _(spark, sf):
    return c.v_city_stats(*rc(spark, sf))


@query("v_temporal_stats", sql(f"""
SELECT CAST(date_trunc('month', review_date_parsed) AS DATE) AS month, business, count(*) AS review_count,
       avg(rating) AS avg_rating, {POS} AS positive_count, {NEG} AS negative_count
FROM rs WHERE review_date_parsed IS NOT NULL GROUP BY 1, 2"""))
def _(spark, sf):
    return c.v_temporal_stats(*rc(spark, sf))


COUNTS = """
SELECT 'places' AS "table", count(*) AS rows FROM places UNION ALL SELECT 'reviews', count(*) FROM reviews
UNION ALL SELECT 'classifications', count(*) FROM classifications
UNION ALL SELECT 'review_categories', count(*) FROM flags UNION ALL SELECT 'processing_runs', 0"""


@query("table_stats", sql(COUNTS))
def _(spark, sf):
    return c.table_stats({
        "places": b.places(spark, sf), "reviews": b.reviews(spark, sf),
        "classifications": b.classifications(spark, sf), "review_categories": b.flags(spark, sf),
        "processing_runs": None,
    })


def _with_orphans(spark, sf):
    """Reviews against the suppliers' share of the places, so that orphans exist."""
    known = b.places(spark, sf).filter(F.col("potential") > 0)
    return b.reviews(spark, sf).filter(F.col("rating") > 1), known, b.classifications(spark, sf)


ORPHANS = """
SELECT 'orphan_reviews' AS "check", count(*) AS orphans FROM reviews r
LEFT JOIN (SELECT * FROM places WHERE potential>0) p ON r.place_id=p.place_id WHERE r.rating>1 AND p.place_id IS NULL
UNION ALL SELECT 'orphan_classifications', count(*) FROM classifications c
LEFT JOIN (SELECT * FROM reviews WHERE rating>1) r ON c.review_id=r.id WHERE r.id IS NULL"""


@query("integrity_report", sql(ORPHANS))
def _(spark, sf):
    return integrity_report(*_with_orphans(spark, sf))


VERIFY = {
    "table_stats": """SELECT 'places' AS "table", count(*) AS rows FROM places WHERE potential>0
UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE rating>1
UNION ALL SELECT 'classifications', count(*) FROM classifications""",
    "integrity_checks": ORPHANS,
    "sentiment_distribution": "SELECT sentiment, count(*) AS count FROM classifications GROUP BY sentiment",
}


def _verify(part):
    @query(f"verify_{part}", sql(VERIFY[part]))
    def _(spark, sf):
        return c.verify(*_with_orphans(spark, sf))[part]


for _part in VERIFY:
    _verify(_part)


FULL = """
SELECT r.id AS review_id, r.place_id, r.author, r.rating, r.text, r.review_date, r.review_date_parsed, r.language,
       r.business, r.city, r.agency_name, p.region, p.latitude, p.longitude, p.cluster_name, p.potential,
       c.sentiment, c.categories_json, c.rationale, c.model_version
FROM reviews r LEFT JOIN places p ON r.place_id=p.place_id LEFT JOIN classifications c ON r.id=c.review_id"""


@query("reviews_full", sql(FULL))
def _(spark, sf):
    return reviews_full(b.reviews(spark, sf), b.places(spark, sf), b.classifications(spark, sf))


@query("reviews_of_place_business_city", sql(
    f"SELECT id, place_id, rating FROM reviews WHERE business='{BUSINESS}' AND city='{CITY}' AND region='EUROPE'"))
def _(spark, sf):
    return filter_reviews(
        b.reviews(spark, sf), business=BUSINESS, city=CITY, region="EUROPE", place_id=None,
    ).select("id", "place_id", "rating")


@query("reviews_in_cities", sql(
    "SELECT id, city FROM reviews WHERE lower(city) IN ('nation_3', 'nation_10')"))
def _(spark, sf):
    return filter_in(b.reviews(spark, sf), "city", ["Nation_3", "NATION_10"], ignore_case=True).select("id", "city")


@query("place_lookup", sql("SELECT place_id, business, name, city FROM places WHERE place_id='42'"))
def _(spark, sf):
    return get_place(b.places(spark, sf), "42").select("place_id", "business", "name", "city")


@query("distinct_cities", sql("SELECT DISTINCT city FROM places WHERE city IS NOT NULL"))
def _(spark, sf):
    return distinct_sorted(b.places(spark, sf), "city")


@query("unclassified_reviews", sql("""
SELECT r.id, r.place_id, r.rating FROM reviews r LEFT JOIN classifications c ON r.id=c.review_id WHERE c.id IS NULL"""))
def _(spark, sf):
    return unclassified(b.reviews(spark, sf), b.classifications(spark, sf)).select("id", "place_id", "rating")


@query("some_reviews", sql("""
SELECT least(count(*), 25) AS rows, least(count(*), 25) AS known FROM reviews WHERE city='""" + CITY + "'"))
def _(spark, sf):
    """A limit without an order: the number of rows, and how many of them are reviews of the city."""
    some = filter_reviews(b.reviews(spark, sf), limit=25, city=CITY).select("id")
    real = b.reviews(spark, sf).filter(F.col("city") == CITY).select("id", F.lit(1).alias("real"))
    return some.join(real, "id", "left").agg(F.count("id").alias("rows"), F.count("real").alias("known"))


@query("flags_of_stored_reviews", sql("""
SELECT review_id, cat_frais_abusifs FROM flags WHERE review_id IN (SELECT id FROM reviews WHERE rating>1)"""))
def _(spark, sf):
    stored = b.reviews(spark, sf).filter(F.col("rating") > 1)
    return keep_existing(b.flags(spark, sf), stored).select("review_id", "cat_frais_abusifs")


@query("business_share_within_city", sql("""
SELECT city, business, count(*) AS n, 100e0*count(*)/sum(count(*)) OVER (PARTITION BY city) AS percentage
FROM reviews GROUP BY city, business"""))
def _(spark, sf):
    pairs = b.reviews(spark, sf).groupBy("city", "business").agg(F.count(F.lit(1)).alias("n"))
    return with_group_share(pairs, ["city"], "n")


def _tables(spark, sf):
    return {
        "reviews": b.reviews(spark, sf), "places": b.places(spark, sf),
        "classifications": b.classifications(spark, sf), "review_categories": b.flags(spark, sf),
    }


NAMED = {
    "business": ({}, sql(BUSINESS_STATS.format(where=""))),
    "city": ({"filter": CITY}, sql(CITY_STATS.format(where=f"WHERE city='{CITY}'"))),
    "ranking": ({"metric": "positive_rate", "top": 2}, sql(f"""
SELECT business, {POS_RATE} AS positive_rate, count(*) AS review_count FROM rs GROUP BY business
HAVING count(*)>=10 ORDER BY positive_rate DESC, business LIMIT 2""")),
    "winners": ({}, CITY_WINNERS),
    "trends": ({"granularity": "year"}, sql(TREND.format(unit="year", where=""))),
    "issues": ({"top": 4}, _issues_sql(top=4)),
    "compare": ({"businesses": ", ".join(BUSINESSES)}, sql(f"""
SELECT business, count(*) AS total_reviews, {AVG} AS avg_rating, {POS_RATE} AS positive_rate,
       {NEG_RATE} AS negative_rate, count(DISTINCT place_id) AS branch_count, count(DISTINCT city) AS city_coverage
FROM rs WHERE business IN {IN_BUSINESSES} GROUP BY business""")),
}


def _named(name, params, oracle):
    @query(f"run_query_{name}", oracle)
    def _(spark, sf):
        return run_query(_tables(spark, sf), name, **params)


for _name, (_params, _oracle) in NAMED.items():
    _named(_name, _params, _oracle)


@query("sql_over_views", sql(f"""
SELECT v.city, v.place_count, count(*) AS classified FROM ({V_CITY}) v
JOIN (SELECT r.city, c.sentiment FROM reviews r JOIN classifications c ON r.id=c.review_id) f ON f.city=v.city
GROUP BY v.city, v.place_count"""))
def _(spark, sf):
    register_frames(_tables(spark, sf))
    return spark.sql("""
        SELECT v.city, v.place_count, count(*) AS classified
        FROM v_city_stats v JOIN v_reviews_full f ON f.city = v.city
        WHERE f.sentiment IS NOT NULL GROUP BY v.city, v.place_count""")




# ------------------------------------------------------------------------------ sketches

@query("approx_distinct_counts", sql("""
, c AS (SELECT 'business' AS level, business AS name, count(DISTINCT place_id) AS places, count(DISTINCT id) AS ids
        FROM reviews GROUP BY business
        UNION ALL SELECT 'city', city, count(DISTINCT place_id), count(DISTINCT id) FROM reviews GROUP BY city
        UNION ALL SELECT 'all', '', count(DISTINCT place_id), count(DISTINCT id) FROM reviews)
SELECT level, name, places, ids, true AS places_close, true AS ids_close FROM c"""))
def _(spark, sf):
    """Sketches of the (business, city) cells united per business, per city and for all: within 3 % of the exact counts."""
    reviews = b.reviews(spark, sf)
    cells = distinct_sketches(reviews, ["business", "city"], ["place_id", "id"])

    def level(name, key):
        keys = [key] if key else []
        labels = [F.lit(name).alias("level"), (F.col(key) if key else F.lit("")).alias("name")]
        near = estimated(unite(cells, keys)).select(
            *labels, F.col("place_id").alias("near_places"), F.col("id").alias("near_ids"))
        exact = reviews.groupBy(*keys).agg(
            F.count_distinct("place_id").alias("places"), F.count_distinct("id").alias("ids")
        ).select(*labels, "places", "ids")
        return union_all(near, exact)

    counts = union_all(level("business", "business"), level("city", "city"), level("all", None))
    both = counts.groupBy("level", "name").agg(*[F.max(c).alias(c) for c in ("places", "ids", "near_places", "near_ids")])
    return both.select("level", "name", "places", "ids", *[
        (F.abs(F.col(f"near_{c}") - F.col(c)) <= 0.03 * F.col(c)).alias(f"{c}_close") for c in ("places", "ids")])
