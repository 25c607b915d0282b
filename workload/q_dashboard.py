"""Dashboard datasets and rollups."""
from __future__ import annotations

from pyspark.sql import functions as F

from vocalake.operators.columns import detect_roles, prepare_reviews
from vocalake.operators.geo import region_by_city
from vocalake.plans import dashboard as d
from vocalake.plans.rollups import ROLLUPS, build_aggregates, rollup_table
from vocalake.taxonomy import CATEGORY_COLUMNS, FLAG_COLUMNS

from . import roles as b
from .registry import query
from .roles import BUSINESSES, NEG, POS, ROLES, pct_sql, quoted, r, sql

IN_BUSINESSES = "(" + ", ".join(quoted(x) for x in BUSINESSES) + ")"
PCT_POS, PCT_NEG = pct_sql(POS, "count(*)"), pct_sql(NEG, "count(*)")


@query("kpis", sql(f"""
SELECT count(*) AS total_reviews, {PCT_POS} AS pct_positive, {PCT_POS}-50 AS positive_vs_50,
       {PCT_NEG} AS pct_negative, {PCT_NEG}-50 AS negative_vs_50, avg(rating) AS avg_rating FROM rs"""))
def _(spark, sf):
    return d.kpis(b.prepared(spark, sf), ROLES)


@query("avg_rating_by_business", sql("SELECT business, avg(rating) AS avg_rating FROM reviews GROUP BY business"))
def _(spark, sf):
    return d.avg_rating_by_business(b.prepared(spark, sf), ROLES)


@query("sentiment_counts", sql(
    "SELECT sentiment, count(*) AS count FROM rs WHERE sentiment IS NOT NULL GROUP BY sentiment"))
def _(spark, sf):
    return d.sentiment_counts(b.prepared(spark, sf), ROLES)


_STARS = ", ".join(
    f"{pct_sql(f'count(CASE WHEN rating={i} THEN 1 END)', 'count(rating)')} AS pct_{i}" for i in range(1, 6))


@query("rating_distribution", sql(f"SELECT business, {_STARS}, avg(rating) AS avg_rating FROM reviews GROUP BY business"))
def _(spark, sf):
    return d.rating_distribution(b.prepared(spark, sf), ROLES)


def _heatmap(kind, columns, direction):
    cells = " UNION ALL ".join(
        f"SELECT {quoted(CATEGORY_COLUMNS[c])} AS category, business, "
        f"{r(f'100e0*coalesce(sum({c}),0)/count(*)', 1)} AS percentage "
        "FROM reviews r LEFT JOIN flags f ON r.id=f.review_id GROUP BY business" for c in columns)

    @query(f"category_heatmap_{kind}", sql(f""", cells AS ({cells})
SELECT *, (rank-1)/CAST(greatest(1, count(*) OVER (PARTITION BY category)-1) AS DOUBLE) AS rank_normalized
FROM (SELECT *, rank() OVER (PARTITION BY category ORDER BY percentage {direction}) AS rank FROM cells)"""))
    def _(spark, sf):
        wide = b.flags(spark, sf).select("review_id", *[F.col(c).alias(CATEGORY_COLUMNS[c]) for c in columns])
        rows = b.reviews(spark, sf).select(F.col("id").alias("review_id"), "business").join(wide, "review_id", "left")
        return d.category_heatmap(rows, ROLES, [CATEGORY_COLUMNS[c] for c in columns], negative=kind == "negative")


_heatmap("negative", FLAG_COLUMNS[7:14], "ASC")
_heatmap("positive", FLAG_COLUMNS[0:7], "DESC")


@query("monthly_trend", sql("""
SELECT CAST(date_trunc('month', review_date_parsed) AS DATE) AS month, avg(rating) AS avg_rating, count(*) AS n_reviews
FROM reviews GROUP BY 1"""))
def _(spark, sf):
    return d.monthly_trend(b.prepared(spark, sf), ROLES)


@query("city_performance", sql("""
SELECT city, avg(rating) AS avg_rating, count(*) AS n_reviews FROM reviews GROUP BY city HAVING count(*)>=10
ORDER BY avg_rating DESC NULLS LAST, city LIMIT 20"""))
def _(spark, sf):
    return d.city_performance(b.prepared(spark, sf), ROLES)


@query("competitor_radar", sql(f"""
SELECT business, avg(rating)/5*100 AS rating_score, {PCT_POS} AS positive_score, 100e0-{PCT_NEG} AS negative_score,
       count(*)/CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM reviews GROUP BY business)) AS DOUBLE)*100
       AS volume_score
FROM rs WHERE business IN {IN_BUSINESSES} GROUP BY business"""))
def _(spark, sf):
    return d.competitor_radar(b.prepared(spark, sf), ROLES, BUSINESSES)


@query("leaderboard", sql(f"""
SELECT business, count(*) AS reviews, avg(rating) AS avg_rating, {PCT_POS} AS pct_positive, {PCT_NEG} AS pct_negative
FROM rs WHERE business IN {IN_BUSINESSES} GROUP BY business"""))
def _(spark, sf):
    return d.leaderboard(b.prepared(spark, sf), ROLES, BUSINESSES)


@query("city_table", sql(f"""
SELECT city, count(*) AS reviews, count(DISTINCT business) AS businesses, avg(rating) AS avg_rating,
       {PCT_POS} AS pct_positive FROM rs GROUP BY city ORDER BY reviews DESC, city LIMIT 30"""))
def _(spark, sf):
    return d.city_table(b.prepared(spark, sf), ROLES)


MATRIX = f"""
SELECT business, city, CASE WHEN count(*)>=3 THEN {r("avg(rating)")} END AS avg_rating FROM reviews
WHERE city IN (SELECT city FROM reviews GROUP BY city ORDER BY count(*) DESC, city LIMIT 15) GROUP BY business, city"""


@query("business_city_matrix", sql(MATRIX))
def _(spark, sf):
    return d.business_city_matrix(b.prepared(spark, sf), ROLES)


ALL_CITIES = tuple(f"NATION_{i}" for i in range(25))


@query("business_city_matrix_wide", sql("""
SELECT business, """ + ", ".join(
    f"CASE WHEN count(CASE WHEN city='{c}' THEN 1 END)>=3 THEN "
    + r(f"avg(CASE WHEN city='{c}' THEN rating END)") + f" END AS {c}" for c in ALL_CITIES)
    + " FROM reviews GROUP BY business"))
def _(spark, sf):
    matrix = d.business_city_matrix(b.prepared(spark, sf), ROLES, cities=len(ALL_CITIES))
    return d.pivot_matrix(matrix, ALL_CITIES)


@query("monthly_by_business", sql("""
SELECT CAST(date_trunc('month', review_date_parsed) AS DATE) AS month, business, avg(rating) AS avg_rating,
       count(*) AS n_reviews FROM reviews GROUP BY 1, 2"""))
def _(spark, sf):
    return d.monthly_by_business(b.prepared(spark, sf), ROLES)


@query("sentiment_evolution", sql("""
, m AS (SELECT CAST(date_trunc('month', review_date_parsed) AS DATE) AS month, sentiment, count(*) AS n
        FROM rs WHERE sentiment IS NOT NULL GROUP BY 1, 2)
SELECT a.month, s.sentiment, 100e0*coalesce(m.n,0)/sum(coalesce(m.n,0)) OVER (PARTITION BY a.month) AS percentage
FROM (SELECT DISTINCT month FROM m) a CROSS JOIN (SELECT DISTINCT sentiment FROM m) s
LEFT JOIN m ON m.month=a.month AND m.sentiment=s.sentiment"""))
def _(spark, sf):
    return d.sentiment_evolution(b.prepared(spark, sf), ROLES)


@query("sentiment_evolution_other_labels", sql("""
, t AS (SELECT review_date_parsed, CASE WHEN id%11=0 THEN 'Inconnu' WHEN id%13=0 THEN 'Error' ELSE sentiment END AS sentiment FROM rs),
m AS (SELECT CAST(date_trunc('month', review_date_parsed) AS DATE) AS month, sentiment, count(*) AS n
      FROM t WHERE sentiment IS NOT NULL GROUP BY 1, 2)
SELECT a.month, s.sentiment, 100e0*coalesce(m.n,0)/sum(coalesce(m.n,0)) OVER (PARTITION BY a.month) AS percentage
FROM (SELECT DISTINCT month FROM m) a CROSS JOIN (SELECT DISTINCT sentiment FROM m) s
LEFT JOIN m ON m.month=a.month AND m.sentiment=s.sentiment"""))
def _(spark, sf):
    label = F.when(F.col("id") % 11 == 0, "Inconnu").when(F.col("id") % 13 == 0, "Error").otherwise(F.col("sentiment"))
    return d.sentiment_evolution(b.prepared(spark, sf).withColumn("sentiment", label), ROLES)


def _mapped(spark, sf):
    """Places with a rating; those with a negative balance have no coordinates."""
    located = F.col("potential") >= 0
    return b.places(spark, sf).select(
        "place_id", "business", F.when(located, F.col("latitude")).alias("latitude"),
        F.when(located, F.col("longitude")).alias("longitude"),
        (F.col("place_id").cast("long") % 6).cast("int").alias("rating"))


@query("map_points", sql("""
SELECT place_id, latitude, longitude, rating,
       CASE WHEN rating=0 THEN 'gray' WHEN rating>=4 THEN 'green' WHEN rating>=3 THEN 'orange' ELSE 'red' END AS color
FROM (SELECT *, CAST(CAST(place_id AS BIGINT)%6 AS INTEGER) AS rating FROM places WHERE potential>=0)"""))
def _(spark, sf):
    return d.map_points(_mapped(spark, sf), ROLES).select("place_id", "latitude", "longitude", "rating", "color")


@query("map_center", sql("""
SELECT round(avg(latitude),6) AS center_lat, round(avg(longitude),6) AS center_lng FROM places WHERE potential>=0"""))
def _(spark, sf):
    center = d.map_center(_mapped(spark, sf))
    return center.select(*[F.round(c, 6).alias(c) for c in center.columns])


@query("collection_stats", sql(
    "SELECT count(DISTINCT place_id) AS total_places, count(*) AS total_reviews FROM reviews"))
def _(spark, sf):
    return d.collection_stats(b.reviews(spark, sf))


@query("resolution_stats", sql("""
SELECT count(*) AS total, count(CASE WHEN status<>'unresolved' THEN 1 END) AS resolved FROM (
  SELECT CASE WHEN potential<0 THEN 'unresolved' ELSE 'cache' END AS status FROM places)"""))
def _(spark, sf):
    return d.resolution_stats(b.places(spark, sf).withColumn(
        "resolve_status", F.when(F.col("potential") < 0, "unresolved").otherwise("cache")))


# Nation index -> a city name with and without accents, capitals and blanks, or an unknown one.
CITY_NAMES = ("Nador", " KÉNITRA ", "oUjDa", "Meknès", "Khénifra", "Atlantis", "Béni Mellal")
CITY_LIST = "[" + ", ".join(quoted(c) for c in CITY_NAMES) + "]"


def named_city(spark, sf):
    """Places with a real-world city name derived from their key."""
    index = (F.col("place_id").cast("long") % len(CITY_NAMES) + 1).cast("int")
    return b.places(spark, sf).drop("region").withColumn(
        "city", F.element_at(F.array(*[F.lit(c) for c in CITY_NAMES]), index))


NAMED_CITIES = f"""
, named AS (SELECT place_id, ({CITY_LIST})[CAST(place_id AS BIGINT)%{len(CITY_NAMES)}+1] AS city FROM places),
regioned AS (SELECT place_id, city, CASE strip_accents(lower(trim(city)))
  WHEN 'nador' THEN 'L''Oriental' WHEN 'kenitra' THEN 'Rabat-Salé-Kénitra' WHEN 'oujda' THEN 'L''Oriental'
  WHEN 'meknes' THEN 'Fès-Meknès' WHEN 'khenifra' THEN 'Béni Mellal-Khénifra'
  WHEN 'beni mellal' THEN 'Béni Mellal-Khénifra' END AS region FROM named)"""


@query("region_by_city", sql(NAMED_CITIES + "SELECT place_id, city, region FROM regioned"))
def _(spark, sf):
    return region_by_city(named_city(spark, sf)).select("place_id", "city", "region")


@query("region_by_city_unfolded", sql(NAMED_CITIES + """
SELECT place_id, city, CASE WHEN strip_accents(city)=city THEN region END AS region FROM regioned"""))
def _(spark, sf):
    return region_by_city(named_city(spark, sf), fold=False).select("place_id", "city", "region")


@query("region_coverage", sql(NAMED_CITIES + """
SELECT count(region) AS assigned, count(*) AS total, 100e0*count(region)/count(*) AS percentage FROM regioned"""))
def _(spark, sf):
    return d.region_coverage(region_by_city(named_city(spark, sf)))


@query("prepare_reviews", sql("""
SELECT id, review_date_parsed AS date, CAST(date_trunc('month', review_date_parsed) AS DATE) AS _month,
       CAST(year(review_date_parsed) AS INTEGER) AS _year, CAST(rating AS DOUBLE) AS rating, business
FROM reviews"""))
def _(spark, sf):
    raw = b.reviews(spark, sf).select(
        "id", F.date_format("review_date_parsed", "dd/MM/yyyy").alias("date"), F.col("rating").cast("string"),
        F.concat(F.lit(" "), "business", F.lit("\t")).alias("business"))
    done = prepare_reviews(raw, detect_roles(raw))
    return done.withColumn("date", F.to_date("date")).select("id", "date", "_month", "_year", "rating", "business")


# ------------------------------------------------------------------------------ rollups

def _labelled(spark, sf):
    labels = b.classifications(spark, sf).select(F.col("review_id").alias("id"), "sentiment")
    return b.reviews(spark, sf).join(labels, "id", "left").select(
        "business", "city", F.nullif("region", F.lit("ASIA")).alias("region"), "rating", "sentiment",
        F.trunc("review_date_parsed", "month").alias("month"))


ROLLUP_CTE = """
, lab AS (SELECT business AS business_id, city, nullif(region,'ASIA') AS region,
                 CAST(date_trunc('month', review_date_parsed) AS DATE) AS month, rating, sentiment FROM rs)"""
ROLLUP_MEASURES = """count(*) AS review_count, avg(rating) AS avg_rating,
  count(CASE WHEN sentiment='Positif' THEN 1 END)/CAST(nullif(count(sentiment),0) AS DOUBLE) AS positive_share,
  count(CASE WHEN sentiment='Négatif' THEN 1 END)/CAST(nullif(count(sentiment),0) AS DOUBLE) AS negative_share,
  count(CASE WHEN sentiment='Neutre' THEN 1 END)/CAST(nullif(count(sentiment),0) AS DOUBLE) AS neutral_share"""


def _rollup(name, keys):
    columns = ", ".join(keys)

    @query(f"rollup_{name}", sql(f"{ROLLUP_CTE} SELECT {columns}, {ROLLUP_MEASURES} FROM lab GROUP BY {columns}"))
    def _(spark, sf):
        return build_aggregates(_labelled(spark, sf))[name]


for _name, _keys in ROLLUPS.items():
    _rollup(_name, _keys)


def rollup_union():
    parts = []
    for name, keys in ROLLUPS.items():
        columns = ", ".join(
            k if k in keys else f"CAST(NULL AS {'DATE' if k == 'month' else 'VARCHAR'}) AS {k}"
            for k in ("business_id", "city", "region", "month"))
        parts.append(f"SELECT '{name}' AS rollup, {columns}, {ROLLUP_MEASURES} FROM lab GROUP BY {', '.join(keys)}")
    return sql(ROLLUP_CTE + " UNION ALL ".join(parts))


@query("rollup_table", rollup_union())
def _(spark, sf):
    return rollup_table(_labelled(spark, sf))


@query("rollup_table_without_business", sql(ROLLUP_CTE + " UNION ALL ".join(
    f"SELECT '{name}' AS rollup, " + ", ".join(
        k if k in keys else f"CAST(NULL AS {'DATE' if k == 'month' else 'VARCHAR'}) AS {k}" for k in ("city", "region", "month"))
    + f", {ROLLUP_MEASURES} FROM lab GROUP BY {', '.join(k for k in keys if k != 'business_id')}"
    for name, keys in ROLLUPS.items() if keys != ("business_id",))))
def _(spark, sf):
    return rollup_table(_labelled(spark, sf).drop("business"))
