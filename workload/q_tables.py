"""Keyed changes of tables, constraints, run log and imports."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vocalake.operators import mutate as m
from vocalake.operators.columns import complete, keep_valid
from vocalake.operators.ids import assign_ids
from vocalake.operators.validate import check_constraints, validate_reviews
from vocalake.plans.migration import import_csv, run_migration, split_classified
from vocalake.plans.store import append_rows, load_table, rejected_rows, sql as store_sql
from vocalake.schemas import CLASSIFICATIONS, PLACES, PROCESSING_RUNS, REVIEW_CATEGORIES, REVIEWS
from vocalake.sinks.writers import export_csv
from vocalake.streaming.incremental import incremental
from vocalake.taxonomy import CATEGORY_COLUMNS, COMPLETED, FLAG_COLUMNS

from . import roles as b
from .registry import query
from .roles import NOW, sql

KEY = "CAST(place_id AS BIGINT)"
LATER = datetime(2024, 2, 1)


def key():
    return F.col("place_id").cast("long")


# ------------------------------------------------------------------------------ places

def stored_places(spark, sf):
    rows = b.places(spark, sf).filter(key() % 2 == 0).withColumn("phone", F.lit("stored"))
    return complete(rows.withColumn("created_at", F.lit(NOW)), PLACES)


def incoming_places(spark, sf):
    """The places not stored yet and some stored ones, each twice; the second copy is the later one."""
    rows = b.places(spark, sf).filter((key() % 2 == 1) | (key() % 3 == 0)).select(
        "place_id", "business", "city", F.lit("incoming").alias("phone"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("line"))
    return rows.withColumn("name", F.concat(F.lit("New "), "place_id", F.lit(" "), F.col("line").cast("string")))


@query("upsert_places", sql(f"""
SELECT place_id, business, business_type, name, phone, potential, created, updated FROM (
  SELECT place_id, business, CASE WHEN {KEY}%2=0 THEN business_type END AS business_type,
    CASE WHEN {KEY}%2=1 OR {KEY}%3=0 THEN 'New '||place_id||' 2' ELSE name END AS name,
    CASE WHEN {KEY}%2=0 THEN 'stored' ELSE 'incoming' END AS phone,
    CASE WHEN {KEY}%2=1 OR {KEY}%3=0 THEN NULL ELSE potential END AS potential,
    CASE WHEN {KEY}%2=0 THEN DATE '2024-01-15' ELSE DATE '2024-02-01' END AS created,
    CASE WHEN {KEY}%2=1 OR {KEY}%3=0 THEN DATE '2024-02-01' END AS updated
  FROM places)"""))
def _(spark, sf):
    merged = m.upsert_places(stored_places(spark, sf), incoming_places(spark, sf), LATER, order=["line"])
    return merged.select(
        "place_id", "business", "business_type", "name", "phone", "potential",
        F.to_date("created_at").alias("created"), F.to_date("updated_at").alias("updated"))


@query("insert_places", sql(f"""
SELECT place_id, CASE WHEN {KEY}%2=0 THEN name ELSE 'New '||place_id||' 1' END AS name, city FROM places"""))
def _(spark, sf):
    raw = incoming_places(spark, sf).select(
        F.col("place_id").alias("canonical_place_id"), F.lit("old").alias("place_id"), F.col("business").alias("_business"),
        F.col("city").alias("_city"), F.col("name").alias("title"), "line")
    return m.insert_places(stored_places(spark, sf), raw, LATER, ["line"]).select("place_id", "name", "city")


# ------------------------------------------------------------------------------ reviews

def stored_reviews(spark, sf):
    """One stored review per place, author and text among the best rated."""
    rows = b.reviews(spark, sf).filter(F.col("rating") >= 4)
    first = rows.groupBy("place_id", "author", "text").agg(F.min("id").alias("id"), F.min("rating").alias("rating"))
    return complete(first, REVIEWS)


def raw_reviews(spark, sf):
    return b.reviews(spark, sf).select(
        F.col("place_id").alias("_place_id"), F.col("business").alias("_business"), F.col("city").alias("_city"),
        F.col("text").alias("review_snippet"), F.col("rating").cast("string").alias("review_rating"),
        F.when(F.col("id") % 9 != 0, F.col("author")).alias("review_name"), F.col("id").alias("line"))


NEW_REVIEWS = """
, stored AS (SELECT min(id) AS id, place_id, author, text, min(rating) AS rating FROM reviews WHERE rating>=4
             GROUP BY place_id, author, text),
raw AS (SELECT id AS line, place_id, CASE WHEN id%9<>0 THEN author END AS author, text, rating FROM reviews),
uniq AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY place_id, author, text ORDER BY line)=1),
numbered AS (SELECT *, (SELECT max(id) FROM stored)+row_number() OVER (ORDER BY line) AS id FROM uniq),
fresh AS (SELECT n.* FROM numbered n LEFT JOIN stored s
          ON s.place_id=n.place_id AND s.author=n.author AND s.text=n.text WHERE s.id IS NULL)"""


@query("insert_reviews", sql(NEW_REVIEWS + """
SELECT id, place_id, author, text, rating FROM stored UNION ALL SELECT id, place_id, author, text, rating FROM fresh"""))
def _(spark, sf):
    merged = m.insert_reviews(stored_reviews(spark, sf), raw_reviews(spark, sf), NOW, ["line"])
    return merged.select("id", "place_id", "author", "text", "rating")


@query("inserted_review_ids", sql(NEW_REVIEWS + "SELECT id, place_id, author, text FROM fresh"))
def _(spark, sf):
    """The rows an insert adds, with the ids they get."""
    fresh = m.new_reviews(stored_reviews(spark, sf), raw_reviews(spark, sf), NOW, ["line"])
    return fresh.select("id", "place_id", "author", "text")


@query("assign_ids", """
SELECT event_id, 1000+row_number() OVER (ORDER BY user_id, ts, event_id) AS id FROM events""")
def _(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return assign_ids(rows, ["user_id", "ts", "event_id"], after=1000).select("event_id", "id")


@query("incremental_reviews", sql("""
SELECT id, place_id FROM reviews WHERE id NOT IN (SELECT review_id FROM classifications)"""))
def _(spark, sf):
    done = b.classifications(spark, sf).select(F.col("review_id").alias("id"))
    return incremental(b.reviews(spark, sf), done, "id").select("id", "place_id")


# ------------------------------------------------------------------------------ classifications

def stored_labels(spark, sf):
    rows = b.classifications(spark, sf).filter(F.col("review_id") % 3 != 0)
    return complete(rows.withColumn("confidence_threshold", F.lit(0.7)), CLASSIFICATIONS)


def incoming_labels(spark, sf):
    """The labels not stored yet and some stored ones."""
    missing = F.col("review_id") % 3 == 0
    return b.classifications(spark, sf).filter(missing | (F.col("review_id") % 2 == 0)).select(
        "review_id", F.lit("Neutre").alias("sentiment"), F.lit("second look").alias("rationale"))


STORED_LABELS = """
, stored AS (SELECT id, review_id, sentiment, rationale FROM classifications WHERE review_id%3<>0),
inc AS (SELECT review_id, 'Neutre' AS sentiment, 'second look' AS rationale FROM classifications
        WHERE review_id%2=0 OR review_id%3=0)"""


@query("upsert_classifications", sql(STORED_LABELS + """
SELECT s.id, s.review_id, coalesce(i.sentiment, s.sentiment) AS sentiment, coalesce(i.rationale, s.rationale) AS rationale,
       0.7e0 AS confidence_threshold FROM stored s LEFT JOIN inc i USING (review_id)
UNION ALL SELECT (SELECT max(id) FROM stored)+row_number() OVER (ORDER BY review_id), review_id, sentiment, rationale, 0.55e0
FROM inc WHERE review_id NOT IN (SELECT review_id FROM stored)"""))
def _(spark, sf):
    merged = m.upsert_classifications(stored_labels(spark, sf), incoming_labels(spark, sf), LATER)
    return merged.select("id", "review_id", "sentiment", "rationale", "confidence_threshold")


@query("replace_classifications", sql(STORED_LABELS + """
SELECT id, review_id, sentiment, rationale, CAST(NULL AS BIGINT) AS processing_run_id FROM stored
WHERE review_id NOT IN (SELECT review_id FROM inc)
UNION ALL SELECT (SELECT max(id) FROM stored)+row_number() OVER (ORDER BY review_id), review_id, sentiment, rationale, 7
FROM inc"""))
def _(spark, sf):
    merged = m.replace_classifications(stored_labels(spark, sf), incoming_labels(spark, sf), LATER, run_id=7)
    return merged.select("id", "review_id", "sentiment", "rationale", "processing_run_id")


@query("upsert_flags", sql("SELECT review_id, " + ", ".join(
    f"CASE WHEN review_id%10<>0 THEN {c} ELSE 1-{c} END AS {c}" for c in FLAG_COLUMNS)
    + " FROM flags WHERE review_id IN (SELECT review_id FROM classifications) OR review_id%10=0"))
def _(spark, sf):
    stored = b.flags(spark, sf).select("review_id", *[(1 - F.col(c)).alias(c) for c in FLAG_COLUMNS])
    stored = complete(stored.filter(F.col("review_id") % 2 == 0), REVIEW_CATEGORIES)
    fresh = b.labelled(spark, sf).filter(F.col("categories_json").isNotNull())
    return m.upsert_flags(stored, fresh)


# ------------------------------------------------------------------------------ run log

def run_log(spark, sf):
    """One finished run per day with orders."""
    days = b.reviews(spark, sf).groupBy("review_date_parsed").agg(F.count(F.lit(1)).cast("int").alias("total_items"))
    rows = days.select(
        F.datediff("review_date_parsed", F.lit("1970-01-01").cast("date")).cast("long").alias("id"),
        F.when(F.dayofmonth("review_date_parsed") % 2 == 0, "collection").otherwise("classification").alias("run_type"),
        F.lit("completed").alias("status"), F.col("review_date_parsed").cast("timestamp").alias("started_at"),
        "total_items")
    return complete(rows, PROCESSING_RUNS)


RUN_LOG = """
, runs AS (SELECT CAST(review_date_parsed - DATE '1970-01-01' AS BIGINT) AS id,
  CASE WHEN day(review_date_parsed)%2=0 THEN 'collection' ELSE 'classification' END AS run_type, 'completed' AS status,
  review_date_parsed AS started, CAST(count(*) AS INTEGER) AS total_items FROM reviews GROUP BY review_date_parsed)"""


@query("run_log", sql(RUN_LOG + """
SELECT id, run_type, status, started, total_items, CAST(NULL AS INTEGER) AS processed_items,
       CAST(NULL AS VARCHAR) AS stats_json, CAST(NULL AS DATE) AS completed FROM runs
UNION ALL SELECT max(id)+1, 'migration', 'completed', DATE '2024-01-15', 5, 4, '{"rows": 4}', DATE '2024-02-01' FROM runs"""))
def _(spark, sf):
    opened = m.start_run(run_log(spark, sf), "migration", NOW, {"source": "x"}, total=5)
    done = m.update_run(opened, m.max_id(opened), LATER, COMPLETED, processed=4, stats={"rows": 4})
    return done.select(
        "id", "run_type", "status", F.to_date("started_at").alias("started"), "total_items", "processed_items",
        "stats_json", F.to_date("completed_at").alias("completed"))


@query("last_run", sql(RUN_LOG + """
SELECT id, run_type, total_items FROM runs WHERE run_type='collection' ORDER BY started DESC LIMIT 1"""))
def _(spark, sf):
    return m.last_run(run_log(spark, sf), "collection").select("id", "run_type", "total_items")


# ------------------------------------------------------------------------------ constraints

def _dirty_reviews(spark, sf):
    return b.reviews(spark, sf).select(
        "id", F.when(F.col("id") % 10 != 3, F.col("place_id")).alias("place_id"),
        F.when(F.col("id") % 7 != 0, F.col("rating") + (F.col("id") % 4).cast("int")).alias("rating"))


DIRTY = """
, dirty AS (SELECT id, CASE WHEN id%10<>3 THEN place_id END AS place_id,
                   CASE WHEN id%7<>0 THEN rating+CAST(id%4 AS INTEGER) END AS rating FROM reviews)"""


@query("keep_valid_columns", sql("""
SELECT id, place_id, CASE WHEN id%5<>0 THEN rating END AS rating, review_date_parsed FROM reviews"""))
def _(spark, sf):
    """Columns the table knows, in its types; what cannot be read in its type becomes null."""
    raw = b.reviews(spark, sf).select(
        F.col("id").cast("string"), F.lit("x").alias("stray"), "place_id",
        F.when(F.col("id") % 5 != 0, F.col("rating").cast("string")).otherwise("five").alias("rating"),
        F.col("review_date_parsed").cast("string"))
    return keep_valid(raw, REVIEWS)


@query("constraints_kept", sql(DIRTY + """
SELECT * FROM dirty WHERE place_id IS NOT NULL AND (rating IS NULL OR rating BETWEEN 0 AND 5)"""))
def _(spark, sf):
    return check_constraints(_dirty_reviews(spark, sf), "reviews")[0]


@query("constraints_rejected", sql(DIRTY + """
SELECT * FROM dirty WHERE place_id IS NULL OR (rating IS NOT NULL AND rating NOT BETWEEN 0 AND 5)"""))
def _(spark, sf):
    return check_constraints(_dirty_reviews(spark, sf), "reviews")[1]


@query("store_rejects_bad_rows", sql(DIRTY + """
, good AS (SELECT * FROM dirty WHERE place_id IS NOT NULL AND (rating IS NULL OR rating BETWEEN 0 AND 5)),
again AS (SELECT g.id FROM good g WHERE g.id%2=0)
SELECT id, 'stored' AS outcome, count(*) AS rows FROM good GROUP BY id
UNION ALL SELECT id, 'rejected', count(*) FROM (
  SELECT id FROM dirty WHERE place_id IS NULL OR (rating IS NOT NULL AND rating NOT BETWEEN 0 AND 5)
  UNION ALL SELECT id FROM again) GROUP BY id"""))
def _(spark, sf):
    """Rows that break a constraint are turned down, and so are those whose id is stored already."""
    base = b.scratch(spark)
    rows = _dirty_reviews(spark, sf)
    append_rows(rows, base, "reviews")
    append_rows(load_table(spark, base, "reviews").filter(F.col("id") % 2 == 0), base, "reviews")
    outcomes = load_table(spark, base, "reviews").select("id", F.lit("stored").alias("outcome")).unionByName(
        rejected_rows(spark, base, "reviews").select("id", F.lit("rejected").alias("outcome")))
    return outcomes.groupBy("id", "outcome").agg(F.count(F.lit(1)).alias("rows"))


@query("validate_reviews", sql(DIRTY + """
, v AS (SELECT id, CASE WHEN place_id IS NULL THEN 'missing snippet'
  WHEN rating IS NOT NULL AND rating NOT BETWEEN 1 AND 5 THEN 'invalid rating' END AS reason FROM dirty)
SELECT id, reason, reason IS NULL AS is_valid FROM v"""))
def _(spark, sf):
    checked = validate_reviews(_dirty_reviews(spark, sf), snippet="place_id")
    return checked.select("id", "reason", "is_valid")


# ------------------------------------------------------------------------------ classified import

def _flat_rows(spark, sf):
    """Reviews with labels, flags in one number, and place. Rows gain the columns of the place last, in one join."""
    labels = b.classifications(spark, sf).select(F.col("review_id").alias("id"), "sentiment", "rationale")
    masks = b.flag_masks(spark, sf).withColumnRenamed("review_id", "id")
    home = b.homes(spark, sf).join(b.places(spark, sf).select("place_id", "latitude", "longitude", "potential"), "place_id")
    rows = b.homeless_reviews(spark, sf).join(labels, "id").join(masks, "id", "left")
    return rows.withColumnRenamed("id", "line").join(home, "place_id")


def _flat_columns(rows):
    """Flat classified file: review, place and label columns; some rows lack a place id or text."""
    return rows.select(
        F.when(F.col("line") % 13 != 0, F.col("place_id")).alias("place_id"), F.col("business").alias("bank"),
        F.col("agency_name").alias("google_maps_name"), "city", "region", "latitude", "longitude", "potential",
        F.when(F.col("line") % 5 != 0, F.col("text")).alias("review_text"),
        F.when(F.col("line") % 6 != 0, F.col("author")).alias("review_name"),
        F.when(F.col("line") % 8 != 0, F.col("rating").cast("double")).alias("rating"), "review_date",
        F.col("review_date_parsed").cast("string").alias("month"), "sentiment", "rationale", "line",
        *[b.flag_of(F.col("mask"), c).cast("string").alias(CATEGORY_COLUMNS[c]) for c in FLAG_COLUMNS])


def flat_classified(spark, sf):
    return _flat_columns(_flat_rows(spark, sf))


CLASSIFIED = """
, flat AS (SELECT r.id AS line, r.place_id, business, r.agency_name, city, CASE WHEN r.id%5<>0 THEN text ELSE '' END AS text,
    CASE WHEN r.id%6<>0 THEN author ELSE 'Anonymous' END AS author, CASE WHEN r.id%8<>0 THEN rating ELSE 0 END AS rating,
    review_date_parsed, sentiment, c.rationale, f.* EXCLUDE (review_id)
  FROM reviews r JOIN classifications c ON c.review_id=r.id LEFT JOIN flags f ON f.review_id=r.id WHERE r.id%13<>0),
uniq AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY place_id, author, text ORDER BY line)=1),
num AS (SELECT *, row_number() OVER (ORDER BY line) AS id FROM uniq)"""

PARTS = {
    "places": (
        "SELECT place_id, arg_min(business, line) AS business, arg_min(agency_name, line) AS name, 'bank' AS business_type "
        "FROM flat GROUP BY place_id", ("place_id", "business", "name", "business_type")),
    "reviews": (
        "SELECT id, place_id, author, text, CAST(rating AS INTEGER) AS rating, review_date_parsed, business, city, "
        "agency_name, 'google_maps' AS source FROM num",
        ("id", "place_id", "author", "text", "rating", "review_date_parsed", "business", "city", "agency_name", "source")),
    "classifications": (
        "SELECT 500+id AS id, id AS review_id, sentiment, rationale, '[]' AS categories_json, 'gpt-4.1-mini' AS model_version, "
        "CAST(9 AS BIGINT) AS processing_run_id, 0.55e0 AS confidence_threshold FROM num",
        ("id", "review_id", "sentiment", "rationale", "categories_json", "model_version", "processing_run_id",
         "confidence_threshold")),
    "review_categories": (
        "SELECT id AS review_id, " + ", ".join(
            f"coalesce({c},0) AS {c}" for c in FLAG_COLUMNS) + " FROM num",
        ("review_id", *FLAG_COLUMNS)),
}


def _part(name, oracle, columns):
    @query(f"split_classified_{name}", sql(CLASSIFIED + oracle))
    def _(spark, sf):
        parts = split_classified(
            flat_classified(spark, sf), NOW, ["line"], after_classification=500, run_id=9)
        return parts[name].select(*columns)


for _name, (_oracle, _columns) in PARTS.items():
    _part(_name, _oracle, _columns)


MIGRATED = {
    "table_stats": """
SELECT 'places' AS "table", count(DISTINCT place_id) AS rows FROM flat UNION ALL SELECT 'reviews', count(*) FROM num
UNION ALL SELECT 'classifications', count(*) FROM num UNION ALL SELECT 'review_categories', count(*) FROM num
UNION ALL SELECT 'processing_runs', 1""",
    "integrity_checks": "SELECT unnest(['orphan_reviews','orphan_classifications']) AS \"check\", CAST(0 AS BIGINT) AS orphans",
    "sentiment_distribution": "SELECT sentiment, count(*) AS count FROM num GROUP BY sentiment",
}


def _flat_file(spark, sf):
    """The flat file as CSV in key order; returns (path, base of a fresh store)."""
    base = b.scratch(spark)
    rows = _flat_columns(_flat_rows(spark, sf).orderBy("line")).drop("line")
    export_csv(rows, f"{base}/flat.csv", wide=False)
    return f"{base}/flat.csv", f"{base}/store"


def _migration(part):
    @query(f"migration_{part}", sql(CLASSIFIED + MIGRATED[part]))
    def _(spark, sf):
        path, base = _flat_file(spark, sf)
        return run_migration(spark, path, base, NOW)[part]


for _name in MIGRATED:
    _migration(_name)


@query("import_twice", sql(CLASSIFIED + """
SELECT place_id, author, text, sentiment FROM num"""))
def _(spark, sf):
    """Importing the same file again must change nothing."""
    path, base = _flat_file(spark, sf)
    for _ in range(2):
        import_csv(spark, path, "classified_reviews", base, NOW)
    return store_sql(spark, base, """
        SELECT r.place_id, r.author, r.text, c.sentiment
        FROM reviews r JOIN classifications c ON c.review_id = r.id""")


@query("import_places_and_reviews", sql("""
SELECT p.city, count(*) AS reviews, count(DISTINCT p.place_id) AS places FROM (
  SELECT DISTINCT place_id, author, text FROM reviews) r JOIN places p ON p.place_id=r.place_id GROUP BY p.city"""))
def _(spark, sf):
    base = b.scratch(spark)
    places = b.places(spark, sf).select(
        F.col("place_id").alias("_place_id"), F.col("business").alias("_business"), F.col("city").alias("_city"),
        F.col("name").alias("title"), F.col("latitude").alias("lat"))
    reviews = b.reviews(spark, sf).select("place_id", "author", "rating", "text", "review_date")
    export_csv(places, f"{base}/places.csv", wide=False)
    export_csv(reviews, f"{base}/reviews.csv", wide=False)
    import_csv(spark, f"{base}/places.csv", "places", f"{base}/store", NOW)
    import_csv(spark, f"{base}/reviews.csv", "reviews", f"{base}/store", NOW)
    stored = load_table(spark, f"{base}/store", "places").select("place_id", "city")
    return load_table(spark, f"{base}/store", "reviews").drop("city").join(stored, "place_id").groupBy("city").agg(
        F.count(F.lit(1)).alias("reviews"), F.count_distinct("place_id").alias("places"))
