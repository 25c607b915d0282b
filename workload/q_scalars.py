"""Expressions: text, dates, numbers, category lists."""
from __future__ import annotations

from pyspark.sql import functions as F

from vocalake.functions import categories as cat, dates, numbers, text
from vocalake.operators.columns import category_columns
from vocalake.operators.filters import require
from vocalake.operators.mutate import category_flags, flags_from_wide
from vocalake.operators.normalize import normalize_reviews
from vocalake.operators.validate import validate_classification
from vocalake.sinks.writers import widen
from vocalake.taxonomy import (
    CATEGORIES, CATEGORY_COLUMNS, FLAG_COLUMNS, OTHER_NEGATIVE, OTHER_POSITIVE, SHORT_CATEGORY_NAMES,
)

from . import roles as b
from .registry import query
from .roles import LABEL_LIST, NOW, quoted, sql

SPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP = f"'^{SPACE_CLASS}+|{SPACE_CLASS}+$'"
NOW_SQL = f"TIMESTAMP '{NOW}'"


# ------------------------------------------------------------------------------ text

@query("normalize_whitespace", f"""
SELECT doc_id, md5(trim(regexp_replace(replace(text,' ',chr(160)||' '), '{SPACE_CLASS}+', ' ', 'g'))) AS text_md5
FROM documents""")
def _(spark, sf):
    spaced = F.replace(F.col("text"), F.lit(" "), F.lit("\u00a0 "))
    return b.documents(spark, sf).select("doc_id", F.md5(text.normalize_whitespace(spaced)).alias("text_md5"))


@query("normalize_whitespace_exact", f"""
SELECT doc_id, md5('fin 1⁄2 kg '||trim(regexp_replace(text, '{SPACE_CLASS}+', ' ', 'g'))) AS text_md5 FROM documents""")
def _(spark, sf):
    """Compatibility characters are composed as well: a ligature, a fraction, a unit."""
    odd = F.concat(F.lit("\u00a0ﬁn ½ ㎏\u3000"), "text")
    return b.documents(spark, sf).select("doc_id", F.md5(text.normalize_whitespace(odd, exact=True)).alias("text_md5"))


FOLDED = f"regexp_replace(strip_accents(regexp_replace(lower(text), {STRIP}, '', 'g')), '[^\\x00-\\x7F]', '', 'g')"


@query("fold_ascii", f"SELECT doc_id, md5({FOLDED}) AS folded_md5 FROM documents")
def _(spark, sf):
    return b.documents(spark, sf).select("doc_id", F.md5(text.fold_ascii(F.col("text"))).alias("folded_md5"))


@query("fold_ascii_exact", f"SELECT doc_id, md5({FOLDED}) AS folded_md5 FROM documents")
def _(spark, sf):
    return b.documents(spark, sf).select(
        "doc_id", F.md5(text.fold_ascii(F.col("text"), exact=True)).alias("folded_md5"))


MARKS = f"md5(trim(regexp_replace(lower(strip_accents(text)), '{SPACE_CLASS}+', ' ', 'g')))"


@query("fold_marks", f"SELECT conv_id, turn, {MARKS} AS folded_md5 FROM conversations")
def _(spark, sf):
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(text.fold_marks(F.col("text"))).alias("folded_md5"))


@query("clean_text", f"""
SELECT doc_id, md5(regexp_replace(coalesce(CASE WHEN doc_id%7=0 THEN NULL ELSE chr(160)||chr(10)||text||' '||chr(9) END,
       ''), {STRIP}, '', 'g')) AS text_md5 FROM documents""")
def _(spark, sf):
    padded = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("\u00a0\n"), "text", F.lit(" \t")))
    return b.documents(spark, sf).select("doc_id", F.md5(text.clean_text(padded)).alias("text_md5"))


@query("slug", "SELECT s_suppkey, replace(lower(s_name||' Main Branch'),' ','-') AS slug FROM supplier")
def _(spark, sf):
    return b.table(spark, sf, "supplier").select(
        "s_suppkey", text.slug(F.concat("s_name", F.lit(" Main Branch"))).alias("slug"))


_SHORT = "CASE " + " ".join(
    f"WHEN contains(lower(c),{quoted(full.lower())}) OR contains({quoted(full.lower())},lower(c)) THEN {quoted(short)}"
    for full, short in SHORT_CATEGORY_NAMES.items()
) + " ELSE CASE WHEN length(trim(split_part(c,'(',1)))>30 THEN substr(trim(split_part(c,'(',1)),1,30)||'...' " \
    "ELSE trim(split_part(c,'(',1)) END END"


@query("short_category", f"""
SELECT p_partkey, {_SHORT} AS short FROM (
  SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN upper(({LABEL_LIST})[p_partkey%17+1])
    WHEN 1 THEN p_name||' of an unknown sort of complaint (detail)' ELSE 'Qualité '||p_size||' (x)' END AS c FROM part)""")
def _(spark, sf):
    key = F.col("p_partkey")
    label = (
        F.when(key % 3 == 0, F.upper(b.label_of(key % 17)))
        .when(key % 3 == 1, F.concat("p_name", F.lit(" of an unknown sort of complaint (detail)")))
        .otherwise(F.concat(F.lit("Qualité "), F.col("p_size").cast("string"), F.lit(" (x)"))))
    return b.table(spark, sf, "part").select("p_partkey", text.short_category(label).alias("short"))


@query("sentiment_bucket", sql("""
SELECT sentiment, CASE sentiment WHEN 'Positif' THEN 'positive' WHEN 'Négatif' THEN 'negative'
  WHEN 'Neutre' THEN 'neutral' END AS bucket, count(*) AS n FROM rs GROUP BY 1, 2"""))
def _(spark, sf):
    rows = b.prepared(spark, sf).withColumn("bucket", text.sentiment_bucket(F.col("sentiment")))
    return rows.groupBy("sentiment", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("sentiment_from_category", sql("""
SELECT label_index, CASE WHEN contains(lower(label),'positif') THEN 'positive'
  WHEN contains(lower(label),'négatif') THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS n
FROM label_pairs GROUP BY 1, 2"""))
def _(spark, sf):
    label = b.label_of(F.col("label_index"))
    rows = b.pairs(spark, sf).withColumn("sentiment", text.sentiment_from_category(label))
    return rows.groupBy("label_index", "sentiment").agg(F.count(F.lit(1)).alias("n"))


KINDS = ("bank", "hôtel", "restaurant", "shop", "")


@query("search_queries", sql("""
, typed AS (SELECT place_id, business AS x, city AS y, (['bank','hôtel','restaurant','shop',''])[CAST(place_id AS BIGINT)%5+1] AS t FROM places),
lists AS (SELECT place_id, list_filter([
  x||' '||y, CASE WHEN t<>'' THEN x||' '||t||' '||y END,
  CASE WHEN t='bank' THEN x||' agence '||y END, CASE WHEN t='bank' THEN x||' succursale '||y END,
  CASE WHEN t='hôtel' THEN x||' hotel '||y END, CASE WHEN t='hôtel' THEN x||' resort '||y END,
  CASE WHEN t='restaurant' THEN x||' restaurant '||y END, CASE WHEN t='restaurant' THEN x||' cuisine '||y END,
  x||' '||y||' Morocco', x||' near '||y||' Morocco'], lambda q: q IS NOT NULL) AS qs FROM typed)
SELECT place_id, CAST(generate_subscripts(qs,1)-1 AS INTEGER) AS position, unnest(qs) AS phrase FROM lists"""))
def _(spark, sf):
    index = (F.col("place_id").cast("long") % 5 + 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), index)
    phrases = text.search_queries(F.col("business"), F.col("city"), kind)
    return b.places(spark, sf).select("place_id", F.posexplode(phrases).alias("position", "phrase"))


_POPULATION = "CAST(place_id AS BIGINT)*1000%900001"
_ZOOM = f"CASE WHEN {_POPULATION}>=800000 THEN '11z' WHEN {_POPULATION}>=200000 THEN '12z' " \
        f"WHEN {_POPULATION}>=50000 THEN '13z' ELSE '14z' END"


@query("city_center_text", sql(f"""
SELECT place_id, printf('@%.6f,%.6f,%s', latitude, longitude, {_ZOOM}) AS center, round(latitude,6) AS lat,
       round(longitude,6) AS lng, {_ZOOM} AS zoom FROM places"""))
def _(spark, sf):
    population = F.col("place_id").cast("long") * 1000 % 900001
    zoom = numbers.zoom_for_population(population)
    center = text.format_center(F.col("latitude"), F.col("longitude"), zoom)
    return b.places(spark, sf).select("place_id", center.alias("center")).withColumn(
        "p", text.parse_center(F.col("center"))).select("place_id", "center", "p.lat", "p.lng", "p.zoom")


@query("display_city", sql("""
SELECT place_id, CASE WHEN CAST(place_id AS BIGINT)%2=0 THEN city ELSE split_part(name,'#',1) END AS city FROM places"""))
def _(spark, sf):
    spaced = F.replace(F.col("name"), F.lit("#"), F.lit(" "))
    other = F.when(F.col("place_id").cast("long") % 2 == 0, F.create_map(F.lit("name:fr"), F.col("city")))
    return b.places(spark, sf).select("place_id", text.display_city(spaced, other).alias("city"))


@query("place_key", sql("""
SELECT place_id, coalesce(CASE WHEN CAST(place_id AS BIGINT)%3=0 THEN 'ChIJ'||place_id END,
  CASE WHEN CAST(place_id AS BIGINT)%3=1 THEN '0x'||place_id END, name||'-'||city) AS key FROM places"""))
def _(spark, sf):
    part = F.col("place_id").cast("long") % 3
    canonical = F.when(part == 0, F.concat(F.lit("ChIJ"), "place_id")).otherwise("")
    numeric = F.when(part == 1, F.concat(F.lit("0x"), "place_id"))
    return b.places(spark, sf).select(
        "place_id", text.place_key(canonical, numeric, F.col("name"), F.col("city")).alias("key"))


@query("canonical_place_ids", sql("""
SELECT place_id, CAST(place_id AS BIGINT)%4=0 AS canonical FROM places"""))
def _(spark, sf):
    part = F.col("place_id").cast("long") % 4
    candidate = (
        F.when(part == 0, F.concat(F.lit("ChIJ_-"), "place_id")).when(part == 1, F.concat(F.lit("ChIJ@"), "place_id"))
        .when(part == 2, F.lit("ChIJ")))
    return b.places(spark, sf).select("place_id", text.is_canonical_place_id(candidate).alias("canonical"))


@query("required_columns", sql("SELECT place_id FROM places WHERE potential>=0 AND CAST(place_id AS BIGINT)%5<>0"))
def _(spark, sf):
    rows = b.places(spark, sf).select(
        "place_id", F.when(F.col("potential") >= 0, F.col("latitude")).alias("latitude"),
        F.when(F.col("place_id").cast("long") % 5 != 0, F.col("name")).otherwise("").alias("name"))
    return require(rows, "latitude", "name").select("place_id")


# ------------------------------------------------------------------------------ dates

UNITS = {"minute": 60, "heure": 3600, "jour": 86400, "semaine": 604800, "mois": 2592000, "an": 31536000}
UNIT_LIST = "[" + ", ".join(f"'{u}'" for u in UNITS) + "]"
SECONDS_LIST = "[" + ", ".join(str(s) for s in UNITS.values()) + "]"


def relative_text():
    """"il y a 3 mois"-like text from the event id, with plural, prefix, word and no-break forms."""
    event = F.col("event_id")
    quantity = (event % 9).cast("int")
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (event % 6 + 1).cast("int"))
    plural = F.when((quantity > 1) & (unit != "mois"), "s").otherwise("")
    word = F.when(quantity == 1, F.when(unit.isin("minute", "heure", "semaine"), "une").otherwise("un")).otherwise(
        quantity.cast("string"))
    prefix = F.when(event % 4 == 0, "Modifié ").when(event % 4 == 1, " ").otherwise("")
    body = F.concat(prefix, F.lit("il y a "), word, F.lit("\u00a0"), unit, plural)
    return F.when(event % 10 == 7, "not a date").otherwise(body)


AGE = f"CASE WHEN event_id%10<>7 THEN (event_id%9)*({SECONDS_LIST})[event_id%6+1] END"
CREATED = f"{NOW_SQL} - to_seconds({AGE})"


@query("relative_french_dates", f"SELECT event_id, CAST(epoch({CREATED}) AS BIGINT) AS created_epoch FROM events")
def _(spark, sf):
    created = dates.parse_relative_french(relative_text(), NOW)
    return b.table(spark, sf, "events").select("event_id", F.unix_seconds(created).alias("created_epoch"))


@query("event_periods", "SELECT event_id, " + ", ".join(
    f"CAST(date_trunc('{u}', ts) AS DATE) AS {u}_start" for u in dates.GRANULARITIES)
    + ", CAST(ts AS DATE)-30 AS month_before FROM events")
def _(spark, sf):
    starts = [dates.period(F.col("ts"), u).alias(f"{u}_start") for u in dates.GRANULARITIES]
    return b.table(spark, sf, "events").select(
        "event_id", *starts, F.date_sub(F.col("ts").cast("date"), 30).alias("month_before"))


@query("dates_dayfirst", """
SELECT event_id, CASE WHEN event_id%9=4 THEN NULL ELSE CAST(ts AS DATE) END AS day,
       CAST(CASE WHEN event_id%9=4 THEN NULL ELSE year(ts) END AS INTEGER) AS year FROM events""")
def _(spark, sf):
    part, ts = F.col("event_id") % 9, F.col("ts")
    written = (
        F.when(part == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(part == 1, F.date_format(ts, "dd/MM/yyyy"))
        .when(part == 2, F.date_format(ts, "d-M-yyyy HH:mm")).when(part == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(part == 4, "soon").when(part == 5, F.date_format(ts, "dd/MM/yy")).when(part == 6, F.date_format(ts, "d MMM yyyy"))
        .when(part == 7, F.date_format(ts, "yyyy/M/d")).otherwise(F.date_format(ts, "dd MMMM yyyy")))
    parsed = dates.parse_date_dayfirst(written)
    return b.table(spark, sf, "events").select(
        "event_id", parsed.cast("date").alias("day"), F.year(parsed).alias("year"))


# ------------------------------------------------------------------------------ numbers

RAW_RATING = "CASE event_id%8 WHEN 0 THEN NULL WHEN 1 THEN 'invalid' ELSE CAST((event_id%15-2)/2e0 AS VARCHAR) END"


def raw_rating():
    part = F.col("event_id") % 8
    return F.when(part == 0, None).when(part == 1, "invalid").otherwise(
        ((F.col("event_id") % 15 - 2) / 2).cast("string"))


RATING_SQL = f"CAST(greatest(1,least(5,round_even(try_cast({RAW_RATING} AS DOUBLE),0))) AS INTEGER)"
CLEAN_RATING = f"CASE WHEN try_cast({RAW_RATING} AS DOUBLE) IS NOT NULL THEN {RATING_SQL} END"


@query("clean_ratings", f"SELECT event_id, try_cast({RAW_RATING} AS DOUBLE) AS raw, {CLEAN_RATING} AS rating FROM events")
def _(spark, sf):
    return b.table(spark, sf, "events").select(
        "event_id", numbers.to_number(raw_rating()).alias("raw"), numbers.clean_rating(raw_rating()).alias("rating"))


@query("distance_to_capital", sql("""
SELECT place_id, round(2*6371000e0*asin(sqrt(pow(sin(radians(34.0209-latitude)/2),2)
  +cos(radians(latitude))*cos(radians(34.0209))*pow(sin(radians(-6.8416-longitude)/2),2))),3) AS metres FROM places"""))
def _(spark, sf):
    metres = numbers.haversine_m(F.col("latitude"), F.col("longitude"), F.lit(34.0209), F.lit(-6.8416))
    return b.places(spark, sf).select("place_id", F.round(metres, 3).alias("metres"))


# ------------------------------------------------------------------------------ category lists

def _answers(spark, sf):
    """Classifications with the parsed list of their JSON."""
    rows = b.labelled(spark, sf)
    return rows.withColumn("categories", cat.parse_categories(F.col("categories_json")))


@query("parsed_categories", sql("""
SELECT review_id, label, confidence FROM label_pairs WHERE review_id IN (SELECT review_id FROM classifications)"""))
def _(spark, sf):
    return _answers(spark, sf).select("review_id", F.inline("categories"))


KEPT = """, kept AS (SELECT p.* FROM label_pairs p JOIN classifications USING (review_id)
  WHERE confidence>=0.7 AND label_index<>3),
rest AS (SELECT review_id, sentiment FROM classifications WHERE review_id NOT IN (SELECT review_id FROM kept))"""


@query("filtered_categories", sql(KEPT + "SELECT review_id, label, confidence FROM kept"))
def _(spark, sf):
    known = [c for i, c in enumerate(CATEGORIES) if i != 3]
    return _answers(spark, sf).select(
        "review_id", F.inline(cat.filter_categories(F.col("categories"), known, 0.7)))


@query("categories_with_fallback", sql(KEPT + f"""
SELECT review_id, label, confidence FROM kept UNION ALL
SELECT review_id, CASE sentiment WHEN 'Positif' THEN {quoted(OTHER_POSITIVE)} ELSE {quoted(OTHER_NEGATIVE)} END, 0.6e0
FROM rest WHERE sentiment<>'Neutre'"""))
def _(spark, sf):
    known = [c for i, c in enumerate(CATEGORIES) if i != 3]
    kept = cat.filter_categories(F.col("categories"), known, 0.7)
    final = cat.categories_json(cat.with_fallback(kept, F.col("sentiment")))
    return _answers(spark, sf).select("review_id", F.inline(cat.parse_categories(final)))



@query("category_flags", sql("SELECT c.review_id, " + ", ".join(
    f"coalesce({c},0) AS {c}" for c in FLAG_COLUMNS)
    + " FROM classifications c LEFT JOIN flags f ON f.review_id=c.review_id"))
def _(spark, sf):
    return category_flags(b.labelled(spark, sf))


@query("wide_categories", sql("SELECT c.review_id, " + ", ".join(
    f'coalesce({short},0) AS "{label}"' for short, label in CATEGORY_COLUMNS.items())
    + " FROM classifications c LEFT JOIN flags f ON f.review_id=c.review_id"))
def _(spark, sf):
    wide = widen(b.labelled(spark, sf))
    return wide.select("review_id", *[F.col(f"`{c}`") for c in CATEGORIES])


@query("flags_from_wide", sql(
    "SELECT review_id, " + ", ".join(FLAG_COLUMNS) + " FROM flags WHERE review_id IN (SELECT id FROM reviews WHERE rating>2)"))
def _(spark, sf):
    wide = b.flags(spark, sf).select("review_id", *[
        F.when(F.col(c) == 1, "1.0").alias(CATEGORY_COLUMNS[c]) for c in FLAG_COLUMNS])
    return flags_from_wide(wide, b.reviews(spark, sf).filter(F.col("rating") > 2))


@query("category_column_groups", sql("SELECT sum(" + "+".join(FLAG_COLUMNS[:7]) + ")::BIGINT AS positive, sum("
       + "+".join(FLAG_COLUMNS[7:14]) + ")::BIGINT AS negative, sum(" + "+".join(FLAG_COLUMNS[14:])
       + ")::BIGINT AS other FROM flags"))
def _(spark, sf):
    wide = b.flags(spark, sf).select("review_id", *[F.col(s).alias(c) for s, c in CATEGORY_COLUMNS.items()])
    groups = dict(zip(("positive", "negative", "other"), category_columns(wide)))
    return wide.agg(*[
        F.sum(sum((F.col(f"`{c}`") for c in cols), F.lit(0))).alias(name) for name, cols in groups.items()])


@query("validate_classifications", sql("""
, n AS (SELECT review_id, count(*) AS n FROM pairs GROUP BY review_id),
v AS (SELECT c.review_id, CASE WHEN c.review_id%7=0 THEN 'sentiment' WHEN coalesce(n,0)>3 THEN 'too many categories'
  WHEN c.review_id%11=0 THEN 'rationale' END AS reason FROM classifications c LEFT JOIN n ON n.review_id=c.review_id)
SELECT review_id, reason, reason IS NULL AS is_valid FROM v"""))
def _(spark, sf):
    rows = _answers(spark, sf).withColumns({
        "sentiment": F.when(F.col("review_id") % 7 != 0, F.col("sentiment")).otherwise("Positive"),
        "rationale": F.when(F.col("review_id") % 11 == 0, F.repeat(F.lit("x"), 301)).otherwise(F.col("rationale")),
    })
    return validate_classification(rows).select("review_id", "reason", "is_valid")


# ------------------------------------------------------------------------------ whole step

@query("normalize_reviews", f"""
SELECT event_id, {CLEAN_RATING} AS rating, CAST(epoch({CREATED}) AS BIGINT) AS created_epoch,
       CAST(date_trunc('month', {CREATED}) AS DATE) AS month,
       CASE WHEN event_id%6=0 THEN NULL ELSE round(value,2) END AS lat,
       coalesce(event_type,'') AS text, 'fes '||event_type AS city_normalized FROM events""")
def _(spark, sf):
    raw = b.table(spark, sf, "events").select(
        "event_id", raw_rating().alias("rating"), relative_text().alias("date"),
        F.when(F.col("event_id") % 6 == 0, "n/a").otherwise(F.round("value", 2).cast("string")).alias("lat"),
        F.concat(F.lit(" \n"), "event_type", F.lit("\u00a0")).alias("text"),
        F.concat(F.lit("  Fès "), "event_type").alias("city"))
    return normalize_reviews(raw, NOW).select(
        "event_id", "rating", F.unix_seconds("created_at").alias("created_epoch"), "month", "lat", "text",
        "city_normalized")
