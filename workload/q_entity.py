"""Regions from coordinates, place resolution, deduplication."""
from __future__ import annotations

import json
import os

from pyspark.sql import functions as F, types as T

from vocalake.operators.dedupe import dedupe_first
from vocalake.operators.entity import attach_place_metadata, consolidate_places, resolve_ids
from vocalake.operators.geo import add_region, city_aliases, city_centers, region_by_point
from vocalake.operators.joins import resolve_city, search_grid, union_all
from vocalake.schemas import GAZETTEER
from vocalake.sources.documents import (
    city_list, parse_place_payloads, parse_review_payloads, read_stored_lookup, write_lookup,
)
from vocalake.sources.regions import RING, describe_regions, read_regions

from . import roles as b
from .registry import query
from .roles import BUSINESSES, quoted, sql

# The region polygons, rectangles in file order.
with open(os.path.join(os.path.dirname(__file__), "regions.geojson"), encoding="utf-8") as _file:
    POLYGONS = [(f["properties"]["name"], f["geometry"]["coordinates"][0]) for f in json.load(_file)["features"]]
RECTANGLES = [
    (i, name, min(x for x, _ in ring), min(y for _, y in ring), max(x for x, _ in ring), max(y for _, y in ring))
    for i, (name, ring) in enumerate(POLYGONS)
]


def regions(spark):
    rows = [(i, name, [tuple(point) for point in ring]) for i, (name, ring) in enumerate(POLYGONS)]
    return describe_regions(spark.createDataFrame(rows, f"region_order int, region string, ring {RING}"))


REGION_ROWS = ", ".join(
    f"({i},{quoted(name)},{x0}::DOUBLE,{y0}::DOUBLE,{x1}::DOUBLE,{y1}::DOUBLE)"
    for i, name, x0, y0, x1, y1 in RECTANGLES)


def _located(points: str, fallback: str = "NULL") -> str:
    """Region of ``points`` (id, lat, lng, city): rectangle, nearest centre, then ``fallback``."""
    return f"""
, regs(o, name, x0, y0, x1, y1) AS (VALUES {REGION_ROWS}), pts AS ({points}),
ok AS (SELECT * FROM pts WHERE lng BETWEEN -17 AND -1 AND lat BETWEEN 21 AND 36),
hit AS (SELECT id, arg_min(name, o) AS name FROM ok JOIN regs ON lng>x0 AND lng<x1 AND lat>y0 AND lat<y1 GROUP BY id),
near AS (SELECT id, arg_min(name, (sqrt(pow(lng-(x0+x1)/2,2)+pow(lat-(y0+y1)/2,2)), o)) AS name
         FROM ok CROSS JOIN regs GROUP BY id),
found AS (SELECT p.id, coalesce(h.name, n.name) AS name, city FROM pts p LEFT JOIN hit h ON h.id=p.id
          LEFT JOIN near n ON n.id=p.id)
SELECT id AS place_id, coalesce(CASE name WHEN 'Oriental' THEN 'L''Oriental' ELSE name END, {fallback}) AS region
FROM found"""


@query("region_by_point", sql(_located("SELECT place_id AS id, latitude AS lat, longitude AS lng, city FROM places")))
def _(spark, sf):
    return region_by_point(b.places(spark, sf), regions(spark), "latitude", "longitude").select("place_id", "region")


@query("region_polygon_only", sql(_located(
    "SELECT place_id AS id, latitude AS lat, longitude AS lng, city FROM places").replace(
    "coalesce(h.name, n.name)", "h.name")))
def _(spark, sf):
    rows = region_by_point(b.places(spark, sf), regions(spark), "latitude", "longitude", nearest=False)
    return rows.select("place_id", "region")


CENTER_LISTS = [[round((r[i] + r[i + 2]) / 2, 2) for r in RECTANGLES] for i in (2, 3)]
_KEY = "CAST(place_id AS BIGINT)"
DENSE = f"""
SELECT place_id AS id, CASE WHEN {_KEY}%10=3 THEN NULL WHEN {_KEY}%10=4 THEN 50e0
         ELSE round(({CENTER_LISTS[1]}::DOUBLE[])[{_KEY}%12+1]+({_KEY}%100-50)/100e0,2) END AS lat,
       round(({CENTER_LISTS[0]}::DOUBLE[])[{_KEY}%12+1]+({_KEY}%90-45)/100e0,2) AS lng,
       (['Fès','Nowhere','SAFI'])[{_KEY}%3+1] AS city FROM places"""


def dense_points(spark, sf):
    """Points around the region centres; some have text, missing or out-of-bounds latitudes."""
    key = F.col("place_id").cast("long")
    centers = [F.array(*[F.lit(v) for v in values]) for values in CENTER_LISTS]
    slot = (key % 12 + 1).cast("int")
    lat = F.round(F.element_at(centers[1], slot) + (key % 100 - 50) / 100.0, 2)
    lng = F.round(F.element_at(centers[0], slot) + (key % 90 - 45) / 100.0, 2)
    return b.places(spark, sf).select(
        "place_id", F.when(key % 10 == 3, "n/a").when(key % 10 == 4, "50").otherwise(lat.cast("string")).alias("lat"),
        lng.alias("lng"),
        F.element_at(F.array(F.lit("Fès"), F.lit("Nowhere"), F.lit("SAFI")), (key % 3 + 1).cast("int")).alias("city"))


@query("add_region", sql(_located(
    DENSE, "CASE city WHEN 'Fès' THEN 'Fès-Meknès' WHEN 'SAFI' THEN 'Marrakech-Safi' END")))
def _(spark, sf):
    return add_region(dense_points(spark, sf), regions(spark)).select("place_id", "region")


def _square(x0, y0, x1, y1, clockwise=False):
    ring = [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    return ring[::-1] if clockwise else ring


# Every region gets a hole off its centre, every second one also a part to the east of it.
PARTS = [
    (i, name, (x0, y0, x1, y1), tuple(round(v, 2) for v in (x0 + 0.1, y0 + 0.1, x0 + 0.3, y0 + 0.4)),
     tuple(round(v, 2) for v in (x1 + 0.06, y0 + 0.1, x1 + 0.18, y1 - 0.1)) if i % 2 == 0 else None)
    for i, name, x0, y0, x1, y1 in RECTANGLES
]


def _feature(i, name, outer, hole, part):
    first = [_square(*outer, clockwise=i % 3 == 0), _square(*hole, clockwise=i % 4 == 0)]
    if part is None:
        geometry = {"type": "Polygon", "coordinates": first}
    elif i % 4 == 0:
        geometry = {"type": "MultiPolygon", "coordinates": [first, [_square(*part)]]}
    else:
        geometry = {"type": "GeometryCollection", "geometries": [
            {"type": "Polygon", "coordinates": first}, {"type": "Polygon", "coordinates": [_square(*part)]}]}
    return {"type": "Feature", "properties": {"name": name}, "geometry": geometry}


def _part_rows():
    def box(corners):
        return ",".join("NULL" if corners is None else f"{v}::DOUBLE" for v in corners or (0, 0, 0, 0))

    return ", ".join(f"({i},{quoted(name)},{box(outer)},{box(hole)},{box(part)})" for i, name, outer, hole, part in PARTS)


@query("region_parts_and_holes", sql(f"""
, regs(o, name, x0, y0, x1, y1, hx0, hy0, hx1, hy1, px0, py0, px1, py1) AS (VALUES {_part_rows()}),
weighed AS (
  SELECT *, (x1-x0)*(y1-y0) AS a, (hx1-hx0)*(hy1-hy0) AS h, coalesce((px1-px0)*(py1-py0), 0) AS p FROM regs),
centered AS (
  SELECT *, ((x0+x1)/2*a-(hx0+hx1)/2*h+coalesce((px0+px1)/2, 0)*p)/(a-h+p) AS cx,
         ((y0+y1)/2*a-(hy0+hy1)/2*h+coalesce((py0+py1)/2, 0)*p)/(a-h+p) AS cy FROM weighed),
pts AS ({DENSE}),
ok AS (SELECT * FROM pts WHERE lng BETWEEN -17 AND -1 AND lat BETWEEN 21 AND 36),
hit AS (
  SELECT id, arg_min(name, o) AS name FROM ok JOIN regs
  ON (lng>x0 AND lng<x1 AND lat>y0 AND lat<y1 AND NOT (lng>=hx0 AND lng<=hx1 AND lat>=hy0 AND lat<=hy1))
     OR (lng>px0 AND lng<px1 AND lat>py0 AND lat<py1) GROUP BY id),
near AS (SELECT id, arg_min(name, (sqrt(pow(lng-cx,2)+pow(lat-cy,2)), o)) AS name FROM ok CROSS JOIN centered GROUP BY id)
SELECT p.id AS place_id, CASE h.name WHEN 'Oriental' THEN 'L''Oriental' ELSE h.name END AS inside,
       CASE coalesce(h.name, n.name) WHEN 'Oriental' THEN 'L''Oriental' ELSE coalesce(h.name, n.name) END AS region
FROM pts p LEFT JOIN hit h ON h.id=p.id LEFT JOIN near n ON n.id=p.id"""))
def _(spark, sf):
    path = f"{b.scratch(spark)}/parts"
    collection = {"type": "FeatureCollection", "features": [_feature(*row) for row in PARTS]}
    spark.createDataFrame([(json.dumps(collection),)], "value string").coalesce(1).write.text(path)
    found = read_regions(spark, path)
    inside = region_by_point(dense_points(spark, sf), found, nearest=False).withColumnRenamed("region", "inside")
    return region_by_point(inside, found).select("place_id", "inside", "region")


# ------------------------------------------------------------------------------ gazetteer

def gazetteer(spark, sf):
    """Customers of a nation as gazetteer entries of one city, with their order in the file."""
    key = F.col("place_id").cast("long")
    rows = b.places(spark, sf).select(
        F.concat(F.lit("Ville "), "city").alias("name"),
        F.when(key % 5 != 0, "city").otherwise("town").alias("type"), F.lit(None).cast("string").alias("inferred_type"),
        (key * 1000 % 900001).alias("population"), F.array("longitude", "latitude").alias("location"),
        F.struct(F.when(key % 7 != 0, "ma").otherwise("fr").alias("country_code"),
                 F.concat(F.lit("É"), "city").alias("city")).alias("address"),
        F.when(key % 2 == 0, F.create_map(F.lit("name:fr"), F.col("city"), F.lit("alt"), F.concat(F.lit("Le  "), "city")))
        .alias("other_names"), key.alias("order"))
    return rows.to(T.StructType([*GAZETTEER, T.StructField("order", T.LongType())]))


_ELIGIBLE = f"{_KEY}%5<>0 AND {_KEY}%7<>0"
_CANONICAL = f"CASE WHEN {_KEY}%2=0 THEN city ELSE 'Ville '||city END"


CENTERS = f"""
SELECT key, arg_max(value, k) AS value FROM (
  SELECT {_KEY} AS k, {_CANONICAL} AS key, printf('@%.6f,%.6f,%s', latitude, longitude,
    CASE WHEN {_KEY}*1000%900001>=800000 THEN '11z' WHEN {_KEY}*1000%900001>=200000 THEN '12z'
         WHEN {_KEY}*1000%900001>=50000 THEN '13z' ELSE '14z' END) AS value FROM places WHERE {_ELIGIBLE})
GROUP BY key"""
ALIASES = f"""
SELECT key, arg_max(value, k) AS value FROM (
  SELECT {_KEY} AS k, {_CANONICAL} AS value, city,
    unnest([lower('Ville '||city), lower('E'||city), CASE WHEN {_KEY}%2=0 THEN lower(city) END,
            CASE WHEN {_KEY}%2=0 THEN lower('Le '||city) END]) AS key FROM places WHERE {_ELIGIBLE})
WHERE key IS NOT NULL GROUP BY key"""


@query("city_centers", sql(CENTERS))
def _(spark, sf):
    return city_centers(gazetteer(spark, sf), F.col("order"))


@query("city_aliases", sql(ALIASES))
def _(spark, sf):
    return city_aliases(gazetteer(spark, sf), F.col("order"))


@query("city_list", sql(f"SELECT DISTINCT CASE WHEN {_KEY}%2=0 THEN city ELSE 'Ville' END AS city FROM places"))
def _(spark, sf):
    return city_list(gazetteer(spark, sf))


# ------------------------------------------------------------------------------ payloads

def _place_hit(offset: int):
    k = F.col("place_id").cast("long")
    return F.struct(
        F.col("name").alias("title"),
        F.when(k % 4 == 0, F.concat(F.lit("ChIJ"), (k - k % 8 + offset).cast("string"))).when(k % 4 == 1, "bad id")
        .alias("place_id"),
        F.when(k % 6 != 0, F.col("city")).alias("address"),
        F.struct("latitude", "longitude").alias("gps_coordinates"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise((k % 50) / 10.0).alias("rating"),
        ((k + offset) % 5 + 0.5).alias("stars"),
        F.when(k % 3 != 0, k % 100).alias("reviews"), (k % 7).alias("number_of_reviews"),
        F.when(k % 2 == 0, "").alias("data_id"), F.when(k % 4 != 3, F.concat(F.lit("n"), (k % 200).cast("string")))
        .alias("cid"),
        F.lit("bank").alias("category"), F.lit("+212").alias("phone"),
    )


def payloads(spark, sf):
    """One search payload per place: two hits, or one under the older key."""
    k = F.col("place_id").cast("long")
    both = F.to_json(F.struct(F.array(_place_hit(0), _place_hit(8)).alias("local_results")))
    older = F.to_json(F.struct(F.expr("array()").alias("local_results"), F.array(_place_hit(0)).alias("places")))
    strategy = F.greatest((k % 3).cast("int"), (F.length("city") % 2).cast("int"))
    return b.places(spark, sf).select(
        k.alias("seq"), "business", "business_type", "city", strategy.alias("strategy"),
        F.concat(F.lit("maps_"), strategy.cast("string")).alias("_engine"),
        F.when(k % 3 == 0, older).otherwise(both).alias("payload"))


HITS = f"""
, h AS (
  SELECT {_KEY} AS seq, {_KEY} AS k, o.hit, business, business_type, city, name, latitude AS lat, longitude AS lng,
    CASE WHEN {_KEY}%6<>0 THEN city ELSE '' END AS address,
    CASE WHEN {_KEY}%4=0 THEN 'ChIJ'||({_KEY}-{_KEY}%8+8*o.hit) END AS place_id,
    CASE WHEN {_KEY}%4<>3 THEN 'n'||({_KEY}%200) END AS data_id, 'bank' AS type,
    CASE WHEN {_KEY}%5=0 OR {_KEY}%50=0 THEN ({_KEY}+8*o.hit)%5+0.5e0 ELSE ({_KEY}%50)/10e0 END AS rating,
    coalesce(nullif(CASE WHEN {_KEY}%3<>0 THEN {_KEY}%100 END,0), nullif({_KEY}%7,0)) AS reviews_count,
    '+212' AS phone, CAST(NULL AS VARCHAR) AS website, greatest({_KEY}%3, length(city)%2) AS strategy
  FROM places JOIN (VALUES (0),(1)) o(hit) ON o.hit=0 OR {_KEY}%3<>0)"""


@query("parse_place_payloads", sql(HITS + """
SELECT seq, CAST(hit AS INTEGER) AS hit, name, address, lat, lng, place_id, data_id, type, rating, reviews_count, phone,
       website FROM h"""))
def _(spark, sf):
    return parse_place_payloads(payloads(spark, sf)).drop("business", "business_type", "city", "strategy", "_engine")


@query("consolidate_places", sql(HITS + """
, branded AS (SELECT * FROM h WHERE regexp_matches(name, '[0-8]$')),
strong AS (SELECT * FROM branded QUALIFY strategy = min(strategy) OVER (PARTITION BY business, city)),
loc AS (SELECT * FROM strong QUALIFY row_number() OVER (
  PARTITION BY business, city, coalesce(place_id, name||'-'||address) ORDER BY seq, hit)=1),
uniq AS (SELECT * FROM loc QUALIFY row_number() OVER (
  PARTITION BY coalesce(place_id, data_id, name||'-'||address) ORDER BY seq, hit)=1),
cache AS (SELECT 'n'||s_suppkey AS key, 'ChIJsup'||s_suppkey AS value FROM supplier),
k AS (SELECT u.*, coalesce(data_id, place_id) AS ck, c.value AS cached FROM uniq u
      LEFT JOIN cache c ON c.key=coalesce(data_id, place_id)),
f AS (SELECT ck, min((seq, hit)) AS first_order, arg_min(place_id, (seq, hit)) AS first_id FROM k
      WHERE cached IS NULL AND place_id IS NOT NULL AND ck IS NOT NULL GROUP BY ck)
SELECT business, business_type, name, address, city, lat, lng, place_id, data_id, type, rating, reviews_count, phone,
  website, 'maps_'||strategy AS _engine,
  CASE WHEN cached IS NOT NULL THEN cached WHEN first_order<(seq, hit) THEN first_id ELSE place_id END
    AS canonical_place_id,
  CASE WHEN cached IS NOT NULL OR first_order<(seq, hit) THEN 'cache' WHEN place_id IS NOT NULL
    THEN 'already_canonical' ELSE 'unresolved' END AS resolve_status
FROM k LEFT JOIN f ON f.ck=k.ck"""))
def _(spark, sf):
    cache = b.table(spark, sf, "supplier").select(
        F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("key"),
        F.concat(F.lit("ChIJsup"), F.col("s_suppkey").cast("string")).alias("value"))
    hits = parse_place_payloads(payloads(spark, sf))
    return consolidate_places(hits, cache, ["seq", "hit"], brand="[0-8]$")[0]


RESOLVABLE = f"""
, p AS (SELECT {_KEY} AS k, CASE {_KEY}%3 WHEN 0 THEN 'ChIJ'||place_id WHEN 1 THEN 'x'||place_id END AS pid,
               CASE WHEN {_KEY}%5<>0 THEN 'n'||({_KEY}%400) END AS did FROM places),
cache AS (SELECT 'n'||s_suppkey AS key, 'ChIJsup'||s_suppkey AS value FROM supplier),
ans AS (SELECT 'n'||n AS key, CASE WHEN n%3=0 THEN 'ChIJapi'||n END AS value, n%3=1 AS failed
        FROM (SELECT DISTINCT {_KEY}%400 AS n FROM places) WHERE n%2=1),
j AS (SELECT p.*, coalesce(did,pid) AS ck, cache.value AS cached, ans.value AS answer, ans.failed,
             CASE WHEN k%3=0 THEN pid ELSE ans.value END AS own FROM p
      LEFT JOIN cache ON cache.key=coalesce(did,pid) LEFT JOIN ans ON ans.key=coalesce(did,pid)),
f AS (SELECT ck, min(k) AS first_k, arg_min(own,k) AS first_own FROM j
      WHERE cached IS NULL AND own IS NOT NULL AND ck IS NOT NULL GROUP BY ck)"""


def _resolvable(spark, sf):
    k = F.col("place_id").cast("long")
    rows = b.places(spark, sf).select(
        k.alias("k"),
        F.when(k % 3 == 0, F.concat(F.lit("ChIJ"), "place_id")).when(k % 3 == 1, F.concat(F.lit("x"), "place_id"))
        .alias("place_id"),
        F.when(k % 5 != 0, F.concat(F.lit("n"), (k % 400).cast("string"))).otherwise("").alias("data_id"))
    n = F.col("n")
    answers = b.places(spark, sf).select((k % 400).alias("n")).distinct().filter(n % 2 == 1).select(
        F.concat(F.lit("n"), n.cast("string")).alias("key"),
        F.when(n % 3 == 0, F.concat(F.lit("ChIJapi"), n.cast("string"))).alias("value"), (n % 3 == 1).alias("failed"))
    return rows, answers


def _resolved(spark, sf):
    rows, answers = _resolvable(spark, sf)
    supplier = F.col("s_suppkey").cast("string")
    cache = b.table(spark, sf, "supplier").select(
        F.concat(F.lit("n"), supplier).alias("key"), F.concat(F.lit("ChIJsup"), supplier).alias("value"))
    return resolve_ids(rows, cache, ["k"], answers)


@query("resolve_ids_second_run", sql(RESOLVABLE + """
SELECT k, pid AS place_id, coalesce(cached, first_own, own) AS canonical_place_id,
  CASE WHEN coalesce(cached, first_own) IS NOT NULL THEN 'cache' WHEN k%3=0 THEN 'already_canonical'
       WHEN failed THEN 'error' ELSE 'unresolved' END AS resolve_status
FROM j LEFT JOIN f ON f.ck=j.ck"""))
def _(spark, sf):
    """What the first run found is stored and serves the second run from the cache."""
    path = f"{b.scratch(spark)}/ids"
    write_lookup(_resolved(spark, sf)[1], path)
    rows, answers = _resolvable(spark, sf)
    return resolve_ids(rows, read_stored_lookup(spark, path), ["k"], answers)[0].select(
        "k", "place_id", "canonical_place_id", "resolve_status")


@query("resolve_ids", sql(RESOLVABLE + """
SELECT k, coalesce(pid, NULL) AS place_id,
  CASE WHEN cached IS NOT NULL THEN cached WHEN first_k<k THEN first_own ELSE own END AS canonical_place_id,
  CASE WHEN cached IS NOT NULL OR first_k<k THEN 'cache' WHEN k%3=0 THEN 'already_canonical'
       WHEN own IS NOT NULL THEN 'api_resolved' WHEN failed THEN 'error' ELSE 'unresolved' END AS resolve_status
FROM j LEFT JOIN f ON f.ck=j.ck"""))
def _(spark, sf):
    return _resolved(spark, sf)[0].select("k", "place_id", "canonical_place_id", "resolve_status")


@query("resolve_ids_cache", sql(RESOLVABLE + """
SELECT key, value FROM cache UNION ALL SELECT ck, first_own FROM f"""))
def _(spark, sf):
    return _resolved(spark, sf)[1]


@query("parse_review_payloads", sql("""
SELECT place_id, CAST(page AS INTEGER) AS page, position, name, local_guide, rating, date, snippet FROM (
  SELECT place_id, CAST(place_id AS BIGINT)%3+1 AS page, 0 AS position, business AS name,
    CAST(place_id AS BIGINT)%2=0 AS local_guide, 4e0 AS rating, 'il y a un an' AS date,
    CASE WHEN CAST(place_id AS BIGINT)%2=0 THEN name ELSE 'long '||name END AS snippet FROM places
  UNION ALL SELECT place_id, CAST(place_id AS BIGINT)%3+1, 1, NULL, NULL, NULL, NULL, city FROM places)"""))
def _(spark, sf):
    k = F.col("place_id").cast("long")
    review = F.struct(
        F.struct(F.col("business").alias("name"), (k % 2 == 0).alias("local_guide")).alias("user"),
        F.lit(4.0).alias("rating"), F.lit("il y a un an").alias("date"),
        F.when(k % 2 == 0, F.col("name")).otherwise("").alias("snippet"),
        F.concat(F.lit("long "), "name").alias("content"))
    bare = F.concat(F.lit(',{"snippet":"'), "city", F.lit('"}]}'))
    payload = F.concat(F.lit('{"reviews":['), F.to_json(review), bare)
    rows = b.places(spark, sf).select("place_id", (k % 3 + 1).cast("int").alias("page"), payload.alias("payload"))
    return parse_review_payloads(rows).select(
        "place_id", "page", "position", "name", "local_guide", "rating", "date", "snippet")


# ------------------------------------------------------------------------------ joins and dedupe

def flat_reviews(spark, sf):
    """Reviews with the metadata of the first of two rows of their place; some places are missing."""
    homes = b.places(spark, sf).filter(F.col("potential") > 0).select(
        F.col("place_id").alias("_place_id"), F.col("city").alias("_city"),
        F.when(F.col("place_id").cast("long") % 2 == 0, F.col("business")).otherwise("").alias("_business"),
        F.concat(F.lit("old "), "business").alias("_bank"), F.col("name").alias("title"),
        F.when(F.col("latitude") > 30, F.col("latitude")).otherwise(0.0).alias("lat"), "latitude",
        F.col("longitude").alias("lng"), F.concat(F.lit('1, rue "'), "name", F.lit('"')).alias("address"),
        (F.col("place_id").cast("long") % 50 / 10).alias("reviews_rating"),
        (F.col("place_id").cast("long") % 97).alias("reviews_count"),
        F.explode(F.array(F.lit(1), F.lit(0))).alias("line"))
    homes = homes.withColumn("title", F.concat("title", F.lit(" "), F.col("line").cast("string")))
    items = b.reviews(spark, sf).select(
        "id", "place_id", F.col("review_date").alias("date"), "rating", F.col("text").alias("snippet"),
        F.col("author").alias("name"))
    return attach_place_metadata(items, homes, ["line"])


FLAT = """
SELECT r.place_id AS _place_id, p.city AS _city,
  CASE WHEN CAST(p.place_id AS BIGINT)%2=0 THEN p.business ELSE 'old '||p.business END AS _business,
  p.name||' 0' AS title, '1, rue "'||p.name||'"' AS address, latitude AS lat, longitude AS lng,
  CAST(p.place_id AS BIGINT)%50/10 AS place_rating, CAST(p.place_id AS BIGINT)%97 AS reviews_count,
  review_date AS date, rating, text, author
FROM reviews r JOIN places p ON p.place_id=r.place_id WHERE potential>0"""


@query("attach_place_metadata", sql(FLAT))
def _(spark, sf):
    return flat_reviews(spark, sf)


@query("resolve_city", sql("""
SELECT id, CASE WHEN id%4=0 THEN 'unknown '||city WHEN id%4=1 THEN '' ELSE lower(replace(city,'_','-')) END AS city
FROM reviews"""))
def _(spark, sf):
    aliases = b.table(spark, sf, "nation").select(
        F.lower("n_name").alias("key"), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("value"))
    part = F.col("id") % 4
    rows = b.reviews(spark, sf).select("id", F.when(part == 0, F.concat(F.lit("unknown "), "city")).when(
        part == 1, "").when(part == 2, F.concat(F.lit("  "), "city")).otherwise(F.col("city")).alias("city"))
    return resolve_city(rows, aliases)


@query("resolve_city_arabic", sql("SELECT id, CASE WHEN id%2=0 THEN city ELSE 'آسفي '||city||' x' END AS city FROM reviews"))
def _(spark, sf):
    """Alias and name fold alike outside Latin letters too: the madda of the first letter is dropped."""
    names = b.table(spark, sf, "nation").select("n_name", F.concat(F.lit("آسفي "), "n_name").alias("arabic"))
    entries = names.select(
        F.col("arabic").alias("name"), F.lit("city").alias("type"), F.array(F.lit(-9.2), F.lit(32.3)).alias("location"),
        F.struct(F.lit("ma").alias("country_code")).alias("address"),
        F.create_map(F.lit("name:fr"), F.col("n_name")).alias("other_names"))
    aliases = city_aliases(entries.to(GAZETTEER), F.col("name"))
    rows = b.reviews(spark, sf).select(
        "id", F.concat(F.lit("آسفي "), "city", F.when(F.col("id") % 2 == 0, "").otherwise(" x")).alias("city"))
    return resolve_city(rows, aliases)


@query("search_grid", sql(
    "SELECT b.business, c.city FROM (SELECT DISTINCT city FROM places) c CROSS JOIN (VALUES "
    + ", ".join(f"({quoted(x)})" for x in BUSINESSES) + ") b(business)"))
def _(spark, sf):
    return search_grid(BUSINESSES, b.places(spark, sf).select("city").distinct())


@query("dedupe_documents", """
SELECT min(doc_id) AS doc_id, lang, md5(text) AS text_md5, arg_min(source, doc_id) AS source
FROM documents GROUP BY lang, text""")
def _(spark, sf):
    rows = b.documents(spark, sf).select("doc_id", "lang", "text", "source")
    first = dedupe_first(rows, ["lang", "text"], ["doc_id"], total=True)
    return first.select("doc_id", "lang", F.md5("text").alias("text_md5"), "source")


@query("union_by_name", """
SELECT c_name AS name, c_mktsegment AS business, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL
SELECT s_name, NULL, s_acctbal FROM supplier""")
def _(spark, sf):
    customers = b.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("business"))
    suppliers = b.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return union_all(customers, suppliers)


@query("hot_key_join", """
SELECT l_orderkey, l_linenumber, r_name FROM lineitem
LEFT JOIN region ON r_regionkey = CASE WHEN l_partkey%3=0 THEN 0 WHEN l_partkey%50=1 THEN NULL ELSE l_suppkey%7 END""")
def _(spark, sf):
    """A third of the lines share one key and some have none; adaptive splitting deals with the key."""
    part = F.col("l_partkey")
    lines = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(part % 3 == 0, 0).when(part % 50 == 1, None).otherwise((F.col("l_suppkey") % 7).cast("int")).alias("key"))
    names = b.table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), "r_name")
    return lines.join(names, "key", "left").select("l_orderkey", "l_linenumber", "r_name")
