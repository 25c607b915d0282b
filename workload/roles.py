"""Role tables: the given tables in the shape of places, reviews, classifications and flags.

``CTES`` is the same derivation in SQL, in front of every oracle query.
"""
from __future__ import annotations

import uuid
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vocalake.functions.categories import categories_json
from vocalake.functions.numbers import round_to
from vocalake.session import configure, ensure_checkpoint_dir
from vocalake.taxonomy import CATEGORIES, FLAG_COLUMNS

NOW = datetime(2024, 1, 15, 12, 0, 0)
TODAY = date(1998, 8, 2)
BUSINESS = "BUILDING"
BUSINESSES = ("BUILDING", "MACHINERY", "HOUSEHOLD")
CITY = "NATION_3"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh directory in the shared checkpoint folder, for queries that write files."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def label_of(index: Column) -> Column:
    """Category label of a taxonomy position."""
    return F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (index + 1).cast("int"))


def places(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation, region = (table(spark, sf, n) for n in ("customer", "nation", "region"))
    cities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    return customer.join(cities, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.cast("string").alias("place_id"), F.col("c_mktsegment").alias("business"),
        F.lit("bank").alias("business_type"), F.col("c_name").alias("name"), F.col("n_name").alias("city"),
        F.col("r_name").alias("region"), (F.lit(21.0) + (key * 37 % 1500) / 100.0).alias("latitude"),
        (F.lit(-17.0) + (key * 53 % 1600) / 100.0).alias("longitude"),
        F.lit(None).cast("string").alias("cluster_name"), F.col("c_acctbal").alias("potential"),
    )


def homeless_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews without the columns of their place."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("place_id"),
        F.col("o_custkey").cast("string").alias("author"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"), F.col("o_orderpriority").alias("text"),
        day.cast("string").alias("review_date"), day.alias("review_date_parsed"),
        F.lit(None).cast("string").alias("language"), F.lit("google_maps").alias("source"),
    )


def homes(spark: SparkSession, sf: str) -> DataFrame:
    return places(spark, sf).select("place_id", "business", "city", "region", F.col("name").alias("agency_name"))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return homeless_reviews(spark, sf).join(homes(spark, sf), "place_id")


def sentiment_of(status: Column) -> Column:
    return F.when(status == "F", "Positif").when(status == "O", "Négatif").when(status == "P", "Neutre")


def classifications(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter(F.col("o_orderkey") % 10 != 0)
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("review_id"),
        sentiment_of(F.col("o_orderstatus")).alias("sentiment"),
        F.concat(F.lit("status "), "o_orderstatus").alias("rationale"), F.lit("v1").alias("model_version"),
        F.lit(None).cast("string").alias("categories_json"),
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(review_id, label_index, confidence): at most one row per review and category."""
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(
        F.col("l_orderkey").alias("review_id"), (F.col("l_partkey") % 17).cast("int").alias("label_index"),
    ).agg(round_to(1 - 6 * F.min("l_discount")).alias("confidence"))


def category_lists(spark: SparkSession, sf: str) -> DataFrame:
    """(review_id, categories_json): never more entries than the taxonomy has labels."""
    entry = F.struct(label_of(F.col("label_index")).alias("label"), "confidence")
    lists = pairs(spark, sf).groupBy("review_id").agg(F.sort_array(F.collect_list(entry)).alias("categories"))
    return lists.select("review_id", categories_json(F.col("categories")).alias("categories_json"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Classifications with their category JSON."""
    return classifications(spark, sf).drop("categories_json").join(category_lists(spark, sf), "review_id", "left")


def flags(spark: SparkSession, sf: str) -> DataFrame:
    index = F.col("l_partkey") % 17
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("review_id")).agg(
        *[F.max((index == i).cast("int")).alias(name) for i, name in enumerate(FLAG_COLUMNS)])


def flag_masks(spark: SparkSession, sf: str) -> DataFrame:
    """The flags of a review as the bits of one number, which is shorter to shuffle."""
    index = (F.col("l_partkey") % 17).cast("int")
    bit = F.when(index < 0, 0).otherwise(F.call_function("shiftleft", F.lit(1), index))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("review_id")).agg(F.bit_or(bit).alias("mask"))


def flag_of(mask: Column, name: str) -> Column:
    return F.shiftright(mask, FLAG_COLUMNS.index(name)).bitwiseAND(F.lit(1))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews with sentiment and month, the frame behind the dashboard datasets."""
    rows = reviews(spark, sf).select("id", "place_id", "business", "city", "rating", "review_date_parsed")
    labels = classifications(spark, sf).select(F.col("review_id").alias("id"), "sentiment")
    return rows.join(labels, "id", "left").withColumn("_month", F.trunc("review_date_parsed", "month"))


ROLES = {
    "business": "business", "city": "city", "date": "review_date_parsed", "rating": "rating", "text": "text",
    "sentiment": "sentiment", "place_id": "place_id",
}


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# ---------------------------------------------------------------------------- SQL twins

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r(expression: str, digits: int = 2) -> str:
    """Rounding exactly as ``round_to`` does it."""
    scale = 10 ** digits
    return f"floor(({expression})*{scale}+0.5)/{scale}"


def pct_sql(part: str, whole: str) -> str:
    return f"100e0*{part}/nullif({whole},0)"


POS, NEG, NEU = (f"count(CASE WHEN sentiment='{s}' THEN 1 END)" for s in ("Positif", "Négatif", "Neutre"))
LABEL_LIST = "[" + ", ".join(quoted(c) for c in CATEGORIES) + "]"
FLAG_SUMS = ", ".join(f"max(CASE WHEN l_partkey%17={i} THEN 1 ELSE 0 END) AS {c}" for i, c in enumerate(FLAG_COLUMNS))

CTES = f"""
WITH places AS (
  SELECT CAST(c_custkey AS VARCHAR) AS place_id, c_mktsegment AS business, 'bank' AS business_type, c_name AS name,
         n_name AS city, r_name AS region, 21e0+(c_custkey*37%1500)/100e0 AS latitude,
         -17e0+(c_custkey*53%1600)/100e0 AS longitude, CAST(NULL AS VARCHAR) AS cluster_name, c_acctbal AS potential
  FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
reviews AS (
  SELECT o_orderkey AS id, place_id, CAST(o_custkey AS VARCHAR) AS author,
         CAST(substr(o_orderpriority,1,1) AS INTEGER) AS rating, o_orderpriority AS text,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS review_date, CAST(o_orderdate AS DATE) AS review_date_parsed,
         CAST(NULL AS VARCHAR) AS language, 'google_maps' AS source, business, city, region, name AS agency_name
  FROM orders JOIN places ON CAST(o_custkey AS VARCHAR)=place_id),
classifications AS (
  SELECT o_orderkey AS id, o_orderkey AS review_id,
         CASE o_orderstatus WHEN 'F' THEN 'Positif' WHEN 'O' THEN 'Négatif' WHEN 'P' THEN 'Neutre' END AS sentiment,
         'status '||o_orderstatus AS rationale, 'v1' AS model_version, CAST(NULL AS VARCHAR) AS categories_json
  FROM orders WHERE o_orderkey%10<>0),
rs AS (SELECT r.*, c.sentiment, c.rationale FROM reviews r LEFT JOIN classifications c ON r.id=c.review_id),
pairs AS (
  SELECT l_orderkey AS review_id, CAST(l_partkey%17 AS INTEGER) AS label_index,
         {r("1-6*min(l_discount)")} AS confidence
  FROM lineitem GROUP BY ALL),
label_pairs AS (SELECT *, ({LABEL_LIST})[label_index+1] AS label FROM pairs),
flags AS (SELECT l_orderkey AS review_id, {FLAG_SUMS} FROM lineitem GROUP BY l_orderkey)
"""


def sql(body: str) -> str:
    return CTES + body
