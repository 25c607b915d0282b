"""JSON sources: lookups, review bundles, gazetteer and raw service payloads."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import display_city, first_truthy, is_canonical_place_id
from ..operators.columns import file_order
from ..operators.geo import city_aliases, city_centers
from ..schemas import GAZETTEER, PLACE_PAGE, REVIEW_BUNDLE, REVIEW_PAGE
from ..taxonomy import DEFAULT_CENTERS, DEFAULT_CITIES

LOOKUP_SCHEMA = "key string, value string"


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited place records; blank and malformed lines are skipped."""
    return spark.read.schema(GAZETTEER).option("mode", "DROPMALFORMED").json(path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Flat JSON dictionary as (key, value) rows; a missing or malformed file gives no rows."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOOKUP_SCHEMA)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def write_lookup(rows: DataFrame, path: str) -> None:
    """(key, value) rows as a Parquet table, which ``read_stored_lookup`` reads back in parallel."""
    rows.select("key", "value").write.mode("overwrite").parquet(path)


def read_stored_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOOKUP_SCHEMA).parquet(path)


def read_review_bundle(spark: SparkSession, path: str, whole_document: bool = False) -> DataFrame:
    """``place_id -> [review, ...]`` objects as one row per review.

    The objects stand one per line (the form our sink writes, splittable);
    ``whole_document`` reads files that hold one pretty-printed object each. A position stored
    with a review counts before its place in the list.
    """
    text = spark.read.text(path, wholetext=whole_document)
    bundles = text.select(F.explode(F.from_json("value", REVIEW_BUNDLE)).alias("place_id", "reviews"))
    items = bundles.select("place_id", F.posexplode("reviews").alias("at", "review"))
    position = F.coalesce("review.position", "at").alias("position")
    review = F.col("review").dropFields("position").alias("review")
    return items.select("place_id", position, review).select("place_id", "position", "review.*")


def parse_place_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per place hit of a search payload; the other columns are kept.

    ``hit`` is the position inside the payload. Ids that are not canonical become null.
    """
    page = F.from_json(payload, PLACE_PAGE)
    hits = F.coalesce(F.when(F.size(page["local_results"]) > 0, page["local_results"]), page["places"])
    keep = [c for c in df.columns if c != payload]
    p = F.col("p")
    place_id = p["place_id"]
    return df.select(*keep, F.posexplode(hits).alias("hit", "p")).select(
        *keep, "hit",
        F.coalesce(p["title"], F.lit("")).alias("name"),
        F.coalesce(p["address"], F.lit("")).alias("address"),
        p["gps_coordinates"]["latitude"].alias("lat"),
        p["gps_coordinates"]["longitude"].alias("lng"),
        F.when(is_canonical_place_id(place_id), place_id).alias("place_id"),
        first_truthy(p["data_id"], p["data_cid"], p["cid"]).alias("data_id"),
        first_truthy(p["type"], p["category"]).alias("type"),
        first_truthy(p["rating"], p["reviews_rating"], p["stars"], empty=0.0).alias("rating"),
        first_truthy(p["reviews"], p["reviews_count"], p["number_of_reviews"], empty=0).alias("reviews_count"),
        p["phone"].alias("phone"),
        p["website"].alias("website"),
    )


def parse_review_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per review of a review page; ``page`` and the other columns are kept."""
    keep = [c for c in df.columns if c != payload]
    r = F.col("r")
    reviews = F.from_json(payload, REVIEW_PAGE)["reviews"]
    return df.select(*keep, F.posexplode(reviews).alias("position", "r")).select(
        *keep, "position",
        r["user"]["name"].alias("name"), r["user"]["link"].alias("link"),
        r["user"]["thumbnail"].alias("thumbnail"), r["user"]["local_guide"].alias("local_guide"),
        r["rating"].alias("rating"), r["date"].alias("date"),
        first_truthy(r["snippet"], r["content"]).alias("snippet"), r["images"].alias("images"),
    )


def load_centers(
    spark: SparkSession, centers_path: str, aliases_path: str, gazetteer_path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(centres, aliases): the stored lookups if both hold rows, else built from the gazetteer
    if that yields centres, else the default centres and no aliases."""
    centers, aliases = read_lookup(spark, centers_path), read_lookup(spark, aliases_path)
    if not centers.isEmpty() and not aliases.isEmpty():
        return centers, aliases
    if gazetteer_path is not None:
        try:
            gazetteer = read_gazetteer(spark, gazetteer_path)
        except AnalysisException:
            gazetteer = None
        if gazetteer is not None:
            centers = city_centers(gazetteer, order=file_order())
            if not centers.isEmpty():
                return centers, city_aliases(gazetteer, order=file_order())
    defaults = spark.createDataFrame(list(DEFAULT_CENTERS.items()), LOOKUP_SCHEMA)
    return defaults, spark.createDataFrame([], LOOKUP_SCHEMA)


def city_list(gazetteer: DataFrame) -> DataFrame:
    """Sorted distinct display names; the default cities if the gazetteer has none."""
    spark = gazetteer.sparkSession
    names = (
        gazetteer.select(display_city(F.col("name"), F.col("other_names")).alias("city"))
        .filter(F.col("city") != "").distinct()
    )
    if names.isEmpty():
        names = spark.createDataFrame([(c,) for c in DEFAULT_CITIES], "city string")
    return names.orderBy("city")
