"""Table schemas, column renames and defaults of the five stored tables."""
from __future__ import annotations

from pyspark.sql import types as T

from .taxonomy import CONFIDENCE_THRESHOLD, FLAG_COLUMNS

_S, _D, _I, _L, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _schema(required: tuple, **columns) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in columns.items()])


PLACES = _schema(
    ("place_id", "business"),
    place_id=_S, business=_S, business_type=_S, name=_S, address=_S, city=_S, region=_S, zipcode=_S,
    latitude=_D, longitude=_D, phone=_S, website=_S, google_rating=_D, google_reviews_count=_I,
    data_id=_S, resolve_status=_S, cluster_name=_S, potential=_D, created_at=_TS, updated_at=_TS,
)
REVIEWS = _schema(
    ("id", "place_id"),
    id=_L, place_id=_S, author=_S, rating=_I, text=_S, review_date=_S, review_date_parsed=T.DateType(),
    language=_S, source=_S, business=_S, city=_S, agency_name=_S, created_at=_TS,
)
CLASSIFICATIONS = _schema(
    ("id", "review_id"),
    id=_L, review_id=_L, sentiment=_S, categories_json=_S, rationale=_S, model_version=_S,
    processing_run_id=_L, confidence_threshold=_D, created_at=_TS,
)
PROCESSING_RUNS = _schema(
    ("id", "run_type"),
    id=_L, run_type=_S, status=_S, started_at=_TS, completed_at=_TS, config_json=_S, stats_json=_S,
    error_message=_S, total_items=_I, processed_items=_I, failed_items=_I,
)
REVIEW_CATEGORIES = _schema(("review_id",), review_id=_L, **{c: _I for c in FLAG_COLUMNS})

TABLES = {
    "places": PLACES,
    "reviews": REVIEWS,
    "classifications": CLASSIFICATIONS,
    "processing_runs": PROCESSING_RUNS,
    "review_categories": REVIEW_CATEGORIES,
}

# Columns that identify a row, each by itself.
UNIQUE_KEYS = {
    "places": ("place_id",), "reviews": ("id",), "classifications": ("id", "review_id"),
    "processing_runs": ("id",), "review_categories": ("review_id",),
}

# Columns an upsert of a known place replaces; the others keep their stored value.
PLACE_UPDATE_COLUMNS = (
    "business", "name", "address", "city", "region", "google_rating", "google_reviews_count",
    "cluster_name", "potential",
)
CLASSIFICATION_UPDATE_COLUMNS = (
    "sentiment", "categories_json", "rationale", "model_version", "processing_run_id",
)
REVIEW_KEY = ("place_id", "author", "text")
# Digest of the key, which the store keeps beside a review so that inserts need not read its text.
KEY_DIGEST = "key_digest"

# Source column -> table column, one map per kind of input.
RENAMES = {
    "places": {
        "canonical_place_id": "place_id", "_place_id": "place_id", "_business": "business", "_city": "city",
        "title": "name", "lat": "latitude", "lng": "longitude", "reviews_count": "google_reviews_count",
    },
    "reviews": {
        "_place_id": "place_id", "_business": "business", "_city": "city", "review_snippet": "text",
        "review_rating": "rating", "name": "author", "review_name": "author", "google_maps_name": "agency_name",
    },
    "classified_places": {
        "bank": "business", "google_maps_name": "name", "cluster_name_grouped": "cluster_name",
    },
    "classified_reviews": {
        "review_text": "text", "review_name": "author", "bank": "business", "google_maps_name": "agency_name",
        "month": "review_date_parsed",
    },
    "classified_labels": {"categories_with_confidence": "categories_json"},
}

# Defaults of columns an input may lack.
DEFAULTS = {
    "places": {"business_type": "bank"},
    "reviews": {"source": "google_maps"},
    "classifications": {
        "categories_json": "[]", "model_version": "gpt-4.1-mini", "confidence_threshold": CONFIDENCE_THRESHOLD,
    },
}

CATEGORY_ARRAY = T.ArrayType(T.StructType([
    T.StructField("label", _S), T.StructField("confidence", _D),
]))
REVIEW_ITEM = T.StructType([
    T.StructField("page", _I), T.StructField("name", _S), T.StructField("link", _S),
    T.StructField("thumbnail", _S), T.StructField("local_guide", T.BooleanType()), T.StructField("rating", _D),
    T.StructField("date", _S), T.StructField("snippet", _S), T.StructField("images", T.ArrayType(_S)),
    T.StructField("position", _I),
])
REVIEW_BUNDLE = T.MapType(_S, T.ArrayType(REVIEW_ITEM))
REVIEW_PAGE = T.StructType([T.StructField("reviews", T.ArrayType(T.StructType([
    T.StructField("user", T.StructType([
        T.StructField("name", _S), T.StructField("link", _S), T.StructField("thumbnail", _S),
        T.StructField("local_guide", T.BooleanType()),
    ])),
    T.StructField("rating", _D), T.StructField("date", _S), T.StructField("snippet", _S),
    T.StructField("content", _S), T.StructField("images", T.ArrayType(_S)),
])))])
PLACE_HIT = T.StructType([
    T.StructField("title", _S), T.StructField("place_id", _S), T.StructField("address", _S),
    T.StructField("gps_coordinates", T.StructType([
        T.StructField("latitude", _D), T.StructField("longitude", _D),
    ])),
    T.StructField("rating", _D), T.StructField("reviews_rating", _D), T.StructField("stars", _D),
    T.StructField("reviews", _L), T.StructField("reviews_count", _L), T.StructField("number_of_reviews", _L),
    T.StructField("data_id", _S), T.StructField("data_cid", _S), T.StructField("cid", _S),
    T.StructField("type", _S), T.StructField("category", _S), T.StructField("phone", _S),
    T.StructField("website", _S),
])
PLACE_PAGE = T.StructType([
    T.StructField("local_results", T.ArrayType(PLACE_HIT)), T.StructField("places", T.ArrayType(PLACE_HIT)),
])
GAZETTEER = T.StructType([
    T.StructField("name", _S), T.StructField("type", _S), T.StructField("inferred_type", _S),
    T.StructField("population", _L), T.StructField("location", T.ArrayType(_D)),
    T.StructField("address", T.StructType([
        T.StructField("country_code", _S), T.StructField("city", _S),
    ])),
    T.StructField("other_names", T.MapType(_S, _S)),
])
