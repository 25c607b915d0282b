"""Place resolution: metadata, canonical ids and consolidation of search results."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import first_truthy, is_canonical_place_id, place_key
from .columns import first_present
from .dedupe import dedupe_first, pick_strategy
from .filters import brand_filter

PLACE_COLUMNS = (
    "business", "business_type", "name", "address", "city", "lat", "lng", "place_id", "data_id", "type", "rating",
    "reviews_count", "phone", "website", "_engine", "canonical_place_id", "resolve_status",
)


def _pick(df: DataFrame, *names: str) -> Column:
    """First truthy value of the columns that exist; null if none does."""
    present = [n for n in names if n in df.columns]
    if not present:
        return F.lit(None).cast("string")
    numeric = isinstance(df.schema[present[0]].dataType, T.NumericType)
    return F.col(present[0]) if len(present) == 1 else first_truthy(*present, empty=0 if numeric else "")


def attach_place_metadata(reviews: DataFrame, places: DataFrame, order: Sequence[str]) -> DataFrame:
    """Flat review rows with the metadata of their place.

    The first place row per id (by ``order``) wins; reviews of unknown places are dropped.
    """
    meta = dedupe_first(places, ["_place_id"], order)
    meta = meta.select(
        F.col("_place_id").alias("place_id"), _pick(meta, "_city").alias("_city"),
        _pick(meta, "_business", "_bank").alias("_business"), _pick(meta, "title").alias("title"),
        _pick(meta, "address").alias("address"), _pick(meta, "lat", "latitude").alias("lat"),
        _pick(meta, "lng", "longitude").alias("lng"),
        _pick(meta, "place_rating", "reviews_rating").alias("place_rating"),
        _pick(meta, "reviews_count").alias("reviews_count"),
    )
    text, author = first_present(reviews, ("snippet", "text")), first_present(reviews, ("name", "author"))
    return reviews.join(meta, "place_id").select(
        F.col("place_id").alias("_place_id"), "_city", "_business", "title", "address", "lat", "lng", "place_rating",
        "reviews_count", "date", "rating", F.col(text).alias("text"), F.col(author).alias("author"),
    )


def resolve_ids(
    places: DataFrame, cache: DataFrame, order: Sequence[str], resolved: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(places with ``canonical_place_id`` and ``resolve_status``, extended cache).

    ``cache`` holds (key, value); ``resolved`` holds the answers of an outside lookup as
    (key, value, failed). A key is the numeric id, else the place id. Within the batch the
    first row of a key that gets an id serves the later rows of that key like the cache does.
    """
    key = first_truthy(F.col("data_id"), F.col("place_id"))
    rows = places.withColumns({"_key": key, "_order": F.struct(*order)})
    known = cache.select(F.col("key").alias("_key"), F.col("value").alias("_cached"))
    rows = rows.join(known, "_key", "left")
    if resolved is None:
        rows = rows.withColumns({"_answer": F.lit(None).cast("string"), "_failed": F.lit(False)})
    else:
        answers = resolved.select(
            F.col("key").alias("_key"), F.col("value").alias("_answer"), F.col("failed").alias("_failed"))
        rows = rows.join(answers, "_key", "left")
    canonical = is_canonical_place_id(F.col("place_id"))
    rows = rows.withColumns({
        "_own": F.when(canonical, F.col("place_id")).otherwise(F.nullif("_answer", F.lit(""))),
        "_canonical": canonical,
    })
    fresh = rows.filter(F.col("_cached").isNull() & F.col("_own").isNotNull() & F.col("_key").isNotNull())
    first = fresh.groupBy("_key").agg(
        F.min_by("_own", "_order").alias("_first_own"), F.min("_order").alias("_first_order"))
    rows = rows.join(first, "_key", "left")
    later = F.col("_first_order") < F.col("_order")
    status = (
        F.when(F.col("_cached").isNotNull() | later, "cache").when(F.col("_canonical"), "already_canonical")
        .when(F.col("_own").isNotNull(), "api_resolved").when(F.coalesce("_failed", F.lit(False)), "error")
        .otherwise("unresolved")
    )
    canonical_id = F.coalesce("_cached", F.when(later, F.col("_first_own")), "_own")
    out = rows.select(
        *places.columns, canonical_id.alias("canonical_place_id"), status.alias("resolve_status"))
    extended = cache.select("key", "value").unionByName(
        first.select(F.col("_key").alias("key"), F.col("_first_own").alias("value")))
    return out, extended


def consolidate_places(
    hits: DataFrame,
    cache: DataFrame,
    order: Sequence[str],
    brand: str | None = None,
    resolved: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(unique places in their 17 output columns, extended id cache) from parsed search hits.

    ``hits`` are the rows of ``parse_place_payloads`` with ``business``, ``business_type``,
    ``city``, ``_engine`` and ``strategy`` (0 = strongest); ``order`` is their arrival order.
    """
    if brand:
        hits = brand_filter(hits, brand)
    hits = pick_strategy(hits)
    label = F.concat("name", F.lit("-"), "address")
    hits = hits.withColumn("_local_key", F.coalesce("place_id", label))
    hits = dedupe_first(hits, ["business", "city", "_local_key"], order)
    overall = place_key(F.col("place_id"), F.col("data_id"), F.col("name"), F.col("address"))
    hits = dedupe_first(hits.withColumn("_key_all", overall), ["_key_all"], order)
    out, extended = resolve_ids(hits, cache, order, resolved)
    return out.select(*PLACE_COLUMNS), extended
