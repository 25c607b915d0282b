"""Keyed changes of the stored tables as DataFrame -> DataFrame functions.

The stored table is the large side and a batch the small one, so nothing here forces a
shuffle of the table: batch keys are matched by a join the optimizer broadcasts while the
batch is small, and the table itself only streams past.
"""
from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.categories import parse_categories, short_flags
from ..schemas import (
    CLASSIFICATION_UPDATE_COLUMNS, CLASSIFICATIONS, KEY_DIGEST, PLACE_UPDATE_COLUMNS, PLACES, PROCESSING_RUNS,
    REVIEW_CATEGORIES, REVIEW_KEY, REVIEWS,
)
from ..taxonomy import CATEGORY_COLUMNS, COMPLETED, FAILED, IN_PROGRESS
from .columns import complete, conform, with_defaults
from .dedupe import dedupe_first, dedupe_last, first_order, key_digest, same_row
from .ids import assign_ids, max_id
from .joins import keep_existing


def without_known(new: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key the target lacks; a key with a null never counts as known."""
    keys = list(keys)
    wanted = new.select(*keys).dropna().distinct()
    known = target.select(*keys).join(wanted, keys, "left_semi").distinct()
    return new.join(known, keys, "left_anti")


def insert_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target plus the new rows with unknown keys; the first row of a key wins."""
    keys = list(keys)
    has_null = reduce(or_, [F.col(k).isNull() for k in keys])
    first = dedupe_first(new.filter(~has_null), keys, order).unionByName(new.filter(has_null))
    fresh = without_known(first, target, keys)
    return target.unionByName(fresh.select(*target.columns))


def upsert(
    target: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], stamps: dict[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(target with ``columns`` replaced where the key matches, updates with an unknown key)."""
    incoming = updates.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    hit = F.coalesce("_hit", F.lit(False))
    changes = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    changes |= {c: F.when(hit, value).otherwise(F.col(c)) for c, value in (stamps or {}).items()}
    merged = target.join(incoming, key, "left").withColumns(changes).select(*target.columns)
    return merged, without_known(updates, target, [key])


def _one_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``, or by the other columns if no order is given."""
    return dedupe_last(df, [key], order or [c for c in df.columns if c != key])


def upsert_places(target: DataFrame, updates: DataFrame, now: datetime, order: Sequence[str] = ()) -> DataFrame:
    """Insert places or replace nine columns and ``updated_at`` of known ones; the last update wins."""
    updates = _one_per_key(updates, "place_id", order)
    stamp = F.lit(now).cast("timestamp")
    updates = complete(updates.withColumns({"created_at": stamp, "updated_at": stamp}), PLACES)
    merged, fresh = upsert(target, updates, "place_id", PLACE_UPDATE_COLUMNS, {"updated_at": stamp})
    return merged.unionByName(fresh.select(*target.columns))


def insert_places(target: DataFrame, df: DataFrame, now: datetime, order: Sequence[str]) -> DataFrame:
    """Bulk insert of places; known ids keep their stored row."""
    keep = [c for c in order if c not in PLACES.names]
    rows = conform(df, "places").withColumns({c: F.lit(now).cast("timestamp") for c in ("created_at", "updated_at")})
    shaped = complete(rows, PLACES)
    if keep:
        shaped = rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in rows.columns
                               else F.lit(None).cast(f.dataType).alias(f.name) for f in PLACES.fields], *keep)
    return insert_ignore(target, shaped, ["place_id"], order)


def new_reviews(target: DataFrame, df: DataFrame, now: datetime, order: Sequence[str]) -> DataFrame:
    """Rows to append to ``reviews``: renamed, defaulted, deduplicated, numbered, conflicts removed.

    The natural key holds the text, so it is compared by its digest: the batch shrinks to digest and
    order (which must be total), these are numbered, the digests that the target knows go, and only then
    the whole rows join in. A target read with its stored digests (``store.load_table(keyed=True)``) is
    scanned for those and its ids alone. A key with a null is never known.
    """
    rows = with_defaults(conform(df, "reviews"), "reviews", now)
    for name in REVIEW_KEY:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    extra = [c for c in order if c not in REVIEWS.names]
    shaped = rows.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in rows.columns
          else F.lit(None).cast(f.dataType).alias(f.name) for f in REVIEWS.fields if f.name != "id"], *extra)
    has_null = reduce(or_, [F.col(k).isNull() for k in REVIEW_KEY])
    keyed = shaped.withColumns({KEY_DIGEST: key_digest(*REVIEW_KEY), "_whole": ~has_null})
    winners = first_order(keyed, [KEY_DIGEST, "_whole"], order)
    numbered = assign_ids(winners, order, after=max_id(target))
    digest = F.col(KEY_DIGEST) if KEY_DIGEST in target.columns else key_digest(*REVIEW_KEY)
    wanted = winners.filter("_whole").select(KEY_DIGEST)
    known = target.select(digest.alias(KEY_DIGEST)).join(wanted, KEY_DIGEST, "left_semi").distinct()
    fresh = numbered.join(known.withColumn("_whole", F.lit(True)), [KEY_DIGEST, "_whole"], "left_anti")
    return keyed.join(fresh, same_row(keyed, fresh, KEY_DIGEST, order)).select(
        fresh["id"], *[keyed[n] for n in REVIEWS.names if n != "id"])


def insert_reviews(target: DataFrame, df: DataFrame, now: datetime, order: Sequence[str]) -> DataFrame:
    return target.select(*REVIEWS.names).unionByName(new_reviews(target, df, now, order))


def upsert_classifications(
    target: DataFrame, updates: DataFrame, now: datetime, order: Sequence[str] = ()
) -> DataFrame:
    """One classification per review: replace the labels of known reviews (id and threshold stay),
    number and add the others."""
    updates = _one_per_key(updates, "review_id", order)
    stamp = F.lit(now).cast("timestamp")
    updates = complete(with_defaults(updates, "classifications", now), CLASSIFICATIONS)
    merged, fresh = upsert(
        target, updates, "review_id", CLASSIFICATION_UPDATE_COLUMNS, {"created_at": stamp})
    numbered = assign_ids(fresh, ["review_id"], after=max_id(target))
    return merged.unionByName(numbered.select(*target.columns))


def replace_classifications(
    target: DataFrame, df: DataFrame, now: datetime, run_id: int | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Drop the stored rows of the batch's reviews and insert the batch under new ids."""
    if "review_id" not in df.columns and "id" in df.columns:
        df = df.withColumnRenamed("id", "review_id")
    missing = {"review_id", "sentiment"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    df = _one_per_key(df, "review_id", order)
    rows = with_defaults(df.drop("model_version", "confidence_threshold"), "classifications", now)
    rows = complete(rows.withColumn("processing_run_id", F.lit(run_id)), CLASSIFICATIONS)
    numbered = assign_ids(rows, ["review_id"], after=max_id(target))
    kept = target.join(rows.select("review_id"), "review_id", "left_anti")
    return kept.select(*target.columns).unionByName(numbered.select(*target.columns))


def category_flags(classifications: DataFrame) -> DataFrame:
    """Seventeen 0/1 columns per review from the category JSON."""
    labels = classifications.select("review_id", parse_categories(F.col("categories_json"))["label"].alias("labels"))
    return labels.select("review_id", *[c.alias(name) for name, c in short_flags(F.col("labels")).items()])


def upsert_flags(target: DataFrame, classifications: DataFrame) -> DataFrame:
    """Flag table with the rows of these classifications replaced or added."""
    fresh = category_flags(classifications)
    kept = target.join(fresh.select("review_id"), "review_id", "left_anti")
    return kept.select(*REVIEW_CATEGORIES.names).unionByName(fresh)


def flags_from_wide(df: DataFrame, reviews: DataFrame, key: str = "review_id") -> DataFrame:
    """Flag rows from label-named columns (null and absent count as 0), for existing reviews."""
    flags = [
        (F.coalesce(F.col(f"`{label}`").try_cast("double").cast("int"), F.lit(0))
         if label in df.columns else F.lit(0)).alias(short)
        for short, label in CATEGORY_COLUMNS.items()
    ]
    return keep_existing(df.select(F.col(key).alias("review_id"), *flags), reviews)


def start_run(
    runs: DataFrame, run_type: str, now: datetime, config: dict | None = None, total: int = 0
) -> DataFrame:
    """Run log with one more open run."""
    row = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).select(
        (F.col("m") + 1).alias("id"), F.lit(run_type).alias("run_type"), F.lit(IN_PROGRESS).alias("status"),
        F.lit(now).cast("timestamp").alias("started_at"), F.lit(json.dumps(config or {})).alias("config_json"),
        F.lit(total).alias("total_items"), F.lit(0).alias("processed_items"), F.lit(0).alias("failed_items"),
    )
    return runs.unionByName(complete(row, PROCESSING_RUNS))


def update_run(
    runs: DataFrame, run_id: int | Column, now: datetime, status: str | None = None, processed: int | None = None,
    failed: int | None = None, total: int | None = None, stats: dict | None = None, error: str | None = None,
) -> DataFrame:
    """Change the given fields of one run; a final status also stamps ``completed_at``."""
    fields = {
        "status": status, "processed_items": processed, "failed_items": failed, "total_items": total,
        "stats_json": json.dumps(stats) if stats else None, "error_message": error,
    }
    fields = {name: F.lit(value) for name, value in fields.items() if value is not None}
    if status in (COMPLETED, FAILED):
        fields["completed_at"] = F.lit(now).cast("timestamp")
    marked = runs.withColumn("_mine", F.col("id") == run_id)
    changes = {n: F.when(F.col("_mine"), v).otherwise(F.col(n)) for n, v in fields.items()}
    return marked.withColumns(changes).drop("_mine")


def last_run(runs: DataFrame, run_type: str) -> DataFrame:
    """The most recent run of a type."""
    return (
        runs.filter(F.col("run_type") == run_type)
        .orderBy(F.desc_nulls_last("started_at"), F.desc("id")).limit(1)
    )


