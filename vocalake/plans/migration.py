"""Import of flat files into the stored tables."""
from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.columns import complete, conform, with_defaults
from ..operators.dedupe import dedupe_first, first_order, key_digest
from ..operators.filters import require
from ..operators.ids import assign_ids, max_id
from ..operators.mutate import flags_from_wide, insert_places, new_reviews, start_run, update_run, without_known
from ..schemas import CLASSIFICATIONS, DEFAULTS, KEY_DIGEST, PLACES, REVIEW_CATEGORIES, REVIEW_KEY, REVIEWS
from ..session import configure
from ..sources.tabular import read_reviews
from ..taxonomy import CATEGORIES, COMPLETED, FAILED
from . import catalogue, store

ROW = "_row"
IMPORTS = ("places", "reviews", "classified_reviews")


def stage_csv(spark: SparkSession, path: str, base: str, name: str) -> DataFrame:
    """The input with its arrival order, written once as Parquet beside the store.

    The import reads its rows several times with different columns; the text is parsed only here.
    In the order the number of the file among the files stands for its path, which no shuffle then carries.
    """
    staged = f"{base}/staging/{name}"
    read_reviews(spark, path, order=ROW).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    files = rows.select(F.col(ROW)["file"].alias("_file")).distinct()
    # One row per file: the window and the broadcast are bounded by the listing of the input.
    numbers = files.select("_file", F.row_number().over(W.orderBy("_file")).alias("_number"))
    placed = rows.join(F.broadcast(numbers), F.col(ROW)["file"] == F.col("_file"))
    place = F.struct(F.col("_number").alias("file"), F.col(ROW)["block"].alias("block"), F.col(ROW)["n"].alias("n"))
    return placed.withColumn(ROW, place).drop("_file", "_number")


def _places(df: DataFrame, now: datetime, order: Sequence[str]) -> DataFrame:
    rows = require(conform(df, "classified_places"), "place_id")
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c in PLACES.names or c in order])
    first = dedupe_first(rows, ["place_id"], order)
    return complete(with_defaults(first, "places", now), PLACES)


def _review_rows(df: DataFrame, now: datetime) -> DataFrame:
    """Review columns plus the untouched label columns."""
    rows = conform(require(df, "place_id"), "classified_reviews")
    rows = rows.withColumns({
        "text": F.coalesce("text", F.lit("")),
        "author": F.coalesce("author", F.lit("Anonymous")) if "author" in rows.columns else F.lit("Anonymous"),
        "rating": F.coalesce(F.col("rating").try_cast("double").cast("int"), F.lit(0)),
        "source": F.lit(DEFAULTS["reviews"]["source"]),
    })
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.lit(now).cast("timestamp"))
    return rows


def _numbered_apart(rows: DataFrame, order: Sequence[str], digests: DataFrame | None, after: int | Column) -> DataFrame:
    """The first row per natural key whose digest is not known, numbered, for an order no two rows share.

    Only digest and order are compared and the order alone is numbered; whole rows are shuffled once, to join.
    """
    winners = first_order(rows.select(key_digest(*REVIEW_KEY).alias(KEY_DIGEST), *order), [KEY_DIGEST], order)
    if digests is not None:
        winners = without_known(winners, digests, [KEY_DIGEST])
    ids = assign_ids(winners.select(*order), order, after=after, cut_by=rows)
    return rows.drop("id").join(ids, list(order)).select("id", *[F.col(f"`{c}`") for c in rows.columns if c != "id"])


def split_classified(
    df: DataFrame,
    now: datetime,
    order: Sequence[str],
    stored_reviews: DataFrame | None = None,
    after_classification: int | Column = 0,
    run_id: int | None = None,
    staging: str | None = None,
) -> dict[str, DataFrame]:
    """Places, reviews, classifications and flags of a flat classified file, ready to append.

    Reviews are deduplicated and rows already stored removed before ids are given, and the
    labels travel in the same row, so every classification points at the review it came with.
    Stored reviews are known by the digest of their key. With ``staging`` the numbered rows are
    written there once instead of being worked out again for each of the tables; no two rows may
    then share a place in the order.
    """
    rows = _review_rows(df, now)
    after_review: int | Column = 0
    digests = None
    if stored_reviews is not None:
        stored = F.col(KEY_DIGEST) if KEY_DIGEST in stored_reviews.columns else key_digest(*REVIEW_KEY)
        digests = stored_reviews.select(stored.alias(KEY_DIGEST))
        after_review = max_id(stored_reviews)
    if staging:
        numbered = _numbered_apart(rows, order, digests, after_review)
        numbered.write.mode("overwrite").parquet(staging)
        numbered = df.sparkSession.read.schema(numbered.schema).parquet(staging)
    else:
        unique = dedupe_first(rows, REVIEW_KEY, order, total=True)
        if digests is not None:
            keyed = unique.withColumn(KEY_DIGEST, key_digest(*REVIEW_KEY))
            unique = without_known(keyed, digests, [KEY_DIGEST]).drop(KEY_DIGEST)
        numbered = assign_ids(unique.drop("id"), order, after=after_review)
    reviews = complete(numbered, REVIEWS)

    labels = with_defaults(
        conform(numbered.drop("created_at"), "classified_labels").withColumns({
            "review_id": F.col("id"), "processing_run_id": F.lit(run_id),
            "id": F.col("id") - after_review + after_classification,
        }), "classifications", now)
    labels = labels.withColumn(
        "categories_json", F.coalesce("categories_json", F.lit(DEFAULTS["classifications"]["categories_json"])))
    if any(c in df.columns for c in CATEGORIES):
        flags = flags_from_wide(numbered.withColumnRenamed("id", "review_id"), reviews)
    else:
        flags = df.sparkSession.createDataFrame([], REVIEW_CATEGORIES)
    return {
        "places": _places(df, now, order),
        "reviews": reviews,
        "classifications": complete(labels, CLASSIFICATIONS),
        "review_categories": flags,
    }


def import_csv(spark: SparkSession, path: str, kind: str, base: str, now: datetime) -> None:
    """Import places, reviews or classified_reviews into the store."""
    if kind not in IMPORTS:
        raise ValueError(f"unknown kind of import: {kind}")
    configure(spark)
    rows = stage_csv(spark, path, base, kind)
    if kind == "places":
        target = store.load_table(spark, base, "places")
        shaped = insert_places(target.limit(0), rows, now, [ROW])
        store.append_rows(without_known(shaped, target, ["place_id"]), base, "places")
    elif kind == "reviews":
        target = store.load_table(spark, base, "reviews", keyed=True)
        store.append_rows(new_reviews(target, rows, now, [ROW]), base, "reviews")
    else:
        _append_classified(spark, rows, base, now, None)


def _unstored(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored; nothing is compared, and so not shuffled, with an empty table."""
    return rows if stored.isEmpty() else without_known(rows, stored, [key])


def _append_classified(spark: SparkSession, rows: DataFrame, base: str, now: datetime, run_id: int | None) -> None:
    reviews = store.load_table(spark, base, "reviews", keyed=True)
    parts = split_classified(
        rows, now, [ROW], None if reviews.isEmpty() else reviews,
        max_id(store.load_table(spark, base, "classifications")), run_id,
        staging=f"{base}/staging/numbered-{uuid.uuid4().hex}")
    places = _unstored(parts.pop("places"), store.load_table(spark, base, "places"), "place_id")
    store.append_rows(places, base, "places")
    # Reviews go last: until they are stored, a repeated run gives the same rows the same ids,
    # and label rows an interrupted run already stored are recognised by their review id.
    for table in ("review_categories", "classifications"):
        fresh = _unstored(parts[table], store.load_table(spark, base, table), "review_id")
        store.append_rows(fresh, base, table)
    store.append_rows(parts["reviews"], base, "reviews")


def run_migration(
    spark: SparkSession, path: str, base: str, now: datetime, buckets: int | None = None, prefix: str = "stored",
) -> dict[str, DataFrame]:
    """Create the store, import a classified file under a run record and verify the result.

    With ``buckets``, reviews and classifications are also written bucketed on the review id, as
    catalogue tables ``<prefix>_<table>`` on which the views then rest (``store.save_bucketed``).
    """
    store.create_tables(spark, base)
    runs = start_run(store.load_table(spark, base, "processing_runs"), "migration", now, {"source": path})
    store.save_table(runs, base, "processing_runs")
    runs = store.load_table(spark, base, "processing_runs")
    run_id = runs.agg(F.max("id").alias("id")).head().id
    try:
        rows = stage_csv(spark, path, base, f"run={run_id}")
        total = rows.count()
        _append_classified(spark, rows, base, now, run_id)
    except Exception as error:
        store.save_table(update_run(runs, run_id, now, FAILED, error=str(error)), base, "processing_runs")
        raise
    store.save_table(
        update_run(runs, run_id, now, COMPLETED, processed=total, total=total, stats={"total_rows": total}),
        base, "processing_runs")
    if buckets:
        tables = store.save_bucketed(spark, base, buckets, prefix)
    else:
        tables = {name: store.load_table(spark, base, name) for name in store.TABLES}
    store.register_frames(tables)
    return catalogue.verify(**tables)
