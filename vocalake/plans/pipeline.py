"""Normalise -> region -> classify -> wide -> write, each stage restartable from its stored input."""
from __future__ import annotations

from collections.abc import Collection
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.classify import Scorer, classify, classify_by_rules
from ..operators.geo import add_region, region_by_city
from ..operators.normalize import normalize_reviews
from ..session import configure
from ..sinks.writers import export_csv, read_latest, widen, write_run

STAGES = ("transform", "classify", "export")


def transform(reviews: DataFrame, now: datetime, regions: DataFrame | None = None) -> DataFrame:
    """Normalised reviews with a region: by coordinates where there are polygons, else by city."""
    clean = normalize_reviews(reviews, now)
    located = {"lat", "latitude"} & set(clean.columns) and {"lng", "longitude", "lon"} & set(clean.columns)
    if regions is not None and located:
        return add_region(clean, regions)
    return region_by_city(clean) if "city" in clean.columns else clean


def run_pipeline(
    spark: SparkSession,
    base: str,
    now: datetime,
    reviews: DataFrame | None = None,
    regions: DataFrame | None = None,
    scorer: Scorer | None = None,
    skip: Collection[str] = (),
) -> DataFrame:
    """Run the stages that are not skipped and return the wide classified reviews.

    Every stage writes a dated run and the next one reads it back, which both cuts the lineage
    and lets a later run skip a stage whose output is already stored.
    """
    configure(spark)
    if "transform" not in skip:
        if reviews is None:
            raise ValueError("the transform stage needs reviews")
        write_run(transform(reviews, now, regions), f"{base}/transformed", now.date())
    if "classify" not in skip:
        rows = read_latest(spark, f"{base}/transformed")
        labelled = classify(rows, scorer) if scorer else classify_by_rules(rows)
        write_run(labelled, f"{base}/classified", now.date())
    labelled = read_latest(spark, f"{base}/classified")
    if "export" not in skip:
        export_csv(labelled, f"{base}/export")
    return widen(labelled)
