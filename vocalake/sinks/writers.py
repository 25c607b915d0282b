"""Sinks: Parquet, CSV, JSON bundles, dated runs and bucketed tables."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.categories import label_flags, parse_categories
from ..functions.text import slug
from ..operators.ids import assign_ids
from ..schemas import REVIEW_ITEM
from ..taxonomy import CATEGORIES


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def widen(df: DataFrame) -> DataFrame:
    """Add one 0/1 column per category label from ``categories_json``."""
    labels = df.withColumn("_labels", parse_categories(F.col("categories_json"))["label"])
    return labels.withColumns(label_flags(F.col("_labels"), CATEGORIES)).drop("_labels")


def export_csv(df: DataFrame, path: str, wide: bool = True) -> None:
    """CSV with a header; ``wide`` adds the category columns."""
    out = widen(df) if wide and "categories_json" in df.columns else df
    out.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def export(df: DataFrame, path: str, wide: bool = True) -> None:
    """The suffix decides: ``.parquet`` or CSV."""
    if path.endswith(".parquet"):
        export_parquet(df, path)
    else:
        export_csv(df, path, wide)


def with_position(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``position``, the place of a review among those of its place in the given order.

    Positions are global row numbers less the first one of the place, so no task gathers a place.
    """
    numbered = assign_ids(df, ["place_id", *order], name="_number")
    first = numbered.groupBy("place_id").agg(F.min("_number").alias("_first"))
    return numbered.join(first, "place_id").withColumn(
        "position", (F.col("_number") - F.col("_first")).cast("int")).drop("_number", "_first")


def bundle_lines(df: DataFrame, by: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Lines of ``{place_id: [review]}``, with the column ``by`` beside them if given.

    A line holds one review and its position inside the place in the given order (by default that
    of all review columns), so lines are the same whatever the batch or partition sizes, and a
    place with many reviews is never gathered. Rows are rebalanced by the key of the output
    directory (or place): small ones share a task, a hot one is split by the adaptive planner.
    """
    columns = [c for c in REVIEW_ITEM.names if c in df.columns and c != "position"]
    rows = with_position(df.filter(F.col("place_id").isNotNull()), order or columns)
    item = F.struct(*columns, "position")
    value = F.to_json(F.create_map(F.col("place_id").cast("string"), F.array(item))).alias("value")
    keep = [by] if by else []
    spread = rows.select("place_id", "position", *keep, value).hint("rebalance", by or "place_id")
    return spread.sortWithinPartitions(*keep, "place_id", "position").select("value", *keep)


def write_review_bundle(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One JSON object of a place and one of its reviews per line."""
    bundle_lines(df, order=order).write.mode("overwrite").text(path)


def write_json_by(df: DataFrame, path: str, column: str, order: Sequence[str] = ()) -> None:
    """The same lines, one directory per slug of ``column`` (city or business)."""
    key = f"{column}_slug"
    lines = bundle_lines(df.withColumn(key, slug(F.col(column))), key, order)
    lines.write.mode("overwrite").partitionBy(key).text(path)


def write_run(df: DataFrame, base: str, run_date: date) -> str:
    """Dated run directory; rerunning a date replaces only that date."""
    path = f"{base}/run_date={run_date:%Y%m%d}"
    df.write.mode("overwrite").parquet(path)
    return path


def run_folders(spark: SparkSession, base: str) -> list[str]:
    """Paths of the dated runs that hold data, oldest first, by listing ``base`` and the newest folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = sorted(
        s.getPath().getName() for s in files.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("run_date="))

    def holds_data(name: str) -> bool:
        inside = files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}"))
        return any(not s.getPath().getName().startswith(("_", ".")) for s in inside)

    while names and not holds_data(names[-1]):
        names.pop()
    return [f"{base}/{name}" for name in names]


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """The newest run; folder names tell which, so no other run is read or listed inside."""
    folders = run_folders(spark, base)
    if not folders:
        raise FileNotFoundError(f"no run below {base}")
    return spark.read.parquet(folders[-1])


def split_failures(df: DataFrame, status: str = "status", failed: str = "failed") -> tuple[DataFrame, DataFrame]:
    """(succeeded rows, distinct place ids that failed)."""
    is_failed = F.coalesce(F.col(status) == failed, F.lit(False))
    return df.filter(~is_failed), df.filter(is_failed).select("place_id").distinct()


def write_aggregates(rollups: DataFrame, path: str) -> None:
    """All rollups in one pass, one Parquet directory per rollup name."""
    rollups.write.mode("overwrite").partitionBy("rollup").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> None:
    """Hash-bucketed, key-sorted table at ``path``: two tables bucketed alike join without a shuffle.

    Rows are dealt by the same hash before, so each bucket is one file whatever the number of tasks.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    writer.option("path", path).saveAsTable(table)
