"""Pre-computed rollups of labelled reviews."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import month_start
from ..functions.numbers import ratio
from ..functions.text import sentiment_from_category, sentiment_matches
from ..operators.columns import first_present

# Rollup name -> grouping columns, and the accepted source columns.
ROLLUPS = {
    "by_business": ("business_id",),
    "by_city": ("city",),
    "by_business_city": ("business_id", "city"),
    "by_region": ("region",),
    "by_business_region": ("business_id", "region"),
    "by_business_month": ("business_id", "month"),
    "by_city_month": ("city", "month"),
}
SENTIMENT_COLUMNS = ("label_sentiment", "sentiment", "category_sentiment")
BUSINESS_COLUMNS = ("business_id", "bank", "business", "business_name")
# Rollups that exist only if this column does; the others use whichever of their columns exist.
NEEDS = {"by_region": "region", "by_business_region": "region", "by_business_month": "month", "by_city_month": "month"}


def infer_sentiment(df: DataFrame) -> Column:
    """First sentiment column present, else derived from the category, else "unknown"."""
    column = first_present(df, SENTIMENT_COLUMNS)
    if column:
        return F.col(column)
    return sentiment_from_category(F.col("category")) if "category" in df.columns else F.lit("unknown")


def _finest(df: DataFrame) -> DataFrame:
    """Counts per combination of all grouping columns and sentiment: the one pass over the reviews."""
    if "rating" not in df.columns:
        raise ValueError("missing column: rating")
    keys = {}
    business = first_present(df, BUSINESS_COLUMNS)
    if business:
        keys["business_id"] = F.col(business)
    keys |= {c: F.col(c) for c in ("city", "region", "month") if c in df.columns}
    if "month" not in keys and "created_at" in df.columns:
        keys["month"] = month_start(F.col("created_at"))
    rows = df.select("rating", infer_sentiment(df).alias("sentiment"), *[c.alias(n) for n, c in keys.items()])
    by_text = rows.groupBy(*keys, "sentiment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("stars"), F.count("rating").alias("rated"))
    # The few distinct sentiment texts are matched after the reviews are reduced.
    return by_text.withColumns({
        "labelled": F.when(F.col("sentiment").isNotNull(), F.col("n")),
        **{stem: F.when(sentiment_matches(F.col("sentiment"), stem), F.col("n")) for stem in ("pos", "neg", "neut")},
    }).drop("sentiment")


def _applicable(columns: list[str]) -> dict[str, tuple[str, ...]]:
    found = {}
    for name, keys in ROLLUPS.items():
        present = tuple(k for k in keys if k in columns)
        if present and NEEDS.get(name, present[0]) in columns:
            found[name] = present
    return found


def _measures() -> list[Column]:
    return [
        F.sum("n").alias("review_count"), ratio(F.sum("stars"), F.sum("rated")).alias("avg_rating"),
        *[ratio(F.coalesce(F.sum(stem), F.lit(0)), F.sum("labelled")).alias(f"{name}_share")
          for stem, name in (("pos", "positive"), ("neg", "negative"), ("neut", "neutral"))],
    ]


def build_aggregates(df: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per rollup; null group keys are kept, empty input is an error."""
    if df.isEmpty():
        raise ValueError("no rows to aggregate")
    finest = _finest(df)
    return {name: finest.groupBy(*keys).agg(*_measures()) for name, keys in _applicable(finest.columns).items()}


def rollup_table(df: DataFrame) -> DataFrame:
    """All rollups in one table with a ``rollup`` column: one scan, one GROUPING SETS pass.

    Rollups that group by the same columns, because a column is missing, all appear.
    """
    finest = _finest(df)
    keys = [c for c in ("business_id", "city", "region", "month") if c in finest.columns]
    by_name = _applicable(finest.columns)
    names = {}
    for name, group in by_name.items():
        names.setdefault(group, []).append(name)
    sets = [[F.col(k) for k in group] for group in names]
    grouped = finest.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        *_measures(), F.grouping_id().alias("_set"))
    label = F.array().cast("array<string>")
    for group, same in names.items():
        bits = int("".join("0" if k in group else "1" for k in keys), 2)
        label = F.when(F.col("_set") == bits, F.array(*[F.lit(name) for name in same])).otherwise(label)
    return grouped.withColumn("rollup", F.explode(label)).drop("_set")
