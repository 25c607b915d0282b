"""Shares, ranks and top-N over aggregated rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numbers import pct, round_to


def order_by(df: DataFrame, column: str, descending: bool, *ties: str) -> DataFrame:
    """Nulls last in both directions, then the tie columns ascending."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(key, *[F.col(t).asc_nulls_last() for t in ties])


def top_n(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    return order_by(df, column, True, *ties).limit(n)


def with_share(df: DataFrame, n: str, name: str = "percentage") -> DataFrame:
    """Percentage of the grand total. The total is a scalar subquery over the same aggregate,
    so no window gathers the rows and the aggregate's shuffle is reused."""
    total = df.agg(F.sum(n).alias("t")).scalar()
    return df.withColumn(name, round_to(pct(F.col(n), total)))


def with_group_share(df: DataFrame, keys: Sequence[str], n: str, name: str = "percentage") -> DataFrame:
    """Percentage of the group's total, for groups bounded by a small domain."""
    return df.withColumn(name, pct(F.col(n), F.sum(n).over(W.partitionBy(*keys))))


def competition_rank(
    df: DataFrame, group: str, value: str, descending: bool, name: str = "rank"
) -> DataFrame:
    """Rank with gaps of ``value`` inside ``group``, for values from a small domain.

    Ranks are computed on the distinct values of a group (a 1-decimal percentage has at most
    1 001) and joined back, so a group with millions of rows is never sorted in one task.
    """
    levels = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    ordering = F.col(value).desc() if descending else F.col(value).asc()
    before = W.partitionBy(group).orderBy(ordering).rowsBetween(W.unboundedPreceding, -1)
    ranks = levels.select(group, value, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).alias(name))
    return df.join(ranks, [group, value])


def global_rank(
    df: DataFrame, value: str, low: float, high: float, name: str = "rank", slots: int = 4_096
) -> DataFrame:
    """``RANK() OVER (ORDER BY value DESC)`` without a single-task sort; null values rank last.

    Distinct values fall into ``slots`` equal slots of [low, high]; a value's rank is the rows
    of the higher slots plus the rows of higher values in its own slot.
    """
    slot = F.floor((F.lit(high) - F.greatest(F.lit(low), F.least(F.lit(high), F.col(value))))
                   * F.lit(slots / (high - low)))
    levels = (
        df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_slot", F.when(F.col(value).isNull(), F.lit(slots + 1)).otherwise(slot))
    )
    per_slot = levels.groupBy("_slot").agg(F.sum("_n").alias("_n"))
    earlier = W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    # At most slots + 2 rows, whatever the data.
    offsets = F.broadcast(per_slot.select("_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    inside = W.partitionBy("_slot").orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, -1)
    ranks = levels.join(offsets, "_slot").select(
        F.coalesce(value, F.lit(float("-inf"))).alias("_level"),
        (F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + 1).alias(name),
    )
    keyed = df.withColumn("_level", F.coalesce(value, F.lit(float("-inf"))))
    return keyed.join(ranks, "_level").drop("_level")
