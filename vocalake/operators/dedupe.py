"""Keep-first deduplication and group selection without gathering a group in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _rest(df: DataFrame, keys: Sequence[str]) -> Column:
    """The other columns as a struct; category names hold dots, so all are quoted."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])


def _unpacked(grouped: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return grouped.select([F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in names])


def key_digest(*names: str) -> Column:
    """256-bit digest of the columns; nulls, empty strings and shifted borders all differ."""
    def part(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(name) for name in names]), 256))


def first_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``keys`` and the order columns of the first row per key; a hash aggregate where the order is one number."""
    if len(order) == 1:
        return rows.groupBy(*keys).agg(F.min(order[0]).alias(order[0]))
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def same_row(rows: DataFrame, winners: DataFrame, key: str, order: Sequence[str]) -> Column:
    same = rows[key] == winners[key]
    for name in order:
        same = same & rows[name].eqNullSafe(winners[name])
    return same


def _first_by_digest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    keyed = df.withColumn("_digest", key_digest(*keys))
    winners = first_order(keyed, ["_digest"], order)
    return keyed.join(winners, same_row(keyed, winners, "_digest", order), "left_semi").drop("_digest")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], total: bool = False) -> DataFrame:
    """The first row per key in the given order; null keys count as equal.

    An aggregate rather than a window: each map task already reduces a key to one row, so a
    key that holds most of the data sends one row per task through the shuffle. ``total`` says that no
    two rows of a key tie in the order; then only a digest of the key and the order are aggregated, and
    the rows meet the winners on both, so long keys never travel as keys and a hot key spreads.
    """
    if total:
        return _first_by_digest(df, keys, order)
    first = F.min_by(_rest(df, keys), F.struct(*order)).alias("_row")
    return _unpacked(df.groupBy(*keys).agg(first), df.columns, keys)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in the given order."""
    last = F.max_by(_rest(df, keys), F.struct(*order)).alias("_row")
    return _unpacked(df.groupBy(*keys).agg(last), df.columns, keys)


def pick_strategy(df: DataFrame, keys: Sequence[str] = ("business", "city"), rank: str = "strategy") -> DataFrame:
    """Rows of the strongest (lowest) strategy that gave the group any result."""
    best = df.groupBy(*keys).agg(F.min(rank).alias(rank))
    return df.join(best, [*keys, rank], "left_semi").select(*df.columns)
