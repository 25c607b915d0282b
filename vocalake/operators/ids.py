"""Dense surrogate ids over a distributed table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F, types as T

MOST_SLOTS = 256
SAMPLED_PER_SLOT = 32


def _comparable(df: DataFrame, name: str) -> Column:
    """The column in a form whose values come back from the driver unchanged."""
    is_instant = isinstance(df.schema[name].dataType, T.TimestampType)
    return F.unix_micros(F.col(name)) if is_instant else F.col(name)


def _splits(df: DataFrame, order: Sequence[str]) -> list[Row]:
    """Values that cut the rows into slots of similar size, from the rows with the smallest hashes.

    The sample depends on the rows alone and is bounded, whatever the size of the table.
    """
    slots = min(MOST_SLOTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = df.select(*[_comparable(df, c).alias(c) for c in order])
    picked = values.orderBy(F.xxhash64(*order), *order).limit(slots * SAMPLED_PER_SLOT)
    sample = picked.orderBy(*order).collect()
    places = sorted({len(sample) * i // slots for i in range(1, slots)} - {0})
    return [sample[i] for i in places]


def _literal(value, kind: T.DataType) -> Column:
    if value is None or not isinstance(kind, T.StructType):
        return F.lit(value).cast(kind)
    return F.struct(*[_literal(part, field.dataType).alias(field.name) for part, field in zip(value, kind.fields)])


def _slot(values: Column, kind: T.StructType, splits: Sequence[Row], first: int = 0) -> Column:
    """Number of splits at or below the values, found by halving; nulls come first."""
    if not splits:
        return F.lit(first)
    middle = len(splits) // 2
    return F.when(values < _literal(splits[middle], kind), _slot(values, kind, splits[:middle], first)).otherwise(
        _slot(values, kind, splits[middle + 1:], first + middle + 1))


def assign_ids(
    df: DataFrame, order: Sequence[str], after: int | Column = 0, name: str = "id", cut_by: DataFrame | None = None
) -> DataFrame:
    """Number the rows ``after + 1, after + 2, ...`` in the given total order.

    Slots of the order are cut at literal values, taken from a bounded sample while the plan is built, so
    a recomputation cuts alike and nothing has to be written. A row's id is its rank inside its slot plus
    the sizes of the slots before it; the sizes need the order columns only, and one small row per slot
    passes through a window without a key. ``cut_by``, a table that holds all the rows and perhaps others,
    gives the sample in place of ``df`` where it is cheaper to read.
    """
    splits = _splits(df if cut_by is None else cut_by, order)
    compared = F.struct(*[_comparable(df, c).alias(c) for c in order])
    kind = df.select(compared.alias("v")).schema["v"].dataType
    placed = df.withColumn("_slot", _slot(compared, kind, splits))
    sizes = placed.groupBy("_slot").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_slot", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("_slot").orderBy(*order)))
    base = after if isinstance(after, Column) else F.lit(after)
    # One row per slot: the broadcast is bounded by MOST_SLOTS.
    return ranked.join(F.broadcast(offsets), "_slot").select(
        (base + F.col("_offset") + F.col("_rank")).cast("long").alias(name),
        *[F.col(f"`{c}`") for c in df.columns if c != name],
    )


def max_id(df: DataFrame, name: str = "id") -> Column:
    """Largest id of a table (0 if empty), as a scalar subquery."""
    return df.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).scalar()
