"""Distinct counts from mergeable sketches: kept per cell of a rollup, united for coarser levels."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# 2^14 registers: a standard error of 0.8 % at 16 KB or less for each cell.
LG_REGISTERS = 14
SUFFIX = "_sketch"


def distinct_sketches(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], lg_registers: int = LG_REGISTERS
) -> DataFrame:
    """One row per cell of ``keys`` with a sketch of the distinct values of each column; nulls do not count."""
    return df.groupBy(*keys).agg(*[
        F.hll_sketch_agg(F.col(c).cast("string"), lg_registers).alias(f"{c}{SUFFIX}") for c in columns])


def unite(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells united to coarser ones; without keys, to a single row. The rows counted are not read again."""
    sketches = [c for c in cells.columns if c.endswith(SUFFIX)]
    return cells.groupBy(*keys).agg(*[F.hll_union_agg(c).alias(c) for c in sketches])


def estimated(cells: DataFrame) -> DataFrame:
    """The cells with each sketch replaced by its estimate, under the name of the column counted."""
    return cells.select(*[
        F.hll_sketch_estimate(c).alias(c.removesuffix(SUFFIX)) if c.endswith(SUFFIX) else F.col(c) for c in cells.columns])
