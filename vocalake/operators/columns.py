"""Column roles, renames and defaults. Only column names are inspected, no job runs."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import month_start, parse_date_dayfirst
from ..functions.numbers import to_number
from ..functions.text import strip
from ..schemas import DEFAULTS, RENAMES, TABLES
from ..taxonomy import CATEGORIES, NEGATIVE_KEYWORDS, OTHER_KEYWORDS, POSITIVE_KEYWORDS

# Dashboard role -> accepted column names in order of preference.
ROLE_NAMES = {
    "business": ("_business", "_bank", "business", "bank", "brand"),
    "city": ("_city", "city", "ville", "commune"),
    "date": ("month", "date", "created_at", "time"),
    "rating": ("rating", "note", "stars", "score"),
    "text": ("text", "review_text", "content", "snippet"),
    "sentiment": ("sentiment",),
    "place_id": ("_place_id", "place_id", "agency_id"),
}


def _loose(name: str) -> str:
    return "".join(ch for ch in name.strip().lower() if ch not in " _")


def detect_column(df: DataFrame, names: Sequence[str], required: bool = False) -> str | None:
    """First candidate present, ignoring case, blanks and underscores."""
    present = {}
    for column in df.columns:
        present.setdefault(_loose(column), column)
    found = next((present[_loose(n)] for n in names if _loose(n) in present), None)
    if found is None and required:
        raise ValueError(f"none of {list(names)} among {df.columns}")
    return found


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """First candidate present under exactly that name."""
    return next((n for n in names if n in df.columns), None)


def file_order() -> Column:
    """Order of rows read from files: file, block in the file, position in the block.

    Spark packs the blocks of several files into tasks by size, so the row position alone
    would not follow the files.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"))


def detect_roles(df: DataFrame) -> dict[str, str | None]:
    return {role: first_present(df, names) for role, names in ROLE_NAMES.items()}


def normalize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def conform(df: DataFrame, kind: str) -> DataFrame:
    """Rename source columns to the table's names; a renamed column replaces one of that name,
    and of several sources for one name the first in the map's order wins."""
    chosen = {}
    for source, target in RENAMES[kind].items():
        if source in df.columns:
            chosen.setdefault(target, source)
    replaced = [t for t in chosen if t in df.columns]
    return df.drop(*replaced).withColumnsRenamed({s: t for t, s in chosen.items()})


def keep_valid(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema that the input has, cast leniently to their type."""
    present = [f for f in schema.fields if f.name in df.columns]
    return df.select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in present])


def complete(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All columns of the schema, missing ones null."""
    return df.select([
        (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def with_defaults(df: DataFrame, table: str, now: datetime) -> DataFrame:
    """Add default columns the input lacks, and stamp the table's timestamps."""
    added = {name: F.lit(value) for name, value in DEFAULTS.get(table, {}).items() if name not in df.columns}
    for stamp in ("created_at", "updated_at"):
        if stamp in TABLES[table].names:
            added[stamp] = F.lit(now).cast("timestamp")
    return df.withColumns(added)


def category_columns(df: DataFrame, taxonomy: Sequence[str] = CATEGORIES) -> tuple[list, list, list]:
    """(positive, negative, other) columns: by taxonomy position, else by keyword."""
    if taxonomy:
        groups = taxonomy[:7], taxonomy[7:14], taxonomy[14:]
        return tuple([c for c in group if c in df.columns] for group in groups)
    keywords = POSITIVE_KEYWORDS, NEGATIVE_KEYWORDS, OTHER_KEYWORDS
    found = [], [], []
    for column in df.columns:
        group = next((i for i, words in enumerate(keywords) if any(w in column.lower() for w in words)), None)
        if group is not None:
            found[group].append(column)
    return found


def prepare_reviews(df: DataFrame, roles: dict[str, str | None]) -> DataFrame:
    """Parse dates, derive ``_month`` and ``_year``, make ratings numeric, trim business names."""
    changes = {}
    if roles["date"]:
        name = roles["date"]
        typed = isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        moment = F.col(name) if typed else parse_date_dayfirst(F.col(name))
        changes |= {name: moment, "_month": month_start(moment), "_year": F.year(moment)}
    if roles["rating"]:
        changes[roles["rating"]] = to_number(F.col(roles["rating"]))
    if roles["business"]:
        changes[roles["business"]] = strip(F.col(roles["business"]).cast("string"))
    return df.withColumns(changes)
