"""Removal of repeated passages by overlapping windows of three lines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def window_keys(lines: Column, window: int = WINDOW) -> Column:
    """128-bit keys of all windows, in order; null where every line of a window is blank."""
    def key(start: Column) -> Column:
        passage = F.array_join(F.array(*[F.get(lines, start + i) for i in range(window)]), "\n")
        return F.when(F.length(F.btrim(passage, F.lit(" \t\r\n\f\x0b"))) > 0, F.unhex(F.md5(passage)))

    return F.when(
        F.size(lines) >= window, F.transform(F.sequence(F.lit(0), F.size(lines) - window), key)
    ).otherwise(F.array().cast("array<binary>"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """Input rows as struct ``row`` with ``lines, n_removed, text``: the text without repeated windows.

    Lines end at each newline and compare exactly. A window is ``window`` consecutive lines, not all
    blank; its first occurrence is the one with the smallest (id, digest of text, position), null ids
    first. Every later occurrence is removed: the lines it covers, merged over all its windows, except
    those inside the first occurrence itself where the two overlap. Texts of fewer lines have no window
    and stay. A null text stays null with 0 lines; a text whose lines all go becomes empty. Repeated
    rows of one id and text are one document and get the same result. The input's columns stay inside
    ``row``, so no name can clash; an empty table gives no rows.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_column).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_column), F.lit("")))).alias("version"),
        F.split(F.coalesce(F.col(text_column), F.lit("")), "\n", -1).alias("lines"),
    )
    windows = rows.select(
        "id", "version", F.posexplode(window_keys(F.col("lines"), window)).alias("at", "key")
    ).filter("key IS NOT NULL")
    repeated = (
        windows.groupBy("key").agg(F.min(F.struct("id", "version", "at")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select("key", "first")
    )
    same_text = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("version") == F.col("first.version"))
    later = windows.join(repeated, "key").filter(~(same_text & (F.col("at") == F.col("first.at")))).select(
        "id", "version",
        F.when(same_text, F.greatest("at", F.col("first.at") + window)).otherwise(F.col("at")).alias("begin"),
        (F.col("at") + window).alias("end"),
    ).filter("begin < end")
    covered = later.groupBy("id", "version").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    positions = F.array_distinct(
        F.flatten(F.transform("ranges", lambda r: F.sequence(r["begin"], r["end"] - 1)))
    )
    other = covered.select(F.col("id").alias("other_id"), F.col("version").alias("other_version"), positions.alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n")
    is_text = F.col(f"row.`{text_column}`").isNotNull()
    return rows.join(
        other, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("version") == F.col("other_version")), "left"
    ).select(
        "row", F.when(is_text, F.size("lines")).otherwise(0).alias("n_lines"),
        F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).alias("n_removed"),
        F.when(F.col("gone").isNotNull(), cleaned).otherwise(F.col(f"row.`{text_column}`")).alias("text"),
    )
