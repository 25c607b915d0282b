"""Exact deduplication that combines salted groups and compares whole contents."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

SALTS = 64


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS,
    digest: Callable[[Column], Column] = content_digest,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest``.

    Texts are equal when identical after lower-casing A-Z. Three combining steps group by the whole
    content, not only by its digest: rows of a task (the map side of the first aggregate), rows of a
    salt, and the winners of all salts, so no task sees more of a hot text than one row per task or
    salt. Rows then meet their winner on the digest, a join of narrow rows that the adaptive planner
    splits where one digest is hot. Digests shared by different contents are found first, and only
    their rows are joined on the content itself.

    Null text counts as empty; empty texts form a group like any other. The largest id wins, a null id
    loses to any other, and a group of null ids has a null ``keep_id``. Rows that repeat the winning
    id and text are all marked kept. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), ascii_lower(F.coalesce(F.col(text_column), F.lit(""))).alias("content")
    ).withColumn("digest", digest(F.col("content")))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "content", "salt").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    )
    winners = salted.groupBy("digest", "content").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    narrow = stored(winners.drop("content"))
    shared = narrow.groupBy("digest").agg(F.count("*").alias("contents")).filter("contents > 1").select("digest")
    labelled = rows.drop("content").join(narrow, "digest")
    if not shared.isEmpty():
        shared = stored(shared)
        labelled = (
            rows.drop("content").join(narrow.join(shared, "digest", "left_anti"), "digest")
            .unionByName(
                rows.join(shared, "digest", "left_semi")
                .join(winners.join(shared, "digest", "left_semi"), ["digest", "content"])
                .drop("content")
            )
        )
    return labelled.select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )
