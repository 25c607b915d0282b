"""Helpers the operators share: stored intermediate tables, ASCII case folding, the training fold."""
from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalake.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder of ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage and survives lost executors; without the setting a local session uses a
    folder of its own (see ``vocalake.session``).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        ensure_checkpoint_dir(spark)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def fold_of(id_column: Column) -> Column:
    """crc32 of the id written as text, modulo 3; 0 for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, label: str, id_column: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the id; all rows of a rarer label.

    The labels themselves are counted on the driver, so they must be few. Rows that repeat an id count
    once.
    """
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.countDistinct(id_column).alias("n")).collect()}
    buckets = 1 << 30
    place = F.pmod(F.xxhash64(id_column), F.lit(buckets))
    share = F.lit(False)
    for value, n in sizes.items():
        share = share | ((F.col(label) == F.lit(value)) & (place < int(buckets * min(1.0, per_label / max(n, 1)))))
    return rows.filter(share).dropDuplicates([id_column])
