"""The stored tables: Parquet below ``<base>/<table>/data``, partitioned by writer, batch and month.

A write first stages its rows in ``staging/writer=<w>``, looks for rows that break a constraint by keys
and row numbers alone, puts those into ``rejects`` and the others into ``data/writer=<w>/batch=<n>``.
A numbered batch overwrites its own folder, so repeating it replaces that batch only; a write that fails
before its Spark job commits leaves the table as it was. One job at a time writes under one writer name.
"""
from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.columns import complete
from ..operators.dedupe import key_digest
from ..operators.joins import reviews_full
from ..operators.validate import check_constraints
from ..schemas import KEY_DIGEST, REVIEW_KEY, TABLES, UNIQUE_KEYS
from ..session import configure
from ..sinks.writers import write_bucketed
from . import catalogue

MAIN = "main"
WRITER, BATCH = "_writer", "_batch"
# Reviews lie in one folder per month of their date, so a query over recent months lists only those.
MONTH = "review_month"
DATED = {"reviews": "review_date_parsed"}
DIGESTED = {"reviews": REVIEW_KEY}
# Statistics join these two on the review id; bucketed alike on it they need no shuffle.
BUCKETED = {"reviews": "id", "classifications": "review_id"}
# Number of a staged row, written with it, so that it stays whatever reads the staged rows.
POSITION = "_at"


def _stored_schema(table: str) -> T.StructType:
    digest = [T.StructField(KEY_DIGEST, T.BinaryType())] if table in DIGESTED else []
    month = [T.StructField(MONTH, T.StringType())] if table in DATED else []
    batch = [T.StructField(WRITER, T.StringType()), T.StructField(BATCH, T.LongType())]
    return T.StructType([*TABLES[table], *digest, *batch, *month])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The Parquet files below ``path``; None if there is no such folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_table(
    spark: SparkSession, base: str, table: str, writer: str | None = None, before_batch: int = 0,
    since: date | None = None, keyed: bool = False,
) -> DataFrame:
    """Rows of the table; with ``writer``, without that writer's batches from ``before_batch`` on;
    with ``since``, only reviews dated from that day's month on; with ``keyed``, with the stored
    digest of a review's key. Batches and months are partitions, so only the wanted ones are read."""
    schema = _stored_schema(table)
    rows = _read(spark, f"{base}/{table}/data", schema)
    if rows is None:
        rows = spark.createDataFrame([], schema)
    if writer is not None:
        rows = rows.filter((F.col(WRITER) != writer) | (F.col(BATCH) < before_batch))
    if since is not None and table in DATED:
        rows = rows.filter(F.col(MONTH) >= f"{since:%Y-%m}")
    digest = [KEY_DIGEST] if keyed and table in DIGESTED else []
    return rows.select(*TABLES[table].names, *digest)


def _rejected_positions(staged: DataFrame, table: str, stored: DataFrame | None) -> DataFrame | None:
    """Positions of staged rows that break NOT NULL, CHECK or a unique key; None if there are none.

    Of rows that share a key the one with the smallest hash of its values stays. A key is counted first,
    which shuffles the key alone; hashes and positions follow only if it repeats. Keys are reduced with
    map-side combine, so a key of many rows is never sorted or gathered in one task.
    """
    good, bad = check_constraints(staged, table)
    keys = UNIQUE_KEYS[table]
    order = F.struct(F.xxhash64(*TABLES[table].names).alias("hash"), POSITION)
    alive = good.select(*dict.fromkeys(keys), POSITION, order.alias("_order"))
    rejected = [] if bad.isEmpty() else [bad.select(POSITION)]
    for key in keys:
        turned_down = []
        if not alive.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
            firsts = alive.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first"))
            repeated = firsts.filter("_n > 1").select(key, "_first")
            turned_down.append(alive.join(repeated, key).filter("_order != _first").select(POSITION))
        if stored is not None:
            known = alive.join(stored.select(key), key, "left_semi")
            turned_down.append(known.select(POSITION))
        if turned_down:
            positions = reduce(DataFrame.unionByName, turned_down)
            positions = positions.distinct() if len(turned_down) > 1 else positions
            rejected.append(positions)
            alive = alive.join(positions, POSITION, "left_anti")
    return reduce(DataFrame.unionByName, rejected) if rejected else None


def _spread(df: DataFrame, table: str) -> tuple[DataFrame, list[str]]:
    """Rows as they are stored, and the columns that name their folders."""
    if table in DIGESTED:
        df = df.withColumn(KEY_DIGEST, key_digest(*DIGESTED[table]))
    if table not in DATED:
        return df, []
    return df.withColumn(MONTH, F.date_format(DATED[table], "yyyy-MM")).hint("rebalance", MONTH), [MONTH]


def _accepted(
    df: DataFrame, base: str, table: str, stored: DataFrame | None, writer: str, folder: str, mode: str
) -> DataFrame:
    """Stage the rows, put those that break a constraint into ``rejects``; the others."""
    spark = df.sparkSession
    names = TABLES[table].names
    staging = f"{base}/{table}/staging/writer={writer}"
    complete(df, TABLES[table]).withColumn(POSITION, F.monotonically_increasing_id()).write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(T.StructType([*TABLES[table], T.StructField(POSITION, T.LongType())])).parquet(staging)
    rejected = _rejected_positions(staged, table, None if stored is None or stored.isEmpty() else stored)
    if rejected is None or rejected.isEmpty():
        return staged.select(*names)
    staged.join(rejected, POSITION, "left_semi").select(*names).write.mode(mode).parquet(
        f"{base}/{table}/rejects/{folder}")
    return staged.join(rejected, POSITION, "left_anti").select(*names)


def save_table(df: DataFrame, base: str, table: str) -> None:
    """Replace the table's content; the new rows, which may come from the table, are staged before."""
    good = _accepted(df, base, table, None, MAIN, f"{WRITER}={MAIN}/{BATCH}=0", "append")
    rows, folders = _spread(good, table)
    rows.withColumns({WRITER: F.lit(MAIN), BATCH: F.lit(0)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy(WRITER, BATCH, *folders).parquet(f"{base}/{table}/data")


def append_rows(df: DataFrame, base: str, table: str, writer: str = MAIN, batch: int | None = None) -> None:
    """Add rows as one batch of the writer; writing a numbered batch again replaces it.

    Batches without a number go to the writer's batch 0 one after another. Rows whose key is stored
    already are rejected; a numbered batch is compared with everything but itself and later ones.
    """
    spark = df.sparkSession
    numbered = batch is not None
    folder = f"{WRITER}={writer}/{BATCH}={batch if numbered else 0}"
    mode = "overwrite" if numbered else "append"
    stored = load_table(spark, base, table, writer=writer if numbered else None, before_batch=batch or 0)
    rows, folders = _spread(_accepted(df, base, table, stored, writer, folder, mode), table)
    rows.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy(*folders).parquet(
        f"{base}/{table}/data/{folder}")


def rejected_rows(spark: SparkSession, base: str, table: str) -> DataFrame:
    """All rows that writes to the table have turned down."""
    rows = _read(spark, f"{base}/{table}/rejects", _stored_schema(table))
    return spark.createDataFrame([], TABLES[table]) if rows is None else rows.select(*TABLES[table].names)


def create_tables(spark: SparkSession, base: str) -> None:
    """Create missing tables as empty typed Parquet; the session gets the settings the jobs rely on."""
    configure(spark)
    for table, schema in TABLES.items():
        if _read(spark, f"{base}/{table}/data", _stored_schema(table)) is None:
            save_table(spark.createDataFrame([], schema), base, table)


def init_catalog(spark: SparkSession, base: str) -> None:
    """Create missing tables and register tables and views."""
    create_tables(spark, base)
    register_views(spark, base)


def register_frames(frames: dict[str, DataFrame]) -> None:
    """Register tables under their names and the four derived views."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    reviews, places, labels = frames["reviews"], frames["places"], frames["classifications"]
    reviews_full(reviews, places, labels).createOrReplaceTempView("v_reviews_full")
    catalogue.v_business_stats(reviews, labels).createOrReplaceTempView("v_business_stats")
    catalogue.v_city_stats(reviews, labels).createOrReplaceTempView("v_city_stats")
    catalogue.v_temporal_stats(reviews, labels).createOrReplaceTempView("v_temporal_stats")


def save_bucketed(spark: SparkSession, base: str, buckets: int, prefix: str) -> dict[str, DataFrame]:
    """All tables, with reviews and classifications copied into ``buckets`` alike on the review id.

    The copies lie below ``<base>/bucketed`` and are named ``<prefix>_<table>`` in the session's catalogue,
    which knows their buckets: statistics that join the sentiment have no shuffle below the join.
    """
    frames = {table: load_table(spark, base, table) for table in TABLES}
    for table, key in BUCKETED.items():
        write_bucketed(frames[table], f"{prefix}_{table}", key, buckets, f"{base}/bucketed/{table}")
        frames[table] = spark.table(f"{prefix}_{table}")
    return frames


def register_views(spark: SparkSession, base: str) -> None:
    register_frames({table: load_table(spark, base, table) for table in TABLES})


def sql(spark: SparkSession, base: str, text: str) -> DataFrame:
    """Ad-hoc SQL over the tables and views of a store."""
    register_views(spark, base)
    return spark.sql(text)
