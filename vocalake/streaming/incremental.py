"""Resumable runs: only what is new gets processed, and repeating a batch changes nothing."""
from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutate import new_reviews
from ..plans import store

STREAM = "stream"


def incremental(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return new.join(done.select(key), key, "left_anti")


def stream_new_files(
    spark: SparkSession, path: str, schema: T.StructType, source: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Files of a directory as a stream; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema).format(source)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def process_available(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Hand every pending micro-batch to ``handle`` and stop; call again to resume."""
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append of a transformed stream to Parquet files."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )


def review_appender(spark: SparkSession, base: str, now: datetime, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch handler that inserts new reviews into the store.

    A micro-batch is compared with everything but itself and later batches of this stream,
    so one that is replayed after a failure writes the same rows to the same place.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        earlier = store.load_table(spark, base, "reviews", writer=STREAM, before_batch=batch_id, keyed=True)
        # The place in the batch breaks ties, so that the order is total.
        rows = new_reviews(earlier, batch.withColumn("_row", F.monotonically_increasing_id()), now, [*order, "_row"])
        store.append_rows(rows, base, "reviews", writer=STREAM, batch=batch_id)

    return handle


def upsert_stream(
    stream: DataFrame, base: str, checkpoint: str, now: datetime, order: list[str]
) -> StreamingQuery:
    """Insert a stream of raw reviews into the store, ignoring known ones."""
    store.create_tables(stream.sparkSession, base)
    return process_available(stream, checkpoint, review_appender(stream.sparkSession, base, now, order))
