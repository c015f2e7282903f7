"""Incremental forms of the batch operators, for rows that keep arriving.

The reference has no streams; these are the event-time counterparts of its rollups, with bounded state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators import facets
from lodestrata.operators.filters import COMPANY_DIMENSIONS, Filters


def read_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, by..., n: rows of each event-time window; rows later than the watermark are dropped with its state.

    Rows without a time belong to no window and are dropped.
    """
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, late)
    counted = rows.groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")


def distinct_rows(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: repeats of a delivery are dropped, state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def keep_facets(stream: DataFrame, path: str, checkpoint: str, filters: Filters | None = None) -> StreamingQuery:
    """Writes each batch's facet counts below path, one folder a batch: counts are additive, read them by summing.

    A batch that is repeated after a failure overwrites its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        got = facets.counts(batch, filters or Filters(), COMPANY_DIMENSIONS, ("company_name", "domain"))
        got.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
