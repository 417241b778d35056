"""Incremental context tables: an extension for feeds that arrive as files or topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions.columns import month_after


def daily_counts(stream: DataFrame, time_column: str, keys: list[str], lateness: str = "7 days") -> DataFrame:
    """Facts a key and day, final once the watermark has passed, so that the state is that of the days still open."""
    days = F.window(time_column, "1 day")
    return stream.withWatermark(time_column, lateness).groupBy(days, *keys).agg(F.count(F.lit(1)).alias("facts")).select(*keys, F.to_date("window.start").alias("day"), "facts")


def monthly_counts(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Facts a key and calendar month, of the table that daily_counts has written."""
    return daily.groupBy(*keys, F.trunc("day", "month").alias("month")).agg(F.sum("facts").alias("facts"))


def feed_context(stream: DataFrame, path: str, checkpoint: str, time_column: str, flatten: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Adds flattened facts, dated as context tables are, to a table partitioned by batch and date. A batch that is tried again replaces what
    its first try has written, so no fact counts twice."""

    def put(batch: DataFrame, number: int) -> None:
        dated = flatten(batch).withColumn("date", month_after(time_column)).withColumn("feed_batch", F.lit(number))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed_batch", "date").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
