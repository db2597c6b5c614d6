"""Symbol frequencies of a stream, by event-time windows (an extension: the blueprint has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_frequencies(stream: DataFrame, symbol: str, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each symbol in windows of ``width``; rows later than ``late`` behind the newest are left out.

    State is one count a (window, symbol) until the watermark passes the window's end.
    """
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), F.col(symbol).alias("symbol")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "symbol", "n")
