"""Time-bucket rollup on a stream; an extension, as the engine served has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, ts: str, keys: list[str], value: str, bucket: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per bucket and key; rows later than ``late`` are left out once their bucket is final."""
    w = F.window(ts, bucket)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("bucket"), *keys, "n", "total")
