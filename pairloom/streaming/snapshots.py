"""Snapshots of a stream of contacts: tumbling windows with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(contacts: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``start, u, v, weight`` of ``ts, i, j`` contacts per window; a window closes once the watermark passes it.

    Works on batch and streaming input alike; on a stream, state is bounded by the windows still open.
    """
    c = contacts.filter("i <> j").withWatermark("ts", late)
    e = c.groupBy(F.window("ts", length).alias("w"), F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    return e.select(F.col("w.start").alias("start"), "u", "v", "weight")
