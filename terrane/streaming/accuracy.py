"""Running accuracy over a stream of graded items: event-time windows with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import stats


def windowed_accuracy(items: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n, correct and share by arm and window of `ts`; works on streams and on tables."""
    out = items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "arm").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("correct"))
    acc, lo, hi = stats.wilson(F.col("correct"), F.col("n"))
    return out.select(F.col("w.start").alias("start"), "arm", "n", "correct", F.round(acc, 6).alias("acc"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))
