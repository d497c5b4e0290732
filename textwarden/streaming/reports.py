"""Guards on streams: the row path as it is, and windowed counts of what it finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.plans.guard import Guard


def censored(stream: DataFrame, guard: Guard, text: str, to: str = "censored") -> DataFrame:
    return stream.withColumn(to, guard.censor(text))


def match_counts(stream: DataFrame, guard: Guard, text: str, time: str, length: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Matches by category in windows of event time; rows later than delay are left out."""
    found = stream.withWatermark(time, delay).select(F.col(time), F.explode(guard.matches(text)).alias("m"))
    counts = found.groupBy(F.window(time, length), F.col("m.category").alias("category")).agg(F.count(F.lit(1)).alias("matches"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "category", "matches")
