"""Streams: row-wise operators, filters and grouped aggregates work on them as they are; operators that
need a global order refuse. Time windows are here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import _agg


def windowed(df: DataFrame, time: str, size: str, keys: list[str], specs, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Grouped aggregates of each time window; late: how long a window waits for late rows on a stream."""
    if late and df.isStreaming:
        df = df.withWatermark(time, late)
    made = df.groupBy(F.window(time, size, slide).alias("w") if slide else F.window(time, size).alias("w"), *keys).agg(*[_agg(df, c, f) for c, f in specs])
    return made.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in made.columns if c != "w"])
