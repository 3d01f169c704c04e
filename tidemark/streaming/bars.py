"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str, late: str, code: str = "code", time: str = "ts", price: str = "price", size: str = "size") -> DataFrame:
    """Event-time bars ``code, trade_time, open, high, low, close, volume`` of a streaming or batch table.

    A bar is final, in append mode, once the watermark of ``late`` has passed its end. Ticks of one instant are
    ordered by price, so the result does not depend on arrival.
    """
    order = F.struct(time, price)
    bars = ticks.withWatermark(time, late).groupBy(F.col(code).alias("code"), F.window(time, width).alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(size).cast("double").alias("volume"),
    )
    return bars.select("code", F.col("w.start").alias("trade_time"), "open", "high", "low", "close", "volume")
