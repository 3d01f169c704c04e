"""Bars: the tick-to-bar job, feeds with extra columns, calendars and shape changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.frames import Rows
from tidemark.functions.scalars import col, no_nan
from tidemark.plans import calendar as calendars

#: Daily bars as read at the boundary.
BARS = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("dt", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)


def read_panel(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType = BARS, **options) -> DataFrame:
    """A long price table with the given schema from any Spark source; NaN becomes null."""
    found = spark.read.format(format).schema(schema).options(**options).load(path)
    floats = [f.name for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return found.withColumns({c: no_nan(c) for c in floats})


def write_panel(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """Write a result table with any Spark sink."""
    df.write.format(format).mode(mode).partitionBy(*partition_by).save(path)


def repeated_keys(df: DataFrame, keys: Sequence[str] = ("code", "dt")) -> DataFrame:
    """Keys that occur more than once, with their count: empty for a sound panel."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: Sequence[str] = ("code",), order: str = "dt", mode: str = "error") -> None:
    """Write a table in ``buckets`` by key, sorted by key and time: windows and joins by the key over it need no shuffle.

    Rows are dealt by key first, so each bucket is one file. A key's rows lie in one bucket; see ``plans.halo`` for keys beyond a task.
    """
    df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys, order).saveAsTable(table)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """ValueError if a column is missing."""
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


@dataclass
class Checks:
    """What a checked panel has shown once an action has read it; ``verify`` raises ValueError on the first faults."""

    seen: Observation

    def counts(self) -> dict[str, int]:
        return dict(self.seen.get)

    def verify(self) -> None:
        if bad := [f"{n} {what.replace('_', ' ')}" for what, n in self.counts().items() if what != "rows" and n]:
            raise ValueError(f"unsound panel: {', '.join(bad)}")


def checked(df: DataFrame, schema: T.StructType = BARS, rows: Rows = Rows()) -> tuple[DataFrame, Checks]:
    """A panel that counts its own faults while it is read, so no second scan is needed.

    Missing columns and other types than those of ``schema`` are an error at once. Null keys, repeated keys, values that are not finite and
    bars whose high lies below their low are counted in the pass of the first action on the returned table; ``Checks.verify`` after it
    raises. The check of repeats looks at the row before, in the order that the signals need anyway.
    """
    require_columns(df, schema.names)
    if wrong := [f"{f.name} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}" for f in schema if df.schema[f.name].dataType != f.dataType]:
        raise ValueError(f"wrong types: {', '.join(wrong)}")
    keys = [*rows.keys, rows.order]
    seen = Observation()
    floats = [f.name for f in schema if isinstance(f.dataType, T.DoubleType)]
    odd = reduce(or_, [F.isnan(c) | (F.abs(c) == float("inf")) for c in floats], F.lit(False))
    counts = [F.count("*").alias("rows"), F.count_if(reduce(or_, [F.col(k).isNull() for k in keys])).alias("null_keys"), F.count_if(F.col("__before") == F.col(rows.order)).alias("repeated_keys"), F.count_if(odd).alias("values_not_finite")]
    if {"high", "low"} <= set(schema.names):
        counts.append(F.count_if(F.col("high") < F.col("low")).alias("highs_below_lows"))
    return df.withColumn("__before", rows.lag(rows.order)).observe(seen, *counts).drop("__before"), Checks(seen)


def ohlcv_bars(
    ticks: DataFrame, code: Column | str, time: Column | str, price: Column | str, size: Column | str, order: Sequence[Column | str], time_name: str = "dt"
) -> DataFrame:
    """Open, high, low, close and volume per code and (already truncated) time.

    ``order`` decides the first and last price; it should be unique, or end in the price itself. One
    aggregation, combined before its shuffle; with a single order column it hashes instead of sorting.
    """
    place = col(order[0]) if len(order) == 1 else F.struct(*[col(o) for o in order])
    rows = ticks.select(col(code).alias("code"), col(time).alias(time_name), col(price).alias("p"), col(size).alias("s"), place.alias("o"))
    return rows.groupBy("code", time_name).agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"),
        F.sum("s").cast("double").alias("volume"),
    )


def scan_range(df: DataFrame, begin=None, end=None, time: str = "dt") -> DataFrame:
    """Rows between two bounds, both included; a missing bound does not limit. Pushed down to the scan."""
    if begin is not None:
        df = df.where(F.col(time) >= F.lit(begin))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end))
    return df


def with_signal(bars: DataFrame, signal: DataFrame, keys: Sequence[str] = ("code", "dt")) -> DataFrame:
    """Bars that have a signal, with its columns next to the prices."""
    return bars.join(signal, list(keys))


def calendar(df: DataFrame, time: str = "dt") -> DataFrame:
    """Every distinct time of the table."""
    return df.select(time).distinct()


def dense_grid(df: DataFrame, code: str = "code", time: str = "dt", shuffled: bool = False) -> DataFrame:
    """Every code at every time of the union calendar, with nulls where it had no row, and ``present``.

    A null code is a code of its own; a row without a time is not on the calendar. ``shuffled`` says that ``df`` comes out of an
    aggregation, whose shuffle then serves the calendar too.
    """
    return calendars.dense(df, code, time, (), shuffled)


def calendar_align(bars: DataFrame, rows: Rows = Rows(), shuffled: bool = False) -> DataFrame:
    """All codes on the union calendar: volume 0 and the last known prices where a code has no bar."""
    (code,) = rows.keys
    prices = ("open", "high", "low", "close")
    held = bars.withColumns({c: rows.last_known(c) for c in prices})
    return calendars.dense(held, code, rows.order, prices, shuffled).drop("present").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def on_grid(df: DataFrame, grid: str, windowed: Callable[[DataFrame, Rows], DataFrame], rows: Rows = Rows()) -> DataFrame:
    """Apply a windowed operator on each code's own rows ('own') or on the union calendar ('union').

    ``windowed(df, rows)`` builds its columns with the given ``rows``. On the union calendar a missing row is a null in every frame
    it falls into; frames are ranges of calendar ranks then, and only rows that exist are made.
    """
    if grid == "own":
        return windowed(df, rows)
    if grid != "union":
        raise ValueError("grid is 'own' or 'union'")
    on, by_rank = calendars.ranked(df, rows)
    return windowed(on, by_rank).drop(calendars.RANK)


def mean_per_time(df: DataFrame, values: Sequence[str], code: str = "code", time: str = "trade_time") -> DataFrame:
    """Means of rows that repeat a code and time."""
    return df.groupBy(code, time).agg(*[F.avg(v).alias(v) for v in values])


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "field", value: str = "value") -> DataFrame:
    """Wide to long, nulls left out."""
    return df.unpivot(list(keys), list(values), name, value).where(F.col(value).isNotNull())


def at_time(df: DataFrame, time_of_day: str, time: str = "trade_time") -> DataFrame:
    """Rows at a time of day, 'HH:mm:ss'."""
    return df.where(F.date_format(time, "HH:mm:ss") == time_of_day)


def aligned(left: DataFrame, right: DataFrame, how: str = "full", keys: Sequence[str] = ("code", "dt")) -> DataFrame:
    """Two panels on common keys: 'full', 'left' or 'right'."""
    if how not in ("full", "left", "right"):
        raise ValueError("how is 'full', 'left' or 'right'")
    return left.join(right, list(keys), how)


def concat(tables: Sequence[DataFrame], keys: Sequence[str] = ("code", "dt")) -> DataFrame:
    """Many panels side by side on the union of their keys."""
    first, *rest = tables
    for t in rest:
        first = aligned(first, t, "full", keys)
    return first
