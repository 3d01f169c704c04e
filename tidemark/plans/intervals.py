"""Joins on time: values inside intervals, and the latest row before a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.halo import running


def _number(time: Column, kind: T.DataType) -> Column:
    """A time as a long: days of a date, microseconds of a timestamp, whole numbers as they are."""
    if isinstance(kind, T.DateType):
        return F.datediff(time, F.lit("1970-01-01").cast("date")).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(time)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(time, F.current_timezone()))
    return time.cast("long")


def contained(values: DataFrame, periods: DataFrame, time: str, begin: str, end: str, keys: Sequence[str] = (), width: int = 64) -> DataFrame:
    """Rows of ``values`` with each of ``periods`` that holds their time (both ends included) and agrees in ``keys``.

    Time is cut into bins of ``width`` days (microseconds of a timestamp, numbers of a number). A period is put into each bin that it
    touches, a value into its own; they join on keys and bin and are trimmed exactly. So a value meets the periods of its bin
    only, and a period makes one row a bin, not one a day. Periods without a begin or end, and values without a time, meet nothing.
    """
    a, b = _number(F.col(begin), periods.schema[begin].dataType), _number(F.col(end), periods.schema[end].dataType)
    bin_of = lambda c: F.floor(F.col(c) / width).cast("long")
    spans = periods.withColumns({"__a": a, "__b": b}).where("__a <= __b").withColumn("__bin", F.explode(F.sequence(bin_of("__a"), bin_of("__b"))))
    rows = values.withColumn("__t", _number(F.col(time), values.schema[time].dataType)).where("__t IS NOT NULL").withColumn("__bin", bin_of("__t"))
    return rows.join(spans, [*keys, "__bin"]).where("__t BETWEEN __a AND __b").drop("__t", "__a", "__b", "__bin")


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("code",), time: str = "dt", tolerance: int | None = None, suffix: str = "_at", coarse: str = "month"
) -> DataFrame:
    """``left`` with the columns of the latest row of ``right`` at or before its time that agrees in ``keys``, and that row's time as ``time + suffix``.

    Beyond ``tolerance`` (days of a date, microseconds of a timestamp) nothing is found; rows without a match stay, with nulls, and so do rows
    without a time. Of rows of ``right`` that repeat a key and time the largest counts. Both sides are put in one order and the last row of ``right`` is
    carried forward: inside calendar periods first, then over the periods, however many are empty. So a key's rows may be many, and no row is joined to more than one.
    """
    others = [c for c in right.columns if c not in (*keys, time)]
    given = [c for c in left.columns if c not in keys]
    found = F.struct(F.col(time).alias("__time"), *others)
    a = left.select(F.struct(*keys).alias("__key"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*given).alias("__own"))
    best = right.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max(F.struct(*others)).alias("__v")).select(*keys, time, "__v.*")
    b = best.select(F.struct(*keys).alias("__key"), F.col(time).alias("__t"), F.lit(0).alias("__side"), found.alias("__found"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__order", F.struct("__t", "__side"))
    part = F.date_trunc(coarse, F.col("__t").cast("timestamp"))
    carried = running(both, {"__match": ("last", F.col("__found"))}, part, "__key", "__order").where("__side = 1")
    kind = left.schema[time].dataType
    near = F.lit(True) if tolerance is None else _number(F.col("__t"), kind) - _number(F.col("__match.__time"), kind) <= tolerance
    match = F.when(F.col("__t").isNotNull() & near, F.col("__match"))
    return carried.select("__key.*", "__own.*", match.alias("__m")).select(*left.columns, F.col("__m.__time").alias(time + suffix), *[F.col(f"__m.`{c}`").alias(c) for c in others])
