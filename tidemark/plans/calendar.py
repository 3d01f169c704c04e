"""The union calendar of all codes without its rows: times are ranked, and windows are ranges of ranks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.frames import Rows
from tidemark.functions.scalars import col, ratio
from tidemark.plans.summaries import reads_all

RANK = "__rank"
#: Whole-number times that make a coarse period.
COARSE = 1000


def _day(time: Column, kind: T.DataType) -> Column:
    """A coarse period of a time, of which a calendar has few: its day, or a thousand of whole-number times."""
    return F.to_date(time) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.floor(time / COARSE)


def days_of(df: DataFrame, time: str, shuffled: bool = False) -> DataFrame:
    """``__day, __times, __before, __all``: a day's distinct times in order, the number of times before it and of all times.

    Times are made distinct per day before their shuffle, so one row a day is all that is put in order. With ``shuffled`` the
    table comes out of an aggregation: then all its columns are read (into a hash that is always known), so that
    this use and the table's own share one shuffle and the source is scanned once.
    """
    day = _day(F.col(time), df.schema[time].dataType).alias("__day")
    known = df.where(F.col(time).isNotNull())
    if shuffled:
        groups = known.groupBy(F.col(time).alias("__time")).agg(reads_all(df).alias("__mix")).where("__mix IS NOT NULL")
        groups = groups.groupBy(_day(F.col("__time"), df.schema[time].dataType).alias("__day")).agg(F.array_sort(F.collect_set("__time")).alias("__times"))
    else:
        groups = known.groupBy(day).agg(F.array_sort(F.collect_set(time)).alias("__times"))
    counts = F.sum(F.size("__times"))
    return groups.withColumns({
        "__before": F.coalesce(counts.over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__all": counts.over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })


def ranks_of(days: DataFrame, time: str, *more: str) -> DataFrame:
    """``time, __rank`` (from 0) and further columns of ``days``, one row per time of the calendar."""
    return days.select(F.posexplode("__times").alias("__place", time), "__before", *more).select(time, (F.col("__before") + F.col("__place")).alias(RANK), *more)


@dataclass(frozen=True)
class CalendarRows(Rows):
    """Column expressions over a code's rows as if each missing time of the calendar were a row of nulls.

    ``order`` is the rank of a row's time. A frame of n rows is the range of the last n ranks, so what is missing counts
    as missing; nothing but the rows that exist is ever made.
    """

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def trail(self, n: int) -> WindowSpec:
        if n < 1:
            raise ValueError("a window has one row at least")
        return self.ordered.rangeBetween(-(n - 1), 0)

    def lag(self, x: Column | str, k: int = 1) -> Column:
        return col(x) if k == 0 else F.first(col(x)).over(self.ordered.rangeBetween(-k, -k))

    def triggered(self, condition: Column) -> Column:
        """True where a condition begins to hold; it does not hold at a missing time, and never begins at the calendar's first."""
        now = F.coalesce(condition, F.lit(False))
        return now & ~F.coalesce(self.lag(now), F.col(self.order) == 0)

    def row(self) -> Column:
        return F.col(self.order)

    def zscore(self, x: Column | str, n: int) -> Column:
        w = self.trail(n)
        return F.when(self.row() >= n - 1, ratio(col(x) - F.avg(col(x)).over(w), F.stddev_pop(col(x)).over(w)))


def ranked(df: DataFrame, rows: Rows, shuffled: bool = False) -> tuple[DataFrame, CalendarRows]:
    """``df`` with the rank of each row's time, and the expressions that use it. A row without a time has no rank and meets only such rows."""
    ranks = ranks_of(days_of(df, rows.order, shuffled), rows.order)
    return df.join(ranks, rows.order, "left"), CalendarRows(rows.keys, RANK)


def dense(df: DataFrame, code: str, time: str, hold: Sequence[str] = (), shuffled: bool = False) -> DataFrame:
    """Every code at every time of the union calendar, with ``present``; null codes are a code, rows without a time are left out.

    Each row makes the missing times up to its code's next row (a code's first row those before it too), so no product of codes and
    times is joined and no row is made twice. Columns in ``hold`` keep the row's value there, the others are null.
    """
    ranks = ranks_of(days_of(df, time, shuffled), time, "__all")
    own = df.join(ranks, time)
    after = Window.partitionBy(code).orderBy(RANK)
    begin = F.when(F.row_number().over(after) == 1, F.lit(0).cast("long")).otherwise(F.col(RANK))
    end = F.greatest(F.coalesce(F.lead(RANK).over(after), "__all") - 1, RANK)
    own = own.withColumns({"__begin": begin, "__end": end}).withColumn("__at", F.explode(F.sequence("__begin", "__end")))
    here = F.col("__at") == F.col(RANK)
    values = [(F.when(here | (F.col("__at") > F.col(RANK)), F.col(c)) if c in hold else F.when(here, F.col(c))).alias(c) for c in df.columns if c not in (code, time)]
    times = ranks.select(F.col(time).alias("__time"), F.col(RANK).alias("__at"))
    return own.drop(time).join(times, "__at").select(code, F.col("__time").alias(time), *values, here.alias("present"))
