"""Intraday noise area: VWAP, distance from the open, and the bounds around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.functions.scalars import larger, ratio, smaller
from tidemark.plans.calendar import RANK, CalendarRows, days_of, ranks_of
from tidemark.sources.bars import dense_grid, mean_per_time

BY_TIME = Rows(("code",), "trade_time")


def _clock(time: str = "trade_time") -> Column:
    return F.date_format(time, "HH:mm:ss")


def prepared(bars: DataFrame) -> DataFrame:
    """Bars averaged per code and time on the dense grid, with ``day`` and ``tod``; ``present`` marks rows that exist."""
    grid = dense_grid(mean_per_time(bars, ["open", "close", "volume"]), "code", "trade_time", shuffled=True)
    return grid.withColumns({"day": F.to_date("trade_time"), "tod": _clock()})


def intraday_vwap(bars: DataFrame, day: Column | None = None) -> DataFrame:
    """``vwap``: value over volume of a day's bars so far."""
    by_day = bars.withColumn("__day", day if day is not None else F.to_date("trade_time"))
    w = Window.partitionBy("code", "__day").orderBy("trade_time").rowsBetween(Window.unboundedPreceding, 0)
    value = F.sum(F.col("close") * F.col("volume")).over(w)
    return by_day.withColumn("vwap", ratio(value, F.sum(F.when(F.col("volume").isNotNull(), F.col("volume"))).over(w))).drop("__day")


def with_open(bars: DataFrame, open_time: str = "09:30:00", rows: Rows = BY_TIME) -> DataFrame:
    """``day_open``: the latest opening price at the opening time so far (a missing one falls back to the day before's)."""
    opens = F.when(_clock() == open_time, F.col("open"))
    return bars.withColumn("day_open", rows.last_known(opens))


def open_distance(bars: DataFrame, open_time: str = "09:30:00", rows: Rows = BY_TIME) -> DataFrame:
    """``distance``: absolute change of the close from the day's open."""
    return with_open(bars, open_time, rows).withColumn("distance", F.abs(ratio("close", "day_open") - 1))


def noise_sigma(bars: DataFrame, window: int = 14, open_time: str = "09:30:00") -> DataFrame:
    """``sigma``: mean distance over the last ``window`` grid days at the same time of day, today's included."""
    found = open_distance(bars, open_time)
    same_time = Rows(("code", "tod"), "trade_time")
    found = found if "tod" in found.columns else found.withColumn("tod", _clock())
    return found.withColumn("sigma", same_time.mean("distance", window))


def day_levels(grid: DataFrame, open_time: str = "09:30:00", close_time: str = "15:00:00") -> DataFrame:
    """Per code and day: ``today_open`` and ``prev_close``, the close of the grid day before at the closing time."""
    opens, closes = F.col("tod") == open_time, F.col("tod") == close_time
    found = grid.where(opens | closes).groupBy("code", "day").agg(F.max(F.when(opens, F.col("open"))).alias("today_open"), F.max(F.when(closes, F.col("close"))).alias("__close"), (F.count_if(closes) > 0).alias("__closes"))
    prev_close = F.when(F.col("__closes"), Rows(("code", "__closes"), "day").lag("__close"))
    return found.select("code", "day", "today_open", prev_close.alias("prev_close"))


def _session(bars: DataFrame, close_time: str) -> DataFrame:
    """``trade_time, tod, __rank, __last_close`` of the union calendar of ``bars``.

    Times are ranked among those of the same time of day; ``__last_close`` is the last time at ``close_time`` on a day before.
    """
    days = days_of(bars, "trade_time", shuffled=True)
    closing = F.get(F.filter("__times", lambda t: F.date_format(t, "HH:mm:ss") == close_time), F.lit(0))
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__last_close", F.last(closing, ignorenulls=True).over(before))
    times = ranks_of(days, "trade_time", "__last_close").withColumn("tod", _clock())
    return times.withColumn(RANK, F.row_number().over(Window.partitionBy("tod").orderBy("trade_time")).cast("long"))


def noise_area(bars: DataFrame, window: int = 14, open_time: str = "09:30:00", close_time: str = "15:00:00", keep_columns: bool = True) -> DataFrame:
    """Input rows with ``upperbound, signal`` (the close), ``lowerbound, vwap``.

    The bounds are the larger of the day's open and the last close times 1 + sigma, and the smaller times 1 - sigma;
    null on a code's first day and on days without its opening bar. Rows that repeat a code and time are averaged;
    a missing bar is a null in every window of the union calendar. Closes are matched by day, not by position.

    No missing bar is made: sigma's frame is a range of ranks among the calendar's days with that time of day, and a last close
    counts if it stands at the calendar's last closing time. The source is scanned once; the calendar reads the shuffle of the averages.
    """
    own = mean_per_time(bars, ["open", "close", "volume"])
    found = own.join(_session(own, close_time), "trade_time").withColumn("day", F.to_date("trade_time"))
    found = intraday_vwap(open_distance(found, open_time), F.col("day"))
    found = found.withColumn("sigma", CalendarRows(("code", "tod"), RANK).mean("distance", window))
    opens = F.max(F.when(F.col("tod") == open_time, F.col("open"))).over(Window.partitionBy("code", "day"))
    earlier = Window.partitionBy("code").orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("tod") == close_time, F.struct("trade_time", "close")), ignorenulls=True).over(earlier)
    found = found.withColumn("today_open", opens).withColumn("__last", last)
    prev_close = F.when(F.col("__last.trade_time") == F.col("__last_close"), F.col("__last.close"))
    upper = larger("today_open", prev_close) * (1 + F.col("sigma"))
    lower = smaller("today_open", prev_close) * (1 - F.col("sigma"))
    base = ["open", "close", "volume"] if keep_columns else []
    return found.select("code", "trade_time", *base, upper.alias("upperbound"), F.col("close").alias("signal"), lower.alias("lowerbound"), "vwap")
