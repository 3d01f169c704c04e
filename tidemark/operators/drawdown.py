"""Drawdowns as gaps and islands of the underwater curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.functions.scalars import business_days, ratio
from tidemark.operators.returns import SERIES
from tidemark.plans import halo
from tidemark.plans.intervals import contained
from tidemark.plans.summaries import reads_all


def underwater(returns: DataFrame, rows: Rows = SERIES) -> DataFrame:
    """``cum`` (growth of 1) and ``underwater``, its distance below the running maximum."""
    cum = returns.withColumn("cum", rows.growth("ret", 1.0))
    return cum.withColumn("underwater", F.col("cum") / F.max("cum").over(rows.run) - 1)


def long_underwater(returns: DataFrame, coarse: str = "month") -> DataFrame:
    """``underwater`` of series that may each be too long for one task, cut into calendar periods; returns are more than -1.

    A period's growth and peak are taken from its own start. Growth before it is the product of the earlier periods, the peak before it the
    largest of their peaks times the growth before each, so one shuffle by series and period serves the rows and the totals.
    """
    part = F.struct(F.col("series").alias("key"), F.date_trunc(coarse, F.col("dt").cast("timestamp")).alias("bucket"))
    work = returns.withColumn("__part", part).repartition("__part")
    run = Window.partitionBy("__part").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    grown = work.withColumn("__c", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(run))
    totals = grown.groupBy("__part").agg(F.max_by("__c", "dt").alias("__g"), F.max("__c").alias("__p"), reads_all(work).alias("__mix")).where("__mix IS NOT NULL")
    before = Window.partitionBy("__part.key").orderBy("__part.bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__growth", F.coalesce(F.product("__g").over(before), F.lit(1.0)))
    totals = totals.select("__part", "__growth", F.max(F.col("__growth") * F.col("__p")).over(before).alias("__peak"))
    found = grown.withColumn("__m", F.max("__c").over(run)).join(totals, "__part").withColumn("cum", F.col("__growth") * F.col("__c"))
    top = F.greatest(F.col("__peak"), F.col("__growth") * F.col("__m"))
    return found.withColumn("underwater", F.col("cum") / top - 1).drop("__part", "__c", "__m", "__growth", "__peak")


def _at_peak() -> Column:
    return F.when(F.col("underwater") == 0, 1).otherwise(0)


def _episodes(falls: DataFrame) -> DataFrame:
    """Episodes of the rows of ``underwater`` with ``__id``, the number of peaks so far."""
    found = falls.groupBy("series", "__id").agg(
        F.min("dt").alias("peak_date"), F.min_by("cum", "dt").alias("peak_cum"), F.min(F.struct("underwater", "dt", "cum")).alias("v"), F.max(F.struct("dt", "cum")).alias("end"), F.min_by("ret", "dt").alias("peak_ret")
    )
    after = Window.partitionBy("series").orderBy("__id")
    last = F.max("end").over(Window.partitionBy("series"))
    found = found.withColumns({"recovery_date": F.lead("peak_date").over(after), "recovery_cum": F.lead("peak_cum").over(after), "last": last}).where("v.underwater < 0")
    return found.select(
        "series", "peak_date", F.col("v.dt").alias("valley_date"), "recovery_date", F.col("v.underwater").alias("depth"), "peak_cum", F.col("v.cum").alias("valley_cum"),
        "recovery_cum", "peak_ret", F.col("last.dt").alias("last_date"), F.col("last.cum").alias("last_cum"),
    )


def episodes(returns: DataFrame, rows: Rows = SERIES) -> DataFrame:
    """One row per fall: ``peak_date, valley_date, recovery_date`` (null if not recovered), ``depth``, growth at
    peak, valley and recovery, and the series' last day with its growth.

    An episode begins where the curve is at its maximum and lasts until it is again; its valley is its first
    lowest row.
    """
    return _episodes(underwater(returns, rows).withColumn("__id", F.sum(_at_peak()).over(rows.run)))


def long_episodes(returns: DataFrame, coarse: str = "month") -> DataFrame:
    """``episodes`` of series that may each be too long for one task; a task holds a period of a series, or its episodes."""
    part = F.date_trunc(coarse, F.col("dt").cast("timestamp"))
    return _episodes(halo.running(long_underwater(returns, coarse), {"__id": ("sum", _at_peak())}, part, "series", "dt"))


def top_drawdowns(returns: DataFrame, top: int = 5, rows: Rows = SERIES, coarse: str | None = None) -> DataFrame:
    """The ``top`` deepest episodes of each series, ``rank`` from 1; ties go to the earlier valley.

    With ``coarse`` (a calendar period) series may each be too long for one task.
    """
    if top < 1:
        raise ValueError("top is 1 at least")
    deepest = Window.partitionBy("series").orderBy("depth", "valley_date")
    found = episodes(returns, rows) if coarse is None else long_episodes(returns, coarse)
    return found.withColumn("rank", F.row_number().over(deepest)).where(F.col("rank") <= top)


def max_drawdown_period(returns: DataFrame, rows: Rows = SERIES, coarse: str | None = None) -> DataFrame:
    """Peak, valley and recovery of each series' deepest fall."""
    return top_drawdowns(returns, 1, rows, coarse).select("series", "peak_date", "valley_date", "recovery_date")


def _described(found: DataFrame, *more: Column) -> DataFrame:
    return found.select(
        "series", "rank", ((F.col("peak_cum") - F.col("valley_cum")) / F.col("peak_cum") * 100).alias("net_drawdown_pct"),
        "peak_date", "valley_date", "recovery_date",
        business_days("peak_date", "valley_date").alias("valley_duration"),
        business_days("valley_date", "recovery_date").alias("end_duration"),
        business_days("peak_date", "recovery_date").alias("duration"), *more,
    )


def drawdown_table(returns: DataFrame, top: int = 5, rows: Rows = SERIES) -> DataFrame:
    """The deepest falls with their depth in percent and their length in business days, both ends counted."""
    return _described(top_drawdowns(returns, top, rows))


def period_compare(periods: DataFrame, returns: DataFrame, benchmark: str) -> DataFrame:
    """``periods`` (``series, rank, peak_date, recovery_date``) with the compound return from peak to recovery of the series and of the benchmark.

    Null for a period that is not recovered. Days meet the periods in bins, see ``intervals.contained``.
    """
    days = returns.select("series", "dt", "ret")
    keys = ["series", "rank"]
    grown = F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1
    spans = periods.select("series", "rank", "peak_date", "recovery_date")
    own = contained(days, spans, "dt", "peak_date", "recovery_date", ["series"]).groupBy(*keys).agg(grown.alias("series_return"))
    base = days.where(F.col("series") == benchmark).drop("series")
    theirs = contained(base, spans, "dt", "peak_date", "recovery_date").groupBy(*keys).agg(grown.alias("benchmark_return"))
    return periods.join(own, keys, "left").join(theirs, keys, "left")


def worst_periods(returns: DataFrame, benchmark: str, top: int = 5, rows: Rows = SERIES) -> DataFrame:
    """drawdown_table with the compound return from peak to recovery of the series and of the benchmark, null if not recovered.

    The series' own return over a fall and its recovery, the peak's day included, is the curve at the recovery over the curve before the peak.
    The benchmark's is taken from its own days, which meet the few periods in bins.
    """
    found = top_drawdowns(returns, top, rows)
    own = ratio(F.col("recovery_cum"), F.col("peak_cum")) * (1 + F.coalesce("peak_ret", F.lit(0.0))) - 1
    base = returns.where(F.col("series") == benchmark).select("dt", "ret")
    keys = ["series", "rank"]
    theirs = contained(base, found.select(*keys, "peak_date", "recovery_date"), "dt", "peak_date", "recovery_date")
    theirs = theirs.groupBy(*keys).agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("benchmark_return"))
    return _described(found, own.alias("series_return")).join(theirs, keys, "left")


def drawdown_points(returns: DataFrame, top: int = 5, rows: Rows = SERIES) -> DataFrame:
    """The table behind a drawdown chart: growth at peak, valley and end, whether it lasts, and how long so far.

    A fall that is not recovered is ``active``: its end is the last row of the series. All of it is known from the episodes.
    """
    active = F.col("recovery_date").isNull()
    return top_drawdowns(returns, top, rows).select(
        "series", "rank", "peak_date", "valley_date", "recovery_date", "peak_cum", "valley_cum",
        F.coalesce("recovery_cum", "last_cum").alias("recovery_cum"), F.when(active, "active").otherwise("recovered").alias("state"),
        F.when(active, business_days("peak_date", "last_date")).alias("active_duration"), "last_date",
    )


def range_slice(df: DataFrame, periods: DataFrame, begin: str, end: str, key: str = "series", time: str = "dt") -> DataFrame:
    """Rows of ``df`` inside each of its key's ``periods``, both ends included, with the period's columns; a period without an end has no rows.

    Rows meet the periods in bins, see ``intervals.contained``; rows in several periods repeat.
    """
    return contained(df, periods, time, begin, end, [key])
