"""Return and risk metrics of many series at once. Returns are simple and not cumulated; a year has 252 days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.functions.scalars import ratio
from tidemark.plans.summaries import folded, growth_summary, moments, pair_moments

SERIES = Rows(("series",), "dt")
YEAR = 252


def returns_of(bars: DataFrame, x: str = "close", rows: Rows = Rows()) -> DataFrame:
    """``series, dt, ret``: change of a price against the last one that is known; null on the first row."""
    before = F.last(F.col(x), ignorenulls=True).over(rows.ordered.rowsBetween(-(2**31), -1))
    (code,) = rows.keys
    return bars.select(F.col(code).alias("series"), F.col(rows.order).alias("dt"), (ratio(F.coalesce(F.col(x), before), before) - 1).alias("ret"))


def _grown(r: str = "ret") -> Column:
    return F.product(1 + F.coalesce(F.col(r), F.lit(0.0)))


def annual_return(r: str = "ret") -> Column:
    """Compound growth a year; rows without a return count as days."""
    return F.pow(_grown(r), ratio(F.lit(float(YEAR)), F.count("*"))) - 1


def cum_return(r: str = "ret") -> Column:
    return _grown(r) - 1


def annual_vol(r: str = "ret") -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(float(YEAR)))


def sharpe(r: str = "ret") -> Column:
    return ratio(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(float(YEAR)))


def sortino(r: str = "ret") -> Column:
    below = F.sqrt(F.avg(F.pow(F.when(F.col(r).isNotNull(), F.least(F.col(r), F.lit(0.0))), F.lit(2))))
    return ratio(F.avg(r) * YEAR, below * F.sqrt(F.lit(float(YEAR))))


#: A series is summed up per such period first; a task then holds a period's rows, or one row a period of a series.
PERIOD = "month"


def _by_period(rows: DataFrame, parts: Sequence[Column], period: str) -> DataFrame:
    """``series`` and ``s``, the merged sums of its periods in order."""
    periods = rows.groupBy("series", F.date_trunc(period, F.col("dt").cast("timestamp")).alias("__period")).agg(*parts)
    names = [c for c in periods.columns if c not in ("series", "__period")]
    lists = periods.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("__period", *names))).alias("__periods"))
    return lists.select("series", folded(F.col("__periods"), names).alias("s"))


def max_drawdowns(returns: DataFrame, rows: Rows = SERIES, period: str = PERIOD) -> DataFrame:
    """``series, max_drawdown``: deepest fall from a running maximum that includes the starting capital.

    Growth, peak, trough and worst fall of each ``period`` are merged in order, so a series may be of any length. Returns are -1 or more.
    """
    key, time = rows.keys[0], rows.order
    named = returns.select(F.col(key).alias("series"), F.col(time).alias("dt"), "ret")
    found = _by_period(named, growth_summary("ret", "dt"), period)
    return found.select(F.col("series").alias(key), F.least(F.lit(0.0), F.col("s.path.worst") - 1).alias("max_drawdown"))


def _benchmark_days(returns: DataFrame, benchmark: str | float) -> Column | DataFrame:
    """The benchmark's days and returns, or a constant return for every day."""
    if isinstance(benchmark, str):
        return returns.where(F.col("series") == benchmark).select("dt", F.col("ret").alias("__b"))
    return F.lit(float(benchmark))


def _with_benchmark(returns: DataFrame, benchmark: str | float) -> DataFrame:
    base = _benchmark_days(returns, benchmark)
    return returns.join(base, "dt", "left") if isinstance(base, DataFrame) else returns.withColumn("__b", base)


def _std(m: Column, below: int) -> Column:
    """Standard deviation of merged moments, over n - ``below``; null for fewer values, exactly 0 for equal ones."""
    m2 = F.when(m["low"] == m["high"], 0.0).otherwise(m["m2"])
    return F.when(m["n"] > below, F.sqrt(m2 / (m["n"] - below)))


def _table(rows: DataFrame, benchmark: str | float | None, days: Column | None, period: str) -> DataFrame:
    """The performance table of rows with ``__b``; ``days`` replaces a series' number of rows by a value of the finished table."""
    parts = [*growth_summary("ret", "dt"), *moments("r", F.col("ret")), F.sum(F.pow(F.least("ret", F.lit(0.0)), F.lit(2))).alias("below")]
    if benchmark is not None:
        both = F.col("ret").isNotNull() & F.col("__b").isNotNull()
        r, b = F.when(both, F.col("ret")), F.when(both, F.col("__b"))
        parts += [*pair_moments("rb", r, b), *moments("d", r - b)]
    found = _by_period(rows, parts, period).select("series", "s.*").select("*", "path.*")
    found = found.withColumn("__days", F.col("rows") if days is None else days)
    year = F.lit(float(YEAR))
    r = F.col("r")
    columns = {
        "annual_return": F.pow("growth", ratio(year, F.col("__days"))) - 1, "cum_return": F.col("growth") - 1,
        "annual_vol": _std(r, 1) * F.sqrt(year), "sharpe": ratio(r["mean"], _std(r, 1)) * F.sqrt(year), "max_drawdown": F.least(F.lit(0.0), F.col("worst") - 1),
        "sortino": ratio(r["mean"] * YEAR, F.sqrt(ratio("below", r["n"])) * F.sqrt(year)),
    }
    found = found.withColumns(columns)
    found = found.withColumn("calmar", F.when(F.col("max_drawdown") < 0, ratio("annual_return", F.abs("max_drawdown"))))
    names = ["series", *columns, "calmar"]
    if benchmark is None:
        return found.select(*names)
    rb, d = F.col("rb"), F.col("d")
    beta = ratio(F.when(rb["n"] > 0, rb["co"] / rb["n"]), F.when(rb["n"] > 0, F.when(rb["low"] == rb["high"], 0.0).otherwise(rb["m2"]) / rb["n"]))
    ir = F.when(d["n"] >= 2, ratio(d["mean"], _std(d, 1)))
    if not isinstance(benchmark, str):  # a constant has neither beta nor alpha
        return found.withColumns({"information_ratio": ir, "excess_return": F.col("annual_return") - (F.pow(1 + F.lit(float(benchmark)), year) - 1)}).select(*names, "information_ratio", "excess_return")
    others = F.col("series") != benchmark
    alpha = F.pow(1 + rb["mean"] - beta * rb["mean2"], F.lit(YEAR)) - 1
    base = F.max(F.when(~others, F.col("annual_return"))).over(Window.partitionBy())  # one row a series here
    found = found.withColumns({"information_ratio": F.when(others, ir), "alpha": F.when(others, alpha), "beta": F.when(others, beta)})
    return found.withColumn("excess_return", F.when(others, F.col("annual_return") - base).otherwise(0.0)).select(*names, "information_ratio", "alpha", "beta", "excess_return")


def benchmark_metrics(returns: DataFrame, benchmark: str | float, period: str = PERIOD) -> DataFrame:
    """``information_ratio, alpha, beta, excess_return`` of every series against the benchmark series.

    Days are matched; a ratio needs two days with both. All but the excess return (0) are null for the benchmark. A number as
    ``benchmark`` is a constant return a day: information ratio and excess return only.
    """
    table = performance_table(returns, benchmark, period=period)
    return table.select("series", *[c for c in ("information_ratio", "alpha", "beta", "excess_return") if c in table.columns])


def performance_table(returns: DataFrame, benchmark: str | float | None = None, rows: Rows = SERIES, period: str = PERIOD) -> DataFrame:
    """One row per series: annual_return, cum_return, annual_vol, sharpe, max_drawdown, sortino, calmar, and with a
    benchmark information_ratio, alpha, beta, excess_return (without alpha and beta if the benchmark is a constant return a day).

    All metrics come from sums that merge: per series and ``period`` first, then over a series' periods in order, so no window runs
    along a series and it may be of any length. The benchmark's days are joined on. Returns are -1 or more.
    """
    work = returns.withColumnsRenamed({rows.keys[0]: "series", rows.order: "dt"})
    return _table(work if benchmark is None else _with_benchmark(work, benchmark), benchmark, None, period)


def metric_rows(table: DataFrame, series: str = "series") -> DataFrame:
    """``metric, series, value`` from a table with one row per series."""
    metrics = [c for c in table.columns if c != series]
    return table.select(series, *[F.col(c).cast("double").alias(c) for c in metrics]).unpivot([series], metrics, "metric", "value")


def backtest_report(returns: DataFrame, prices: DataFrame, benchmark: str = "benchmark", x: str = "close", period: str = PERIOD) -> DataFrame:
    """performance_table of return series on the days of a benchmark's prices (``dt`` and ``x``), which it names.

    Days without a return count as days, as their number is the benchmark's; days that the benchmark lacks are left out. No day is made:
    a missing return adds to the number of days only.
    """
    base = returns_of(prices.withColumn("code", F.lit(benchmark)), x).select("dt", F.col("ret").alias("__b"), F.lit(True).alias("__in"))
    own = returns.select("series", "dt", "ret").join(base, "dt", "left").select("series", "dt", F.when(F.col("__in"), F.col("ret")).alias("ret"), "__b")
    both = own.unionByName(base.select(F.lit(benchmark).alias("series"), "dt", F.col("__b").alias("ret"), "__b"))
    days = F.max(F.when(F.col("series") == benchmark, F.col("rows"))).over(Window.partitionBy())  # one row a series here
    return _table(both, benchmark, days, period)


def compounded(returns: DataFrame, by: Sequence[str]) -> DataFrame:
    """Compound returns per series and calendar parts ('year', 'month')."""
    parts = {"year": F.year("dt"), "month": F.month("dt")}
    return returns.groupBy("series", *[parts[p].alias(p) for p in by]).agg(cum_return().alias("ret"))


def monthly_matrix(returns: DataFrame, digits: int = 3) -> DataFrame:
    """One row per series and year, months 1 to 12 as columns ``m1`` to ``m12``."""
    months = compounded(returns, ("year", "month"))
    names = [F.round(F.max(F.when(F.col("month") == k, F.col("ret"))), digits).alias(f"m{k}") for k in range(1, 13)]
    return months.groupBy("series", "year").agg(*names)


def monthly_histogram(returns: DataFrame, width: float = 0.01) -> DataFrame:
    """``series, bin, low, n``: monthly returns in bins of fixed width."""
    if width <= 0:
        raise ValueError("the width of a bin is positive")
    bins = compounded(returns, ("year", "month")).withColumn("bin", F.floor(F.col("ret") / width).cast("long"))
    return bins.groupBy("series", "bin").agg(F.count("*").alias("n")).select("series", "bin", (F.col("bin") * width).alias("low"), "n")


def log_returns(returns: DataFrame, days: int = YEAR) -> DataFrame:
    """Total and mean log return, and the mean's yearly equivalent."""
    logs = F.log1p("ret")
    return returns.groupBy("series").agg(
        F.sum(logs).alias("total"), F.avg(logs).alias("mean"), (F.exp(F.avg(logs) * days) - 1).alias("annualised")
    )


def yearly_stats(returns: DataFrame) -> DataFrame:
    """Mean, spread (population), counts by sign, best and worst of a series' yearly returns."""
    y = compounded(returns, ("year",))
    return y.groupBy("series").agg(
        F.avg("ret").alias("average"), F.stddev_pop("ret").alias("stddev"), F.count_if(F.col("ret") > 0).alias("positive"),
        F.count_if(F.col("ret") < 0).alias("negative"), F.count_if(F.col("ret") == 0).alias("nochange"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
    )


def yearly_sharpe(returns: DataFrame, riskfree: float = 0.04) -> DataFrame:
    """Mean yearly return over a risk-free rate, by the population spread of the yearly returns."""
    y = compounded(returns, ("year",))
    return y.groupBy("series").agg(ratio(F.avg("ret") - riskfree, F.stddev_pop("ret")).alias("sharpe"))


def bar_returns(equity: DataFrame, x: str = "equity") -> DataFrame:
    """Per-bar returns of an equity column."""
    return returns_of(equity, x)
