"""Trailing windows over long tables: one row per key and time, ordered by time within a key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import col, ratio


@dataclass(frozen=True)
class Rows:
    """Column expressions over the rows of a key up to the current one.

    A trailing statistic of n rows is null until n rows with a value are in its frame.
    """

    keys: Sequence[str] = ("code",)
    order: str = "dt"

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def trail(self, n: int) -> WindowSpec:
        if n < 1:
            raise ValueError("a window has one row at least")
        return self.ordered.rowsBetween(-(n - 1), 0)

    @property
    def run(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def full(self, x: Column | str, n: int, value: Column) -> Column:
        w = self.trail(n)
        return F.when(F.count(col(x)).over(w) == n, value.over(w))

    def mean(self, x: Column | str, n: int) -> Column:
        return self.full(x, n, F.avg(col(x)))

    def std(self, x: Column | str, n: int) -> Column:
        """Sample standard deviation."""
        return self.full(x, n, F.stddev_samp(col(x)))

    def sum(self, x: Column | str, n: int) -> Column:
        return self.full(x, n, F.sum(col(x)))

    def quantile(self, x: Column | str, n: int, q: float) -> Column:
        """Exact, with linear interpolation."""
        return self.full(x, n, F.percentile(col(x), F.lit(q)))

    def lag(self, x: Column | str, k: int = 1) -> Column:
        return col(x) if k == 0 else F.lag(col(x), k).over(self.ordered) if k > 0 else F.lead(col(x), -k).over(self.ordered)

    def diff(self, x: Column | str) -> Column:
        return col(x) - self.lag(x)

    def last_known(self, x: Column | str) -> Column:
        """The latest value that is not null, this row's included."""
        return F.last(col(x), ignorenulls=True).over(self.run)

    def held(self, x: Column | str) -> Column:
        """last_known, and 0 before the first value."""
        return F.coalesce(self.last_known(x), F.lit(0))

    def triggered(self, condition: Column) -> Column:
        """True where a condition begins to hold; never on a key's first row."""
        now = F.coalesce(condition, F.lit(False))
        return now & ~F.coalesce(F.lag(now).over(self.ordered), F.lit(True))

    def row(self) -> Column:
        """0 for a key's first row."""
        return F.row_number().over(self.ordered) - 1

    def correlation(self, x: Column | str, y: Column | str, n: int) -> Column:
        both = F.when(col(x).isNotNull() & col(y).isNotNull(), col(x))
        w = self.trail(n)
        spread = F.stddev_pop(col(x)).over(w) * F.stddev_pop(col(y)).over(w)
        return F.when(F.count(both).over(w) == n, ratio(F.covar_pop(col(x), col(y)).over(w), spread))

    def slope(self, x: Column | str, y: Column | str, n: int) -> Column:
        """Least-squares slope of y on x."""
        both = F.when(col(x).isNotNull() & col(y).isNotNull(), col(x))
        w = self.trail(n)
        return F.when(F.count(both).over(w) == n, ratio(F.covar_pop(col(y), col(x)).over(w), F.var_pop(col(x)).over(w)))

    def sigma_ratio(self, x: Column | str, y: Column | str, n: int) -> Column:
        """Population standard deviation of y over that of x."""
        both = F.when(col(x).isNotNull() & col(y).isNotNull(), col(x))
        w = self.trail(n)
        return F.when(F.count(both).over(w) == n, ratio(F.stddev_pop(col(y)).over(w), F.stddev_pop(col(x)).over(w)))

    def zscore(self, x: Column | str, n: int) -> Column:
        """Of the last value among n rows, nulls among them skipped, population standard deviation."""
        w = self.trail(n)
        return F.when(F.count("*").over(w) == n, ratio(col(x) - F.avg(col(x)).over(w), F.stddev_pop(col(x)).over(w)))

    def growth(self, r: Column | str, start: float = 0.0) -> Column:
        """Running product of 1 + r with nulls as zero; minus 1 for start 0, else times start."""
        product = F.product(1 + F.coalesce(col(r), F.lit(0.0))).over(self.run)
        return product - 1 if start == 0 else product * start

    def windows(self, x: Column | str, n: int) -> Column:
        """The last n values as an array in order (nulls left out)."""
        return F.collect_list(col(x)).over(self.trail(n))


def with_monotone(df: DataFrame, x: str, n: int, out: str, rows: Rows = Rows()) -> DataFrame:
    """``df`` with a column of 1 where the last n values rise strictly, -1 where they fall strictly, else null."""
    if n < 2:
        raise ValueError("two values at least make a direction")
    steps = rows.trail(n - 1)
    known = F.count(col(x)).over(rows.trail(n)) == n
    direction = F.when(F.min("__step").over(steps) > 0, 1).when(F.max("__step").over(steps) < 0, -1)
    return df.withColumn("__step", rows.diff(x)).withColumn(out, F.when(known, direction)).drop("__step")


def sliding_windows(df: DataFrame, x: str, window: int, step: int = 1, rows: Rows = Rows()) -> DataFrame:
    """Every ``step``-th full window of ``window`` rows: keys, order, ``window_no``, ``values`` array."""
    if window < 1 or step < 1:
        raise ValueError("window and step are 1 at least")
    seq = rows.row()
    found = df.select(*rows.keys, rows.order, seq.alias("__seq"), rows.windows(x, window).alias("values"))
    start = F.col("__seq") - (window - 1)
    kept = found.where((start >= 0) & (start % step == 0))
    return kept.select(*rows.keys, rows.order, (start / step).cast("long").alias("window_no"), "values")


def day_windows(df: DataFrame, x: str, days: int, points_a_day: int, rows: Rows = Rows()) -> DataFrame:
    """Windows of ``days`` whole days of ``points_a_day`` rows, one day apart."""
    return sliding_windows(df, x, days * points_a_day, points_a_day, rows)


def rolling_apply(df: DataFrame, x: str, n: int, function, out: str, rows: Rows = Rows()) -> DataFrame:
    """A user's function of each full window, as an Arrow-batched pandas UDF from array to double.

    ``function`` gets a numpy array of the n values. The slow path: prefer the built-in statistics.
    """
    @F.pandas_udf("double")
    def apply(windows: pd.Series) -> pd.Series:
        return windows.map(lambda v: None if v is None else float(function(v)))

    full = F.when(F.count(col(x)).over(rows.trail(n)) == n, rows.windows(x, n))
    return df.withColumn("__window", full).withColumn(out, apply("__window")).drop("__window")


def grouped_apply(df: DataFrame, function, schema: str, keys: Sequence[str] = ("code",)) -> DataFrame:
    """A user's function from pandas frame to pandas frame on each group. A whole group must fit in one task."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def top_k(df: DataFrame, by: str, k: int, key: str = "code", order: str = "dt", out: str = "k") -> DataFrame:
    """The ``k`` rows of each key with the smallest ``by``, ranked from 1 in ``out``; ties go to the earlier row, nulls never rank.

    A limit on a rank: rows beyond it are dropped before the shuffle.
    """
    if k < 1:
        raise ValueError("k is 1 at least")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(by, order))
    return df.where(F.col(by).isNotNull()).withColumn(out, rank).where(F.col(out) <= k)


def last_row(df: DataFrame, values: Sequence[str], key: str = "code", order: str = "dt") -> DataFrame:
    """Each key's last row: its key, its time and the given columns, by one aggregation."""
    return df.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values])
