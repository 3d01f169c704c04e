"""Trailing statistics whose cost does not grow with the window: blocks, and what stands before and behind a place in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.functions.scalars import ratio
from tidemark.plans.summaries import known_of, merged_pairs, pairs_of


def trailing_moments(df: DataFrame, x: str, y: str | None, n: int, out: str, rows: Rows = Rows()) -> DataFrame:
    """``df`` with ``out``: the joint moments (``n, mean, mean2, m2, m22, co`` and the extremes) of the last n rows with both values, null before row n.

    A key's rows are cut into blocks of n. A trailing window is the rest of one block and the beginning of the next, so it is
    merged from the moments of the block so far and those of the rows behind a place in the block before. Both are running
    aggregates, one in each direction; nothing is subtracted, so nothing cancels. Windows cost the same whatever n is.
    """
    if n < 1:
        raise ValueError("a window has one row at least")
    y = y or x
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    work = df.withColumns({"__x": F.when(both, F.col(x).cast("double")), "__y": F.when(both, F.col(y).cast("double")), "__place": rows.row()})
    work = work.withColumns({"__block": F.floor(F.col("__place") / n), "__at": F.col("__place") % n})
    parts = [*rows.keys, "__block"]
    so_far = Window.partitionBy(*parts).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*parts).orderBy(F.col("__place").desc()).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("__head", pairs_of(F.col("__x"), F.col("__y"), so_far)).withColumn("__tail", pairs_of(F.col("__x"), F.col("__y"), behind))
    before = F.lag("__tail", n - 1).over(Window.partitionBy(*rows.keys).orderBy("__place")) if n > 1 else F.col("__tail")
    work = work.withColumn("__before", before)
    whole = F.when(F.col("__at") == n - 1, F.col("__head")).otherwise(merged_pairs(F.col("__before"), F.col("__head")))
    found = work.withColumn(out, F.when(F.col("__place") >= n - 1, whole))
    return found.drop("__x", "__y", "__place", "__block", "__at", "__head", "__tail", "__before")


def _m(name: str) -> Column:
    return F.col(name)


def mean_of(m: str, n: int) -> Column:
    return F.when(_m(m)["n"] == n, _m(m)["mean"])


def std_of(m: str, n: int) -> Column:
    """Sample standard deviation."""
    return F.when(_m(m)["n"] == n, F.when(_m(m)["n"] > 1, F.sqrt(known_of(_m(m), 1) / (_m(m)["n"] - 1))))


def zscore_of(x: Column, m: str) -> Column:
    """Of a value among the window's values, population standard deviation; the window has its rows, values among them may be missing."""
    return ratio(x - _m(m)["mean"], F.sqrt(known_of(_m(m), 1) / _m(m)["n"]))


def slope_of(m: str, n: int) -> Column:
    """Least-squares slope of the second value on the first."""
    return F.when(_m(m)["n"] == n, ratio(_m(m)["co"], known_of(_m(m), 1)))


def correlation_of(m: str, n: int) -> Column:
    return F.when(_m(m)["n"] == n, ratio(_m(m)["co"], F.sqrt(known_of(_m(m), 1)) * F.sqrt(known_of(_m(m), 2))))


def sigma_ratio_of(m: str, n: int) -> Column:
    """Standard deviation of the second value over that of the first."""
    return F.when(_m(m)["n"] == n, ratio(F.sqrt(known_of(_m(m), 2)), F.sqrt(known_of(_m(m), 1))))
