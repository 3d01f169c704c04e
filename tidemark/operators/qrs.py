"""Regression signals of highs on lows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.functions.scalars import ratio
from tidemark.plans.blocks import trailing_moments, zscore_of
from tidemark.sources.bars import on_grid


def _checked(n: int, m: int = 1) -> None:
    if n < 2 or m < 1:
        raise ValueError("a regression has two rows at least, a z-score one")


def beta(bars: DataFrame, n: int = 18, simple: bool = False, grid: str = "own", rows: Rows = Rows()) -> DataFrame:
    """``beta`` per bar from the n-th row of a code on: the slope of high on low, or with ``simple`` the ratio of
    their standard deviations."""
    _checked(n)
    value = lambda r: r.sigma_ratio("low", "high", n) if simple else r.slope("low", "high", n)
    found = on_grid(bars, grid, lambda b, r: b.withColumn("beta", value(r)).withColumn("__row", r.row()), rows)
    return found.where(F.col("__row") >= n - 1).drop("__row")


#: From so many rows on a window is merged from blocks; measured on 800,000 rows, windows of 600 take 2 s that way and 20 s as sliding frames.
LONG = 64


def _zscore(found: DataFrame, m: int, rows: Rows) -> DataFrame:
    """``found`` with the ``zscore`` of its beta among m rows."""
    if m < LONG:
        return found.withColumn("zscore", rows.zscore("beta", m))
    return trailing_moments(found, "beta", None, m, "__m", rows).withColumn("zscore", zscore_of(F.col("beta"), "__m")).drop("__m")


def zscore_beta(bars: DataFrame, n: int = 18, m: int = 600, simple: bool = False, grid: str = "own", rows: Rows = Rows()) -> DataFrame:
    """``beta`` and its ``zscore`` among m betas, from row n + m - 2 of a code on."""
    _checked(n, m)
    found = _zscore(beta(bars, n, simple, grid, rows), m, rows).withColumn("__row", rows.row())
    return found.where(F.col("__row") >= m - 1).drop("__row")


def regulation(bars: DataFrame, n: int = 18, power: float = 2, grid: str = "own", rows: Rows = Rows()) -> DataFrame:
    """``regulation``: the correlation of high and low over n rows to a power (2 gives R squared)."""
    _checked(n)
    return on_grid(bars, grid, lambda b, r: b.withColumn("regulation", F.pow(r.correlation("low", "high", n), F.lit(power))), rows)


def regulation_mean(bars: DataFrame, n: int = 18, power: float = 2, grid: str = "own", rows: Rows = Rows()) -> DataFrame:
    """``regulation`` and its mean over n rows."""
    found = regulation(bars, n, power, grid, rows)
    return found.withColumn("regulation_mean", rows.mean("regulation", n))


def qrs_signal(
    bars: DataFrame, n: int = 18, m: int = 600, power: float = 2, adjust: bool = False, simple: bool = False, grid: str = "own", rows: Rows = Rows()
) -> DataFrame:
    """``signal`` = z-score of beta times regulation, with ``adjust`` divided by the regulation's mean over n rows.

    The first row of a code is its row n + m - 2. All windows share one partitioning: one shuffle
    whatever the number of codes, and a long z-score costs the same whatever m is; a code's rows stay in one task (see plans.halo for series beyond that).
    """
    _checked(n, m)

    def measured(b: DataFrame, r: Rows) -> DataFrame:
        value = r.sigma_ratio("low", "high", n) if simple else r.slope("low", "high", n)
        b = b.withColumns({"beta": value, "regulation": F.pow(r.correlation("low", "high", n), F.lit(power)), "__row": r.row()})
        return b.withColumn("__mean", r.mean("regulation", n)) if adjust else b

    found = on_grid(bars, grid, measured, rows).where(F.col("__row") >= n - 1)
    found = _zscore(found, m, rows).where(F.col("__row") >= n + m - 2)
    weight = ratio("regulation", "__mean") if adjust else F.col("regulation")
    return found.withColumn("signal", F.col("zscore") * weight).drop("__row", "__mean")
