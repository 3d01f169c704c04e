"""MACD, its signal, volume momentum, flow bands, phase signals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.functions.scalars import ratio
from tidemark.plans.recurrence import exponential_means
from tidemark.sources.bars import on_grid


def ema(df: DataFrame, x: str, period: int, out: str = "ema", rows: Rows = Rows()) -> DataFrame:
    """Exponential moving average seeded with the mean of the first ``period`` values.

    Null from the first null in it on. With several averages to make, call exponential_means once.
    """
    (key,) = rows.keys
    return exponential_means(df.withColumn("__seq", rows.row()), {out: (x, period)}, period - 1, "__seq", key).drop("__seq")


def macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, rows: Rows = Rows()) -> DataFrame:
    """``dif, dea, hist``: fast minus slow exponential average, its own average, their difference.

    Both averages begin at the slow one's first row; all three columns are null before row slow + signal - 2.
    """
    if not 1 <= fast < slow or signal < 1:
        raise ValueError("1 <= fast < slow, and signal is 1 at least")
    (key,) = rows.keys
    start = slow - 1
    found = exponential_means(df.withColumn("__seq", rows.row()), {"__fast": (x, fast), "__slow": (x, slow)}, start, "__seq", key)
    found = found.withColumn("__dif", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    found = exponential_means(found, {"dea": ("__dif", signal)}, start + signal - 1, "__seq", key)
    found = found.withColumn("dif", F.when(F.col("dea").isNotNull(), F.col("__dif")))
    return found.withColumn("hist", F.col("dif") - F.col("dea")).drop("__seq", "__dif")


def macd_events(df: DataFrame, rows: Rows = Rows()) -> DataFrame:
    """``event`` from ``dif, dea, hist``: 1 on an upward cross with none of them negative, -1 on a downward cross with
    all of them negative, else 0."""
    dif1, dea1, hist1 = (rows.lag(c) for c in ("dif", "dea", "hist"))
    up = (F.col("dif") > F.col("dea")) & (dif1 <= dea1) & (F.col("hist") > 0) & (hist1 <= 0)
    down = (F.col("dif") < F.col("dea")) & (dif1 >= dea1) & (F.col("hist") < 0) & (hist1 >= 0)
    up = up & (F.col("dif") >= 0) & (F.col("dea") >= 0) & (F.col("hist") >= 0)
    down = down & (F.col("dif") < 0) & (F.col("dea") < 0) & (F.col("hist") < 0)
    return df.withColumn("event", F.when(up, 1).when(down, -1).otherwise(0))


def macd_signal(df: DataFrame, x: str = "close", keep: bool = True, rows: Rows = Rows()) -> DataFrame:
    """``signal``: the last event that is not 0, 0 before the first; without ``keep`` the events themselves."""
    found = macd_events(macd(df, x, rows=rows), rows)
    return found.withColumn("signal", rows.held(F.nullif("event", F.lit(0))) if keep else F.col("event")).drop("event")


def vmacd_mtm(df: DataFrame, x: str = "volume", period: int = 60, rows: Rows = Rows()) -> DataFrame:
    """``vmacd_mtm``: the sum over ``period`` rows of the changes of the z-score of the volume's MACD histogram.

    The changes telescope, so the sum is the z-score less that of ``period`` rows ago, null unless all between are known.
    """
    found = macd(df, x, rows=rows)
    z = ratio(F.col("hist") - rows.mean("hist", period), rows.std("hist", period))
    found = found.withColumn("__z", z)
    known = F.count("__z").over(rows.trail(period + 1)) == period + 1
    return found.withColumn("vmacd_mtm", F.when(known, F.col("__z") - rows.lag("__z", period))).drop("__z", "dif", "dea", "hist")


def flow_signal(flow: DataFrame, x: str = "north_money", window: int = 60, low: float = 0.2, high: float = 0.8, rows: Rows = Rows(("series",)), grid: str = "own") -> DataFrame:
    """``signal``: 1 above the upper quantile of the last ``window`` rows, -1 below the lower one, held in between."""
    def signal(b: DataFrame, r: Rows) -> DataFrame:
        bands = b.withColumns({"upper": r.quantile(x, window, high), "lower": r.quantile(x, window, low)})
        event = F.when(F.col(x) > F.col("upper"), 1).when(F.col(x) < F.col("lower"), -1)
        return bands.withColumn("__event", event).withColumn("signal", r.held("__event")).drop("__event")

    return on_grid(flow, grid, signal, rows)


def phase_weights(n: int) -> list[float]:
    """Taps that give the imaginary part of the analytic signal of n values at the last of them.

    The inverse transform of the one-sided spectrum, written out: 2/n times the sum of sines of the kept frequencies.
    """
    if n < 2:
        raise ValueError("a window has two rows at least")
    kept = range(1, (n + 1) // 2)
    return [2.0 / n * sum(math.sin(2 * math.pi * k * (n - 1 - i) / n) for k in kept) for i in range(n)]


def phase_fir(df: DataFrame, x: str, n: int = 30, out: str = "phase", rows: Rows = Rows(), grid: str = "own") -> DataFrame:
    """Instantaneous phase at the last of n values: a dot product with fixed taps, then an arc tangent.

    Null until n values that are not null are in the window.
    """
    taps = F.array(*[F.lit(w) for w in phase_weights(n)])
    imaginary = F.aggregate(F.zip_with("__w", taps, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def phase(b: DataFrame, r: Rows) -> DataFrame:
        window = F.when(F.count(x).over(r.trail(n)) == n, r.windows(x, n))
        return b.withColumn("__w", window).withColumn(out, F.atan2(imaginary, F.col(x))).drop("__w")

    return on_grid(df, grid, phase, rows)


def ht_signal(df: DataFrame, x: str = "close", ma: int = 60, ht: int = 30, rows: Rows = Rows(), grid: str = "own") -> DataFrame:
    """``signal`` from row ma + ht - 1 on: 1 while the last phase of ``ht`` changes of the average lies in the right
    half plane, else 0.

    The phase does so exactly if its real part, which is the last change itself, is not negative; so no transform
    is made and ``ht`` only sets the warm-up. A change of exactly zero gives 1.
    """
    steps = on_grid(df, grid, lambda b, r: b.withColumn("__ma", r.mean(x, ma)).withColumn("__step", r.diff("__ma")), rows).where("__step IS NOT NULL")
    found = steps.withColumn("__row", rows.row()).where(F.col("__row") >= ht - 1)
    return found.withColumn("signal", F.when(F.col("__step") >= 0, 1).otherwise(0)).drop("__ma", "__step", "__row")


def band_signal(df: DataFrame, x: str = "close", period: int = 60, band: int = 2, rows: Rows = Rows(), grid: str = "own") -> DataFrame:
    """``signal`` from row ``period`` - 1 on: 1 if the last value of a frequency band is not negative.

    Band k is the moving average of 2^k rows less that of 2^(k+1), the fastest at k = 0; after the last band whose
    longer average fits the period comes the slow rest, less the window's mean. A band beyond that gives 0. This
    stands for adaptive decompositions and does not equal them numerically.
    """
    bands = int(math.log2(period))

    def signal(b: DataFrame, r: Rows) -> DataFrame:
        if band < bands:
            value = r.mean(x, 2**band) - r.mean(x, 2 ** (band + 1))
        elif band == bands:
            value = r.mean(x, 2**bands) - r.mean(x, period)
        else:
            value = F.lit(None).cast("double")
        found = b.withColumn("__row", r.row()).withColumn("signal", F.when(value >= 0, 1).otherwise(0))
        return found.where(F.col("__row") >= period - 1).drop("__row")

    return on_grid(df, grid, signal, rows)
