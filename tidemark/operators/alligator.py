"""Alligator lines, awesome oscillator, fractals and their combination."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows, with_monotone
from tidemark.sources.bars import dense_grid, on_grid

LINES = ("jaw", "teeth", "lips")


def _three(values: Sequence[int], what: str) -> None:
    if len(values) != 3:
        raise ValueError(f"three {what}, one for each line")


def alligator_lines(bars: DataFrame, periods: Sequence[int] = (13, 8, 5), lags: Sequence[int] = (8, 5, 3), rows: Rows = Rows(), grid: str = "own") -> DataFrame:
    """``jaw, teeth, lips``: moving averages of the close, each shifted by its lag."""
    _three(periods, "periods")
    _three(lags, "lags")

    def lines(b: DataFrame, r: Rows) -> DataFrame:
        b = b.withColumns({f"__{name}": r.mean("close", p) for name, p in zip(LINES, periods)})
        return b.withColumns({name: r.lag(f"__{name}", k) for name, k in zip(LINES, lags)}).drop(*[f"__{name}" for name in LINES])

    return on_grid(bars, grid, lines, rows)


def alignment(lines: Sequence[str] = LINES, direction: str = "bullish", rows: Rows = Rows()) -> Column:
    """True where the lines begin to stand in strict order: rising ('bullish') or falling ('bearish')."""
    if direction not in ("bullish", "bearish"):
        raise ValueError("direction is 'bullish' or 'bearish'")
    ordered = F.lit(True)
    for a, b in zip(lines, lines[1:]):
        ordered = ordered & ((F.col(b) > F.col(a)) if direction == "bullish" else (F.col(b) < F.col(a)))
    return rows.triggered(ordered)


def _on_dense(bars: DataFrame, grid: str, operator: Callable[[DataFrame], DataFrame], rows: Rows) -> DataFrame:
    """An operator whose result may change at missing rows: on the union calendar these are made, and left out again."""
    if grid == "own":
        return operator(bars)
    if grid != "union":
        raise ValueError("grid is 'own' or 'union'")
    (code,) = rows.keys
    return operator(dense_grid(bars, code, rows.order)).where("present").drop("present")


def _events(bars: DataFrame, periods: Sequence[int], lags: Sequence[int], rows: Rows) -> DataFrame:
    lines = alligator_lines(bars, periods, lags, rows)
    return lines.withColumn("event", F.when(alignment(direction="bullish", rows=rows), 1).when(alignment(direction="bearish", rows=rows), -1))


def alligator_events(bars: DataFrame, periods: Sequence[int] = (13, 8, 5), lags: Sequence[int] = (8, 5, 3), rows: Rows = Rows(), grid: str = "own") -> DataFrame:
    """``event``: 1 or -1 where the lines begin to stand in order, else null.

    On the union calendar lines go on at missing rows, since they are shifted, so an event may fall on one.
    """
    return _on_dense(bars, grid, lambda b: _events(b, periods, lags, rows), rows)


def alligator_signal(
    bars: DataFrame, periods: Sequence[int] = (13, 8, 5), lags: Sequence[int] = (8, 5, 3), keep: bool = True, rows: Rows = Rows(), grid: str = "own"
) -> DataFrame:
    """``signal``: the last event, 0 before the first; without ``keep`` the events themselves."""
    return _on_dense(bars, grid, lambda b: _events(b, periods, lags, rows).withColumn("signal", rows.held("event") if keep else F.col("event")).drop("event"), rows)


def _ao(b: DataFrame, periods: Sequence[int], rows: Rows) -> DataFrame:
    short, long = periods
    return b.withColumn("__half", (F.col("high") - F.col("low")) / 2).withColumn("ao", rows.mean("__half", short) - rows.mean("__half", long)).drop("__half")


def ao(bars: DataFrame, periods: Sequence[int] = (5, 34), rows: Rows = Rows(), grid: str = "own") -> DataFrame:
    """``ao``: short minus long moving average of half the range of high and low."""
    return on_grid(bars, grid, lambda b, r: _ao(b, periods, r), rows)


def ao_signal(bars: DataFrame, window: int = 3, keep: bool = True, periods: Sequence[int] = (5, 34), rows: Rows = Rows(), grid: str = "own") -> DataFrame:
    """``signal``: 1 or -1 while the oscillator rose or fell through ``window`` values, held in between."""
    def signal(b: DataFrame, r: Rows) -> DataFrame:
        found = with_monotone(_ao(b, periods, r), "ao", window, "__event", r)
        return found.withColumn("signal", r.held("__event") if keep else F.col("__event")).drop("__event")

    return on_grid(bars, grid, signal, rows)


def _fractals(b: DataFrame, rows: Rows) -> DataFrame:
    h0, h1, h2 = (rows.lag("high", k) for k in (0, 1, 2))
    l0, l1, l2 = (rows.lag("low", k) for k in (0, 1, 2))
    top = (h2 < h1) & (h1 > h0) & (l2 < l1) & (l1 > l0)
    bottom = (h2 > h1) & (h1 < h0) & (l2 > l1) & (l1 < l0)
    found = b.withColumns({"top": F.when(top, 1).otherwise(0), "bottom": F.when(bottom, -1).otherwise(0), "__row": rows.row()})
    return found.withColumn("fractal", F.col("top") + F.col("bottom"))


def fractals(bars: DataFrame, rows: Rows = Rows(), grid: str = "own") -> DataFrame:
    """``top`` (1 or 0), ``bottom`` (-1 or 0) and their sum ``fractal``, from a code's third row on.

    A top is a middle bar of three whose high and low both lie above its neighbours'; a bottom is the mirror.
    """
    return on_grid(bars, grid, lambda b, r: _fractals(b, r).where("__row >= 2").drop("__row"), rows)


def _fractal_signal(b: DataFrame, rows: Rows, since: int) -> DataFrame:
    """``signal`` of rows with ``fractal``; ``since`` is the row from which a fractal counts."""
    close3, last = rows.lag("close", 3), rows.lag(F.when(F.col("__row") >= since, F.col("fractal")))
    return b.withColumn("signal", F.when((F.col("close") > close3) & (last == 1), 1).when((F.col("close") < close3) & (last == -1), -1).otherwise(0))


def fractal_signal(bars: DataFrame, rows: Rows = Rows(), grid: str = "own") -> DataFrame:
    """``signal``: 1 if the last bar's fractal was a top and the close lies above that of three bars ago, -1 if it was
    a bottom and lies below, else 0."""
    def signal(b: DataFrame, r: Rows) -> DataFrame:
        return _fractal_signal(_fractals(b, r), r, 2).where("__row >= 2").drop("__row", "top", "bottom", "fractal")

    return on_grid(bars, grid, signal, rows)


def combined(a: Column, o: Column, f: Column) -> Column:
    """1 if the first signal and one of the others are 1, else -1 if any is -1, else 0."""
    return F.when((a == 1) & ((o == 1) | (f == 1)), 1).when((a == -1) | (o == -1) | (f == -1), -1).otherwise(0)


def combine_signals(alligator: DataFrame, oscillator: DataFrame, fractal: DataFrame, keys: Sequence[str] = ("code", "dt")) -> DataFrame:
    """``signal`` from three tables with a ``signal`` column each, on the keys that all have."""
    named = [t.select(*keys, F.col("signal").alias(n)) for t, n in ((alligator, "a"), (oscillator, "o"), (fractal, "f"))]
    joined = named[0].join(named[1], list(keys)).join(named[2], list(keys))
    return joined.select(*keys, combined(F.col("a"), F.col("o"), F.col("f")).alias("signal"))


def combined_signal(
    bars: DataFrame, periods: Sequence[int] = (13, 8, 5), lags: Sequence[int] = (8, 5, 3), ao_periods: Sequence[int] = (5, 34), window: int = 3, rows: Rows = Rows()
) -> DataFrame:
    """``signal`` of the three signals of one bar table, from a code's third row on: all are windows of the same sort, so nothing is joined."""
    found = _events(bars, periods, lags, rows).withColumn("__a", rows.held("event")).drop("event", *LINES)
    found = with_monotone(_ao(found, ao_periods, rows), "ao", window, "__event", rows).withColumn("__o", rows.held("__event")).drop("ao", "__event")
    found = _fractal_signal(_fractals(found, rows), rows, 2).withColumnRenamed("signal", "__f")
    return found.withColumn("signal", combined(F.col("__a"), F.col("__o"), F.col("__f"))).where("__row >= 2").drop("__a", "__o", "__f", "__row", "top", "bottom", "fractal")
