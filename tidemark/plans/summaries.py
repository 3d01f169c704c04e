"""Sums of a stretch of a series that merge with those of the next stretch: moments, products, and growth with its worst fall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def reads_all(df: DataFrame) -> Column:
    """An aggregate that is always known and needs every column.

    Filtered on, it keeps an aggregation from reading fewer columns than another use of the same shuffle, so that both share it.
    """
    return F.bit_xor(F.xxhash64(*df.columns))


def growth_summary(ret: str, time: str) -> list[Column]:
    """Aggregates of a stretch: ``rows``, and from its own start ``growth``, ``peak`` and ``trough`` (1 included) and ``worst``, the least
    ratio of a value to one before it. A missing return leaves the value as it is. The stretch's rows are put in order in one list."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.coalesce(F.col(ret), F.lit(0.0)).alias("r")))), lambda v: v["r"])
    start = F.struct(F.lit(1.0).alias("growth"), F.lit(1.0).alias("peak"), F.lit(1.0).alias("trough"), F.lit(1.0).alias("worst"))

    def step(a: Column, r: Column) -> Column:
        value = a["growth"] * (1 + r)
        peak = F.greatest(a["peak"], value)
        return F.struct(value.alias("growth"), peak.alias("peak"), F.least(a["trough"], value).alias("trough"), F.least(a["worst"], value / peak).alias("worst"))

    return [F.count("*").alias("rows"), F.aggregate(values, start, step).alias("path")]


def moments(name: str, x: Column) -> list[Column]:
    """``n, mean, m2`` (sum of squared distances from the mean) and the smallest and largest value, nulls left out."""
    return [F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high")).alias(name)]


def pair_moments(name: str, x: Column, y: Column) -> list[Column]:
    """``n``, both means, ``co`` (sum of products of distances from the means) and of ``y`` its ``m2, low, high``; both are null together."""
    n = F.count(x)
    return [F.struct(n.alias("n"), F.avg(x).alias("mean"), F.avg(y).alias("mean2"), (F.covar_pop(x, y) * n).alias("co"), (F.var_pop(y) * n).alias("m2"), F.min(y).alias("low"), F.max(y).alias("high")).alias(name)]


def _known(a: Column, b: Column, merged: Column) -> Column:
    """``merged`` where both sides have values, else the side that has."""
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(merged)


def _joined(a: Column, b: Column) -> Column:
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    return _known(a, b, F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"), F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high")))


def _joined_pairs(a: Column, b: Column) -> Column:
    n, apart, apart2 = a["n"] + b["n"], b["mean"] - a["mean"], b["mean2"] - a["mean2"]
    return _known(a, b, F.struct(
        n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["mean2"] + apart2 * b["n"] / n).alias("mean2"), (a["co"] + b["co"] + apart * apart2 * a["n"] * b["n"] / n).alias("co"),
        (a["m2"] + b["m2"] + apart2 * apart2 * a["n"] * b["n"] / n).alias("m2"), F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"),
    ))


def _joined_paths(a: Column, b: Column) -> Column:
    """Growth, peak, trough and worst fall of a stretch and the one behind it; the worst fall may begin in one and end in the other."""
    return F.struct(
        (a["growth"] * b["growth"]).alias("growth"), F.greatest(a["peak"], a["growth"] * b["peak"]).alias("peak"), F.least(a["trough"], a["growth"] * b["trough"]).alias("trough"),
        F.least(a["worst"], b["worst"], a["growth"] * b["trough"] / a["peak"]).alias("worst"),
    )


def folded(stretches: Column, names: list[str]) -> Column:
    """The stretches of an array in order, merged into one: ``path`` as growth, ``rb`` as pairs, ``r`` and ``d`` as moments, others as sums."""
    merge = {"path": _joined_paths, "rb": _joined_pairs, "r": _joined, "d": _joined}
    plain = lambda a, b: F.coalesce(a + b, a, b)
    step = lambda a, b: F.struct(*[merge.get(n, plain)(a[n], b[n]).alias(n) for n in names])
    first = F.element_at(stretches, 1)
    rest = F.slice(stretches, F.lit(2), F.size(stretches))
    return F.aggregate(rest, F.struct(*[first[n].alias(n) for n in names]), step)


def pairs_of(x: Column, y: Column, window: WindowSpec) -> Column:
    """Moments of both values along a window: ``n, mean, mean2, m2, m22, co, low, high, low2, high2``; both are null together."""
    n = F.count(x).over(window)
    spread = lambda c: F.var_pop(c).over(window) * n
    return F.struct(
        n.alias("n"), F.avg(x).over(window).alias("mean"), F.avg(y).over(window).alias("mean2"), spread(x).alias("m2"), spread(y).alias("m22"), (F.covar_pop(x, y).over(window) * n).alias("co"),
        F.min(x).over(window).alias("low"), F.max(x).over(window).alias("high"), F.min(y).over(window).alias("low2"), F.max(y).over(window).alias("high2"),
    )


def merged_pairs(a: Column, b: Column) -> Column:
    """The moments of ``pairs_of`` of two stretches together."""
    n, apart, apart2 = a["n"] + b["n"], b["mean"] - a["mean"], b["mean2"] - a["mean2"]
    share = a["n"] * b["n"] / n
    return F.when(b["n"] == 0, a).when(a.isNull() | (a["n"] == 0), b).otherwise(F.struct(
        n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["mean2"] + apart2 * b["n"] / n).alias("mean2"), (a["m2"] + b["m2"] + apart * apart * share).alias("m2"),
        (a["m22"] + b["m22"] + apart2 * apart2 * share).alias("m22"), (a["co"] + b["co"] + apart * apart2 * share).alias("co"), F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"),
        F.least(a["low2"], b["low2"]).alias("low2"), F.greatest(a["high2"], b["high2"]).alias("high2"),
    ))


def known_of(m: Column, which: int) -> Column:
    """The sum of squared distances of the first or second value, exactly 0 for equal values."""
    low, high, m2 = ("low", "high", "m2") if which == 1 else ("low2", "high2", "m22")
    return F.when(m[low] == m[high], 0.0).otherwise(m[m2])
