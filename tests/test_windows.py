import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import close_to, column, panel, returns_table
from tidemark.functions.frames import Rows, day_windows, rolling_apply, sliding_windows, with_monotone
from tidemark.functions.scalars import field_or_zero
from tidemark.operators import drawdown, momentum
from tidemark.plans import halo
from tidemark.plans.recurrence import exponential_means
from tidemark.sources import bars as feed

ROWS = Rows()
CLOSES = [3.0, 5.0, None, 4.0, 8.0, 9.0, 9.0, 2.0, 7.0, 1.0, 6.0, 6.5]


def test_statistics_match_pandas(spark):
    df = panel(spark, CLOSES)
    s = pd.Series(CLOSES, dtype=float)
    want = {"mean": s.rolling(3).mean(), "std": s.rolling(3).std(), "sum": s.rolling(3).sum(), "q": s.rolling(3).quantile(0.3)}
    got = df.withColumns({"mean": ROWS.mean("close", 3), "std": ROWS.std("close", 3), "sum": ROWS.sum("close", 3), "q": ROWS.quantile("close", 3, 0.3)})
    for name, series in want.items():
        assert all(close_to(a, None if math.isnan(b) else b) for a, b in zip(column(got, name), series)), name


def test_zero_variance_is_null(spark):
    df = panel(spark, [5.0] * 6)
    got = df.withColumns({"c": ROWS.correlation("low", "high", 3), "b": ROWS.slope("low", "high", 3), "z": ROWS.zscore("close", 3)})
    assert set(column(got, "c") + column(got, "b") + column(got, "z")) == {None}


def test_codes_do_not_mix(spark):
    a, b = panel(spark, CLOSES, "A"), panel(spark, list(reversed(CLOSES)), "B")
    both = a.union(b).withColumn("m", ROWS.mean("close", 2))
    assert column(both.where("code = 'A'"), "m") == column(a.withColumn("m", ROWS.mean("close", 2)), "m")


def test_grid_modes_differ_at_gaps(spark):
    df = panel(spark, [1.0, 2.0, 3.0, 4.0, 5.0], "A", gaps=(2,)).union(panel(spark, [1.0] * 5, "B"))
    windowed = lambda b, rows: b.withColumn("m", rows.mean("close", 2))
    own = column(feed.on_grid(df, "own", windowed).where("code = 'A'"), "m")
    union = column(feed.on_grid(df, "union", windowed).where("code = 'A'"), "m")
    assert own == [None, 1.5, 3.0, 4.5] and union == [None, 1.5, None, 4.5]
    with pytest.raises(ValueError):
        feed.on_grid(df, "other", windowed)


def test_monotone_and_trigger(spark):
    df = with_monotone(panel(spark, [1.0, 2.0, 3.0, 3.0, 2.0, 1.0]), "close", 3, "m")
    assert column(df, "m") == [None, None, 1, None, None, -1]
    rising = df.withColumn("t", ROWS.triggered(F.col("close") > 1.5))
    assert column(rising, "t") == [False, True, False, False, False, False]


def test_sliding_windows(spark):
    df = panel(spark, [float(k) for k in range(7)])
    assert column(sliding_windows(df, "close", 3, 2), "values") == [[0, 1, 2], [2, 3, 4], [4, 5, 6]]
    assert column(day_windows(df, "close", 2, 2), "values") == [[0, 1, 2, 3], [2, 3, 4, 5]]
    assert sliding_windows(df, "close", 8).count() == 0
    with pytest.raises(ValueError):
        sliding_windows(df, "close", 0)


def test_rolling_apply(spark):
    df = rolling_apply(panel(spark, CLOSES), "close", 3, lambda x: float(np.ptp(x)), "r")
    want = pd.Series(CLOSES, dtype=float).rolling(3).apply(np.ptp)
    assert all(close_to(a, None if math.isnan(b) else b) for a, b in zip(column(df, "r"), want))


@pytest.mark.parametrize("period", [1, 2, 9, 60])
def test_exponential_mean_over_blocks(spark, period):
    random.seed(period)
    x = [random.uniform(1, 100) for _ in range(1100)]
    a, y, want = 2 / (period + 1), None, []
    for k, v in enumerate(x):
        y = None if k < period - 1 else sum(x[:period]) / period if k == period - 1 else a * v + (1 - a) * y
        want.append(y)
    got = column(momentum.ema(panel(spark, x), "close", period), "ema")
    assert all(close_to(g, w, 1e-10) for g, w in zip(got, want))


def test_exponential_means_reject_bad_period(spark):
    with pytest.raises(ValueError):
        exponential_means(panel(spark, [1.0]), {"e": ("close", 0)}, 0, "dt")


def test_long_series_patterns(spark):
    x = [float(k % 13) for k in range(300)]
    df = halo.global_sequence(panel(spark, x))
    assert column(df, "seq") == list(range(300))
    plain = column(df.withColumn("m", ROWS.mean("close", 20)), "m")
    assert all(close_to(a, b) for a, b in zip(column(halo.long_mean(df, "close", 20, 32, "m"), "m"), plain))
    total = column(halo.long_running_sum(df, F.col("close"), 32, "s"), "s")
    assert all(close_to(a, b) for a, b in zip(total, np.cumsum(x)))


def test_two_levels_equal_plain_windows(spark):
    x = [None if k % 7 == 3 or k < 40 else float((k * 31) % 17 - 8) / 8 + 1.5 for k in range(150)]
    df = panel(spark, x, "A").union(panel(spark, x[::-1], "B")).union(panel(spark, [2.0, None, 1.0], None))
    numbered = halo.global_sequence(df)
    plain = {"sum": F.sum("close"), "product": F.product("close"), "max": F.max("close"), "last": F.last("close", ignorenulls=True)}
    cut = {"sum": halo.long_running_sum, "product": halo.long_running_product, "max": halo.long_running_max, "last": halo.long_last_known}
    for name, value in plain.items():
        expected = df.withColumn("v", value.over(ROWS.run)).orderBy("code", "dt").collect()
        found = cut[name](numbered, F.col("close"), 16, "v").orderBy("code", "dt").collect()
        assert [(r["code"], r["dt"]) for r in found] == [(r["code"], r["dt"]) for r in expected], name
        assert all(close_to(a["v"], b["v"]) for a, b in zip(found, expected)), name
    with pytest.raises(ValueError):
        halo.long_running_max(numbered, F.col("close"), 0, "v")
    assert halo.long_running_sum(numbered.limit(0), F.col("close"), 16, "v").count() == 0


def test_long_falls_equal_the_plain_ones(spark):
    ret = [None if k % 11 == 5 else ((k * 29) % 13 - 6) / 100 for k in range(200)]
    df = returns_table(spark, ret).union(returns_table(spark, ret[::-1], "B"))
    plain = drawdown.episodes(df).orderBy("series", "peak_date").collect()
    cut = drawdown.long_episodes(df).orderBy("series", "peak_date").collect()
    assert len(plain) > 4
    assert [r[:4] for r in cut] == [r[:4] for r in plain]
    assert all(close_to(a["depth"], b["depth"]) for a, b in zip(cut, plain))


def test_long_series_equals_the_plain_operator(spark):
    x = [float(k * 7 % 23) for k in range(300)]
    df = panel(spark, x, "A").union(panel(spark, x[::-1], "B"))
    plain = df.withColumn("m", ROWS.std("close", 9))
    cut = halo.long_series(df, 9, 16, lambda b, rows: b.withColumn("m", rows.std("close", 9)))
    assert cut.columns == plain.columns
    assert [(r["code"], r["dt"], r["m"]) for r in cut.orderBy("code", "dt").collect()] == [(r["code"], r["dt"], r["m"]) for r in plain.orderBy("code", "dt").collect()]


def test_nested_numbers_default_to_zero(spark):
    df = spark.createDataFrame([(((3.0,),),), ((None,),), (None,)], "a struct<b: struct<c: double>>")
    assert [r[0] for r in df.select(field_or_zero("a", "b", "c")).collect()] == [3.0, 0.0, 0.0]


def test_nan_becomes_null_on_read(spark, tmp_path):
    panel(spark, [1.0, float("nan"), 3.0]).write.parquet(str(tmp_path / "p"))
    assert column(feed.read_panel(spark, str(tmp_path / "p")), "close") == [1.0, None, 3.0]


def test_panel_round_trip_csv(spark, tmp_path):
    feed.write_panel(panel(spark, [1.0, 2.0]), str(tmp_path / "c"), "csv")
    assert column(feed.read_panel(spark, str(tmp_path / "c"), "csv"), "close") == [1.0, 2.0]


def test_empty_and_single_row(spark):
    one = panel(spark, [1.0])
    assert column(one.withColumn("m", ROWS.mean("close", 2)), "m") == [None]
    assert feed.dense_grid(one.where("false")).count() == 0
    assert feed.calendar_align(one).count() == 1


def test_grid_keeps_null_codes(spark):
    from tidemark.sources import bars

    rows = [(c, t, float(k)) for k, (c, t) in enumerate([("a", 1), ("b", 1), (None, 2), ("c", 3), ("d", 3), ("e", 1), ("a", 3)])]
    grid = bars.dense_grid(spark.createDataFrame(rows, "code string, dt int, x double")).collect()
    assert len(grid) == 6 * 3 and sum(r["present"] for r in grid) == len(rows)
    assert {(r["code"], r["dt"], r["x"]) for r in grid if r["present"]} == {(c, t, x) for c, t, x in rows}
    assert all(r["x"] is None for r in grid if not r["present"])
