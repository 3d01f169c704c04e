from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.helpers import close_to, column, panel
from tidemark.catalog import Tables
from tidemark.operators import alligator, momentum, noise, qrs
from tidemark.streaming.bars import stream_bars

SF = "/root/testdata/sf0.001"


def test_beta_is_the_least_squares_slope(spark):
    rng = np.random.default_rng(1)
    low, high = rng.uniform(20, 30, 40), rng.uniform(30, 40, 40)
    df = panel(spark, low.tolist()).drop("high", "low")
    rows = [(r["code"], r["dt"], float(h), float(x)) for r, h, x in zip(df.orderBy("dt").collect(), high, low)]
    bars = spark.createDataFrame(rows, "code string, dt date, high double, low double")
    last = qrs.beta(bars, 18).orderBy("dt").collect()[-1]["beta"]
    assert close_to(last, np.polyfit(low[-18:], high[-18:], 1)[0])
    r2 = qrs.regulation(bars, 18).orderBy("dt").collect()[-1]["regulation"]
    assert close_to(r2, np.corrcoef(low[-18:], high[-18:])[0, 1] ** 2)


def test_qrs_plan_has_one_shuffle_beyond_the_bars(spark):
    b = Tables(spark, SF).bars
    plan = qrs.qrs_signal(b)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 2 and "SinglePartition" not in plan and "Python" not in plan


def test_qrs_is_scale_free_and_causal(spark):
    b = Tables(spark, SF).bars.where("code = 'NO'")
    scaled = b.withColumns({c: b[c] * 7 for c in ("high", "low")})
    a, s = (qrs.qrs_signal(x, m=100).orderBy("dt").collect() for x in (b, scaled))
    assert all(close_to(x["signal"], y["signal"], 1e-6) for x, y in zip(a, s))
    cut = a[len(a) // 2]["dt"]
    early = qrs.qrs_signal(b.where(b.dt <= cut), m=100).orderBy("dt").collect()
    assert all(close_to(x["signal"], y["signal"]) for x, y in zip(early, a))


def test_fractals_need_three_rows(spark):
    df = panel(spark, [1.0, 3.0, 1.0, 0.0, 2.0])
    assert column(alligator.fractals(df), "fractal") == [1, 0, -1]
    assert alligator.fractals(panel(spark, [1.0, 2.0])).count() == 0


def test_first_row_never_triggers(spark):
    df = alligator.alligator_events(panel(spark, [float(k) for k in range(30)]), (3, 2, 1), (3, 2, 1))
    events = column(df, "event")
    assert events.count(1) == 1 and events.index(1) == 5
    with pytest.raises(ValueError):
        alligator.alligator_lines(df, (1, 2), (1, 2, 3))


def test_macd_warm_up_and_short_series(spark):
    hist = column(momentum.macd(panel(spark, [float(k) for k in range(40)])), "hist")
    assert hist[:33] == [None] * 33 and None not in hist[33:]
    assert set(column(momentum.macd_signal(panel(spark, [1.0] * 5)), "signal")) == {0}
    with pytest.raises(ValueError):
        momentum.macd(panel(spark, [1.0]), fast=3, slow=2)


def test_phase_in_right_half_plane_iff_value_not_negative(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=80)
    df = momentum.phase_fir(panel(spark, x.tolist()), "close", 30)
    spectrum = np.zeros(30)
    spectrum[0] = spectrum[15] = 1
    spectrum[1:15] = 2
    for k, phase in enumerate(column(df, "phase")):
        if k >= 29:
            analytic = np.fft.ifft(np.fft.fft(x[k - 29 : k + 1]) * spectrum)[-1]
            assert close_to(phase, float(np.angle(analytic)), 1e-8)
            assert (abs(phase) <= np.pi / 2) == (x[k] >= 0)


def test_ht_signal_zero_change_is_one(spark):
    assert column(momentum.ht_signal(panel(spark, [5.0] * 10), ma=3, ht=4), "signal") == [1] * 4  # rows 6 to 9


def test_band_beyond_the_last_is_zero(spark):
    assert set(column(momentum.band_signal(panel(spark, [float(k) for k in range(20)]), period=8, band=9), "signal")) == {0}


def _intraday(spark, rows):
    return spark.createDataFrame([(c, t, float(o), float(x), float(v)) for c, t, o, x, v in rows], "code string, trade_time timestamp_ntz, open double, close double, volume double")


def test_noise_area_first_day_and_missing_open(spark):
    day = lambda k, h: datetime(2024, 1, 1 + k, h)
    rows = [("A", day(k, h), 10 + k, 11 + k, 5) for k in range(4) for h in (9, 12, 15) if (k, h) != (2, 9)]
    found = noise.noise_area(_intraday(spark, rows), 2, "09:00:00", "15:00:00").orderBy("trade_time").collect()
    bound = {r["trade_time"]: r["upperbound"] for r in found}
    assert all(bound[day(0, h)] is None for h in (9, 12, 15)), "first day"
    assert bound[day(2, 12)] is None and bound[day(2, 15)] is None, "no opening bar"
    assert bound[day(1, 12)] is not None and len(found) == len(rows)


def test_noise_area_averages_repeats_and_zero_volume(spark):
    t = datetime(2024, 1, 1, 9)
    found = noise.noise_area(_intraday(spark, [("A", t, 1, 2, 0), ("A", t, 3, 4, 0)]), 1, "09:00:00", "15:00:00").collect()
    assert len(found) == 1 and found[0]["signal"] == 3 and found[0]["vwap"] is None


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    ticks = spark.createDataFrame([("A", datetime(2024, 1, 1) + timedelta(seconds=20 * k), float(k % 7), 1) for k in range(200)], "code string, ts timestamp, price double, size int")
    ticks.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        stream_bars(source, "5 minutes", "2 hours").writeStream.format("memory").queryName("bars_out").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.table("bars_out").orderBy("trade_time").collect()
    assert got == stream_bars(ticks, "5 minutes", "2 hours").orderBy("trade_time").collect() and len(got) > 10


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 50), min_size=8, max_size=30))
def test_signals_do_not_look_ahead(spark, closes):
    df = panel(spark, [float(c) for c in closes])
    cut = df.where(df.dt < df.orderBy("dt").collect()[len(closes) // 2]["dt"])
    for f in (alligator.fractal_signal, lambda b: alligator.ao_signal(b, periods=(2, 4)), lambda b: alligator.alligator_signal(b, (3, 2, 1), (2, 1, 1))):
        whole, part = column(f(df), "signal"), column(f(cut), "signal")
        assert whole[: len(part)] == part


def test_average_is_null_from_an_inner_null_on(spark):
    from tidemark.operators.momentum import ema

    values = [float(k % 7) for k in range(700)]
    rows = [("a", k, None if k == 600 else v) for k, v in enumerate(values)] + [("b", k, v) for k, v in enumerate(values)] + [("c", k, None if k < 3 else v) for k, v in enumerate(values)]
    got = {}
    for r in ema(spark.createDataFrame(rows, "code string, dt int, x double"), "x", 5).orderBy("dt").collect():
        got.setdefault(r["code"], []).append(r["ema"])
    want, y = [None] * 4, sum(values[:5]) / 5
    for k in range(4, 700):
        y = y if k == 4 else values[k] / 3 + y * 2 / 3
        want.append(y)
    assert got["b"][:4] == want[:4] and all(abs(a - b) < 1e-9 for a, b in zip(got["b"][4:], want[4:]))
    assert got["a"][600:] == [None] * 100 and all(abs(a - b) < 1e-9 for a, b in zip(got["a"][4:600], want[4:600]))
    assert set(got["c"]) == {None}
