"""The union calendar without its rows, merged sums, folds in buckets, joins on time, appended rows, bucketed tables, checks."""

import math
import random
import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import close_to, column, days, panel, returns_table
from tidemark.catalog import Tables
from tidemark.functions.frames import Rows
from tidemark.functions.quantiles import SortedBlocks, long_quantile, rolling_quantiles
from tidemark.operators import alligator, drawdown, momentum, qrs, returns, trades
from tidemark.plans import append, blocks, halo, intervals
from tidemark.plans import calendar as calendars
from tidemark.sources import bars as feed

SF = "/root/testdata/sf0.001"
ROWS = Rows()


def gappy(spark, codes=4, n=60, share=0.25, seed=1):
    """Bars of a few codes, one of them null, each without some of the days; some values are null."""
    rng = random.Random(seed)
    rows = []
    for k in range(codes):
        for d in days(n):
            if rng.random() > share:
                x = [float(rng.randrange(40)) if rng.random() > 0.05 else None for _ in range(3)]
                low, high = (min(x[:2]), max(x[:2])) if None not in x[:2] else (x[0], x[1])
                rows.append((None if k == 0 else f"c{k}", d, x[2], high, low, x[2], float(rng.randrange(9))))
    return spark.createDataFrame(rows, "code string, dt date, open double, high double, low double, close double, volume double")


def same(a, b, tolerance=1e-9):
    key = lambda r: (str(r["code"]), r["dt"])
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and len(a) > 0
    for x, y in zip(a, b):
        assert set(x.asDict()) == set(y.asDict())
        for c, v in x.asDict().items():
            assert close_to(v, y[c], tolerance) if isinstance(v, float) else v == y[c], (c, x, y)


def crossed(df):
    """Every code at every time by a product, nulls where there is no row: what the ranks stand for."""
    grid = df.select("code").distinct().crossJoin(df.select("dt").distinct())
    return grid.alias("g").join(df.withColumn("present", F.lit(True)).alias("b"), F.expr("g.code <=> b.code AND g.dt = b.dt"), "left").select("g.code", "g.dt", "open", "high", "low", "close", "volume", F.coalesce("present", F.lit(False)).alias("present"))


OPERATORS = {
    "mean": lambda b, r: b.withColumn("v", r.mean("close", 3)), "quantile": lambda b, r: b.withColumn("v", r.quantile("close", 3, 0.3)), "lag": lambda b, r: b.withColumn("v", r.lag("close", 2)),
    "lead": lambda b, r: b.withColumn("v", r.lag("close", -1)), "zscore": lambda b, r: b.withColumn("v", r.zscore("close", 3)), "held": lambda b, r: b.withColumn("v", r.held("close")),
    "triggered": lambda b, r: b.withColumn("v", r.triggered(F.col("close") > 20)), "row": lambda b, r: b.withColumn("v", r.row().cast("long")), "slope": lambda b, r: b.withColumn("v", r.slope("low", "high", 3)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ranges_of_ranks_equal_rows_of_nulls(spark, name):
    df = gappy(spark)
    same(feed.on_grid(df, "union", OPERATORS[name]), OPERATORS[name](crossed(df), ROWS).where("present").drop("present"))


SIGNALS = {
    "ao": lambda b, g: alligator.ao_signal(b, 2, periods=(2, 3), grid=g), "fractals": lambda b, g: alligator.fractals(b, grid=g), "fractal": lambda b, g: alligator.fractal_signal(b, grid=g),
    "flow": lambda b, g: momentum.flow_signal(b, "close", 3, rows=ROWS, grid=g), "phase": lambda b, g: momentum.phase_fir(b, "close", 3, grid=g), "band": lambda b, g: momentum.band_signal(b, "close", 4, 0, grid=g),
    "alligator": lambda b, g: alligator.alligator_signal(b, (3, 2, 1), (2, 1, 1), grid=g), "events": lambda b, g: alligator.alligator_events(b, (2, 1, 1), (2, 1, 0), grid=g),
    "lines": lambda b, g: alligator.alligator_lines(b, (3, 2, 1), (2, 1, 1), grid=g), "beta": lambda b, g: qrs.beta(b, 2, grid=g), "ht": lambda b, g: momentum.ht_signal(b, "close", 2, 3, grid=g),
}


@pytest.mark.parametrize("name", SIGNALS)
def test_signals_on_the_union_calendar(spark, name):
    df, f = gappy(spark), SIGNALS[name]
    dense = f(crossed(df), "own").where("present").drop("present")
    same(f(df, "union"), dense)


def test_dense_grid_equals_the_product(spark):
    df = gappy(spark)
    for shuffled in (False, True):
        same(feed.dense_grid(df, shuffled=shuffled), crossed(df))
    aligned = feed.calendar_align(df)
    held = crossed(df).withColumns({c: ROWS.last_known(c) for c in ("open", "high", "low", "close")}).withColumn("volume", F.coalesce("volume", F.lit(0.0))).drop("present")
    same(aligned, held)
    late = df.where("dt > '2024-02-20' AND code = 'c1'").unionByName(df.where("code = 'c2'"))
    same(feed.dense_grid(late), crossed(late))


def test_rows_without_a_time(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", 5, 2.0), ("b", 7, 3.0), ("b", 2005, 4.0)], "code string, dt int, x double")
    assert sorted((r["code"], r["dt"], r["present"]) for r in feed.dense_grid(df).collect()) == [(c, d, (c, d) in {("a", 5), ("b", 7), ("b", 2005)}) for c in "ab" for d in (5, 7, 2005)]
    ranks = {(r["code"], r["dt"]): r[calendars.RANK] for r in calendars.ranked(df, ROWS)[0].collect()}
    assert ranks == {("a", None): None, ("a", 5): 0, ("b", 7): 1, ("b", 2005): 2}


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    return plan.count("Scan parquet"), plan.count("Exchange hashpartitioning")


def test_plans_scan_once(spark):
    """Counted after a run, since shuffles are shared as stages then."""
    import __spark_entry__ as entry

    for name, most in {"noise_area": 1, "calendar_align": 1, "performance_table": 2, "backtest_report": 2, "underwater_long": 1, "long_series_sum": 1, "equity_curve_long": 1, "combine_signals": 1, "worst_periods": 1, "drawdown_points": 1, "trade_stats": 1}.items():
        df = entry.queries()[name](spark, SF)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert 1 <= final.count("Scan parquet") <= most, name
        assert "CartesianProduct" not in final and "NestedLoop" not in final, name


# --- merged sums --------------------------------------------------------------------------------


def test_performance_from_merged_sums(spark):
    rng = np.random.default_rng(2)
    tables = {}
    for s, n in (("B", 150), ("A", 200), ("C", 3), ("D", 1)):
        r = [None if rng.random() < 0.05 else float(x) for x in rng.normal(0.001, 0.02, n)]
        tables[s] = r if s != "D" else [None]
    df = returns_table(spark, tables["B"], "B")
    for s in "ACD":
        df = df.union(returns_table(spark, tables[s], s))
    df = df.union(returns_table(spark, [0.01] * 40, "E"))
    tables["E"] = [0.01] * 40
    got = {r["series"]: r for r in returns.performance_table(df, "B").collect()}
    for s, r in tables.items():
        x = np.array([v for v in r if v is not None])
        c = np.cumprod([1.0] + [1 + (v or 0) for v in r])
        assert close_to(got[s]["cum_return"], c[-1] - 1) and close_to(got[s]["max_drawdown"], float((c / np.maximum.accumulate(c) - 1).min()))
        assert close_to(got[s]["annual_return"], c[-1] ** (252 / len(r)) - 1)
        assert close_to(got[s]["annual_vol"], float(x.std(ddof=1) * 252**0.5) if len(x) > 1 else None, 1e-7)
        pairs = np.array([(a, b) for a, b in zip(r, tables["B"]) if a is not None and b is not None])
        if s not in "BD" and len(pairs) > 2:
            d = pairs[:, 0] - pairs[:, 1]
            assert close_to(got[s]["information_ratio"], float(d.mean() / d.std(ddof=1)))
            assert close_to(got[s]["beta"], float(np.cov(pairs.T, ddof=0)[0, 1] / pairs[:, 1].var()))
    assert got["E"]["sharpe"] is None and got["E"]["annual_vol"] == 0 and got["D"]["sharpe"] is None and got["B"]["beta"] is None


def test_constant_benchmark(spark):
    r = [0.01, -0.02, 0.03, None, 0.005]
    (got,) = returns.benchmark_metrics(returns_table(spark, r), 0.001).collect()
    x = np.array([v for v in r if v is not None]) - 0.001
    assert close_to(got["information_ratio"], float(x.mean() / x.std(ddof=1)))
    annual = np.prod([1 + (v or 0) for v in r]) ** (252 / 5) - 1
    assert close_to(got["excess_return"], float(annual - (1.001**252 - 1))) and "beta" not in got.asDict()


def test_report_counts_the_benchmark_days(spark):
    prices = spark.createDataFrame([(d, 100.0 + k) for k, d in enumerate(days(10))], "dt date, close double")
    df = returns_table(spark, [0.1, 0.2, -0.1]).union(spark.createDataFrame([("X", date(2030, 1, 1), 0.5)], "series string, dt date, ret double"))
    got = {r["series"]: r for r in returns.backtest_report(df, prices, "base").collect()}
    assert close_to(got["A"]["annual_return"], (1.1 * 1.2 * 0.9) ** (252 / 10) - 1) and got["X"]["cum_return"] == 0 and set(got) == {"A", "X", "base"}


# --- long series --------------------------------------------------------------------------------


def test_equity_in_buckets_equals_the_plain_one(spark):
    rng = np.random.default_rng(5)
    x = (100 * np.cumprod(1 + rng.normal(0, 0.02, 150))).tolist()
    df = panel(spark, x, "A").union(panel(spark, x[::-1], "B")).union(panel(spark, x[:3], "C")).withColumn("signal", ROWS.zscore("close", 5))
    plain = trades.equity_curve(trades.position(df))
    for bucket in (16, 7):
        cut = trades.long_equity_curve(df, bucket)
        same(cut.select(*plain.columns), plain)
    assert plain.where("side = 'sell'").count() > 5
    # events that repeat, that come at the edges of buckets and on every row
    for seed, enter, leave in ((1, 30, 60), (2, 5, 95), (3, 50, 50)):
        rng = random.Random(seed)
        draws = df.withColumn("code", F.concat("code", F.lit("x"))).withColumn("signal", F.element_at(F.array(*[F.lit(rng.randrange(100)) for _ in range(150)]), F.datediff("dt", F.lit("2024-01-01").cast("date")) + 1))
        plain = trades.equity_curve(trades.position(draws, F.col("signal") < enter, F.col("signal") >= leave))
        same(trades.long_equity_curve(draws, 8, conditions=lambda r: (F.col("signal") < enter, F.col("signal") >= leave), look_back=1).select(*plain.columns), plain)


def test_averages_in_buckets_equal_the_plain_ones(spark):
    x = [float(k * 7 % 23) for k in range(200)]
    df = panel(spark, x, "A").union(panel(spark, x[:120] + [None] + x[121:], "B")).union(panel(spark, x[:4], "C"))
    numbered = halo.global_sequence(df)
    for period, bucket in ((26, 16), (5, 1), (1, 16), (3, 300)):
        same(halo.long_ema(numbered, "close", period, bucket, "v").drop("seq"), momentum.ema(df, "close", period, "v"))
    with pytest.raises(ValueError):
        halo.long_ema(numbered, "close", 2, 1000)


def test_machines_in_buckets_equal_a_loop(spark):
    rng = random.Random(6)
    df = panel(spark, [float(rng.randrange(10)) for _ in range(120)], "A").union(panel(spark, [float(rng.randrange(10)) if k % 9 else None for k in range(100)], "B"))
    c = F.col("close")
    rules = {0: [(c > 7, 1), (c < 2, 2)], 1: [(c < 5, 0)], 2: [(c > 6, 3)], 3: [(c == 4, 1), (c == 5, 0)]}
    plain = {0: lambda v: 1 if v > 7 else 2 if v < 2 else 0, 1: lambda v: 0 if v < 5 else 1, 2: lambda v: 3 if v > 6 else 2, 3: lambda v: 1 if v == 4 else 0 if v == 5 else 3}
    for coarse in ("month", "week"):
        got = trades.multi_state(df, rules, 4, rows=ROWS, coarse=coarse)
        for code in "AB":
            state, want = 0, []
            for v in column(df.where(F.col("code") == code), "close"):
                state = state if v is None else plain[state](v)
                want.append(state)
            assert column(got.where(F.col("code") == code), "state") == want


def test_one_bucket_of_many_rows(spark, monkeypatch):
    """Levels of composed tables, in a bucket that has more rows than the two lower levels hold, and at each of their edges."""
    rng = random.Random(14)
    c = F.col("close")
    rules = {0: [(c > 7, 1), (c < 2, 2)], 1: [(c == 4, 0)], 2: [(c > 8, 0), (c == 3, 1)]}
    plain = {0: lambda v: 1 if v > 7 else 2 if v < 2 else 0, 1: lambda v: 0 if v == 4 else 1, 2: lambda v: 0 if v > 8 else 1 if v == 3 else 2}
    x = [float(rng.randrange(10)) for _ in range(3000)]
    df = panel(spark, x)
    want, state = [], 2
    for v in x:
        state = plain[state](v)
        want.append(state)
    assert column(trades.multi_state(df, rules, 3, 2, ROWS, coarse="century"), "state") == want
    monkeypatch.setattr(halo, "FAN", 4)
    assert column(trades.multi_state(df.limit(300), rules, 3, 2, ROWS, coarse="quarter"), "state") == want[:300]


def test_moments_of_blocks(spark):
    rng = random.Random(7)
    x = [None if rng.random() < 0.1 else rng.gauss(1e6, 1) for _ in range(90)]
    df = panel(spark, x, "A").union(panel(spark, [5.0] * 30, "B"))
    for n in (1, 2, 7, 40):
        got = blocks.trailing_moments(df, "close", "high", n, "m")
        got = got.select("code", "dt", blocks.mean_of("m", n).alias("mean"), blocks.std_of("m", n).alias("std"), F.when(F.col("m").isNotNull(), blocks.zscore_of(F.col("close"), "m")).alias("z"), blocks.correlation_of("m", n).alias("corr"), blocks.slope_of("m", n).alias("slope"))
        want = df.select("code", "dt", ROWS.mean("close", n).alias("mean"), ROWS.std("close", n).alias("std"), ROWS.zscore("close", n).alias("z"), ROWS.correlation("close", "high", n).alias("corr"), ROWS.slope("close", "high", n).alias("slope"))
        same(got, want, 1e-6)


def test_window_cost_does_not_grow(spark):
    df = spark.range(120_000).select((F.col("id") % 4).cast("string").alias("code"), F.col("id").alias("dt"), F.rand(1).alias("x")).persist()
    df.count()

    def took(n):
        begin = time.time()
        blocks.trailing_moments(df, "x", None, n, "m").write.format("noop").mode("overwrite").save()
        return time.time() - begin

    took(20)
    assert min(took(5000) for _ in range(3)) < 2.5 * min(took(20) for _ in range(3))
    df.unpersist()


def test_long_quantiles(spark):
    rng = random.Random(8)
    x = [None if rng.random() < 0.02 else float(rng.randrange(50)) for _ in range(300)]
    df = panel(spark, x, "A").union(panel(spark, x[::-1], "B"))
    for n, q, bucket in ((20, 0.3, 25), (7, 1.0, None), (1, 0.5, 4)):
        same(long_quantile(df, "close", n, q, "v", bucket=bucket), df.withColumn("v", ROWS.quantile("close", n, q)))
    walk = [rng.gauss(0, 1) for _ in range(3000)]
    got = rolling_quantiles(walk, 1000, 0.37)
    assert all(close_to(got[k], float(np.quantile(walk[k - 999 : k + 1], 0.37))) for k in range(999, 3000, 101))


def test_sorted_blocks_stay_small():
    held, rng = SortedBlocks(8), random.Random(9)
    kept = []
    for _ in range(2000):
        if kept and rng.random() < 0.45:
            held.remove(kept.pop(rng.randrange(len(kept))))
        else:
            kept.append(rng.randrange(50) / 2)
            held.add(kept[-1])
    assert [held.at(k) for k in range(len(kept))] == sorted(kept) and max(map(len, held.blocks)) <= 8


# --- joins on time ------------------------------------------------------------------------------


def test_contained_equals_a_filter(spark):
    rng = random.Random(10)
    day = lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(400))
    values = spark.createDataFrame([(rng.choice("abc"), day() if rng.random() > 0.05 else None, k) for k in range(300)], "k string, t date, v int")
    spans = spark.createDataFrame([(rng.choice("abcd"), (a := day()) if rng.random() > 0.1 else None, a + timedelta(days=rng.randrange(-5, 200)) if rng.random() > 0.1 else None, k) for k in range(60)], "k string, a date, b date, p int")
    want = sorted((v["v"], p["p"]) for v in values.collect() for p in spans.collect() if v["k"] == p["k"] and None not in (v["t"], p["a"], p["b"]) and p["a"] <= v["t"] <= p["b"])
    got = intervals.contained(values, spans, "t", "a", "b", ["k"], 30)
    assert sorted((r["v"], r["p"]) for r in got.collect()) == want and len(want) > 100
    assert got.columns == ["k", "t", "v", "a", "b", "p"]
    times = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, k), k) for k in range(10)], "t timestamp, v int")
    span = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 3), datetime(2024, 1, 1, 0, 0, 5))], "a timestamp, b timestamp")
    assert sorted(r["v"] for r in intervals.contained(times, span, "t", "a", "b", width=2_000_000).collect()) == [3, 4, 5]


def test_asof_over_empty_periods(spark):
    rng = random.Random(11)
    day = lambda: date(2020, 1, 1) + timedelta(days=rng.randrange(1500))
    left = [(rng.choice(["a", "b", None]), day() if rng.random() > 0.05 else None, k) for k in range(200)]
    right = [(rng.choice(["a", "b", None]), day() if rng.random() > 0.05 else None, rng.randrange(99)) for k in range(25)] + [("a", date(2021, 1, 1), 3), ("a", date(2021, 1, 1), 7)]
    a, b = spark.createDataFrame(left, "code string, dt date, k int"), spark.createDataFrame(right, "code string, dt date, x int")
    for tolerance in (None, 40):
        want = []
        for code, d, k in left:
            near = [(t, x) for c, t, x in right if c == code and None not in (d, t) and t <= d and (tolerance is None or (d - t).days <= tolerance)]
            want.append((k, *(max(near) if near else (None, None))))
        got = intervals.asof(a, b, tolerance=tolerance)
        assert sorted(((r["k"], r["dt_at"], r["x"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["code", "dt", "k", "dt_at", "x"] and intervals.asof(a.limit(0), b).count() == 0


# --- appended rows, bucketed tables, checks -----------------------------------------------------


def test_appended_rows_equal_the_whole_run(spark, tmp_path):
    rng = random.Random(12)
    x = [float(rng.randrange(100)) for _ in range(80)]
    df = panel(spark, x, "A").union(panel(spark, x[40:], "B", start=days(80)[40])).union(panel(spark, x[:20], "C"))
    folds = {"top": ("max", F.col("close")), "n": ("sum", F.lit(1))}
    operator = lambda b, r: b.withColumn("m", r.mean("close", 6)).withColumn("d", r.lag("close", 5))
    whole = operator(df, ROWS).withColumns({"top": F.max("close").over(ROWS.run), "n": F.sum(F.lit(1)).over(ROWS.run)})
    state, cuts = None, [date(2024, 1, 1), date(2024, 1, 4), date(2024, 2, 1), date(2024, 2, 15), date(2025, 1, 1)]
    parts = []
    for k, (begin, end) in enumerate(zip(cuts, cuts[1:])):
        new = df.where((F.col("dt") >= begin) & (F.col("dt") < end))
        found, state = append.append(state, new, operator, 6, ROWS, folds)
        found.write.parquet(f"{tmp_path}/out{k}")
        state.save(f"{tmp_path}/state{k}")
        state = append.load(spark, f"{tmp_path}/state{k}", folds=True)
        parts.append(f"{tmp_path}/out{k}")
        assert state.tail.groupBy("code").count().agg(F.max("count")).first()[0] <= 5
    same(spark.read.parquet(*parts).select(*whole.columns), whole)


def test_bucketed_bars_need_no_shuffle(spark, tmp_path):
    bars = Tables(spark, SF).bars
    spark.sql("DROP TABLE IF EXISTS bucketed_bars")
    feed.write_bucketed(bars, "bucketed_bars", 4)
    table = spark.table("bucketed_bars")
    found = qrs.qrs_signal(table, m=100)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    same(found.select("code", "dt", "signal"), qrs.qrs_signal(bars, m=100).select("code", "dt", "signal"), 1e-6)
    spark.sql("DROP TABLE bucketed_bars")


def test_checks_in_the_pass(spark):
    good = panel(spark, [1.0, 2.0, 3.0])
    df, checks = feed.checked(good)
    assert df.count() == 3
    checks.verify()
    assert checks.counts()["rows"] == 3
    bad = good.union(good.limit(1)).union(panel(spark, [4.0], None)).union(panel(spark, [float("inf")], "Z")).withColumn("high", F.when(F.col("close") == 2, 0.0).otherwise(F.col("high")))
    df, checks = feed.checked(bad)
    qrs.beta(df, 2).collect()
    with pytest.raises(ValueError, match="1 null keys, 1 repeated keys, 1 values not finite, 1 highs below lows"):
        checks.verify()
    with pytest.raises(ValueError, match="volume"):
        feed.checked(good.drop("volume"))
    with pytest.raises(ValueError, match="close is int, not double"):
        feed.checked(good.withColumn("close", F.col("close").cast("int")))
    assert isinstance(feed.BARS, T.StructType) and math.isfinite(1.0)


def test_signals_on_raw_closes(spark):
    """Changes of averages of prices with fractions, where sums round: compared away from exact ties."""
    rng = np.random.default_rng(13)
    x = 100 * np.cumprod(1 + rng.normal(0, 0.01, 300))
    df = panel(spark, x.tolist())
    steps = np.diff(np.convolve(x, np.ones(60) / 60, "valid"))
    want = {k + 60: s for k, s in enumerate(steps) if k >= 29 and abs(s) > 1e-9}
    got = column(momentum.ht_signal(df), "signal")
    assert len(got) == 300 - 89 and all(got[k - 89] == (s >= 0) for k, s in want.items())
    bands = {k: x[k - 3 : k + 1].mean() - x[k - 7 : k + 1].mean() for k in range(59, 300)}
    got = column(momentum.band_signal(df), "signal")
    assert len(got) == 241 and all(got[k - 59] == (v >= 0) for k, v in bands.items() if abs(v) > 1e-9)
