import random
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import close_to, column, panel, returns_table
from tidemark.functions.scalars import business_days, larger, rescale_from_max, rescale_from_min
from tidemark.operators import charts, drawdown, returns, trades


def test_initial_loss_counts_for_max_drawdown_only(spark):
    r = returns_table(spark, [-0.5, 0.1, 0.2])
    assert close_to(returns.max_drawdowns(r).first()["max_drawdown"], -0.5)
    assert set(column(drawdown.underwater(r), "underwater")) == {0.0}


def test_rising_series_has_no_drawdown(spark):
    r = returns_table(spark, [0.1, 0.2, 0.1])
    assert drawdown.drawdown_table(r).count() == 0
    row = returns.performance_table(r).first()
    assert row["calmar"] is None and row["sortino"] is None and row["max_drawdown"] == 0


def _worst_by_cutting(ret, top):
    """Find the worst fall, cut it out, repeat."""
    cum = (1 + pd.Series(ret).fillna(0)).cumprod()
    under = cum / np.maximum.accumulate(cum) - 1
    found = []
    for _ in range(top):
        if not len(under) or under.min() == 0:
            break
        valley = under.idxmin()
        peak = under.loc[:valley][under.loc[:valley] == 0].index[-1]
        after = under.loc[valley:][under.loc[valley:] == 0].index
        recovery = after[0] if len(after) else None
        found.append((peak, valley, recovery))
        under = under.drop(under.loc[peak:recovery].index[1:-1] if recovery is not None else under.index[under.index > peak])
    return found


def test_top_drawdowns_equal_cutting(spark):
    for seed in range(3):
        random.seed(seed)
        values = [round(random.gauss(0, 0.02), 4) for _ in range(150)]
        r = returns_table(spark, values)
        days = {d: k for k, d in enumerate(column(r, "dt"))}
        got = [(days[x["peak_date"]], days[x["valley_date"]], days.get(x["recovery_date"])) for x in drawdown.top_drawdowns(r, 4).orderBy("rank").collect()]
        assert got == _worst_by_cutting(values, 4)


def test_unrecovered_drawdown_is_active(spark):
    r = returns_table(spark, [0.0, 0.1, -0.2, 0.05])
    row = drawdown.drawdown_points(r).first()
    assert row["state"] == "active" and row["recovery_date"] is None and row["active_duration"] == 3  # Tue to Thu
    assert drawdown.worst_periods(r, "A").first()["series_return"] is None
    assert [z["zone"] for z in charts.drawdown_zones(r).collect()] == ["active"]


def test_equal_depths_go_by_valley(spark):
    r = returns_table(spark, [0.0, -0.5, 1.0, -0.5, 1.0])
    valleys = [x["valley_date"] for x in drawdown.top_drawdowns(r).orderBy("rank").collect()]
    assert valleys == sorted(valleys) and len(valleys) == 2


def test_business_days_match_pandas(spark):
    pairs = [(date(2024, 1, 1 + a), date(2024, 1, 1 + b)) for a in range(9) for b in range(a, 20)]
    df = spark.createDataFrame(pairs, "a date, b date").withColumn("n", business_days("a", "b"))
    assert all(r["n"] == len(pd.bdate_range(r["a"], r["b"])) for r in df.collect())


def test_benchmark_metrics(spark):
    rng = np.random.default_rng(5)
    b = rng.normal(0, 0.01, 60)
    r = 2 * b + 0.001
    table = returns_table(spark, r.tolist()).union(returns_table(spark, b.tolist(), "base"))
    rows = {x["series"]: x for x in returns.performance_table(table, "base").collect()}
    assert close_to(rows["A"]["beta"], 2.0, 1e-8) and close_to(rows["A"]["alpha"], 1.001**252 - 1, 1e-6)
    assert rows["base"]["beta"] is None and rows["base"]["excess_return"] == 0
    single = returns_table(spark, [0.1]).union(returns_table(spark, [0.2], "base"))
    assert returns.benchmark_metrics(single, "base").where("series = 'A'").first()["information_ratio"] is None


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, None), (0.0, 5.0), (4.0, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(larger("x", "y")).collect()] == [None, 5.0, 4.0]
    low, high = F.lit(0.0), F.lit(4.0)
    assert [r[0] for r in df.select(rescale_from_min(F.col("x"), low, high, 7, 14)).collect()] == [8.75, 7.0, 14.0]
    same = df.select(rescale_from_min(F.col("x"), F.lit(1.0), F.lit(1.0), 7, 14), rescale_from_max(F.col("x"), F.lit(1.0), F.lit(1.0), 7, 14)).first()
    assert tuple(same) == (7.0, 14.0)
    half = df.select(rescale_from_max(F.lit(2.0), F.lit(2.0), F.lit(3.0), 7, 14)).first()[0]
    assert close_to(half, 14 / 1.5)


def _walk(opens, closes, highs, lows, positions, a):
    """Cash and units, bar by bar."""
    cash, units, equity, last_fill = a.cash, 0.0, [], None
    for t in range(len(opens)):
        before = positions[t - 1] if t else 0
        earlier = positions[t - 2] if t > 1 else 0
        if before > earlier:
            price = min(opens[t] * (1 + a.slippage), highs[t])
            units = a.share * cash / closes[t - 1]
            cash -= units * price * (1 + a.commission)
        elif before < earlier:
            price = max(opens[t] * (1 - a.slippage), lows[t])
            cash += units * price * (1 - a.commission - a.duty)
            units = 0.0
        equity.append(cash + units * closes[t])
    return equity


def test_equity_equals_a_cash_walk(spark):
    random.seed(9)
    closes = [100.0]
    for _ in range(80):
        closes.append(round(closes[-1] * random.uniform(0.97, 1.03), 2))
    bars = panel(spark, closes).withColumn("signal", F.sin(F.dayofyear("dt") / 4.0))
    placed = trades.position(bars)
    rows = trades.equity_curve(placed).orderBy("dt").collect()
    want = _walk(closes, closes, [c + 1 for c in closes], [c - 1 for c in closes], [r["position"] for r in rows], trades.Account())
    assert all(close_to(r["equity"], w, 1e-9) for r, w in zip(rows, want))
    listed = trades.trade_list(placed).orderBy("ref").collect()
    assert len(listed) >= 3 and close_to(sum(t["pnl"] for t in listed), want[-1] - 1e9, 1e-6)
    closed = [t for t in listed if t["status"] == 2]
    assert all(close_to(t["chng_pct"], 100 * t["priceout"] / t["pricein"] - 100, 1e-2) and close_to(t["value"], t["size"] * t["pricein"]) for t in closed)


def test_open_trade_and_odd_fill(spark):
    bars = panel(spark, [10.0, 11.0, 12.0, 13.0, 14.0])
    placed = trades.position(bars, F.col("close") >= 11, F.lit(False))
    (trade,) = trades.trade_list(placed).collect()
    assert trade["status"] == 1 and trade["nbars"] is None and trade["mfe_pct"] is None and trade["priceout"] == 14.0
    (pair,) = trades.pair_fills(trades.fills(placed)).collect()
    assert pair["dateout"] is None and pair["pricein"] is not None
    stats = trades.trade_stats(trades.trade_list(placed)).first()
    assert stats["profit_factor"] is None and stats["open"] == 1 and stats["longest_win"] == 0


def test_signal_on_the_last_bar_does_not_fill(spark):
    bars = panel(spark, [10.0, 9.0, 12.0])
    assert trades.fills(trades.position(bars, F.col("close") > 11, F.lit(False))).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_short_tables(spark, n):
    r = returns_table(spark, [0.1] * n)
    assert returns.performance_table(r).count() == n
    assert returns.monthly_matrix(r).count() == n and drawdown.drawdown_table(r).count() == 0
