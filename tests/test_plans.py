"""Plans of the built-in operators: no Python, no global sort, filters and columns pushed to the scan."""

import pytest

from tidemark.catalog import OPS, Tables
from tidemark.sources import bars as feed

SF = "/root/testdata/sf0.001"
#: The hooks for user functions.
PYTHON = {"rolling_apply", "grouped_apply"}
#: Order statistics of long windows, as Arrow batches.
ARROW = {"rolling_quantile_long"}
#: A one-row list of series, or a table ordered for the reader.
SINGLE = {"backtest_report", "order_by_time_code", "last_row"}
#: One row a day of the calendar is put in order, or the benchmark's row is handed to the finished rows of the series.
DAYS = {"calendar_align", "dense_grid", "unpivot_bounds", "day_broadcast", "prev_at_time", "open_distance", "noise_sigma", "noise_bounds", "noise_area"}
FINISHED = {"performance_table", "benchmark_metrics", "metric_table"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("op", [o for o in OPS if o.name not in PYTHON | ARROW], ids=lambda o: o.name)
def test_no_python(spark, op):
    plan = plan_of(op.query(spark, SF))
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))
    if not any(x in plan for x in ("BroadcastNestedLoopJoin", "CartesianProduct")) and op.name not in SINGLE:
        if op.name in DAYS | FINISHED or op.name.endswith("_union"):
            heads = [line for line in plan.split("Initial Plan")[-1].split("\n") if "SinglePartition" in line]
            assert 1 <= len(heads) <= 4 and ("__day" in plan or op.name in FINISHED)
            return
        assert "SinglePartition" not in plan.split("Initial Plan")[-1]


def test_no_product_of_large_tables(spark):
    for op in OPS:
        assert "CartesianProduct" not in plan_of(op.query(spark, SF)), op.name


def test_scan_reads_what_is_asked(spark):
    df = feed.scan_range(Tables(spark, SF).raw("orders"), "1997-01-01", None, "o_orderdate").select("o_orderkey")
    plan = plan_of(df)
    assert "GreaterThanOrEqual(o_orderdate" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in plan and "o_totalprice" not in plan


def test_bars_of_one_order_column_hash(spark):
    t = Tables(spark, SF).raw("events")
    plan = plan_of(feed.ohlcv_bars(t, "event_type", "user_id", "value", "value", ["ts"]))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["ema", "macd", "macd_signal", "vmacd_mtm"])
def test_averages_take_one_scan_and_one_shuffle_beyond_the_bars(spark, name):
    (op,) = [o for o in OPS if o.name == name]
    plan = plan_of(op.query(spark, SF))
    tree = plan.split("\n\n")[0]
    assert "Join" not in plan and tree.count("Exchange hashpartitioning") <= 2


#: Scans and hash exchanges before adaptive changes; uses of one exchange are planned once each and run once.
LONG = {"equity_curve_long": (4, 17), "ema_long": (4, 15), "three_state_strategy": (2, 5), "underwater_long": (2, 8), "performance_table": (2, 6), "day_broadcast": (3, 9)}


@pytest.mark.parametrize("name", LONG)
def test_long_series_are_planned_with_few_scans(spark, name):
    (op,) = [o for o in OPS if o.name == name]
    plan = plan_of(op.query(spark, SF))
    assert plan.count("Scan parquet") <= LONG[name][0] and plan.count("Exchange hashpartitioning") <= LONG[name][1]
