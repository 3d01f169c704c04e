"""Tables behind charts; drawing them is left to a plotting tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.functions.scalars import rescale_from_min
from tidemark.operators.drawdown import drawdown_points, underwater
from tidemark.operators.returns import SERIES, compounded, metric_rows, monthly_histogram, monthly_matrix
from tidemark.operators.trades import by_status


def cumulative_vs_benchmark(returns: DataFrame, benchmark: str, rows: Rows = SERIES) -> DataFrame:
    """``cum`` of each series and ``benchmark_cum`` on its days, both starting at 0."""
    base = returns.where(F.col("series") == benchmark).select("dt", F.col("ret").alias("__base"))
    joined = returns.join(base, "dt", "left")
    return joined.select("series", "dt", rows.growth("ret").alias("cum"), rows.growth("__base").alias("benchmark_cum"))


def pos_neg_area(curves: DataFrame, x: str = "cum", other: str = "benchmark_cum") -> DataFrame:
    """``above`` and ``below``: the curve where it lies over (under) the other one, else the other one."""
    return curves.withColumns({
        "above": F.when(F.col(x) > F.col(other), F.col(x)).otherwise(F.col(other)), "below": F.when(F.col(x) < F.col(other), F.col(x)).otherwise(F.col(other))
    })


def underwater_chart(returns: DataFrame) -> DataFrame:
    return underwater(returns).select("series", "dt", "underwater")


def drawdown_zones(returns: DataFrame, top: int = 5) -> DataFrame:
    """Rectangles ``zone, x0, x1``: decline from peak to valley, recovery to the end, or active to the last day."""
    p = drawdown_points(returns, top)
    zone = lambda name, x0, x1: F.struct(F.lit(name).alias("zone"), F.col(x0).alias("x0"), F.col(x1).alias("x1"))
    zones = F.when(F.col("state") == "active", F.array(zone("active", "peak_date", "last_date"))).otherwise(
        F.array(zone("decline", "peak_date", "valley_date"), zone("recovery", "valley_date", "recovery_date"))
    )
    return p.select("series", "rank", F.inline(zones))


def annual_bars(returns: DataFrame) -> DataFrame:
    """Yearly returns with a colour by sign and the mean of the series' years."""
    from pyspark.sql import Window

    y = compounded(returns, ("year",))
    return y.withColumns({"colour": F.when(F.col("ret") < 0, "green").otherwise("red"), "mean": F.avg("ret").over(Window.partitionBy("series"))})


def monthly_heatmap(returns: DataFrame) -> DataFrame:
    return monthly_matrix(returns)


def monthly_distribution(returns: DataFrame, width: float = 0.01) -> DataFrame:
    """monthly_histogram with the mean monthly return of the series."""
    mean = compounded(returns, ("year", "month")).groupBy("series").agg(F.avg("ret").alias("mean"))
    return monthly_histogram(returns, width).join(mean, "series")


def order_markers(trades: DataFrame) -> DataFrame:
    """``kind`` (buy, sell, active), day and price of every end of a trade."""
    mark = lambda kind, dt, price: F.struct(kind.alias("kind"), F.col(dt).alias("dt"), F.col(price).alias("price"))
    out = F.when(F.col("status") == 2, "sell").otherwise("active")
    return trades.select("ticker", "ref", F.inline(F.array(mark(F.lit("buy"), "datein", "pricein"), mark(out, "dateout", "priceout"))))


def position_zones(trades: DataFrame) -> DataFrame:
    """Rectangles from entry to exit with their bucket and zone (profit or loss)."""
    return by_status(trades).select(
        "ticker", "ref", "bucket", F.when(F.col("pnl") >= 0, "profit").otherwise("loss").alias("zone"),
        F.col("datein").alias("x0"), F.col("pricein").alias("y0"), F.col("dateout").alias("x1"), F.col("priceout").alias("y1"),
    )


def pnl_bubbles(trades: DataFrame, sizes: tuple[float, float] = (7, 14), opacities: tuple[float, float] = (0.75, 0.9)) -> DataFrame:
    """Exit day and profit with marker size and opacity growing with the absolute percentage, per ticker."""
    from pyspark.sql import Window

    all_ = Window.partitionBy("ticker")
    x = F.abs("pnl_pct")
    scaled = lambda to: rescale_from_min(x, F.min(x).over(all_), F.max(x).over(all_), *to)
    kind = F.when(F.col("status") == 1, "Open").when(F.col("pnl") > 0, "Closed - Profit").otherwise("Closed - Loss")
    return trades.select("ticker", "ref", "dateout", "pnl", "pnl_pct", kind.alias("kind"), scaled(sizes).alias("size"), scaled(opacities).alias("opacity"))


def metric_table(table: DataFrame) -> DataFrame:
    return metric_rows(table)
