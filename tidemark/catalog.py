"""Every operator as a query over the test tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import frames, quantiles, scalars
from tidemark.functions.frames import Rows
from tidemark.operators import alligator, charts, drawdown, momentum, noise, qrs, returns, trades
from tidemark.plans import append, blocks, halo, intervals
from tidemark.sources import bars as feed
from tidemark.streaming.bars import stream_bars

ROWS, HOURS, FLOW = Rows(), Rows(("code",), "trade_time"), Rows(("series",), "dt")
OPEN_TIME, CLOSE_TIME = "09:00:00", "15:00:00"
BENCHMARK = "NO"


class Tables:
    """Fixture tables derived from the parquet files of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def bars(self) -> DataFrame:
        return feed.ohlcv_bars(
            self.raw("lineitem"), F.concat("l_returnflag", "l_linestatus"), F.to_date("l_shipdate"), "l_extendedprice", "l_quantity",
            ["l_orderkey", "l_linenumber", "l_extendedprice"],
        )

    @property
    def cents(self) -> DataFrame:
        """Daily bars in whole cents: sums are exact, so comparisons of averages do not hang on rounding noise."""
        return self.bars.withColumns({c: F.round(F.col(c) * 100) for c in ("open", "high", "low", "close")})

    @property
    def hourly(self) -> DataFrame:
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        return feed.ohlcv_bars(self.raw("events"), "event_type", hour, "value", F.lit(1), ["ts", "event_id", "value"], "trade_time")

    @property
    def flow(self) -> DataFrame:
        money = F.when(F.col("o_orderstatus") == "O", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
        return self.raw("orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("dt")).agg(F.sum(money).alias("north_money"))

    def daily(self, table: str, code: str, time: str, value: Column) -> DataFrame:
        """``code, dt`` and an aggregate of one of the tables."""
        return self.raw(table).groupBy(F.col(code).alias("code"), F.to_date(time).alias("dt")).agg(value)

    @property
    def shipped(self) -> DataFrame:
        return self.daily("lineitem", "l_linestatus", "l_shipdate", F.sum("l_quantity").alias("shipped"))

    @property
    def ordered(self) -> DataFrame:
        return self.daily("orders", "o_orderstatus", "o_orderdate", F.count("*").alias("ordered"))

    @property
    def flagged(self) -> DataFrame:
        return self.daily("lineitem", "l_returnflag", "l_shipdate", F.count("*").alias("flagged"))

    @property
    def returns(self) -> DataFrame:
        return returns.returns_of(self.bars)

    @property
    def signals(self) -> DataFrame:
        return self.bars.select("code", "dt", ROWS.zscore("close", 20).alias("signal"))

    @property
    def positions(self) -> DataFrame:
        return trades.position(self.bars.withColumn("signal", ROWS.zscore("close", 20)))

    @property
    def trades(self) -> DataFrame:
        return trades.trade_list(self.positions)

    @property
    def fills(self) -> DataFrame:
        return trades.fills(self.positions)


# --- SQL of the fixture tables ------------------------------------------------------------------

BARS = """bars AS (SELECT l_returnflag || l_linestatus AS code, CAST(l_shipdate AS DATE) AS dt,
  first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS open, max(l_extendedprice) AS high,
  min(l_extendedprice) AS low, last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS close,
  CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2)"""
CENTS = [BARS.replace("bars AS", "raw_bars AS", 1), "bars AS (SELECT code, dt, " + ", ".join(f"round({c} * 100) AS {c}" for c in ("open", "high", "low", "close")) + ", volume FROM raw_bars)"]
HOURLY = """hourly AS (SELECT event_type AS code, date_trunc('hour', ts) AS trade_time, first(value ORDER BY ts, event_id, value) AS open,
  max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id, value) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""
FLOWS = """flow AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS dt,
  sum(CASE WHEN o_orderstatus = 'O' THEN -o_totalprice ELSE o_totalprice END) AS north_money FROM orders GROUP BY 1, 2)"""
PANELS = [
    "shipped AS (SELECT l_linestatus AS code, CAST(l_shipdate AS DATE) AS dt, sum(l_quantity) AS shipped FROM lineitem GROUP BY 1, 2)",
    "ordered AS (SELECT o_orderstatus AS code, CAST(o_orderdate AS DATE) AS dt, count(*) AS ordered FROM orders GROUP BY 1, 2)",
    "flagged AS (SELECT l_returnflag AS code, CAST(l_shipdate AS DATE) AS dt, count(*) AS flagged FROM lineitem GROUP BY 1, 2)",
]
RETURNS = "returns AS (SELECT code AS series, dt, close / lag(close) OVER (PARTITION BY code ORDER BY dt) - 1 AS ret FROM bars)"


def w(n: int, key: str = "code", order: str = "dt") -> str:
    return f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def run(key: str = "code", order: str = "dt") -> str:
    return f"(PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"


def o(key: str = "code", order: str = "dt") -> str:
    return f"(PARTITION BY {key} ORDER BY {order})"


def full(x: str, n: int, value: str, key: str = "code", order: str = "dt") -> str:
    return f"CASE WHEN count({x}) OVER {w(n, key, order)} = {n} THEN {value} OVER {w(n, key, order)} END"


def held(x: str, key: str = "code", order: str = "dt") -> str:
    return f"coalesce(last_value({x} IGNORE NULLS) OVER {run(key, order)}, 0)"


GRID = """grid AS (SELECT c.code, d.dt, b.open, b.high, b.low, b.close, b.volume, b.code IS NOT NULL AS present
  FROM (SELECT DISTINCT code FROM bars) c CROSS JOIN (SELECT DISTINCT dt FROM bars) d LEFT JOIN bars b ON b.code = c.code AND b.dt = d.dt)"""
QRS = [
    BARS,
    f"""fit AS (SELECT *, row_number() OVER {o()} - 1 AS rn,
      CASE WHEN count(*) OVER {w(18)} = 18 THEN covar_pop(high, low) OVER {w(18)} / nullif(var_pop(low) OVER {w(18)}, 0) END AS beta,
      CASE WHEN count(*) OVER {w(18)} = 18 THEN covar_pop(high, low) OVER {w(18)} / nullif(stddev_pop(low) OVER {w(18)} * stddev_pop(high) OVER {w(18)}, 0) END AS rho,
      CASE WHEN count(*) OVER {w(18)} = 18 THEN stddev_pop(high) OVER {w(18)} / nullif(stddev_pop(low) OVER {w(18)}, 0) END AS sigma_ratio FROM bars)""",
    f"""reg AS (SELECT *, rho * rho AS regulation, {full("rho", 18, "avg(rho * rho)")} AS regulation_mean FROM fit)""",
    f"""z AS (SELECT *, CASE WHEN count(*) OVER {w(600)} = 600 THEN (beta - avg(beta) OVER {w(600)}) / nullif(stddev_pop(beta) OVER {w(600)}, 0) END AS zscore,
      CASE WHEN count(*) OVER {w(600)} = 600 THEN (sigma_ratio - avg(sigma_ratio) OVER {w(600)}) / nullif(stddev_pop(sigma_ratio) OVER {w(600)}, 0) END AS simple_z
      FROM reg WHERE rn >= 17)""",
]
ALLIGATOR = [
    *CENTS,
    f"""ma AS (SELECT *, {full("close", 13, "avg(close)")} AS m13, {full("close", 8, "avg(close)")} AS m8, {full("close", 5, "avg(close)")} AS m5 FROM bars)""",
    f"""lines AS (SELECT *, lag(m13, 8) OVER {o()} AS jaw, lag(m8, 5) OVER {o()} AS teeth, lag(m5, 3) OVER {o()} AS lips FROM ma)""",
    "cond AS (SELECT *, coalesce(teeth > jaw AND lips > teeth, false) AS up, coalesce(teeth < jaw AND lips < teeth, false) AS down FROM lines)",
    f"""trig AS (SELECT *, up AND NOT coalesce(lag(up) OVER {o()}, true) AS bull, down AND NOT coalesce(lag(down) OVER {o()}, true) AS bear FROM cond)""",
    f"""asig AS (SELECT code, dt, CASE WHEN bull THEN 1 WHEN bear THEN -1 END AS event FROM trig)""",
]
AO = [
    f"""aos AS (SELECT *, {full("high - low", 5, "avg((high - low) / 2)")} - ({full("high - low", 34, "avg((high - low) / 2)")}) AS ao FROM bars)""",
    f"steps AS (SELECT *, ao - lag(ao) OVER {o()} AS step FROM aos)",
    f"""aoe AS (SELECT code, dt, CASE WHEN count(ao) OVER {w(3)} = 3 THEN CASE WHEN min(step) OVER {w(2)} > 0 THEN 1 WHEN max(step) OVER {w(2)} < 0 THEN -1 END END AS event FROM steps)""",
]
FRACTAL = [
    f"""shift AS (SELECT *, lag(high) OVER {o()} AS h1, lag(high, 2) OVER {o()} AS h2, lag(low) OVER {o()} AS l1, lag(low, 2) OVER {o()} AS l2,
      lag(close, 3) OVER {o()} AS c3, row_number() OVER {o()} - 1 AS rn FROM bars)""",
    """fr AS (SELECT *, CASE WHEN h2 < h1 AND h1 > high AND l2 < l1 AND l1 > low THEN 1 ELSE 0 END AS top,
      CASE WHEN h2 > h1 AND h1 < high AND l2 > l1 AND l1 < low THEN -1 ELSE 0 END AS bottom FROM shift WHERE rn >= 2)""",
    f"""fsig AS (SELECT code, dt, CASE WHEN close > c3 AND lag(top + bottom) OVER {o()} = 1 THEN 1 WHEN close < c3 AND lag(top + bottom) OVER {o()} = -1 THEN -1 ELSE 0 END AS signal FROM fr)""",
]


def _on_grid(ctes: Sequence[str]) -> list[str]:
    """The same steps over every code at every time."""
    return [c.replace("FROM bars", "FROM grid") for c in ctes]


def macd_ctes(x: str) -> list[str]:
    a, b, c = 2 / 13, 2 / 27, 2 / 10
    return [
        f"s AS (SELECT code, dt, {x} AS x, row_number() OVER {o()} - 1 AS rn, avg({x}) OVER {w(12)} AS s12, avg({x}) OVER {w(26)} AS s26 FROM bars)",
        f"""e AS (SELECT code, rn, s12 AS f, s26 AS g FROM s WHERE rn = 25 UNION ALL
          SELECT s.code, s.rn, {a!r} * s.x + (1 - {a!r}) * e.f, {b!r} * s.x + (1 - {b!r}) * e.g FROM e JOIN s ON s.code = e.code AND s.rn = e.rn + 1)""",
        f"d AS (SELECT code, rn, f - g AS dif, avg(f - g) OVER {w(9, 'code', 'rn')} AS s9 FROM e)",
        f"""h AS (SELECT code, rn, dif, s9 AS dea FROM d WHERE rn = 33 UNION ALL
          SELECT d.code, d.rn, d.dif, {c!r} * d.dif + (1 - {c!r}) * h.dea FROM h JOIN d ON d.code = h.code AND d.rn = h.rn + 1)""",
        "m AS (SELECT s.code, s.dt, s.rn, h.dif, h.dea, h.dif - h.dea AS hist FROM s LEFT JOIN h ON s.code = h.code AND s.rn = h.rn)",
    ]


MACD_EVENT = f"""ev AS (SELECT code, dt, CASE
    WHEN dif > dea AND lag(dif) OVER {o()} <= lag(dea) OVER {o()} AND hist > 0 AND lag(hist) OVER {o()} <= 0 AND dif >= 0 AND dea >= 0 THEN 1
    WHEN dif < dea AND lag(dif) OVER {o()} >= lag(dea) OVER {o()} AND hist < 0 AND lag(hist) OVER {o()} >= 0 AND dif < 0 AND dea < 0 THEN -1
    ELSE 0 END AS event FROM m)"""
NOISE = [
    HOURLY,
    """ngrid AS (SELECT c.code, t.trade_time, h.open, h.close, h.volume, h.code IS NOT NULL AS present, CAST(t.trade_time AS DATE) AS day,
      strftime(t.trade_time, '%H:%M:%S') AS tod FROM (SELECT DISTINCT code FROM hourly) c CROSS JOIN (SELECT DISTINCT trade_time FROM hourly) t
      LEFT JOIN hourly h ON h.code = c.code AND h.trade_time = t.trade_time)""",
    f"""opened AS (SELECT *, last_value(CASE WHEN tod = '{OPEN_TIME}' THEN open END IGNORE NULLS) OVER {run("code", "trade_time")} AS day_open,
      sum(close * volume) OVER {run("code, day", "trade_time")} / nullif(sum(volume) OVER {run("code, day", "trade_time")}, 0) AS vwap FROM ngrid)""",
    "dist AS (SELECT *, abs(close / nullif(day_open, 0) - 1) AS distance FROM opened)",
    f"""sig AS (SELECT *, {full("distance", 14, "avg(distance)", "code, tod", "trade_time")} AS sigma FROM dist)""",
    f"""closes AS (SELECT code, day, lag(close) OVER {o("code", "day")} AS prev_close FROM ngrid WHERE tod = '{CLOSE_TIME}')""",
    f"opens AS (SELECT code, day, open AS today_open FROM ngrid WHERE tod = '{OPEN_TIME}')",
    f"ends AS (SELECT code, day, close AS prev_close FROM ngrid WHERE tod = '{CLOSE_TIME}')",
    """levels AS (SELECT s.*, o.today_open, c.prev_close FROM sig s LEFT JOIN opens o ON o.code = s.code AND o.day = s.day
      ASOF LEFT JOIN ends c ON c.code = s.code AND c.day < s.day WHERE s.present)""",
]
DRAWDOWN = [
    BARS, RETURNS,
    f"grown AS (SELECT *, product(1 + coalesce(ret, 0)) OVER {run('series')} AS cum FROM returns)",
    f"uw AS (SELECT *, cum / max(cum) OVER {run('series')} - 1 AS underwater FROM grown)",
    f"ids AS (SELECT *, sum(CASE WHEN underwater = 0 THEN 1 ELSE 0 END) OVER {run('series')} AS id FROM uw)",
    """falls AS (SELECT series, id, min(dt) AS peak_date, first(dt ORDER BY underwater, dt) AS valley_date, min(underwater) AS depth,
      first(cum ORDER BY dt) AS peak_cum, first(cum ORDER BY underwater, dt) AS valley_cum FROM ids GROUP BY series, id)""",
    "eps AS (SELECT *, lead(peak_date) OVER (PARTITION BY series ORDER BY id) AS recovery_date FROM falls)",
    "top AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY depth, valley_date) AS rank FROM eps WHERE depth < 0 QUALIFY rank <= 5)",
]


def weekdays(a: str, b: str) -> str:
    n = lambda d: f"(5 * ((({d}) - DATE '1969-12-29') // 7) + least((({d}) - DATE '1969-12-29') % 7, 5))"
    return f"({n(f'{b} + 1')} - {n(a)})".replace(f"{b} + 1", f"CAST({b} + INTERVAL 1 DAY AS DATE)")


TRADES = [
    BARS,
    f"sg AS (SELECT *, CASE WHEN count(*) OVER {w(20)} = 20 THEN (close - avg(close) OVER {w(20)}) / nullif(stddev_pop(close) OVER {w(20)}, 0) END AS signal FROM bars)",
    f"""evt AS (SELECT *, CASE WHEN signal >= 0.301 AND lag(signal) OVER {o()} >= 0.301 THEN 1 WHEN signal <= -0.301 AND lag(signal) OVER {o()} <= -0.301 THEN 0 END AS event FROM sg)""",
    f"pos AS (SELECT *, {held('event')} AS position FROM evt)",
    f"chg AS (SELECT *, lag(position) OVER {o()} - coalesce(lag(position, 2) OVER {o()}, 0) AS change, lag(close) OVER {o()} AS c1 FROM pos)",
    """fl AS (SELECT *, CASE WHEN change > 0 THEN 'buy' WHEN change < 0 THEN 'sell' END AS side,
      CASE WHEN change > 0 THEN least(open * 1.0001, high) WHEN change < 0 THEN greatest(open * 0.9999, low) END AS fill_price FROM chg)""",
    f"""eq1 AS (SELECT *, count(CASE WHEN side = 'buy' THEN 1 END) OVER {run()} AS trade_id,
      last_value(CASE WHEN side = 'buy' THEN fill_price END IGNORE NULLS) OVER {run()} AS entry_price,
      last_value(CASE WHEN side = 'buy' THEN c1 END IGNORE NULLS) OVER {run()} AS base, last_value(side IGNORE NULLS) OVER {run()} AS last_side FROM fl)""",
    "eq2 AS (SELECT *, CASE WHEN side = 'sell' THEN 1 + 0.95 / base * (fill_price * 0.9988 - entry_price * 1.0002) END AS factor FROM eq1)",
    f"""eq3 AS (SELECT *, 1e9 * product(coalesce(factor, 1)) OVER {run()} AS closed,
      1e9 * coalesce(product(coalesce(factor, 1)) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS start FROM eq2)""",
    f"""eq AS (SELECT *, last_value(CASE WHEN side = 'buy' THEN start END IGNORE NULLS) OVER {run()} AS entry_equity,
      CASE WHEN last_side = 'buy' THEN closed * (1 + 0.95 / base * (close - entry_price * 1.0002)) ELSE closed END AS equity FROM eq3)""",
    """tl0 AS (SELECT code, trade_id, min(dt) AS datein, max(dt) AS dateout, max(entry_price) AS pricein, max(CASE WHEN side = 'sell' THEN fill_price END) AS out,
      max_by(close, dt) AS lastclose, max(0.95 * entry_equity / base) AS size, max_by(equity, dt) AS after, max(entry_equity) AS before, count(*) - 1 AS bars,
      max(high) AS high, min(low) AS low FROM eq WHERE trade_id > 0 AND (last_side = 'buy' OR side = 'sell') GROUP BY 1, 2)""",
    """tl AS (SELECT CASE WHEN out IS NULL THEN 1 ELSE 2 END AS status, trade_id AS ref, code AS ticker, 'long' AS dir, datein, pricein, dateout,
      coalesce(out, lastclose) AS priceout, round_even(100 * coalesce(out, lastclose) / pricein - 100, 2) AS chng_pct, after - before AS pnl, round_even(100 * (after - before) / after, 2) AS pnl_pct,
      size, size * pricein AS value, sum(after - before) OVER (PARTITION BY code ORDER BY trade_id) AS cumpnl, CASE WHEN out IS NOT NULL THEN bars END AS nbars,
      CASE WHEN out IS NOT NULL THEN round_even((after - before) / nullif(bars, 0), 2) END AS pnl_per_bar,
      CASE WHEN out IS NOT NULL THEN round_even(100 * (high - pricein) / pricein, 2) END AS mfe_pct, CASE WHEN out IS NOT NULL THEN round_even(100 * (low - pricein) / pricein, 2) END AS mae_pct FROM tl0)""",
]
METRICS = """perf0 AS (SELECT series, pow(product(1 + coalesce(ret, 0)), 252.0 / count(*)) - 1 AS annual_return, product(1 + coalesce(ret, 0)) - 1 AS cum_return,
    stddev_samp(ret) * sqrt(252) AS annual_vol, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe,
    avg(ret) * 252 / nullif(sqrt(avg(CASE WHEN ret IS NOT NULL THEN least(ret, 0) ^ 2 END)) * sqrt(252), 0) AS sortino FROM returns GROUP BY series)"""
MAXDD = [
    f"cums AS (SELECT series, dt, product(1 + coalesce(ret, 0)) OVER {run('series')} AS cum FROM returns)",
    f"mdd AS (SELECT series, least(0, min(f)) AS max_drawdown FROM (SELECT series, cum / greatest(1, max(cum) OVER {run('series')}) - 1 AS f FROM cums) GROUP BY series)",
]
RELATIVE = f"""rel AS (SELECT r.series, CASE WHEN count(r.ret - b.ret) >= 2 THEN avg(r.ret - b.ret) / nullif(stddev_samp(r.ret - b.ret), 0) END AS ir,
    covar_pop(r.ret, b.ret) / nullif(var_pop(b.ret) FILTER (r.ret IS NOT NULL), 0) AS beta, avg(r.ret) FILTER (b.ret IS NOT NULL) AS mr, avg(b.ret) FILTER (r.ret IS NOT NULL) AS mb
    FROM returns r JOIN returns b ON b.dt = r.dt AND b.series = '{BENCHMARK}' GROUP BY r.series)"""
YEARLY = "yr AS (SELECT series, year(dt) AS year, product(1 + coalesce(ret, 0)) - 1 AS ret FROM returns GROUP BY 1, 2)"
MONTHLY = "mo AS (SELECT series, year(dt) AS year, month(dt) AS month, product(1 + coalesce(ret, 0)) - 1 AS ret FROM returns GROUP BY 1, 2, 3)"


#: Columns of a performance table with a benchmark.
TABLE = "series annual_return:6 cum_return:6 annual_vol:6 sharpe:6 max_drawdown:6 sortino:6 calmar:6 information_ratio:6 alpha:5 beta:6 excess_return:6"


def performance(benchmark: str) -> str:
    return (
        f"SELECT p.*, m.max_drawdown, CASE WHEN m.max_drawdown < 0 THEN p.annual_return / abs(m.max_drawdown) END AS calmar, CASE WHEN p.series <> '{benchmark}' THEN r.ir END AS information_ratio, "
        f"CASE WHEN p.series <> '{benchmark}' THEN pow(1 + r.mr - r.beta * r.mb, 252) - 1 END AS alpha, CASE WHEN p.series <> '{benchmark}' THEN r.beta END AS beta, "
        f"p.annual_return - (SELECT annual_return FROM perf0 WHERE series = '{benchmark}') AS excess_return FROM perf0 p JOIN mdd m ON p.series = m.series LEFT JOIN rel r ON p.series = r.series"
    )


@dataclass(frozen=True)
class Op:
    """A query: ``out`` lists its columns, ``name:6`` rounded to six digits, ``name:i`` as a long."""

    name: str
    out: str
    spark: Callable[[Tables], DataFrame]
    sql: str | None = None
    ctes: Sequence[str] = field(default_factory=lambda: [BARS])

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.spark(Tables(spark, sf_dir)).select(*[_column(c) for c in self.out.split()])

    def oracle(self) -> str:
        columns = ", ".join(_sql_column(c) for c in self.out.split())
        return f"WITH RECURSIVE {', '.join([*self.ctes, f'q AS ({self.sql})'])} SELECT {columns} FROM q"


def _column(spec: str) -> Column:
    name, _, kind = spec.partition(":")
    if not kind:
        return F.col(name)
    return (F.col(name).cast("long") if kind == "i" else F.round(F.col(name) + _nudge(kind), int(kind)) + 0.0).alias(name)


def _sql_column(spec: str) -> str:
    name, _, kind = spec.partition(":")
    return name if not kind else f"CAST({name} AS BIGINT) AS {name}" if kind == "i" else f"round({name} + {_nudge(kind)!r}, {kind}) + 0.0 AS {name}"


def _nudge(digits: str) -> float:
    """Moves exact ties, which the engines round by noise, off the edge."""
    return 10.0 ** -(int(digits) + 3)


def _summary(group):
    """A user's function for grouped_apply."""
    return group.groupby("code", as_index=False).agg(n=("close", "size"), top=("close", "max"))


def _appended(df: DataFrame, cuts: Sequence[str]) -> DataFrame:
    """A z-score, running maximum and running sum of bars that come in one part after the other."""
    state, results = None, []
    for begin, end in zip([None, *cuts], [*cuts, None]):
        new = df if begin is None else df.where(F.col("dt") >= begin)
        new = new if end is None else new.where(F.col("dt") < end)
        folds = {"top": ("max", F.col("close")), "total": ("sum", F.col("volume"))}
        found, state = append.append(state, new, lambda b, rows: b.withColumn("z", rows.zscore("close", 20)), 20, ROWS, folds)
        results.append(found)
    return functools.reduce(DataFrame.unionByName, results)


def _long_moments(df: DataFrame, n: int) -> DataFrame:
    found = blocks.trailing_moments(df, "low", "high", n, "m")
    return found.select("code", "dt", blocks.mean_of("m", n).alias("mean"), blocks.std_of("m", n).alias("std"), blocks.slope_of("m", n).alias("slope"), blocks.correlation_of("m", n).alias("corr"),
                        blocks.sigma_ratio_of("m", n).alias("ratio"), blocks.zscore_of(F.col("low"), "m").alias("z"))


def _window_bars(t: Tables) -> DataFrame:
    ticks = t.raw("events").withColumns({"ts": F.col("ts").cast("timestamp"), "one": F.lit(1)})
    bars = stream_bars(ticks, "6 hours", "1 day", "event_type", "ts", "value", "one")
    return bars.withColumn("trade_time", F.col("trade_time").cast("timestamp_ntz"))


#: Out of state 0 above 70000 or below 20000, out of 1 on a fall or a quiet day, out of 2 on a rise.
THREE_STATES = {
    0: [("close > 70000", 1), ("close < 20000", 2)], 1: [("close < 40000", 2), ("volume < 50", 0)], 2: [("close > 50000", 0)],
}

OPS: list[Op] = [
    # sources and shape
    Op("ohlcv_bars", "code dt open high low close volume", lambda t: t.bars, "SELECT * FROM bars"),
    Op("ohlcv_bars_hourly", "code trade_time open high low close volume", lambda t: t.hourly, "SELECT * FROM hourly", [HOURLY]),
    Op("scan_date_range", "code dt close", lambda t: feed.scan_range(t.bars, "1997-01-01", "1998-06-30"), "SELECT * FROM bars WHERE dt BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'"),
    Op("signal_bars", "code dt open high low close volume signal:6", lambda t: feed.with_signal(t.bars, t.signals),
       "SELECT *, CASE WHEN count(*) OVER w = 20 THEN (close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0) END AS signal FROM bars "
       f"WINDOW w AS {w(20)}"),
    Op("repeated_keys", "l_orderkey l_linenumber n:i", lambda t: feed.repeated_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"]),
       "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", ["z AS (SELECT 1)"]),
    Op("calendar_align", "code dt open high low close volume", lambda t: feed.calendar_align(t.bars, shuffled=True),
       "SELECT code, dt, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER {run()} AS {c}" for c in ("open", "high", "low", "close")) + ", coalesce(volume, 0) AS volume FROM grid", [BARS, GRID]),
    Op("calendar_distinct", "dt", lambda t: feed.calendar(t.bars), "SELECT DISTINCT dt FROM bars"),
    Op("dense_grid", "code dt close present", lambda t: feed.dense_grid(t.bars, shuffled=True), "SELECT * FROM grid", [BARS, GRID]),
    Op("pivot_mean", "code trade_time open:6 close:6 volume:6",
       lambda t: feed.mean_per_time(t.raw("events").select(F.col("event_type").alias("code"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("trade_time"), F.col("value").alias("open"), (F.col("value") * 2).alias("close"), F.col("user_id").cast("double").alias("volume")), ["open", "close", "volume"]),
       "SELECT event_type AS code, date_trunc('hour', ts) AS trade_time, avg(value) AS open, avg(value * 2) AS close, avg(CAST(user_id AS DOUBLE)) AS volume FROM events GROUP BY 1, 2", ["z AS (SELECT 1)"]),
    Op("unpivot_bounds", "code trade_time bound value:6", lambda t: feed.melt(noise.noise_area(t.hourly, 14, OPEN_TIME, CLOSE_TIME), ["code", "trade_time"], ["upperbound", "lowerbound"], "bound", "value"),
       "SELECT code, trade_time, bound, value FROM (SELECT code, trade_time, greatest(today_open, prev_close) * (1 + sigma) AS upperbound, least(today_open, prev_close) * (1 - sigma) AS lowerbound FROM levels "
       "WHERE today_open IS NOT NULL AND prev_close IS NOT NULL) UNPIVOT (value FOR bound IN (upperbound, lowerbound))", NOISE),
    Op("at_time", "code trade_time close", lambda t: feed.at_time(t.hourly, OPEN_TIME), f"SELECT * FROM hourly WHERE strftime(trade_time, '%H:%M:%S') = '{OPEN_TIME}'", [HOURLY]),
    Op("align_outer", "code dt shipped:0 ordered:i", lambda t: feed.aligned(t.shipped, t.ordered), "SELECT * FROM shipped FULL JOIN ordered USING (code, dt)", PANELS),
    Op("align_left", "code dt shipped:0 ordered:i", lambda t: feed.aligned(t.shipped, t.ordered, "left"), "SELECT * FROM shipped LEFT JOIN ordered USING (code, dt)", PANELS),
    Op("align_right", "code dt shipped:0 ordered:i", lambda t: feed.aligned(t.shipped, t.ordered, "right"), "SELECT * FROM shipped RIGHT JOIN ordered USING (code, dt)", PANELS),
    Op("concat_outer", "code dt shipped:0 ordered:i flagged:i", lambda t: feed.concat([t.shipped, t.ordered, t.flagged]),
       "SELECT * FROM shipped FULL JOIN ordered USING (code, dt) FULL JOIN flagged USING (code, dt)", PANELS),
    Op("asof_open", "code trade_time day_open", lambda t: noise.with_open(t.hourly, OPEN_TIME),
       f"SELECT code, trade_time, last_value(CASE WHEN strftime(trade_time, '%H:%M:%S') = '{OPEN_TIME}' THEN open END IGNORE NULLS) OVER {run('code', 'trade_time')} AS day_open FROM hourly", [HOURLY]),
    Op("day_broadcast", "code day today_open prev_close", lambda t: noise.day_levels(noise.prepared(t.hourly), OPEN_TIME, CLOSE_TIME),
       "SELECT coalesce(o.code, c.code) AS code, coalesce(o.day, c.day) AS day, today_open, prev_close FROM opens o FULL JOIN closes c ON o.code = c.code AND o.day = c.day", NOISE),
    Op("range_slice", "series rank:i n:i growth:6",
       lambda t: drawdown.range_slice(t.returns, drawdown.top_drawdowns(t.returns).select("series", "rank", "peak_date", "recovery_date"), "peak_date", "recovery_date").groupBy("series", "rank").agg(F.count("*").alias("n"), (F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("growth")),
       "SELECT r.series, t.rank, count(*) AS n, product(1 + coalesce(ret, 0)) - 1 AS growth FROM returns r JOIN top t ON r.series = t.series AND r.dt BETWEEN t.peak_date AND t.recovery_date GROUP BY 1, 2", DRAWDOWN),
    Op("last_row", "code dt close", lambda t: frames.last_row(t.bars, ["close"]), "SELECT code, max(dt) AS dt, max_by(close, dt) AS close FROM bars GROUP BY code"),
    Op("order_by_time_code", "code trade_time close", lambda t: t.hourly.orderBy("trade_time", "code"), "SELECT * FROM hourly ORDER BY trade_time, code", [HOURLY]),
    Op("head_trim", "code dt close", lambda t: t.bars.withColumn("rn", ROWS.row()).where("rn >= 616"), f"SELECT * FROM bars QUALIFY row_number() OVER {o()} - 1 >= 616"),
    # generic windows
    Op("rolling_mean", "code dt v:4", lambda t: t.bars.withColumn("v", ROWS.mean("close", 20)), f"SELECT *, {full('close', 20, 'avg(close)')} AS v FROM bars"),
    Op("rolling_mean_union", "code dt v:4", lambda t: feed.on_grid(t.bars, "union", lambda b, r: b.withColumn("v", r.mean("close", 5))), f"SELECT * FROM (SELECT *, {full('close', 5, 'avg(close)')} AS v FROM grid) WHERE present", [BARS, GRID]),
    Op("rolling_std", "code dt v:4", lambda t: t.bars.withColumn("v", ROWS.std("close", 20)), f"SELECT *, {full('close', 20, 'stddev_samp(close)')} AS v FROM bars"),
    Op("rolling_sum", "code dt v:4", lambda t: t.bars.withColumn("v", ROWS.sum("volume", 20)), f"SELECT *, {full('volume', 20, 'sum(volume)')} AS v FROM bars"),
    Op("rolling_quantile", "code dt v:4", lambda t: t.bars.withColumn("v", ROWS.quantile("close", 60, 0.8)), f"SELECT *, {full('close', 60, 'quantile_cont(close, 0.8)')} AS v FROM bars"),
    Op("rolling_monotone", "code dt v:i", lambda t: frames.with_monotone(t.bars, "close", 3, "v"),
       f"SELECT *, CASE WHEN count(close) OVER {w(3)} = 3 THEN CASE WHEN min(s) OVER {w(2)} > 0 THEN 1 WHEN max(s) OVER {w(2)} < 0 THEN -1 END END AS v FROM (SELECT *, close - lag(close) OVER {o()} AS s FROM bars)"),
    Op("rolling_corr", "code dt v:6", lambda t: t.bars.withColumn("v", ROWS.correlation("low", "high", 18)), "SELECT code, dt, rho AS v FROM fit", QRS[:2]),
    Op("rolling_beta", "code dt v:6", lambda t: t.bars.withColumn("v", ROWS.slope("low", "high", 18)), "SELECT code, dt, beta AS v FROM fit", QRS[:2]),
    Op("rolling_sigma_ratio", "code dt v:6", lambda t: t.bars.withColumn("v", ROWS.sigma_ratio("low", "high", 18)), "SELECT code, dt, sigma_ratio AS v FROM fit", QRS[:2]),
    Op("rolling_zscore", "code dt v:6", lambda t: t.bars.withColumn("v", ROWS.zscore("close", 20)), "SELECT code, dt, signal AS v FROM sg", [BARS, TRADES[1]]),
    Op("cumsum", "code trade_time v:4", lambda t: t.hourly.withColumn("day", F.to_date("trade_time")).withColumn("v", F.sum("volume").over(Rows(("code", "day"), "trade_time").run)),
       f"SELECT *, sum(volume) OVER {run('code, CAST(trade_time AS DATE)', 'trade_time')} AS v FROM hourly", [HOURLY]),
    Op("cumprod", "series dt v:6", lambda t: t.returns.withColumn("v", FLOW.growth("ret")), f"SELECT *, product(1 + coalesce(ret, 0)) OVER {run('series')} - 1 AS v FROM returns", [BARS, RETURNS]),
    Op("cummax", "code dt v", lambda t: t.bars.withColumn("v", F.max("close").over(ROWS.run)), f"SELECT *, max(close) OVER {run()} AS v FROM bars"),
    Op("lag", "code dt v", lambda t: t.bars.withColumn("v", ROWS.lag("close", 3)), f"SELECT *, lag(close, 3) OVER {o()} AS v FROM bars"),
    Op("diff", "code dt v:4", lambda t: t.bars.withColumn("v", ROWS.diff("close")), f"SELECT *, close - lag(close) OVER {o()} AS v FROM bars"),
    Op("pct_change", "series dt ret:6", lambda t: t.returns, "SELECT * FROM returns", [BARS, RETURNS]),
    Op("ffill", "code dt v", lambda t: t.bars.withColumn("v", ROWS.held(F.when(F.col("volume") > 150, F.col("close")))), f"SELECT *, {held('CASE WHEN volume > 150 THEN close END')} AS v FROM bars"),
    Op("prev_at_time", "code day v", lambda t: noise.prepared(t.hourly).where(F.col("tod") == CLOSE_TIME).withColumn("v", Rows(("code",), "day").lag("close")), "SELECT code, day, prev_close AS v FROM closes", NOISE),
    Op("cross_signal", "code dt v", lambda t: t.bars.withColumn("c", F.col("close") > F.col("open")).withColumn("v", ROWS.triggered(F.col("c"))),
       f"SELECT *, close > open AND NOT coalesce(lag(close > open) OVER {o()}, true) AS v FROM bars"),
    Op("ema", "code dt v:4", lambda t: momentum.ema(t.bars, "close", 26, "v"), "SELECT s.code, s.dt, e.g AS v FROM s LEFT JOIN e ON s.code = e.code AND s.rn = e.rn", [BARS, *macd_ctes("close")[:2]]),
    Op("sliding_window", "code dt window_no:i total:4", lambda t: frames.sliding_windows(t.bars, "close", 10, 5).withColumn("total", F.aggregate("values", F.lit(0.0), lambda a, b: a + b)),
       f"SELECT code, dt, (rn - 9) // 5 AS window_no, total FROM (SELECT *, row_number() OVER {o()} - 1 AS rn, sum(close) OVER {w(10)} AS total FROM bars) WHERE rn >= 9 AND (rn - 9) % 5 = 0"),
    Op("sliding_window_days", "code trade_time window_no:i total:4", lambda t: frames.day_windows(t.hourly, "close", 3, 24, HOURS).withColumn("total", F.aggregate("values", F.lit(0.0), lambda a, b: a + b)),
       f"SELECT code, trade_time, (rn - 71) // 24 AS window_no, total FROM (SELECT *, row_number() OVER {o('code', 'trade_time')} - 1 AS rn, sum(close) OVER {w(72, 'code', 'trade_time')} AS total FROM hourly) WHERE rn >= 71 AND (rn - 71) % 24 = 0", [HOURLY]),
    Op("rolling_apply", "code dt v:4", lambda t: frames.rolling_apply(t.bars, "close", 10, lambda x: x.max() - x.min(), "v"), f"SELECT *, CASE WHEN count(close) OVER {w(10)} = 10 THEN max(close) OVER {w(10)} - min(close) OVER {w(10)} END AS v FROM bars"),
    Op("phase_fir", "code dt phase:6", lambda t: momentum.phase_fir(t.bars.withColumn("ret", ROWS.diff("close")).where("ret IS NOT NULL"), "ret", 30),
       "SELECT code, dt, CASE WHEN rn >= 29 THEN atan2(im, ret) END AS phase FROM (SELECT a.code, a.dt, a.rn, a.ret, sum(b.ret * t.wt) AS im FROM steps2 a JOIN steps2 b ON a.code = b.code AND b.rn BETWEEN a.rn - 29 AND a.rn JOIN taps t ON t.i = 29 - (a.rn - b.rn) GROUP BY 1, 2, 3, 4)",
       [BARS, f"st AS (SELECT code, dt, close - lag(close) OVER {o()} AS ret FROM bars)", f"steps2 AS (SELECT *, row_number() OVER {o()} - 1 AS rn FROM st WHERE ret IS NOT NULL)",
        "taps AS (SELECT i, 2.0 / 30 * sum(sin(2 * pi() * k * (29 - i) / 30)) AS wt FROM range(30) a(i), range(1, 15) b(k) GROUP BY i)"]),
    # timing signals
    Op("qrs_beta", "code dt beta:6 zscore:6", lambda t: qrs.zscore_beta(t.bars), "SELECT * FROM z WHERE rn >= 616", QRS),
    Op("qrs_simple", "code dt beta:6 zscore:6", lambda t: qrs.zscore_beta(t.bars, simple=True), "SELECT code, dt, sigma_ratio AS beta, simple_z AS zscore FROM z WHERE rn >= 616", QRS),
    Op("qrs_regulation", "code dt regulation:6", lambda t: qrs.regulation(t.bars), "SELECT * FROM reg", QRS[:3]),
    Op("qrs_regulation_mean", "code dt regulation:6 regulation_mean:6", lambda t: qrs.regulation_mean(t.bars), f"SELECT *, CASE WHEN count(regulation) OVER {w(18)} = 18 THEN regulation_mean END AS rm FROM reg", QRS[:3]),
    Op("qrs_signal", "code dt signal:6", lambda t: qrs.qrs_signal(t.bars), "SELECT code, dt, zscore * regulation AS signal FROM z WHERE rn >= 616", QRS),
    Op("qrs_signal_adjusted", "code dt signal:6", lambda t: qrs.qrs_signal(t.bars, adjust=True), "SELECT code, dt, zscore * regulation / nullif(regulation_mean, 0) AS signal FROM z WHERE rn >= 616", QRS),
    Op("alligator_lines", "code dt jaw:4 teeth:4 lips:4", lambda t: alligator.alligator_lines(t.cents), "SELECT * FROM lines", ALLIGATOR[:4]),
    Op("alignment", "code dt bull bear", lambda t: alligator.alligator_lines(t.cents).withColumns({"bull": alligator.alignment(), "bear": alligator.alignment(direction="bearish")}), "SELECT * FROM trig", ALLIGATOR[:6]),
    Op("alligator_rows", "code dt event:i", lambda t: alligator.alligator_events(t.cents), "SELECT * FROM asig", ALLIGATOR),
    Op("alligator_signal", "code dt signal:i", lambda t: alligator.alligator_signal(t.cents), f"SELECT *, {held('event')} AS signal FROM asig", ALLIGATOR),
    Op("ao", "code dt ao:4", lambda t: alligator.ao(t.cents), "SELECT * FROM aos", [*CENTS, AO[0]]),
    Op("ao_signal", "code dt signal:i", lambda t: alligator.ao_signal(t.cents), f"SELECT *, {held('event')} AS signal FROM aoe", [*CENTS, *AO]),
    Op("top_fractal", "code dt top:i", lambda t: alligator.fractals(t.bars), "SELECT * FROM fr", [BARS, *FRACTAL[:2]]),
    Op("bottom_fractal", "code dt bottom:i", lambda t: alligator.fractals(t.bars), "SELECT * FROM fr", [BARS, *FRACTAL[:2]]),
    Op("fractal_class", "code dt fractal:i", lambda t: alligator.fractals(t.bars), "SELECT *, top + bottom AS fractal FROM fr", [BARS, *FRACTAL[:2]]),
    Op("fractal_signal", "code dt signal:i", lambda t: alligator.fractal_signal(t.bars), "SELECT * FROM fsig", [BARS, *FRACTAL]),
    Op("combine_signals", "code dt signal:i", lambda t: alligator.combined_signal(t.cents),
       f"""SELECT a.code, a.dt, CASE WHEN a.s = 1 AND (o.s = 1 OR f.signal = 1) THEN 1 WHEN a.s = -1 OR o.s = -1 OR f.signal = -1 THEN -1 ELSE 0 END AS signal
       FROM (SELECT *, {held('event')} AS s FROM asig) a JOIN (SELECT *, {held('event')} AS s FROM aoe) o ON a.code = o.code AND a.dt = o.dt JOIN fsig f ON a.code = f.code AND a.dt = f.dt""", [*ALLIGATOR, *AO, *FRACTAL]),
    Op("macd", "code dt dif:4 dea:4 hist:4", lambda t: momentum.macd(t.bars), "SELECT * FROM m", [BARS, *macd_ctes("close")]),
    Op("macd_class", "code dt event:i", lambda t: momentum.macd_events(momentum.macd(t.bars)), "SELECT * FROM ev", [BARS, *macd_ctes("close"), MACD_EVENT]),
    Op("macd_signal", "code dt signal:i", lambda t: momentum.macd_signal(t.bars), f"SELECT *, {held('nullif(event, 0)')} AS signal FROM ev", [BARS, *macd_ctes("close"), MACD_EVENT]),
    Op("flow_signal", "series dt signal:i", lambda t: momentum.flow_signal(t.flow), f"SELECT *, {held('event', 'series')} AS signal FROM fe",
       [FLOWS, f"fe AS (SELECT *, CASE WHEN north_money > {full('north_money', 60, 'quantile_cont(north_money, 0.8)', 'series')} THEN 1 WHEN north_money < {full('north_money', 60, 'quantile_cont(north_money, 0.2)', 'series')} THEN -1 END AS event FROM flow)"]),
    Op("vmacd_mtm", "code dt vmacd_mtm:5", lambda t: momentum.vmacd_mtm(t.bars), f"SELECT *, CASE WHEN count(z) OVER {w(61)} = 61 THEN z - lag(z, 60) OVER {o()} END AS vmacd_mtm FROM vz",
       [BARS, *macd_ctes("volume"), f"vz AS (SELECT *, (hist - {full('hist', 60, 'avg(hist)')}) / nullif({full('hist', 60, 'stddev_samp(hist)')}, 0) AS z FROM m)"]),
    Op("intraday_vwap", "code trade_time vwap:6", lambda t: noise.intraday_vwap(t.hourly),
       "SELECT *, sum(close * volume) OVER r / nullif(sum(volume) OVER r, 0) AS vwap FROM hourly WINDOW r AS (PARTITION BY code, CAST(trade_time AS DATE) ORDER BY trade_time ROWS UNBOUNDED PRECEDING)", [HOURLY]),
    Op("open_distance", "code trade_time distance:6", lambda t: noise.open_distance(noise.prepared(t.hourly), OPEN_TIME), "SELECT * FROM dist", NOISE),
    Op("noise_sigma", "code trade_time sigma:6", lambda t: noise.noise_sigma(noise.prepared(t.hourly), 14, OPEN_TIME), "SELECT * FROM sig", NOISE),
    Op("noise_bounds", "code trade_time upperbound:6 lowerbound:6", lambda t: noise.noise_area(t.hourly, 14, OPEN_TIME, CLOSE_TIME),
       "SELECT *, CASE WHEN today_open IS NOT NULL AND prev_close IS NOT NULL THEN greatest(today_open, prev_close) * (1 + sigma) END AS upperbound, CASE WHEN today_open IS NOT NULL AND prev_close IS NOT NULL THEN least(today_open, prev_close) * (1 - sigma) END AS lowerbound FROM levels", NOISE),
    Op("noise_area", "code trade_time open close volume upperbound:6 signal lowerbound:6 vwap:6", lambda t: noise.noise_area(t.hourly, 14, OPEN_TIME, CLOSE_TIME),
       "SELECT *, close AS signal, CASE WHEN today_open IS NOT NULL AND prev_close IS NOT NULL THEN greatest(today_open, prev_close) * (1 + sigma) END AS upperbound, CASE WHEN today_open IS NOT NULL AND prev_close IS NOT NULL THEN least(today_open, prev_close) * (1 - sigma) END AS lowerbound FROM levels", NOISE),
    Op("ht_signal", "code dt signal:i", lambda t: momentum.ht_signal(t.bars.withColumn("close", F.floor("close"))),
       f"SELECT *, CASE WHEN d >= 0 THEN 1 ELSE 0 END AS signal FROM (SELECT *, ma - lag(ma) OVER {o()} AS d, row_number() OVER {o()} - 1 AS rn FROM (SELECT *, {full('floor(close)', 60, 'sum(floor(close))')} AS ma FROM bars)) WHERE rn >= 89"),
    Op("band_signal", "code dt signal:i", lambda t: momentum.band_signal(t.bars.withColumn("close", F.floor("close"))),
       f"SELECT *, CASE WHEN {full('close', 4, 'sum(floor(close))')} * 2 >= {full('close', 8, 'sum(floor(close))')} THEN 1 ELSE 0 END AS signal FROM bars QUALIFY row_number() OVER {o()} >= 60"),
    Op("ao_signal_union", "code dt signal:i", lambda t: alligator.ao_signal(t.cents, grid="union"), f"SELECT s.* FROM (SELECT *, {held('event')} AS signal FROM aoe) s JOIN bars USING (code, dt)", [*CENTS, GRID, *_on_grid(AO)]),
    Op("alligator_signal_union", "code dt signal:i", lambda t: alligator.alligator_signal(t.cents, grid="union"), f"SELECT s.* FROM (SELECT *, {held('event')} AS signal FROM asig) s JOIN bars USING (code, dt)", [*CENTS, GRID, *_on_grid(ALLIGATOR[len(CENTS):])]),
    Op("fractal_signal_union", "code dt signal:i", lambda t: alligator.fractal_signal(t.bars, grid="union"), "SELECT f.* FROM fsig f JOIN bars USING (code, dt)", [BARS, GRID, *_on_grid(FRACTAL)]),
    Op("fractal_class_union", "code dt fractal:i", lambda t: alligator.fractals(t.bars, grid="union"), "SELECT f.code, f.dt, f.top + f.bottom AS fractal FROM fr f JOIN bars USING (code, dt)", [BARS, GRID, *_on_grid(FRACTAL[:2])]),
    Op("qrs_regulation_union", "code dt regulation:6", lambda t: qrs.regulation(t.bars, grid="union"),
       f"SELECT g.code, g.dt, CASE WHEN n = 18 THEN power(r, 2) END AS regulation FROM (SELECT *, count(low) OVER {w(18)} AS n, covar_pop(high, low) OVER {w(18)} / nullif(stddev_pop(low) OVER {w(18)} * stddev_pop(high) OVER {w(18)}, 0) AS r FROM grid) g WHERE present", [BARS, GRID]),
    Op("flow_signal_union", "series dt signal:i", lambda t: momentum.flow_signal(t.flow, window=5, grid="union"), f"SELECT s.* FROM (SELECT *, {held('event', 'series')} AS signal FROM fe) s JOIN flow USING (series, dt)",
       [FLOWS, "fgrid AS (SELECT s.series, d.dt, f.north_money FROM (SELECT DISTINCT series FROM flow) s CROSS JOIN (SELECT DISTINCT dt FROM flow) d LEFT JOIN flow f ON f.series = s.series AND f.dt = d.dt)",
        f"fe AS (SELECT *, CASE WHEN north_money > {full('north_money', 5, 'quantile_cont(north_money, 0.8)', 'series')} THEN 1 WHEN north_money < {full('north_money', 5, 'quantile_cont(north_money, 0.2)', 'series')} THEN -1 END AS event FROM fgrid)"]),
    Op("ht_signal_union", "code dt signal:i", lambda t: momentum.ht_signal(t.bars.withColumn("close", F.floor("close")), grid="union"),
       f"SELECT * FROM (SELECT code, dt, CASE WHEN d >= 0 THEN 1 ELSE 0 END AS signal, row_number() OVER {o()} - 1 AS k FROM (SELECT *, ma - lag(ma) OVER {o()} AS d FROM (SELECT *, {full('floor(close)', 60, 'sum(floor(close))')} AS ma FROM grid)) WHERE d IS NOT NULL) WHERE k >= 29", [BARS, GRID]),
    Op("band_signal_union", "code dt signal:i", lambda t: momentum.band_signal(t.bars.withColumn("close", F.floor("close")), grid="union"),
       f"SELECT s.* FROM (SELECT code, dt, CASE WHEN {full('close', 4, 'sum(floor(close))')} * 2 >= {full('close', 8, 'sum(floor(close))')} THEN 1 ELSE 0 END AS signal FROM grid QUALIFY row_number() OVER {o()} >= 60) s JOIN bars USING (code, dt)", [BARS, GRID]),
    Op("phase_fir_union", "code dt phase:6", lambda t: momentum.phase_fir(t.bars, "close", 30, grid="union"),
       "SELECT code, dt, CASE WHEN n = 30 THEN atan2(im, close) END AS phase FROM (SELECT a.code, a.dt, a.close, a.present, count(b.close) AS n, sum(b.close * t.wt) AS im FROM numbered a JOIN numbered b ON a.code = b.code AND b.rn BETWEEN a.rn - 29 AND a.rn JOIN taps t ON t.i = 29 - (a.rn - b.rn) GROUP BY ALL) WHERE present",
       [BARS, GRID, f"numbered AS (SELECT *, row_number() OVER {o()} - 1 AS rn FROM grid)", "taps AS (SELECT i, 2.0 / 30 * sum(sin(2 * pi() * k * (29 - i) / 30)) AS wt FROM range(30) a(i), range(1, 15) b(k) GROUP BY i)"]),
    # metrics
    Op("performance_table", TABLE, lambda t: returns.performance_table(t.returns, BENCHMARK), performance(BENCHMARK), [BARS, RETURNS, METRICS, *MAXDD, RELATIVE]),
    *[Op(name, f"series {name}:6", lambda t, n=name: t.returns.groupBy("series").agg(getattr(returns, n)().alias(n)), "SELECT * FROM perf0", [BARS, RETURNS, METRICS]) for name in ("annual_return", "cum_return", "annual_vol", "sharpe", "sortino")],
    Op("max_drawdown", "series max_drawdown:6", lambda t: returns.max_drawdowns(t.returns), "SELECT * FROM mdd", [BARS, RETURNS, *MAXDD]),
    Op("calmar", "series calmar:6", lambda t: returns.performance_table(t.returns), "SELECT p.series, CASE WHEN m.max_drawdown < 0 THEN p.annual_return / abs(m.max_drawdown) END AS calmar FROM perf0 p JOIN mdd m ON p.series = m.series", [BARS, RETURNS, METRICS, *MAXDD]),
    Op("benchmark_metrics", "series information_ratio:6 alpha:5 beta:6 excess_return:6", lambda t: returns.benchmark_metrics(t.returns, BENCHMARK),
       f"SELECT p.series, CASE WHEN p.series <> '{BENCHMARK}' THEN r.ir END AS information_ratio, CASE WHEN p.series <> '{BENCHMARK}' THEN pow(1 + r.mr - r.beta * r.mb, 252) - 1 END AS alpha, "
       f"CASE WHEN p.series <> '{BENCHMARK}' THEN r.beta END AS beta, p.annual_return - (SELECT annual_return FROM perf0 WHERE series = '{BENCHMARK}') AS excess_return FROM perf0 p LEFT JOIN rel r ON p.series = r.series", [BARS, RETURNS, METRICS, RELATIVE]),
    Op("backtest_report", TABLE, lambda t: returns.backtest_report(t.returns.where("series <> 'NO'"), t.bars.where("code = 'NO'").select("dt", "close"), "benchmark"), performance("benchmark"),
       [BARS, RETURNS.replace("returns AS", "rets AS"), "returns AS (SELECT n.series, d.dt, r.ret FROM (SELECT DISTINCT series FROM rets WHERE series <> 'NO') n CROSS JOIN (SELECT dt FROM rets WHERE series = 'NO') d LEFT JOIN rets r ON r.series = n.series AND r.dt = d.dt UNION ALL SELECT 'benchmark', dt, ret FROM rets WHERE series = 'NO')",
        METRICS, *MAXDD, RELATIVE.replace(f"'{BENCHMARK}'", "'benchmark'")]),
    Op("agg_returns_yearly", "series year:i ret:6", lambda t: returns.compounded(t.returns, ("year",)), "SELECT * FROM yr", [BARS, RETURNS, YEARLY]),
    Op("agg_returns_monthly", "series year:i month:i ret:6", lambda t: returns.compounded(t.returns, ("year", "month")), "SELECT * FROM mo", [BARS, RETURNS, MONTHLY]),
    Op("monthly_matrix", "series year:i " + " ".join(f"m{k}:3" for k in range(1, 13)), lambda t: returns.monthly_matrix(t.returns),
       "SELECT series, year, " + ", ".join(f"round(max(CASE WHEN month = {k} THEN ret END), 3) AS m{k}" for k in range(1, 13)) + " FROM mo GROUP BY 1, 2", [BARS, RETURNS, MONTHLY]),
    Op("monthly_hist", "series bin:i n:i", lambda t: returns.monthly_histogram(t.returns), "SELECT series, floor(ret / 0.01) AS bin, count(*) AS n FROM mo GROUP BY 1, 2", [BARS, RETURNS, MONTHLY]),
    Op("bar_returns_log", "series total:6 mean:6 annualised:6", lambda t: returns.log_returns(t.returns), "SELECT series, sum(ln(1 + ret)) AS total, avg(ln(1 + ret)) AS mean, exp(avg(ln(1 + ret)) * 252) - 1 AS annualised FROM returns GROUP BY 1", [BARS, RETURNS]),
    Op("yearly_stats", "series average:6 stddev:6 positive:i negative:i nochange:i best:6 worst:6", lambda t: returns.yearly_stats(t.returns),
       "SELECT series, avg(ret) AS average, stddev_pop(ret) AS stddev, count(*) FILTER (ret > 0) AS positive, count(*) FILTER (ret < 0) AS negative, count(*) FILTER (ret = 0) AS nochange, max(ret) AS best, min(ret) AS worst FROM yr GROUP BY 1", [BARS, RETURNS, YEARLY]),
    Op("yearly_sharpe", "series sharpe:6", lambda t: returns.yearly_sharpe(t.returns), "SELECT series, (avg(ret) - 0.04) / nullif(stddev_pop(ret), 0) AS sharpe FROM yr GROUP BY 1", [BARS, RETURNS, YEARLY]),
    Op("metric_rows", "series metric value:5", lambda t: returns.metric_rows(returns.performance_table(t.returns).select("series", "annual_return", "cum_return", "sharpe")), "SELECT series, metric, value FROM perf0 UNPIVOT INCLUDE NULLS (value FOR metric IN (annual_return, cum_return, sharpe))", [BARS, RETURNS, METRICS]),
    # drawdowns
    Op("underwater", "series dt underwater:6", lambda t: drawdown.underwater(t.returns), "SELECT * FROM uw", DRAWDOWN),
    Op("max_dd_period", "series peak_date valley_date recovery_date", lambda t: drawdown.max_drawdown_period(t.returns), "SELECT * FROM top WHERE rank = 1", DRAWDOWN),
    Op("top_drawdowns", "series rank:i peak_date valley_date recovery_date depth:6", lambda t: drawdown.top_drawdowns(t.returns), "SELECT * FROM top", DRAWDOWN),
    Op("drawdown_table", "series rank:i net_drawdown_pct:5 peak_date valley_date recovery_date valley_duration:i end_duration:i duration:i", lambda t: drawdown.drawdown_table(t.returns),
       f"SELECT *, (peak_cum - valley_cum) / peak_cum * 100 AS net_drawdown_pct, {weekdays('peak_date', 'valley_date')} AS valley_duration, {weekdays('valley_date', 'recovery_date')} AS end_duration, CASE WHEN recovery_date IS NOT NULL THEN {weekdays('peak_date', 'recovery_date')} END AS duration FROM (SELECT * FROM top)", DRAWDOWN),
    Op("period_compare", "series rank:i series_return:6 benchmark_return:6", lambda t: drawdown.worst_periods(t.returns, BENCHMARK),
       f"SELECT t.series, t.rank, (SELECT product(1 + coalesce(ret, 0)) - 1 FROM returns r WHERE r.series = t.series AND r.dt BETWEEN t.peak_date AND t.recovery_date) AS series_return, (SELECT product(1 + coalesce(ret, 0)) - 1 FROM returns r WHERE r.series = '{BENCHMARK}' AND r.dt BETWEEN t.peak_date AND t.recovery_date) AS benchmark_return FROM top t", DRAWDOWN),
    Op("worst_periods", "series rank:i net_drawdown_pct:5 duration:i series_return:6 benchmark_return:6", lambda t: drawdown.worst_periods(t.returns, BENCHMARK, 3),
       f"SELECT t.series, t.rank, (peak_cum - valley_cum) / peak_cum * 100 AS net_drawdown_pct, CASE WHEN recovery_date IS NOT NULL THEN {weekdays('peak_date', 'recovery_date')} END AS duration, (SELECT product(1 + coalesce(ret, 0)) - 1 FROM returns r WHERE r.series = t.series AND r.dt BETWEEN t.peak_date AND t.recovery_date) AS series_return, (SELECT product(1 + coalesce(ret, 0)) - 1 FROM returns r WHERE r.series = '{BENCHMARK}' AND r.dt BETWEEN t.peak_date AND t.recovery_date) AS benchmark_return FROM top t WHERE t.rank <= 3", DRAWDOWN),
    Op("drawdown_points", "series rank:i peak_cum:6 valley_cum:6 recovery_cum:6 state active_duration:i last_date", lambda t: drawdown.drawdown_points(t.returns),
       f"SELECT t.*, coalesce(u.cum, l.cum) AS recovery_cum, CASE WHEN t.recovery_date IS NULL THEN 'active' ELSE 'recovered' END AS state, CASE WHEN t.recovery_date IS NULL THEN {weekdays('t.peak_date', 'l.last_date')} END AS active_duration, l.last_date FROM top t JOIN lst l ON t.series = l.series LEFT JOIN uw u ON u.series = t.series AND u.dt = t.recovery_date",
       [*DRAWDOWN, "lst AS (SELECT series, max(dt) AS last_date, max_by(cum, dt) AS cum FROM uw GROUP BY 1)"]),
    Op("lookup_value", "series rank:i recovery_cum:6", lambda t: drawdown.drawdown_points(t.returns), "SELECT t.series, t.rank, coalesce((SELECT cum FROM uw u WHERE u.series = t.series AND u.dt = t.recovery_date), (SELECT max_by(cum, dt) FROM uw u WHERE u.series = t.series)) AS recovery_cum FROM top t", DRAWDOWN),
    Op("top_k", "series dt ret:6 k:i", lambda t: frames.top_k(t.returns, "ret", 10, "series"), "SELECT *, row_number() OVER (PARTITION BY series ORDER BY ret, dt) AS k FROM returns WHERE ret IS NOT NULL QUALIFY k <= 10", [BARS, RETURNS]),
    # trades
    Op("hysteresis_position", "code dt position:i", lambda t: t.positions, "SELECT * FROM pos", TRADES[:4]),
    Op("fills", "code dt side price:4 commission:0", lambda t: t.fills, "SELECT code, dt, side, fill_price AS price, abs(0.95 * entry_equity / base) * fill_price * CASE WHEN (side = 'buy') = (entry_equity > 0) THEN 0.0002 ELSE 0.0012 END AS commission FROM eq WHERE side IS NOT NULL", TRADES),
    Op("commission", "l_orderkey l_linenumber l_quantity cost:6", lambda t: t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", trades.commission_of(F.col("l_quantity") - 25, F.col("l_extendedprice")).alias("cost")),
       "SELECT l_orderkey, l_linenumber, l_quantity, abs(l_quantity - 25) * l_extendedprice * CASE WHEN l_quantity > 25 THEN 0.0002 WHEN l_quantity < 25 THEN 0.0012 ELSE 0 END AS cost FROM lineitem", ["z AS (SELECT 1)"]),
    Op("equity_curve", "code dt trade_id:i growth:6", lambda t: trades.equity_curve(t.positions).withColumn("growth", F.col("equity") / 1e9), "SELECT *, equity / 1e9 AS growth FROM eq", TRADES),
    Op("trade_list", "status:i ref:i ticker dir datein pricein:4 dateout priceout:4 chng_pct:2 pnl:-3 pnl_pct:2 size:-1 value:-3 cumpnl:-3 nbars:i pnl_per_bar:-3 mfe_pct:2 mae_pct:2", lambda t: t.trades, "SELECT * FROM tl", TRADES),
    Op("mfe_mae", "ticker ref:i mfe_pct:2 mae_pct:2", lambda t: t.trades.where("status = 2"), "SELECT * FROM tl WHERE status = 2", TRADES),
    Op("pair_fills", "code pair:i datein pricein:4 dateout priceout:4", lambda t: trades.pair_fills(t.fills),
       f"SELECT code, k // 2 AS pair, max(CASE WHEN k % 2 = 0 THEN dt END) AS datein, max(CASE WHEN k % 2 = 0 THEN fill_price END) AS pricein, max(CASE WHEN k % 2 = 1 THEN dt END) AS dateout, max(CASE WHEN k % 2 = 1 THEN fill_price END) AS priceout FROM (SELECT *, row_number() OVER {o()} - 1 AS k FROM fl WHERE side IS NOT NULL) GROUP BY 1, 2", TRADES[:6]),
    Op("transactions", "dt amount:-1 price:4 sid:i symbol value:-3", lambda t: trades.transactions(t.fills),
       "SELECT dt, 0.95 * entry_equity / base * CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS amount, fill_price AS price, trade_id AS sid, code AS symbol, -0.95 * entry_equity / base * CASE WHEN side = 'buy' THEN 1 ELSE -1 END * fill_price AS value FROM eq WHERE side IS NOT NULL", TRADES),
    Op("trades_by_status", "ticker ref:i bucket", lambda t: trades.by_status(t.trades), "SELECT *, CASE WHEN status = 1 THEN 'Active' WHEN pnl > 0 THEN 'Exit-Profit' WHEN pnl < 0 THEN 'Exit-Loss' ELSE 'Exit' END AS bucket FROM tl", TRADES),
    Op("trade_stats", "ticker total:i closed:i open:i won:i lost:i win_rate:6 profit_factor:5 bars_avg:6 bars_max:i bars_min:i longest_win:i longest_loss:i", lambda t: trades.trade_stats(t.trades),
       "SELECT a.*, coalesce(b.win, 0) AS longest_win, coalesce(b.lose, 0) AS longest_loss FROM (SELECT ticker, count(*) AS total, count(*) FILTER (status = 2) AS closed, count(*) FILTER (status = 1) AS open, count(*) FILTER (status = 2 AND pnl > 0) AS won, count(*) FILTER (status = 2 AND pnl < 0) AS lost, "
       "count(*) FILTER (status = 2 AND pnl > 0) / count(*) AS win_rate, sum(pnl) FILTER (status = 2 AND pnl > 0) / abs(nullif(sum(pnl) FILTER (status = 2 AND pnl < 0), 0)) AS profit_factor, avg(nbars) AS bars_avg, max(nbars) AS bars_max, min(nbars) AS bars_min FROM tl GROUP BY 1) a "
       "LEFT JOIN (SELECT ticker, max(CASE WHEN s > 0 THEN n END) AS win, max(CASE WHEN s < 0 THEN n END) AS lose FROM (SELECT ticker, s, g, count(*) AS n FROM (SELECT ticker, sign(pnl) AS s, row_number() OVER (PARTITION BY ticker ORDER BY ref) - row_number() OVER (PARTITION BY ticker, sign(pnl) ORDER BY ref) AS g FROM tl WHERE status = 2) GROUP BY 1, 2, 3) GROUP BY 1) b ON a.ticker = b.ticker", TRADES),
    Op("sqn", "ticker sqn:5", lambda t: trades.sqn(t.trades), "SELECT ticker, sqrt(count(*)) * avg(pnl) / nullif(stddev_pop(pnl), 0) AS sqn FROM tl WHERE status = 2 GROUP BY 1", TRADES),
    Op("order_log", "code dt message", lambda t: trades.order_log(t.fills), "SELECT code, dt, strftime(dt, '%Y-%m-%d') || ', ' || upper(side) || ' EXECUTED, ' || code || ', Price: ' || format('{:.2f}', round(fill_price, 2)) AS message FROM fl WHERE side IS NOT NULL", TRADES[:6]),
    Op("bar_returns", "series dt ret:6", lambda t: returns.bar_returns(trades.equity_curve(t.positions)), f"SELECT code AS series, dt, equity / lag(equity) OVER {o()} - 1 AS ret FROM eq", TRADES),
    # chart tables
    Op("cumulative_vs_benchmark", "series dt cum:6 benchmark_cum:6", lambda t: charts.cumulative_vs_benchmark(t.returns, BENCHMARK),
       f"SELECT r.series, r.dt, product(1 + coalesce(r.ret, 0)) OVER (PARTITION BY r.series ORDER BY r.dt ROWS UNBOUNDED PRECEDING) - 1 AS cum, product(1 + coalesce(b.ret, 0)) OVER (PARTITION BY r.series ORDER BY r.dt ROWS UNBOUNDED PRECEDING) - 1 AS benchmark_cum FROM returns r LEFT JOIN returns b ON b.dt = r.dt AND b.series = '{BENCHMARK}'", [BARS, RETURNS]),
    Op("pos_neg_area", "code dt above below", lambda t: charts.pos_neg_area(t.bars, "close", "open"), "SELECT *, CASE WHEN close > open THEN close ELSE open END AS above, CASE WHEN close < open THEN close ELSE open END AS below FROM bars"),
    Op("underwater_chart", "series dt underwater:6", lambda t: charts.underwater_chart(t.returns), "SELECT * FROM uw", DRAWDOWN),
    Op("drawdown_zones", "series rank:i zone x0 x1", lambda t: charts.drawdown_zones(t.returns),
       "SELECT series, rank, 'active' AS zone, peak_date AS x0, (SELECT max(dt) FROM uw u WHERE u.series = t.series) AS x1 FROM top t WHERE recovery_date IS NULL UNION ALL SELECT series, rank, 'decline', peak_date, valley_date FROM top WHERE recovery_date IS NOT NULL UNION ALL SELECT series, rank, 'recovery', valley_date, recovery_date FROM top WHERE recovery_date IS NOT NULL", DRAWDOWN),
    Op("annual_bars", "series year:i ret:6 colour mean:6", lambda t: charts.annual_bars(t.returns), "SELECT *, CASE WHEN ret < 0 THEN 'green' ELSE 'red' END AS colour, avg(ret) OVER (PARTITION BY series) AS mean FROM yr", [BARS, RETURNS, YEARLY]),
    Op("monthly_distribution", "series bin:i n:i mean:6", lambda t: charts.monthly_distribution(t.returns), "SELECT h.*, a.mean FROM (SELECT series, floor(ret / 0.01) AS bin, count(*) AS n FROM mo GROUP BY 1, 2) h JOIN (SELECT series, avg(ret) AS mean FROM mo GROUP BY 1) a ON a.series = h.series", [BARS, RETURNS, MONTHLY]),
    Op("order_markers", "ticker ref:i kind dt price:4", lambda t: charts.order_markers(t.trades), "SELECT ticker, ref, 'buy' AS kind, datein AS dt, pricein AS price FROM tl UNION ALL SELECT ticker, ref, CASE WHEN status = 2 THEN 'sell' ELSE 'active' END, dateout, priceout FROM tl", TRADES),
    Op("position_zones", "ticker ref:i bucket zone x0 y0:4 x1 y1:4", lambda t: charts.position_zones(t.trades), "SELECT *, CASE WHEN status = 1 THEN 'Active' WHEN pnl > 0 THEN 'Exit-Profit' WHEN pnl < 0 THEN 'Exit-Loss' ELSE 'Exit' END AS bucket, CASE WHEN pnl >= 0 THEN 'profit' ELSE 'loss' END AS zone, datein AS x0, pricein AS y0, dateout AS x1, priceout AS y1 FROM tl", TRADES),
    Op("pnl_bubbles", "ticker ref:i dateout kind size:4 opacity:4", lambda t: charts.pnl_bubbles(t.trades),
       "SELECT ticker, ref, dateout, CASE WHEN status = 1 THEN 'Open' WHEN pnl > 0 THEN 'Closed - Profit' ELSE 'Closed - Loss' END AS kind, CASE WHEN hi = lo THEN 7 ELSE 7 + (x - lo) / (hi - lo) * (CASE WHEN hi / nullif(lo, 0) < 2 THEN hi / lo * 7 ELSE 14 END - 7) END AS size, "
       "CASE WHEN hi = lo THEN 0.75 ELSE 0.75 + (x - lo) / (hi - lo) * (CASE WHEN hi / nullif(lo, 0) < 0.9 / 0.75 THEN hi / lo * 0.75 ELSE 0.9 END - 0.75) END AS opacity FROM (SELECT *, abs(pnl_pct) AS x, max(abs(pnl_pct)) OVER (PARTITION BY ticker) AS hi, min(abs(pnl_pct)) OVER (PARTITION BY ticker) AS lo FROM tl)", TRADES),
    # scalars
    Op("business_days", "o_orderkey n:i", lambda t: t.raw("orders").select("o_orderkey", scalars.business_days(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 37)).alias("n")),
       "SELECT o_orderkey, (SELECT count(*) FROM range(38) r(k) WHERE isodow(CAST(o_orderdate AS DATE) + CAST(r.k AS INTEGER)) <= 5) AS n FROM orders", ["z AS (SELECT 1)"]),
    Op("scalar_max_min", "code dt hi lo", lambda t: t.bars.withColumn("p", ROWS.lag("close")).select("code", "dt", scalars.larger("open", "p").alias("hi"), scalars.smaller("open", "p").alias("lo")),
       "SELECT code, dt, CASE WHEN p IS NOT NULL THEN greatest(open, p) END AS hi, CASE WHEN p IS NOT NULL THEN least(open, p) END AS lo FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY dt) AS p FROM bars)"),
    Op("rescale", "code dt a:6 b:6", lambda t: t.bars.select("code", "dt", *[f(F.col("close"), F.min("close").over(frames.Window.partitionBy("code")), F.max("close").over(frames.Window.partitionBy("code")), 2, 9).alias(n) for f, n in ((scalars.rescale_from_min, "a"), (scalars.rescale_from_max, "b"))]),
       "SELECT code, dt, CASE WHEN hi = lo THEN 2 ELSE 2 + (close - lo) / (hi - lo) * (CASE WHEN hi / nullif(lo, 0) < 4.5 THEN hi / lo * 2 ELSE 9 END - 2) END AS a, CASE WHEN hi = lo THEN 9 ELSE (CASE WHEN hi / nullif(lo, 0) < 4.5 THEN 9 / (hi / lo) ELSE 2 END) + (close - lo) / (hi - lo) * (9 - (CASE WHEN hi / nullif(lo, 0) < 4.5 THEN 9 / (hi / lo) ELSE 2 END)) END AS b "
       "FROM (SELECT *, max(close) OVER (PARTITION BY code) AS hi, min(close) OVER (PARTITION BY code) AS lo FROM bars)"),
    Op("renormalize", "code dt v:6", lambda t: t.bars.withColumn("v", scalars.renormalize("close", 0, 100_000, -1, 1)), "SELECT *, -1 + (close - 0) / 100000.0 * 2 AS v FROM bars"),
    Op("grouped_apply", "code n:i top", lambda t: frames.grouped_apply(t.bars.select("code", "close"), _summary, "code string, n long, top double"), "SELECT code, count(*) AS n, max(close) AS top FROM bars GROUP BY code"),
    Op("monthly_heatmap", "series year:i " + " ".join(f"m{k}:3" for k in range(1, 13)), lambda t: charts.monthly_heatmap(t.returns), "SELECT series, year, " + ", ".join(f"round(max(CASE WHEN month = {k} THEN ret END), 3) AS m{k}" for k in range(1, 13)) + " FROM mo GROUP BY 1, 2", [BARS, RETURNS, MONTHLY]),
    Op("metric_table", "series metric value:5", lambda t: charts.metric_table(returns.performance_table(t.returns, BENCHMARK)),
       " UNION ALL ".join(f"SELECT series, '{c}' AS metric, {c} AS value FROM ({performance(BENCHMARK)})" for c in (spec.partition(":")[0] for spec in TABLE.split()[1:])), [BARS, RETURNS, METRICS, *MAXDD, RELATIVE]),
    Op("window_bars", "code trade_time open high low close volume", lambda t: _window_bars(t),
       "SELECT event_type AS code, time_bucket(INTERVAL 6 HOURS, ts) AS trade_time, first(value ORDER BY ts, value) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, value) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2", ["z AS (SELECT 1)"]),
    # long series
    Op("long_series_mean", "code dt v:4", lambda t: halo.long_mean(halo.global_sequence(t.bars.select("code", "dt", "close")), "close", 20, 256, "v"), f"SELECT *, {full('close', 20, 'avg(close)')} AS v FROM bars"),
    Op("qrs_signal_long", "code dt signal:6", lambda t: halo.long_series(t.bars.select("code", "dt", "high", "low"), 617, 1024, lambda b, rows: qrs.qrs_signal(b, rows=rows)), "SELECT code, dt, zscore * regulation AS signal FROM z WHERE rn >= 616", QRS),
    Op("long_series_sum", "code dt v:0", lambda t: halo.running(t.bars.select("code", "dt", "volume"), {"v": ("sum", F.col("volume"))}, F.date_trunc("month", "dt")), f"SELECT *, sum(volume) OVER {run()} AS v FROM bars"),
    Op("long_series_product", "series dt v:6", lambda t: halo.running(t.returns, {"v": ("product", 1 + F.coalesce("ret", F.lit(0.0)))}, F.date_trunc("month", "dt"), "series"), f"SELECT *, product(1 + coalesce(ret, 0)) OVER {run('series')} AS v FROM returns", [BARS, RETURNS]),
    Op("long_series_max", "code dt v", lambda t: halo.running(t.bars.select("code", "dt", "close"), {"v": ("max", F.col("close"))}, F.date_trunc("month", "dt")), f"SELECT *, max(close) OVER {run()} AS v FROM bars"),
    Op("long_series_ffill", "code dt v", lambda t: halo.running(t.bars.select("code", "dt", "close", "volume"), {"v": ("last", F.when(F.col("volume") > 150, F.col("close")))}, F.date_trunc("month", "dt")), f"SELECT *, last_value(CASE WHEN volume > 150 THEN close END IGNORE NULLS) OVER {run()} AS v FROM bars"),
    Op("rolling_quantile_long", "code dt v:4", lambda t: quantiles.long_quantile(t.bars.select("code", "dt", "close"), "close", 500, 0.8, "v"), f"SELECT *, {full('close', 500, 'quantile_cont(close, 0.8)')} AS v FROM bars"),
    Op("rolling_moments_long", "code dt mean:4 std:4 slope:6 corr:6 ratio:6 z:6", lambda t: _long_moments(t.bars.select("code", "dt", "low", "high"), 600),
       f"SELECT *, {full('low', 600, 'avg(low)')} AS mean, {full('low', 600, 'stddev_samp(low)')} AS std, CASE WHEN count(*) OVER w = 600 THEN covar_pop(high, low) OVER w / nullif(var_pop(low) OVER w, 0) END AS slope, "
       "CASE WHEN count(*) OVER w = 600 THEN covar_pop(high, low) OVER w / nullif(stddev_pop(low) OVER w * stddev_pop(high) OVER w, 0) END AS corr, CASE WHEN count(*) OVER w = 600 THEN stddev_pop(high) OVER w / nullif(stddev_pop(low) OVER w, 0) END AS ratio, "
       f"CASE WHEN count(*) OVER w = 600 THEN (low - avg(low) OVER w) / nullif(stddev_pop(low) OVER w, 0) END AS z FROM bars WINDOW w AS {w(600)}"),
    Op("append_in_parts", "code dt z:6 top total:0", lambda t: _appended(t.bars.select("code", "dt", "close", "volume"), ["1997-01-01", "1999-06-01"]),
       f"SELECT code, dt, CASE WHEN count(*) OVER {w(20)} = 20 THEN (close - avg(close) OVER {w(20)}) / nullif(stddev_pop(close) OVER {w(20)}, 0) END AS z, max(close) OVER {run()} AS top, sum(volume) OVER {run()} AS total FROM bars"),
    Op("ema_long", "code dt v:4", lambda t: halo.long_ema(halo.global_sequence(t.bars.select("code", "dt", "close")), "close", 26, 256, "v"), "SELECT s.code, s.dt, e.g AS v FROM s LEFT JOIN e ON s.code = e.code AND s.rn = e.rn", [BARS, *macd_ctes("close")[:2]]),
    Op("equity_curve_long", "code dt position:i trade_id:i growth:6", lambda t: trades.long_equity_curve(t.bars.drop("volume").withColumn("signal", ROWS.zscore("close", 20)), 256).withColumn("growth", F.col("equity") / 1e9), "SELECT *, equity / 1e9 AS growth FROM eq", TRADES),
    Op("three_state_strategy", "code dt state:i", lambda t: trades.multi_state(t.bars.select("code", "dt", "close", "volume"), THREE_STATES, 3), """SELECT code, dt, state FROM walk""",
       [BARS, f"numbered AS (SELECT *, row_number() OVER {o()} AS rn FROM bars)",
        """walk AS (SELECT n.code, n.dt, n.rn, CASE WHEN n.close > 70000 THEN 1 WHEN n.close < 20000 THEN 2 ELSE 0 END AS state FROM numbered n WHERE n.rn = 1 UNION ALL
          SELECT n.code, n.dt, n.rn, CASE WHEN w.state = 0 AND n.close > 70000 THEN 1 WHEN w.state = 0 AND n.close < 20000 THEN 2 WHEN w.state = 1 AND n.close < 40000 THEN 2 WHEN w.state = 1 AND n.volume < 50 THEN 0
            WHEN w.state = 2 AND n.close > 50000 THEN 0 ELSE w.state END FROM walk w JOIN numbered n ON n.code = w.code AND n.rn = w.rn + 1)"""]),
    Op("asof_join", "code dt ordered:i dt_at shipped:0", lambda t: intervals.asof(t.ordered, t.shipped, tolerance=3),
       "SELECT a.code, a.dt, a.ordered, CASE WHEN a.dt - b.dt <= 3 THEN b.dt END AS dt_at, CASE WHEN a.dt - b.dt <= 3 THEN b.shipped END AS shipped FROM ordered a ASOF LEFT JOIN shipped b ON a.code = b.code AND a.dt >= b.dt", PANELS),
    Op("max_dd_period_long", "series peak_date valley_date recovery_date", lambda t: drawdown.max_drawdown_period(t.returns, coarse="month"), "SELECT * FROM top WHERE rank = 1", DRAWDOWN),
    Op("benchmark_constant", "series information_ratio:6 excess_return:6", lambda t: returns.benchmark_metrics(t.returns, 0.0001),
       "SELECT p.series, x.ir AS information_ratio, p.annual_return - (pow(1.0001, 252) - 1) AS excess_return FROM perf0 p JOIN (SELECT series, avg(ret - 0.0001) / stddev_samp(ret - 0.0001) AS ir FROM returns GROUP BY 1) x ON x.series = p.series", [BARS, RETURNS, METRICS]),
    Op("checked_bars", "code dt open high low close volume", lambda t: feed.checked(t.bars)[0], "SELECT * FROM bars"),
    Op("nested_lookup", "l_orderkey l_linenumber tax none:i", lambda t: t.raw("lineitem").select("l_orderkey", "l_linenumber", F.struct(F.struct(F.when(F.col("l_quantity") > 10, F.col("l_tax")).alias("tax")).alias("cost")).alias("line"))
       .select("l_orderkey", "l_linenumber", scalars.field_or_zero("line", "cost", "tax").alias("tax"), scalars.field_or_zero(F.when(F.col("l_linenumber") < 0, F.col("line")), "cost", "tax").alias("none")),
       "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN l_tax ELSE 0 END AS tax, 0 AS none FROM lineitem", ["z AS (SELECT 1)"]),
    Op("underwater_long", "series dt underwater:6", lambda t: drawdown.long_underwater(t.returns), "SELECT * FROM uw", DRAWDOWN),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {op.name: op.query for op in OPS}


def oracles() -> dict[str, str]:
    return {op.name: op.oracle() for op in OPS if op.sql is not None}
