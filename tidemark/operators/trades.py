"""From a signal to positions, fills, equity and trades, for all instruments at once.

One all-in, all-out long position a code, with fractional sizes: what a simulator does bar by bar is a chain of
running aggregates here, since a position depends on the last event only and equity on a product of trade factors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.functions.scalars import ratio, round_even
from tidemark.plans.halo import global_sequence, long_states, walked, with_halo
from tidemark.plans.summaries import reads_all


@dataclass(frozen=True)
class Account:
    """Money and costs: cash per code, share of equity per entry, slippage, commission, stamp duty on sales."""

    cash: float = 1e9
    share: float = 0.95
    slippage: float = 0.0001
    commission: float = 0.0002
    duty: float = 0.001


def hysteresis(signal: str = "signal", enter: float = 0.301, leave: float = -0.301, rows: Rows = Rows()) -> tuple[Column, Column]:
    """Enter and exit conditions: the signal beyond a threshold on this bar and the one before."""
    before = rows.lag(signal)
    return (F.col(signal) >= enter) & (before >= enter), (F.col(signal) <= leave) & (before <= leave)


def position(bars: DataFrame, enter: Column | None = None, leave: Column | None = None, rows: Rows = Rows()) -> DataFrame:
    """``position`` (1 long, 0 flat) after each bar: the last event decides. The conditions are any boolean columns."""
    standard = hysteresis(rows=rows)
    enter, leave = (enter if enter is not None else standard[0]), (leave if leave is not None else standard[1])
    return bars.withColumn("__event", F.when(enter, 1).when(leave, 0)).withColumn("position", rows.held("__event")).drop("__event")


def machine(rules: Mapping[int, Sequence[tuple[Column | str, int]]], states: int) -> Column:
    """A row's array of the next state by state: the first of a state's ``(condition, next)`` that holds, else the state itself.

    A condition is a boolean column or its SQL.
    """
    def after(state: int) -> Column:
        chosen = F.lit(state)
        for condition, to in reversed(list(rules.get(state, ()))):
            chosen = F.when(F.expr(condition) if isinstance(condition, str) else condition, F.lit(to)).otherwise(chosen)
        return chosen

    return F.array(*[after(s) for s in range(states)])


def multi_state(bars: DataFrame, rules: Mapping[int, Sequence[tuple[Column | str, int]]], states: int, start: int = 0, rows: Rows = Rows(), coarse: str = "month") -> DataFrame:
    """``state`` after each bar of a strategy with any number of states, numbered from 0; where two states are enough see ``position``.

    ``rules`` gives for each state the conditions that leave it, in order; a null condition does not hold. A series is walked in calendar periods, see ``halo.long_states``.
    """
    (key,) = rows.keys
    part = F.date_trunc(coarse, F.col(rows.order).cast("timestamp"))
    return long_states(bars, machine(rules, states), part, start, "state", key, rows.order)


def _fill_prices(account: Account) -> tuple[Column, Column]:
    """What a purchase and a sale at a bar's open cost."""
    return F.least(F.col("open") * (1 + account.slippage), F.col("high")), F.greatest(F.col("open") * (1 - account.slippage), F.col("low"))


def _filled(bars: DataFrame, change: Column, account: Account) -> DataFrame:
    side = F.when(change > 0, "buy").when(change < 0, "sell")
    buy, sell = _fill_prices(account)
    return bars.withColumn("side", side).withColumn("fill_price", F.when(F.col("side") == "buy", buy).when(F.col("side") == "sell", sell))


def _gain(money: Column, price: Column, base: Column, account: Account) -> Column:
    """Factor of a trade that put ``share`` of the equity to work at the close ``base`` and bought at ``price``, once a share is worth ``money``."""
    return 1 + account.share / base * (money - price * (1 + account.commission))


def with_fills(bars: DataFrame, account: Account = Account(), rows: Rows = Rows()) -> DataFrame:
    """``bars`` (with ``position``) plus ``side`` and ``fill_price`` of the order that fills at a bar's open.

    A change of position at a bar fills at the next bar's open, slipped against the trader within that bar's range.
    """
    before, earlier = rows.lag("position", 1), rows.lag("position", 2)
    return _filled(bars, before - F.coalesce(earlier, F.lit(0)), account)


def commission_of(size: Column, price: Column, account: Account = Account()) -> Column:
    """Cost of a fill: commission both ways, stamp duty on sales (negative sizes), nothing for size 0."""
    rate = F.when(size > 0, account.commission).when(size < 0, account.commission + account.duty).otherwise(0.0)
    return F.abs(size) * price * rate


def equity_curve(bars: DataFrame, account: Account = Account(), rows: Rows = Rows()) -> DataFrame:
    """``with_fills`` plus ``trade_id, entry_price, entry_equity, size`` and ``equity`` per bar.

    A trade puts ``share`` of the equity at its signal bar's close to work. Equity is the cash times the factors
    of all trades closed so far, and while long the open trade's factor at the close.
    """
    c, d, share = account.commission, account.duty, account.share
    work = with_fills(bars, account, rows).withColumns({"__c1": rows.lag("close"), "__buy": F.when(F.col("side") == "buy", 1)})
    work = work.withColumns({
        "trade_id": F.count("__buy").over(rows.run),
        "entry_price": F.last(F.when(F.col("side") == "buy", F.col("fill_price")), ignorenulls=True).over(rows.run),
        "__base": F.last(F.when(F.col("side") == "buy", F.col("__c1")), ignorenulls=True).over(rows.run),
    })
    gain = lambda money: _gain(money, F.col("entry_price"), F.col("__base"), account)
    work = work.withColumn("__factor", F.when(F.col("side") == "sell", gain(F.col("fill_price") * (1 - c - d))))
    closed = F.product(F.coalesce("__factor", F.lit(1.0)))
    before = rows.ordered.rowsBetween(Window.unboundedPreceding, -1)
    work = work.withColumns({
        "__closed": account.cash * closed.over(rows.run),
        "__open": F.last("side", ignorenulls=True).over(rows.run) == "buy",
        "__start": account.cash * F.coalesce(closed.over(before), F.lit(1.0)),
    })
    work = work.withColumn("entry_equity", F.last(F.when(F.col("side") == "buy", F.col("__start")), ignorenulls=True).over(rows.run))
    equity = F.when(F.col("__open"), F.col("__closed") * gain(F.col("close"))).otherwise(F.col("__closed"))
    work = work.withColumns({"equity": equity, "size": share * F.col("entry_equity") / F.col("__base"), "in_trade": F.coalesce("__open", F.lit(False)) | (F.col("side") == "sell")})
    return work.withColumn("in_trade", F.coalesce("in_trade", F.lit(False))).drop("__c1", "__buy", "__base", "__factor", "__closed", "__open", "__start")


def _walk_trades(totals: DataFrame, account: Account) -> DataFrame:
    """``__part, __s``: what each bucket begins with: ``long``, the trade's ``price`` and ``base``, ``growth`` of closed trades, ``entry`` (growth at the entry), ``n`` trades.

    Only a bucket's first event and first exit depend on what was before: if the event enters, it does so where the series was
    flat; the first exit closes the trade held then, or the one that event began.
    """
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).alias("long"), none.alias("price"), none.alias("base"), F.lit(1.0).alias("growth"), none.alias("entry"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, b: Column) -> Column:
        begins = F.coalesce((b["first"] == 1) & (s["long"] == 0), F.lit(False))
        price, base, entry = (F.when(begins, x).otherwise(y) for x, y in ((b["begun_price"], s["price"]), (b["begun_base"], s["base"]), (s["growth"], s["entry"])))
        ended = F.when((b["first"] == 1) | (s["long"] == 1), _gain(b["ended_price"] * (1 - account.commission - account.duty), price, base, account))
        growth = s["growth"] * F.coalesce(ended, F.lit(1.0))
        later = b["entries"] > 0
        return F.struct(
            F.coalesce(b["last"], s["long"]).alias("long"), F.when(later, b["price"]).otherwise(price).alias("price"), F.when(later, b["base"]).otherwise(base).alias("base"),
            (growth * b["growth"]).alias("growth"), F.when(later, growth * b["before"]).otherwise(entry).alias("entry"), (s["n"] + b["entries"] + begins.cast("long")).alias("n"),
        )

    return walked(totals, start, step)


def long_equity_curve(
    bars: DataFrame, bucket: int, account: Account = Account(), conditions: Callable[[Rows], tuple[Column, Column]] = lambda rows: hysteresis(rows=rows), look_back: int = 2, key: str = "code", time: str = "dt"
) -> DataFrame:
    """``equity_curve`` with its ``position`` from bars with a signal, for series that may each be too long for one task.

    ``conditions(rows)`` gives the enter and exit conditions, which look at ``look_back`` rows at most. Rows are numbered and dealt out in buckets of
    ``bucket`` rows behind a few copied ones. A bucket is summed up as a map of what was before it: its first and last event, its
    first exit, the growth of the trades that lie inside it, its last entry. The maps are walked in order, one row a bucket, and each bucket's rows start from what it begins
    with: one shuffle after the numbering. Bars that fill an order have a price, and the bars before them a close.
    """
    cost, seq = account.commission + account.duty, "__seq"
    cut = with_halo(global_sequence(bars, key, time, out=seq), look_back + 1, bucket, seq)
    dealt = cut.withColumn("__part", F.struct(F.col(key).alias("key"), "bucket")).drop("bucket").repartition("__part")
    rows = Rows(("__part",), seq)
    enter, leave = conditions(rows)
    work = dealt.withColumn("__e", F.when(enter, 1).when(leave, 0))
    work = work.withColumns({"__e1": rows.lag("__e"), "__c1": rows.lag("close")}).where("not in_halo").drop("in_halo")
    # the position that orders at this bar's open lead to, as far as the bucket's own events tell, and the one before
    work = work.withColumn("__to", rows.last_known("__e1")).withColumn("__from", rows.lag("__to"))
    first = F.col("__to").isNotNull() & F.col("__from").isNull()
    enters = (F.col("__to") == 1) & (F.coalesce("__from", F.lit(0)) == 0)
    exits = (F.col("__to") == 0) & (F.coalesce("__from", F.lit(1)) == 1)

    buy, sell = _fill_prices(account)
    own = work.withColumns({"__enters": enters & ~first, "__first": first, "__buy": buy, "__sell": sell, "__exit": F.count(F.when(exits, 1)).over(rows.run), "__exits": exits})
    own = own.withColumns({"__price": rows.last_known(F.when(enters, buy)), "__base": rows.last_known(F.when(enters, F.col("__c1")))})
    own = own.withColumn("__factor", F.coalesce(F.when(F.col("__exits") & (F.col("__exit") > 1), _gain(sell * (1 - cost), F.col("__price"), F.col("__base"), account)), F.lit(1.0)))
    own = own.withColumn("__growth", F.product("__factor").over(rows.run))
    at = F.when(F.col("__enters"), F.col(seq))
    begun = F.col("__first") & (F.col("__to") == 1)
    totals = own.groupBy("__part").agg(
        F.min_by("__to", F.when(F.col("__first"), F.col(seq))).alias("first"), F.max_by("__to", seq).alias("last"), F.max(F.when(begun, F.col("__buy"))).alias("begun_price"), F.max(F.when(begun, F.col("__c1"))).alias("begun_base"),
        F.max(F.when(F.col("__exits") & (F.col("__exit") == 1), F.col("__sell"))).alias("ended_price"), F.product("__factor").alias("growth"), F.count_if("__enters").alias("entries"),
        F.max_by("__buy", at).alias("price"), F.max_by("__c1", at).alias("base"), F.max_by("__growth", at).alias("before"), reads_all(dealt.drop("in_halo")).alias("__mix"),
    ).where("__mix IS NOT NULL").drop("__mix")
    work = work.join(_walk_trades(totals, account), "__part")
    to, before = F.coalesce("__to", "__s.long"), F.coalesce("__from", "__s.long")
    work = _filled(work.withColumn("__long", to), to - before, account).withColumn("position", F.coalesce("__e", "__long"))
    bought = lambda x: F.when(F.col("side") == "buy", x)
    work = work.withColumns({
        "trade_id": F.col("__s.n") + F.count(bought(F.lit(1))).over(rows.run),
        "entry_price": F.coalesce(rows.last_known(bought(F.col("fill_price"))), "__s.price"), "__base": F.coalesce(rows.last_known(bought(F.col("__c1"))), "__s.base"),
    })
    factor = F.when(F.col("side") == "sell", _gain(F.col("fill_price") * (1 - cost), F.col("entry_price"), F.col("__base"), account))
    work = work.withColumn("__factor", F.coalesce(factor, F.lit(1.0))).withColumn("__closed", account.cash * F.col("__s.growth") * F.product("__factor").over(rows.run))
    work = work.withColumn("entry_equity", F.coalesce(rows.last_known(bought(F.col("__closed"))), account.cash * F.col("__s.entry")))
    now = F.col("__closed") * _gain(F.col("close"), F.col("entry_price"), F.col("__base"), account)
    work = work.withColumns({
        "equity": F.when(F.col("__long") == 1, now).otherwise(F.col("__closed")), "size": account.share * F.col("entry_equity") / F.col("__base"),
        "in_trade": (F.col("__long") == 1) | F.coalesce(F.col("side") == "sell", F.lit(False)),
    })
    return work.drop("__part", seq, "__e", "__e1", "__c1", "__to", "__from", "__long", "__s", "__base", "__factor", "__closed")


def fills(bars: DataFrame, account: Account = Account(), rows: Rows = Rows()) -> DataFrame:
    """One row per fill: code, day, side, price, signed size and cost."""
    found = equity_curve(bars, account, rows).where("side IS NOT NULL")
    size = F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size"))
    found = found.select("code", "dt", "side", F.col("fill_price").alias("price"), size.alias("size"), "trade_id")
    return found.withColumn("commission", commission_of(F.col("size"), F.col("price"), account))


def transactions(fill_rows: DataFrame) -> DataFrame:
    """Fills as ``dt, amount, price, sid, symbol, value``."""
    return fill_rows.select("dt", F.col("size").alias("amount"), "price", F.col("trade_id").alias("sid"), F.col("code").alias("symbol"), (-F.col("size") * F.col("price")).alias("value"))


def trade_list(bars: DataFrame, account: Account = Account(), rows: Rows = Rows()) -> DataFrame:
    """One row per round trip; ``status`` is 2 for a closed trade, 1 for an open one.

    An open trade is marked at the code's last close and has no nbars, pnl_per_bar, mfe_pct and mae_pct. The
    profit includes costs; pnl_pct relates it to the equity after it; mfe and mae are the highest high
    and lowest low from entry to exit bar against the entry price.
    """
    held = equity_curve(bars, account, rows).where("in_trade AND trade_id > 0")
    out = F.max(F.when(F.col("side") == "sell", F.col("fill_price")))
    t = held.groupBy("code", "trade_id").agg(
        F.min("dt").alias("datein"), F.max("dt").alias("dateout"), F.max("entry_price").alias("pricein"), out.alias("__out"),
        F.max_by("close", "dt").alias("__close"), F.max("size").alias("size"), F.max_by("equity", "dt").alias("__after"),
        F.max("entry_equity").alias("__before"), (F.count("*") - 1).alias("__bars"), F.max("high").alias("__high"), F.min("low").alias("__low"),
    )
    closed = F.col("__out").isNotNull()
    t = t.withColumns({"status": F.when(closed, 2).otherwise(1), "priceout": F.coalesce("__out", "__close"), "pnl": F.col("__after") - F.col("__before")})
    pct = lambda x: F.when(closed, round_even(100 * (x - F.col("pricein")) / F.col("pricein"), 2))
    return t.select(
        "status", F.col("trade_id").alias("ref"), F.col("code").alias("ticker"), F.lit("long").alias("dir"), "datein", "pricein", "dateout", "priceout",
        round_even(100 * F.col("priceout") / F.col("pricein") - 100, 2).alias("chng_pct"), "pnl",
        round_even(100 * F.col("pnl") / F.col("__after"), 2).alias("pnl_pct"), "size", (F.col("size") * F.col("pricein")).alias("value"),
        F.sum("pnl").over(Window.partitionBy("code").orderBy("trade_id").rowsBetween(Window.unboundedPreceding, 0)).alias("cumpnl"),
        F.when(closed, F.col("__bars")).alias("nbars"), F.when(closed, round_even(ratio(F.col("pnl"), F.col("__bars")), 2)).alias("pnl_per_bar"),
        pct(F.col("__high")).alias("mfe_pct"), pct(F.col("__low")).alias("mae_pct"),
    )


def pair_fills(fill_rows: DataFrame, rows: Rows = Rows()) -> DataFrame:
    """Consecutive fills of a code in pairs: first in, second out; an odd last one has no out."""
    numbered = fill_rows.withColumn("__row", F.row_number().over(rows.ordered) - 1)
    first = F.col("__row") % 2 == 0
    return numbered.groupBy("code", F.floor(F.col("__row") / 2).cast("long").alias("pair")).agg(
        F.max(F.when(first, F.col("dt"))).alias("datein"), F.max(F.when(first, F.col("price"))).alias("pricein"),
        F.max(F.when(~first, F.col("dt"))).alias("dateout"), F.max(F.when(~first, F.col("price"))).alias("priceout"),
    )


def by_status(trades: DataFrame) -> DataFrame:
    """``trades`` with ``bucket``: Active, Exit-Profit, Exit-Loss or Exit."""
    return trades.withColumn("bucket", F.when(F.col("status") == 1, "Active").when(F.col("pnl") > 0, "Exit-Profit").when(F.col("pnl") < 0, "Exit-Loss").otherwise("Exit"))


def trade_stats(trades: DataFrame) -> DataFrame:
    """Totals per ticker: counts, longest winning and losing streak, win rate over all trades, profit factor (null without
    losers), holding bars. Null where there is nothing to divide by.

    A closed trade's place in its streak is the number of closed trades since the sign last changed, so streaks are a column of the same rows.
    """
    closed, won, lost = F.col("status") == 2, (F.col("status") == 2) & (F.col("pnl") > 0), (F.col("status") == 2) & (F.col("pnl") < 0)
    inside = Window.partitionBy("ticker", closed).orderBy("ref")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    work = trades.withColumns({"__sign": F.signum("pnl"), "__place": F.row_number().over(inside)})
    work = work.withColumn("__begin", F.max(F.when(~F.lag("__sign").over(inside).eqNullSafe(F.col("__sign")), F.col("__place"))).over(run))
    streak = F.col("__place") - F.col("__begin") + 1
    longest = lambda rows: F.coalesce(F.max(F.when(rows, streak)), F.lit(0)).cast("long")
    return work.groupBy("ticker").agg(
        F.count("*").alias("total"), F.count_if(closed).alias("closed"), F.count_if(~closed).alias("open"), F.count_if(won).alias("won"), F.count_if(lost).alias("lost"),
        ratio(F.count_if(won), F.count("*")).alias("win_rate"), ratio(F.sum(F.when(won, F.col("pnl"))), F.abs(F.sum(F.when(lost, F.col("pnl"))))).alias("profit_factor"),
        F.avg("nbars").alias("bars_avg"), F.max("nbars").alias("bars_max"), F.min("nbars").alias("bars_min"), longest(won).alias("longest_win"), longest(lost).alias("longest_loss"),
    )


def sqn(trades: DataFrame) -> DataFrame:
    """``ticker, sqn``: root of the number of closed trades times mean over population spread of their profits."""
    return trades.where("status = 2").groupBy("ticker").agg((F.sqrt(F.count("*")) * ratio(F.avg("pnl"), F.stddev_pop("pnl"))).alias("sqn"))


def order_log(fill_rows: DataFrame) -> DataFrame:
    """A line of text per fill."""
    line = F.format_string("%s, %s EXECUTED, %s, Price: %.2f", F.date_format("dt", "yyyy-MM-dd"), F.upper("side"), F.col("code"), F.col("price"))
    return fill_rows.select("code", "dt", line.alias("message"))
