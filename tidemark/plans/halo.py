"""Windows over one very long series: buckets with a halo, running folds in two levels, averages and state machines by composed maps."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.plans.summaries import reads_all


def global_sequence(df: DataFrame, key: str = "code", time: str = "dt", coarse: str = "month", out: str = "seq") -> DataFrame:
    """Number a key's rows from 0 in time order without sorting the key in one task.

    Rows are numbered inside coarse periods, and the rows of the periods before are counted; both use one shuffle by key and
    period. Rows of a null key are numbered as one series, rows without a time come first.
    """
    part = F.date_trunc(coarse, F.col(time).cast("timestamp"))
    return running(df, {out: ("sum", F.lit(1))}, part, key, time).withColumn(out, F.col(out) - 1)


def with_halo(df: DataFrame, look_back: int, bucket: int, seq: str = "seq") -> DataFrame:
    """Copy the last ``look_back - 1`` rows of each bucket into the next one.

    Adds ``bucket`` and ``in_halo``. Windows of up to ``look_back`` rows may then partition by key and bucket;
    rows with ``in_halo`` are dropped afterwards.
    """
    if not 1 <= look_back <= bucket:
        raise ValueError("look_back is between 1 and the bucket's size")
    own = F.floor(F.col(seq) / bucket).cast("long")
    spills = F.col(seq) % bucket >= bucket - (look_back - 1)
    places = F.when(spills, F.array(F.struct(own.alias("bucket"), F.lit(False).alias("in_halo")), F.struct((own + 1).alias("bucket"), F.lit(True).alias("in_halo"))))
    places = places.otherwise(F.array(F.struct(own.alias("bucket"), F.lit(False).alias("in_halo"))))
    return df.withColumn("__place", F.explode(places)).select("*", "__place.bucket", "__place.in_halo").drop("__place")


def long_series(
    df: DataFrame, look_back: int, bucket: int, operator: Callable[[DataFrame, Rows], DataFrame], key: str = "code", time: str = "dt", coarse: str = "month"
) -> DataFrame:
    """Any operator with a bounded look-back over series that may each be too long for one task.

    ``operator(df, rows)`` gets the rows of each bucket behind the ``look_back - 1`` rows before it, with ``rows``
    naming key and bucket; it must pass columns through. A series is cut into tasks of ``bucket`` rows.
    """
    work = with_halo(global_sequence(df, key, time, coarse, "__seq"), look_back, bucket, "__seq")
    return operator(work, Rows((key, "bucket"), time)).where("not in_halo").drop("bucket", "in_halo", "__seq")


def long_mean(df: DataFrame, x: str, n: int, bucket: int, out: str, key: str = "code", seq: str = "seq") -> DataFrame:
    """Trailing mean of n rows of series that may each be too long for one task."""
    w = Window.partitionBy(key, "bucket").orderBy(seq).rowsBetween(-(n - 1), 0)
    value = F.when(F.count(x).over(w) == n, F.avg(x).over(w))
    return with_halo(df, n, bucket, seq).withColumn(out, value).where("not in_halo").drop("bucket", "in_halo")


def _last(x: Column, order: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), order))


#: By kind: the running aggregate, a bucket's total (value, order), and how a total and the value behind it merge.
FOLDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (F.sum, lambda x, o: F.sum(x), lambda a, b: F.coalesce(a + b, a, b)),
    "product": (F.product, lambda x, o: F.product(x), lambda a, b: F.coalesce(a * b, a, b)),
    "max": (F.max, lambda x, o: F.max(x), lambda a, b: F.greatest(a, b)),
    "last": (lambda x: F.last(x, ignorenulls=True), _last, lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, folds: Mapping[str, tuple[str, Column]], part: Column, key: str = "code", order: str = "dt") -> DataFrame:
    """``df`` with running folds ``{out: (kind, x)}`` from a series' start, of kinds ``sum, product, max, last``.

    ``part`` cuts a series into buckets and never falls along ``order``: a row number over the bucket's size, or a calendar period.
    Values are folded inside buckets and merged with the fold of the buckets' totals before. A task holds one bucket, or one total
    of each bucket of a series. Nulls are skipped; before the first value a fold is null. All folds take one shuffle by key and bucket,
    which the totals read too, and two of totals. That shuffle is shared if all columns of ``df`` are used in the end, so leave out those that are not wanted.
    """
    names = {out: f"__x{k}" for k, out in enumerate(folds)}
    dealt = df.withColumn("__part", F.struct(F.col(key).alias("key"), part.alias("bucket"))).repartition("__part")  # a struct joins on nulls too
    work = dealt.withColumns({names[out]: x for out, (_, x) in folds.items()})
    totals = work.groupBy("__part").agg(*[FOLDS[kind][1](F.col(names[out]), F.col(order)).alias(names[out]) for out, (kind, _) in folds.items()], reads_all(dealt).alias("__mix")).where("__mix IS NOT NULL")
    before = Window.partitionBy("__part.key").orderBy("__part.bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__part", *[FOLDS[kind][0](F.col(names[out])).over(before).alias(f"__before{k}") for k, (out, (kind, _)) in enumerate(folds.items())])
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = work.withColumns({f"__in{k}": FOLDS[kind][0](F.col(names[out])).over(inside) for k, (out, (kind, _)) in enumerate(folds.items())}).join(carried, "__part")
    found = found.withColumns({out: FOLDS[kind][2](F.col(f"__before{k}"), F.col(f"__in{k}")) for k, (out, (kind, _)) in enumerate(folds.items())})
    return found.drop("__part", *names.values(), *(f"__{x}{k}" for k in range(len(folds)) for x in ("in", "before")))


def _by_number(df: DataFrame, kind: str, x: Column, bucket: int, out: str, key: str, seq: str) -> DataFrame:
    if bucket < 1:
        raise ValueError("a bucket has one row at least")
    return running(df, {out: (kind, x)}, F.floor(F.col(seq) / bucket), key, seq)


def long_running_sum(df: DataFrame, x: Column, bucket: int, out: str, key: str = "code", seq: str = "seq") -> DataFrame:
    """Running sum from the start of a series, nulls skipped."""
    return _by_number(df, "sum", x, bucket, out, key, seq)


def long_running_product(df: DataFrame, x: Column, bucket: int, out: str, key: str = "code", seq: str = "seq") -> DataFrame:
    """Running product from the start of a series, nulls skipped."""
    return _by_number(df, "product", x, bucket, out, key, seq)


def long_running_max(df: DataFrame, x: Column, bucket: int, out: str, key: str = "code", seq: str = "seq") -> DataFrame:
    """Running maximum from the start of a series, nulls skipped."""
    return _by_number(df, "max", x, bucket, out, key, seq)


def long_last_known(df: DataFrame, x: Column, bucket: int, out: str, key: str = "code", seq: str = "seq") -> DataFrame:
    """The latest value that is not null, this row's included."""
    return _by_number(df, "last", x, bucket, out, key, seq)


def long_ema(df: DataFrame, x: str, period: int, bucket: int, out: str = "ema", key: str = "code", seq: str = "seq") -> DataFrame:
    """Exponential moving average, as ``momentum.ema``, of series cut into buckets of ``bucket`` rows by their number.

    A bucket maps the average before it to the one behind it: y becomes a + b y, where a is the average of the bucket's rows from zero. Buckets before
    the current one are full, so b is the same for all of them and maps compose to a sum of a's with falling powers of b, which ends
    where the power is nothing in doubles. The bucket that holds the seed's last row adds what earlier buckets hold of the seed, and nulls so far are counted
    over the totals too, so there is one shuffle by key and bucket and one of totals.
    """
    if period < 1 or not 1 <= bucket <= 256 * period:
        raise ValueError("a period has one row at least, a bucket one to 256 periods")
    a, start = 2.0 / (period + 1), period - 1
    keep = 1 - a
    power = lambda n: F.pow(F.lit(keep), n) if period > 1 else F.when(n == 0, 1.0).otherwise(0.0)
    dealt = df.withColumn("__part", F.struct(F.col(key).alias("key"), F.floor(F.col(seq) / bucket).alias("bucket"))).repartition("__part")
    inside = Window.partitionBy("__part").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    early = F.when(F.col(seq) <= start, F.col(x))
    work = dealt.withColumns({"__early": early, "__r": F.col(seq) % bucket, "__gaps": F.sum(F.col(x).isNull().cast("long")).over(inside)})
    seed = F.coalesce(F.sum("__early").over(inside), F.lit(0.0)) / period
    work = work.withColumn("__u", F.when(F.col(seq) == start, seed).when(F.col(seq) > start, a * F.col(x)))
    local = F.coalesce(F.sum(F.col("__u") * F.pow(F.lit(keep), -F.col("__r"))).over(inside), F.lit(0.0)) * power(F.col("__r")) if period > 1 else F.col("__u")
    work = work.withColumn("__local", local)
    totals = work.groupBy("__part").agg(
        F.max_by("__local", seq).alias("__a"), F.sum("__early").alias("__seed"), F.max("__gaps").alias("__nulls"), F.max(seq).alias("__end"), reads_all(dealt).alias("__mix"),
    ).where("__mix IS NOT NULL")
    order = Window.partitionBy("__part.key").orderBy("__part.bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"__before": F.coalesce(F.sum("__seed").over(before), F.lit(0.0)) / period, "__missed": F.coalesce(F.sum("__nulls").over(before), F.lit(0).cast("long"))})
    seeds = F.col("__part.bucket") == start // bucket  # the bucket of the seed's last row
    behind = F.col("__a") + F.when(seeds, F.col("__before") * power(F.col("__end") - start)).otherwise(0.0)
    terms = 1 if period == 1 else int(-60 * math.log(2) / (bucket * math.log(keep))) + 1
    passed = F.aggregate(F.collect_list("__behind").over(order.rowsBetween(-terms, -1)), F.lit(0.0), lambda y, v: y * keep**bucket + v)
    carried = totals.withColumn("__behind", behind).select("__part", passed.alias("__passed"), F.when(seeds, F.col("__before")).otherwise(0.0).alias("__before"), "__missed")
    found = work.join(carried, "__part")
    known = (F.col(seq) >= start) & (F.col("__gaps") + F.col("__missed") == 0)
    value = F.col("__local") + F.col("__passed") * power(F.col("__r") + 1) + F.col("__before") * power(F.col(seq) - start)
    return found.withColumn(out, F.when(known, value)).drop("__part", "__early", "__r", "__gaps", "__u", "__local", "__passed", "__before", "__missed")


def walked(totals: DataFrame, start: Column, step: Callable[[Column, Column], Column], out: str = "__s") -> DataFrame:
    """``__part, out``: the state that each bucket begins in; ``step(state, total)`` is the state behind a bucket, ``start`` the first one.

    ``totals`` has one row a bucket, with its ``__part`` (key and bucket) and what the step reads. A series' totals are walked in one task.
    """
    others = [c for c in totals.columns if c != "__part"]
    walks = totals.groupBy(F.col("__part.key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("__part", *others))).alias("__walk"))
    begun = F.aggregate("__walk", F.array(start), lambda s, b: F.array_append(s, step(F.element_at(s, -1), b)))
    begun = walks.select(F.explode(F.arrays_zip(F.col("__walk.__part").alias("p"), begun.alias("s"))).alias("__b")).where("__b.p IS NOT NULL")
    return begun.select(F.col("__b.p").alias("__part"), F.col("__b.s").alias(out))


#: Tables that are composed one by one on each of the lower levels of a bucket.
FAN = 32


def _then(a: Column, b: Column) -> Column:
    """Table ``a`` and then ``b``; a missing one changes nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.transform(a, lambda s: F.get(b, s)))


def long_states(df: DataFrame, table: Column, part: Column, start: int = 0, out: str = "state", key: str = "code", order: str = "dt") -> DataFrame:
    """``df`` with the state of a machine behind each row; ``table`` is the row's array of the next state by state.

    Tables of a bucket's rows are composed into one, buckets are walked from the ``start`` state, and rows apply the composed tables
    before them to the state their bucket begins in. A row composes the tables before it in its block of ``FAN`` rows, those of the
    blocks before in its ``FAN`` blocks, and those of the larger blocks before: one sort, and some 2 ``FAN`` steps a row in buckets of tens of thousands.
    """
    dealt = df.withColumn("__part", F.struct(F.col(key).alias("key"), part.alias("bucket"))).repartition("__part")
    number = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    work = dealt.withColumns({"__table": table, "__at": number}).withColumns({"__large": F.floor(F.col("__at") / FAN**2), "__small": F.floor(F.col("__at") / FAN)})
    sort = ["__large", "__small", "__at"]

    def before(tables: Column, level: int, last: int) -> Column:
        """The tables up to the row ``last`` rows off in the row's block of a level, composed."""
        listed = F.collect_list(tables).over(Window.partitionBy("__part", *sort[:level]).orderBy(*sort[level:]).rowsBetween(Window.unboundedPreceding, last))
        return F.when(F.size(listed) > 0, F.aggregate(F.slice(listed, F.lit(2), F.size(listed)), F.get(listed, F.lit(0)), lambda a, b: F.transform(a, lambda s: F.get(b, s))))

    ends = lambda rows: F.col("__at") % rows == rows - 1
    work = work.withColumn("__map", before(F.col("__table"), 2, 0))
    work = work.withColumn("__map2", before(F.when(ends(FAN), F.col("__map")), 1, -1)).withColumn("__map", _then(F.col("__map2"), F.col("__map")))
    work = work.withColumn("__map2", before(F.when(ends(FAN**2), F.col("__map")), 0, -1)).withColumn("__map", _then(F.col("__map2"), F.col("__map"))).drop("__map2")
    totals = work.groupBy("__part").agg(F.max_by("__map", "__at").alias("__all"), reads_all(dealt).alias("__mix")).where("__mix IS NOT NULL")
    found = work.join(walked(totals.select("__part", "__all"), F.lit(start), lambda s, b: F.get(b["__all"], s)), "__part")
    return found.withColumn(out, F.get("__map", F.col("__s"))).drop("__part", "__table", "__map", "__s", "__at", "__large", "__small")
