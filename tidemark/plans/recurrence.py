"""Linear recurrences along ordered rows without a per-row function."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks before the current one that still count; (1 - a) to the power of so many blocks is nothing in doubles.
CARRIES = 4


def block_of(period: int) -> int:
    """Rows of a block, large enough for CARRIES blocks to hold all of the memory of an average."""
    return max(256, 16 * period)


def exponential_means(df: DataFrame, averages: Mapping[str, tuple[str, int]], start: int, seq: str, key: str = "code") -> DataFrame:
    """``df`` with exponential averages ``{out: (column, period)}``, null before row ``start`` of a key.

    y = a x + (1 - a) y', a = 2 / (period + 1), and the first y is the plain mean of the ``period`` values up to
    row ``start``. ``seq`` numbers a key's rows from 0. From the first null in the seed's window or after it on an average
    is null: what follows an unknown value is unknown. Rows are cut into blocks: inside one a running weighted sum gives
    the average from zero; what a block passes on decays so fast that the last CARRIES blocks suffice, and each of their last
    rows is looked up by a window over the block number. So all averages take one shuffle by key and no join.
    """
    if any(period < 1 for _, period in averages.values()):
        raise ValueError("a period is one row at least")
    block = block_of(max(p for _, p in averages.values()))
    j = F.col(seq) - start
    at = F.when(j >= 0, j % block)
    rows = Window.partitionBy(key).orderBy("__b", seq)  # the same order as by seq: block numbers rise, rows before them have none
    inside_key = rows.rowsBetween(Window.unboundedPreceding, 0)
    work = df.withColumns({"__b": F.when(j >= 0, F.floor(j / block)), "__r": at})
    inside = Window.partitionBy(key, "__b").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    inputs, locals_ = {}, {}
    for k, (x, period) in enumerate(averages.values()):
        a = 2.0 / (period + 1)
        seed = F.avg(x).over(rows.rowsBetween(-(period - 1), 0))
        inputs[f"__u{k}"] = F.when(F.col(seq) == start, seed).when(F.col(seq) > start, a * F.col(x))
        keep = F.lit(1 - a)
        locals_[f"__l{k}"] = F.sum(F.col(f"__u{k}") * F.pow(keep, -F.col("__r"))).over(inside) * F.pow(keep, F.col("__r")) if period > 1 else F.col(f"__u{k}")
    work = work.withColumns(inputs).withColumns(locals_)
    work = work.withColumns({f"__e{k}": F.when(F.col("__r") == block - 1, F.col(f"__l{k}")) for k in range(len(averages))})
    ends = Window.partitionBy(key).orderBy("__b")
    outs, last = {}, {}
    for k, (out, (x, period)) in enumerate(averages.items()):
        keep = 1 - 2.0 / (period + 1)
        passed = (F.coalesce(F.sum(f"__e{k}").over(ends.rangeBetween(-m, -m)), F.lit(0.0)) * keep ** (block * (m - 1)) for m in range(1, CARRIES + 1))
        last[f"__c{k}"] = sum(passed, F.lit(0.0))
        unknown = F.sum(F.when(F.col(x).isNull() & (F.col(seq) > start - period), 1)).over(inside_key)
        outs[out] = F.when(unknown.isNull(), F.col(f"__l{k}") + F.col(f"__c{k}") * F.pow(F.lit(keep), F.col("__r") + 1))
    helper = ["__b", "__r", *inputs, *locals_, *last, *(f"__e{k}" for k in range(len(averages)))]
    return work.withColumns(last).withColumns(outs).drop(*helper)
