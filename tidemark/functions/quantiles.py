"""Rolling quantiles over long windows: blocks of sorted values, ranks selected over the blocks."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.plans.halo import global_sequence, with_halo


class SortedBlocks:
    """Values in sorted blocks of bounded size; a value is put in or taken out inside one block, a rank found by the blocks' sizes."""

    def __init__(self, size: int):
        self.size, self.blocks, self.tops = size, [], []

    def add(self, value: float) -> None:
        if not self.blocks:
            self.blocks, self.tops = [[value]], [value]
            return
        k = min(bisect_left(self.tops, value), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, value)
        self.tops[k] = block[-1]
        if len(block) > self.size:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.tops[k : k + 1] = [block[half - 1], block[-1]]

    def remove(self, value: float) -> None:
        k = bisect_left(self.tops, value)
        block = self.blocks[k]
        del block[bisect_left(block, value)]
        if block:
            self.tops[k] = block[-1]
        else:
            del self.blocks[k], self.tops[k]

    def at(self, rank: int) -> float:
        for block in self.blocks:
            if rank < len(block):
                return block[rank]
            rank -= len(block)
        raise IndexError(rank)


def rolling_quantiles(values: list[float | None], n: int, q: float) -> list[float | None]:
    """Exact quantile, with linear interpolation, of each trailing window of n values; null unless all of them are there."""
    held, known, out = SortedBlocks(2 * int(n**0.5) + 1), 0, []
    place = (n - 1) * q
    low, share = int(place), place - int(place)
    for k, v in enumerate(values):
        if v is not None:
            held.add(v)
            known += 1
        if k >= n and (gone := values[k - n]) is not None:
            held.remove(gone)
            known -= 1
        if known < n:
            out.append(None)
        else:
            a = held.at(low)
            out.append(a if not share else a + (held.at(low + 1) - a) * share)
    return out


def long_quantile(df: DataFrame, x: str, n: int, q: float, out: str, rows: Rows = Rows(), bucket: int | None = None, coarse: str = "month") -> DataFrame:
    """``df`` with the exact trailing quantile of n rows, null until n values are there, for long windows and series of any length.

    The built-in aggregate sorts each window anew. Here rows are numbered and cut into buckets of ``bucket`` rows (4 n unless given) behind copies of the
    n - 1 rows before; inside a task a row costs two changes of one sorted block of about the root of n values. Rows travel as Arrow batches; short
    windows are better served by ``Rows.quantile``.
    """
    if n < 1 or not 0 <= q <= 1:
        raise ValueError("a window has one row at least, a quantile lies between 0 and 1")
    (key,) = rows.keys
    bucket = max(bucket or 4 * n, n)
    work = with_halo(global_sequence(df.withColumn("__v", F.col(x).cast("double")), key, rows.order, coarse, "__seq"), n, bucket, "__seq")
    schema = work.drop("in_halo", "bucket", "__v").schema.add(out, "double")

    def quantiles(table: pa.Table) -> pa.Table:
        table = table.sort_by("__seq")
        found = rolling_quantiles(table["__v"].to_pylist(), n, q)
        kept = table.drop_columns(["bucket", "__v"]).append_column(out, pa.array(found, pa.float64()))
        return kept.filter(pc.invert(kept["in_halo"])).drop_columns(["in_halo"])

    return work.groupBy(key, "bucket").applyInArrow(quantiles, schema).drop("__seq")
