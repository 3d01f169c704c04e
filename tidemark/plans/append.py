"""Results over series that grow at their end: new rows are added without reading the old ones again."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import Rows
from tidemark.plans.halo import FOLDS


@dataclass(frozen=True)
class State:
    """What is kept of all rows so far: each key's last rows, and its running folds."""

    tail: DataFrame
    totals: DataFrame | None = None

    def save(self, path: str) -> None:
        """Write to a new folder; a state refers to the one before it until it is written and read again."""
        self.tail.write.parquet(f"{path}/tail")
        if self.totals is not None:
            self.totals.write.parquet(f"{path}/totals")


def load(spark: SparkSession, path: str, folds: bool = False) -> State:
    return State(spark.read.parquet(f"{path}/tail"), spark.read.parquet(f"{path}/totals") if folds else None)


def append(
    state: State | None, new: DataFrame, operator: Callable[[DataFrame, Rows], DataFrame], look_back: int, rows: Rows = Rows(), folds: Mapping[str, tuple[str, Column]] | None = None
) -> tuple[DataFrame, State]:
    """The operator's rows for ``new``, and the state behind them; ``state`` is None for the first rows of all.

    ``operator(df, rows)`` looks at ``look_back`` rows at most and passes columns through; it gets the kept rows and the new ones. ``folds``
    ``{out: (kind, x)}`` run from a series' start (kinds of ``halo.FOLDS``) and are merged with the kept ones. New rows of a key come after all
    of its rows so far. So only the new rows and ``look_back - 1`` rows a key are read, and results equal those of a run over everything.
    """
    if look_back < 1:
        raise ValueError("an operator looks at one row at least")
    folds = dict(folds or {})
    both = new.withColumn("__new", F.lit(True))
    if state is not None:
        both = state.tail.withColumn("__new", F.lit(False)).unionByName(both)
    found = operator(both, rows).where("__new").drop("__new")
    last = Window.partitionBy(*rows.keys).orderBy(F.col(rows.order).desc())
    tail = both.withColumn("__k", F.row_number().over(last)).where(F.col("__k") < look_back).drop("__k", "__new")
    if not folds:
        return found, State(tail)
    key = F.struct(*rows.keys).alias("__key")
    found = found.withColumns({out: FOLDS[kind][0](x).over(rows.run) for out, (kind, x) in folds.items()})
    added = new.groupBy(key).agg(*[FOLDS[kind][1](x, F.col(rows.order)).alias(out) for out, (kind, x) in folds.items()])
    if state is None or state.totals is None:
        return found, State(tail, added)
    kept = state.totals.select("__key", *[F.col(out).alias(f"__{out}") for out in folds])
    found = found.withColumn("__key", key).join(kept, "__key", "left").withColumns({out: FOLDS[kind][2](F.col(f"__{out}"), F.col(out)) for out, (kind, _) in folds.items()})
    totals = kept.join(added, "__key", "full").select("__key", *[FOLDS[kind][2](F.col(f"__{out}"), F.col(out)).alias(out) for out, (kind, _) in folds.items()])
    return found.drop("__key", *(f"__{out}" for out in folds)), State(tail, totals)
