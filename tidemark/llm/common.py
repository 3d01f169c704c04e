"""Shared helpers: the shared checkpoint folder and null-safe text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset and Spark runs in one process
    (tests, a laptop) is a temporary folder made; the session then remembers it as its checkpoint folder. On a
    cluster an unset folder is an error, since machines do not see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return named or sc.getCheckpointDir()


_open_scratches: list[list[str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; inside a ``scratch`` it goes when that ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _open_scratches:
        _open_scratches[-1].append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders made inside go at its end. What was built inside must be written out by then, since it reads them."""
    _open_scratches.append([])
    try:
        yield
    finally:
        for path in _open_scratches.pop():
            drop_folder(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back; unlike a checkpoint it is compressed and has a known size."""
    df.write.parquet(path := new_folder(df.sparkSession, label))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, kept in the shared folder, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a narrow table that one partition holds.
ROWS_A_PARTITION = 100_000


def settled(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """A narrow table, checkpointed and put into as few partitions as its size asks for, and its row count.

    Steps over a table that fits one partition then need no shuffle; a large one keeps its partitions.
    """
    if rows is None:
        df = cut_lineage(df)
        rows = df.count()
    return df.coalesce(rows // ROWS_A_PARTITION + 1), rows


#: Rows of a narrow table (under 100 bytes each) that are broadcast at most.
BROADCAST_ROWS = 50_000


def lookup(df: DataFrame) -> DataFrame:
    """A narrow table to join with: counted first, broadcast if small, else left to a shuffle join that can split skew."""
    df, rows = settled(df)
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batch, column: int, limit: int = 4 << 20):
    """Runs of rows of an Arrow batch with about ``limit`` bytes of text each, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def sliced(batches, column: int, limit: int = 4 << 20):
    """All batches cut as by ``slices``; empty ones give nothing."""
    for batch in batches:
        yield from slices(batch, column, limit)
