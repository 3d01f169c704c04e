"""Token counts of a corpus as an exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settled, sliced, whole_text

#: Lengths summed in one window partition; only sums per block meet in one task.
BLOCK = 1024
_ENCODERS: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    """A byte-level encoder from a ranks file, kept for the life of the worker."""
    if (path, pattern) not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        _ENCODERS[path, pattern] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def token_lengths(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens`` of every row: whole texts, a null text has none, special tokens are ordinary text.

    ``path`` is the ranks file, found under the same path on every machine; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern).encode_ordinary
        for part in sliced(batches, 1):
            counts = pa.array([len(encode(t.as_py())) for t in part.column(1)], pa.int64())
            yield pa.record_batch([part.column(0), counts], names=[id_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), whole_text(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, with suffix sums; any table with a long ``n_tokens`` will do.

    ``n_docs`` of just this length; ``docs_at_least, tokens_at_least`` of this length or more;
    ``truncated_tokens``, the total if every document were cut to this length; ``share_within``, the share
    of documents of at most this length; ``total_docs, total_tokens`` of the corpus. Exact. An empty table
    gives an empty result, a null length is left out.
    """
    counts = lengths.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counts, _ = settled(counts)  # read twice below, and as small as the longest document allows
    counts = counts.withColumn("block", F.expr(f"n_tokens div {BLOCK}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(everywhere).alias("total_docs"), F.sum("t").over(everywhere).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(blocks, "block").select(
        "n_tokens", "n_docs",
        (F.sum("n_docs").over(within) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("tokens_above")).alias("tokens_at_least"),
        "total_docs", "total_tokens",
    )
    return rows.withColumn(
        "truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    ).withColumn("share_within", (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row ``n_tokens``: the smallest length that a share ``q`` of the documents stays within."""
    return histogram.where(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``context_limit, n_docs_cut, truncated_tokens`` for any limits, from the histogram alone."""
    sums = [
        F.struct(
            F.lit(int(x)).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs"))), F.lit(0)).alias("n_docs_cut"),
            F.coalesce(F.sum(F.least("n_tokens", F.lit(int(x))) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
        )
        for x in limits
    ]
    return histogram.agg(F.array(*sums).alias("answers")).select(F.inline("answers"))
