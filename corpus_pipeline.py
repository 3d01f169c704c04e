"""A corpus pipeline of five of the training-data operators, each stage over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import drop_folder, new_folder, scratch
from tidemark.llm.lines import dedup_lines
from tidemark.llm.mixing import mix
from tidemark.llm.simhash import keep_one_per_group
from tidemark.llm.queries import encoded_digests
from tidemark.llm.repetition import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that spread over sites; ``n_chars`` follows the text."""
    cut = dedup_lines(docs)
    return cut.selectExpr(*("length(text) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns)).to(docs.schema)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a similarity of 0.8 or more over five-word shingles."""
    return keep_one_per_group(docs, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their weights, in global random order."""
    return mix(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, one row per repeated document."""
    return encoded_digests(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("source mixing", mixing),
    ("bpe encoding", encoding),
]

#: Suffix arrays and tokenizers are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written as Parquet to the shared folder and read again.

    What a stage has written for itself goes once its result is written, and so does the result before it. The last stage's input and
    its own helper tables stay, since the returned table reads them.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_folder(spark, f"stage{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            drop_folder(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
