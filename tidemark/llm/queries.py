"""Queries of the operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, dialogue, html_text, lines, media, mixing, pii, repetition, simhash, token_histogram, urls, vector_codes, vector_near


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.score_quality(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, kind)).alias(kind) for kind in pii.BASE_KINDS]
    counts = [(F.size(base) - n).cast("long").alias(f"n_{kind}") for kind, n in zip(pii.BASE_KINDS, counts)]
    return found.select("doc_id", *counts, _sha256(pii.span_text(base)).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op5_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lengths = token_histogram.token_lengths(_table(spark, sf_dir, "documents"), str(path), public_tokenizers.PATTERN)
    return token_histogram.length_histogram(lengths)


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Of every document the number of its tokens, and digests of the ids and of the text they decode to."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha256(ids).alias("ids_sha256"), _sha256(F.col("decoded")).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(_table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_columns(_table(spark, sf_dir, "documents"))
    return stored.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"),
        F.lower(F.hex("media_sha256")).alias("media_sha256"), "feature", "width", "height",
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 with a redirect table made of the pages' own addresses, so that verdicts pass between them."""
    pages = _table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, redirects=urls.story_redirects(pages))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op11_vector_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near.near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damage(_table(spark, sf_dir, "conversations")), dropped_col="dropped")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_token_histogram": op5_token_histogram,
    "op6_bpe": op6_bpe,
    "op7_media": op7_media,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_html_text": op10_html_text,
    "op11_vector_near": op11_vector_near,
    "op12_dialogue_repair": op12_dialogue_repair,
    "op13_vector_codes": op13_vector_codes,
    "url_redirects": url_redirects,
}

#: The others are beyond SQL (XXH64, suffix arrays, tokenizers, images, HTML); tests/llm has brute-force versions.
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.oracle(),
    "op8_line_dedup": lines.oracle(),
    "op9_url_filter": urls.oracle(),
    "op11_vector_near": vector_near.oracle(),
    "op12_dialogue_repair": dialogue.oracle(),
    "op13_vector_codes": vector_codes.oracle(),
    "url_redirects": urls.oracle(redirected=True),
}
