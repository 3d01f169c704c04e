"""Mixing sources to target weights by hash-seeded Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, free_name, whole_text

#: A Poisson count of a larger mean is the sum of counts of equal smaller means.
PART_MEAN = 16.0
#: Steps of the distribution function of a mean up to PART_MEAN; beyond it is 1 in doubles.
STEPS = 80
#: Rates of at most so many sources are broadcast (about 1 KB each); more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def _digits(*parts: Column | str) -> Column:
    """52 bits of an MD5 over the parts, the same in every SQL engine."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    epochs: float = 1.0,
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per source: ``src, size, rate, parts, cdf``.

    ``size`` counts code points (1 at least). A source's weight is the one in ``weights`` or else
    ``size ** exponent``; the mix aims at ``epochs`` times the corpus, shared out by weight, so a source's
    documents repeat ``rate`` times on average. ``cdf`` is the distribution function of a Poisson count of
    mean ``rate / parts``.
    """
    size = docs.groupBy(F.col(source_col).alias("src")).agg(F.greatest(F.sum(F.length(whole_text(text_col))), F.lit(1)).cast("double").alias("size"))
    weight = F.pow("size", F.lit(exponent))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("src") == name, F.lit(float(value))).otherwise(weight)
    weighed = cut_lineage(size.withColumn("weight", weight))
    all_size, all_weight = weighed.agg(F.sum("size"), F.sum("weight")).first()  # two numbers
    rate = F.lit(epochs * (all_size or 0.0)) * F.col("weight") / F.lit(all_weight or 1.0) / F.col("size")
    rates = weighed.select("src", "size", rate.alias("rate"))
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all")),
        lambda s, k: F.struct(
            (s["term"] * mean / k).alias("term"),
            (s["sum"] + s["term"] * mean / k).alias("sum"),
            F.concat(s["all"], F.array(s["sum"] + s["term"] * mean / k)).alias("all"),
        ),
        lambda s: s["all"],
    )
    return rates.withColumn("cdf", cdf)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    exponent: float = 0.5,
    epochs: float = 1.0,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs`` plus ``replica`` (0, 1, ...) and ``order_key``, globally shuffled.

    A document's count inverts the Poisson distribution of its source's rate at a number hashed from the
    seed and the id, so it is the same in every run and on every cluster; rows that repeat an id repeat its
    count; where the id is null a digest of the text stands for it. A null source is a source of its own, a null text has no size. Columns of
    ``docs`` named ``replica`` or ``order_key`` are replaced. Rows are dealt to tasks by a hash of id and
    replica and sorted by ``order_key`` inside, which is a global random order written part by part; no
    source or document stays in one task.
    """
    docs = docs.drop("replica", "order_key")
    columns = docs.columns
    src, parts, cdf, n = free_name(docs, "src", "parts", "cdf", "n")
    ids = F.coalesce(F.col(id_col).cast("string"), F.md5(whole_text(text_col).cast("binary")))
    rates = cut_lineage(source_rates(docs, weights, exponent, epochs, source_col, text_col).select(
        F.col("src").alias(src), F.col("parts").alias(parts), F.col("cdf").alias(cdf)))
    side = F.broadcast(rates) if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else rates
    known = docs.join(side, F.col(source_col).eqNullSafe(F.col(src)))
    count = F.aggregate(
        F.transform(
            F.sequence(F.lit(0), F.col(parts) - 1),
            lambda part: F.size(F.filter(F.col(cdf), lambda c: c <= _digits(str(seed), ids, part) / float(1 << 52))),
        ),
        F.lit(0), lambda a, b: a + b,
    )
    copies = known.withColumn(n, count).where(F.col(n) > 0)
    copies = copies.select(*(F.col(c) for c in columns), F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("replica"))
    copies = copies.withColumn("order_key", _digits(str(seed), F.lit("order"), ids, F.col("replica")))
    return copies.repartition("order_key").sortWithinPartitions("order_key")


def oracle(exponent: float = 0.5, epochs: float = 1.0, seed: int = 7) -> str:
    """DuckDB SQL of ``mix`` over ``documents``."""
    return f"""
WITH RECURSIVE sizes AS (
  SELECT source AS src, CAST(greatest(sum(length(coalesce(text, ''))), 1) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (
  SELECT src, {epochs} * sum(size) OVER () * pow(size, {exponent}) / sum(pow(size, {exponent})) OVER () / size AS rate FROM sizes),
means AS (SELECT src, greatest(1, CAST(ceil(rate / {PART_MEAN}) AS INTEGER)) AS parts, rate / greatest(1, ceil(rate / {PART_MEAN})) AS mean FROM rates),
steps AS (
  SELECT src, parts, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS total FROM means
  UNION ALL
  SELECT src, parts, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1) FROM steps WHERE k < {STEPS}),
cdf AS (SELECT src, parts, list(total ORDER BY k) AS cdf FROM steps GROUP BY src, parts),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(parts), lambda p: len(list_filter(cdf, lambda c: c <=
    CAST(('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, ''))), CAST(p AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0)))) AS n
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.src),
copies AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(CAST(n AS BIGINT))) AS INTEGER) AS replica FROM drawn)
SELECT *, CAST(('0x' || substr(md5(concat_ws(':', '{seed}', 'order', coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))), CAST(replica AS VARCHAR))), 1, 13)) AS BIGINT) AS order_key
FROM copies"""
