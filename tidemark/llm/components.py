"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, settled


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("u"), F.col("dst").alias("v")),
                F.struct(F.col("dst").alias("u"), F.col("src").alias("v")),
            )
        ).alias("e")
    ).select("e.u", "e.v")


def with_least(rows: DataFrame, key: str, value: str, spread: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the smallest ``value`` of their ``key``.

    A key may hold any share of the rows: minima are combined before their shuffle, and come back by key and
    one of 64 parts (a hash of ``spread``), only to the parts that the key has rows in. So a hot key's rows
    spread over up to 64 tasks, and the minima are never more than the rows.
    """
    rows = rows.withColumn("__part", F.expr(f"cast(pmod(xxhash64(`{spread}`), 64) AS int)"))
    least = rows.groupBy(key).agg(F.min(value).alias(out), F.bit_or(F.expr("shiftleft(1L, __part)")).alias("__parts"))
    parts = F.explode(F.expr("filter(sequence(0, 63), k -> getbit(__parts, k) = 1)")).alias("__part")
    return rows.join(least.select(key, out, parts), [key, "__part"]).drop("__part")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node around it."""
    near = with_least(_both_ways(edges), "u", "v", "v", "m")
    return near.where("v > u").select(F.col("v").alias("src"), F.least("u", "m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    down = with_least(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")), "u", "v", "v", "m")
    # the row of the smallest neighbour itself stands for the node
    return down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("src"), F.col("m").alias("dst")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has ``src`` and ``dst`` of one orderable type. Self-loops, repeated edges and nulls
    are ignored. Returns ``node, root`` for every node on an edge, the root being the smallest node of
    its component; an empty edge table gives an empty result. Each round only takes minima per node
    (combined before the shuffle) and joins them back in parts, so a hub never gathers its neighbours in one
    group or task. Rounds grow with the logarithm of the graph, and each is
    checkpointed.
    """
    stars = cut_lineage(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    )
    mark = _fingerprint(stars)
    stars, _ = settled(stars, mark[0])
    while mark[0]:
        stars = cut_lineage(_small_star(_large_star(stars)))
        last, mark = mark, _fingerprint(stars)
        stars, _ = settled(stars, mark[0])
        if mark == last:
            break
    return stars.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(
        stars.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and an order-free hash: equal when a round changed nothing."""
    return tuple(
        edges.agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("src", "dst")).alias("x"),
            F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s"),
        ).first()
    )
