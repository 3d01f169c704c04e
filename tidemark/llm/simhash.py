"""SimHash fingerprints and near-duplicate groups by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, free_name, settled, sliced, whole_text
from tidemark.llm.components import connected_components, with_least

#: Hash values whose bits are counted at a time.
HASH_BLOCK = 1 << 16
#: Node pairs that a task expands at a time.
PAIR_BLOCK = 1 << 19
#: Two ranges whose product is at most this are compared directly.
DIRECT = 16
#: A list of up to so many node pairs (about 50 bytes each) is broadcast; a longer one is joined by shuffle.
BROADCAST_PAIRS = 50_000


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """Majority bits of XXH64 (seed 42) over word shingles, as a signed 64-bit number.

    A-Z are lower-cased, words are runs of anything but ASCII white space, repeated shingles count
    each time. Fewer words than a shingle: the whole sequence is one. No word: zero.
    """
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle_words + 1)
    hash_of = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]
    values = np.fromiter((hash_of(g, 42) for g in grams), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, HASH_BLOCK):
        block = values[at : at + HASH_BLOCK]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > count, bitorder="little").view(np.int64)
    return int(majority[0])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``id_col, fp`` (long) of every row; a null text counts as empty, ids are of any type and may repeat or be null."""
    kept = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            prints = [fingerprint(t.as_py(), shingle_words) for t in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return kept.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long").withColumnRenamed("doc_id", id_col)


# --- trie self-join inside one pair of subtrees -------------------------------------------------


def _roots(n: int, src: list[np.ndarray], dst: list[np.ndarray]) -> np.ndarray:
    """Smallest index reachable over the links, by hooking and pointer jumping."""
    root = np.arange(n)
    a, b = np.concatenate(src), np.concatenate(dst)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if not (differs := low != high).any():
            return root
        np.minimum.at(root, high[differs], low[differs])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two subtrees (or inside one, ``right`` None).

    Both hold sorted distinct fingerprints that share their first ``depth`` bits up to ``errors``
    differing ones. A node is a range of the sorted values; a pair of nodes is split on the next bit
    into its four child pairs, the two crossing ones one error dearer, and dropped beyond ``budget``.
    Pairs are expanded depth first in blocks, so memory stays bounded however many fingerprints are alike.
    """
    both = left if right is None else np.concatenate([left, right])
    start = (0, len(left), 0, len(left)) if right is None else (0, len(left), len(left), len(both))
    splits: dict[int, np.ndarray] = {}

    def middle(lo: np.ndarray, hi: np.ndarray, t: int) -> np.ndarray:
        """Where the values of each range with bit t set begin; 63 - t counts from the low end."""
        if t not in splits:
            bit = (both >> np.uint64(63 - t)) & np.uint64(1)
            splits[t] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return hi - (splits[t][hi] - splits[t][lo])

    src: list[np.ndarray] = []
    dst: list[np.ndarray] = []
    held = 0
    stack = [(depth, *(np.array([x]) for x in start), np.array([errors]))]
    while stack:
        t, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > PAIR_BLOCK:
            half = len(alo) // 2
            stack += [(t, *(x[half:] for x in (alo, ahi, blo, bhi, err))), (t, *(x[:half] for x in (alo, ahi, blo, bhi, err)))]
            continue
        size = (ahi - alo) * (bhi - blo)
        if (small := (size <= DIRECT) | (t >= 64)).any():
            n, width = size[small], (bhi - blo)[small]
            pair = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = alo[small][pair] + k // width[pair], blo[small][pair] + k % width[pair]
            near = (np.bitwise_count(both[i] ^ both[j]) <= budget) & (i < j)
            src.append(i[near])
            dst.append(j[near])
            held += len(src[-1])
            if held > 4 * PAIR_BLOCK + 2 * len(both):
                root = _roots(len(both), src, dst)
                linked = np.nonzero(root != np.arange(len(both)))[0]
                src, dst, held = [linked], [root[linked]], len(linked)
        big = ~small
        if not big.any():
            continue
        alo, ahi, blo, bhi, err = (x[big] for x in (alo, ahi, blo, bhi, err))
        amid, bmid = middle(alo, ahi, t), middle(blo, bhi, t)
        same = (alo == blo) & (ahi == bhi)
        children = [
            (alo, amid, blo, bmid, err, None),
            (amid, ahi, bmid, bhi, err, None),
            (alo, amid, bmid, bhi, err + 1, None),
            (amid, ahi, blo, bmid, err + 1, ~same),  # of a node with itself, one crossing pair is enough
        ]
        parts = []
        for a0, a1, b0, b1, e, extra in children:
            keep = (a1 > a0) & (b1 > b0) & (e <= budget)
            keep = keep if extra is None else keep & extra
            parts.append([x[keep] for x in (a0, a1, b0, b1, e)])
        if len(found := [np.concatenate(x) for x in zip(*parts)]) and len(found[0]):
            stack.append((t + 1, *found))
    if not held:
        none = np.zeros(0, np.uint64)
        return none, none
    root = _roots(len(both), src, dst)
    linked = np.nonzero(root != np.arange(len(both)))[0]
    return both[linked], both[root[linked]]


def _join_group(table: pa.Table, budget: int) -> pa.Table:
    """One pair of subtrees: rows ``depth, errors, side, fp``."""
    depth, errors = table.column("depth")[0].as_py(), table.column("errors")[0].as_py()
    side = table.column("side").to_numpy()
    fp = table.column("fp").to_numpy().view(np.uint64)
    left, right = np.unique(fp[side == 0]), np.unique(fp[side == 1])
    src, dst = trie_links(left, right if (side == 1).any() else None, depth, errors, budget)
    return pa.table({"src": pa.array(src.view(np.int64), pa.int64()), "dst": pa.array(dst.view(np.int64), pa.int64())})


def subtree_members(prints: DataFrame, budget: int, leaf: int, step: int = 4, exact: int = 0) -> DataFrame:
    """Rows ``depth, a, b, errors, side`` and those of ``prints``: which pairs of subtrees a fingerprint belongs to.

    ``prints`` has longs in ``fp``. The trie is walked from its root ``step`` bits at a time as a
    DataFrame of node pairs with their accumulated errors; pairs over the budget go, pairs of at most
    ``leaf`` fingerprints a side become one task each, larger ones go deeper. So a task's share is bounded
    whatever the bits look like, and a fingerprint is copied to as many tasks as its node has neighbours
    within the budget. With ``exact`` the walk begins at the nodes that many bits deep, none of which may differ.
    """
    low = (1 << step) - 1
    masks = F.array(*(F.lit(m).cast("long") for m in range(1 << step) if m.bit_count() <= budget))
    large, ready, depth = None, [], exact
    if exact:
        nodes = prints.groupBy(F.shiftrightunsigned("fp", 64 - exact).alias("a")).agg(F.count("*").alias("n")).where("n > 1")
        pairs, _ = settled(nodes.select("a", F.col("a").alias("b"), F.lit(0).alias("errors"), (F.col("n") > leaf).alias("large")))
        ready.append((exact, pairs.where("not large").select("a", "b", "errors")))
        large = pairs.where("large").select("a", "b", "errors")
    while depth < 64 and (large is None or not large.isEmpty()):
        depth += step
        nodes = prints.groupBy(F.shiftrightunsigned("fp", 64 - depth).alias("node")).agg(F.count("*").alias("n"))
        nodes, _ = settled(nodes)
        if large is None:
            one = nodes.select("node", "n", F.lit(0).cast("long").alias("up"), F.lit(0).alias("spent"))
        else:
            one = nodes.join(large, F.shiftrightunsigned("node", step) == F.col("a")).select("node", "n", F.col("b").alias("up"), F.col("errors").alias("spent"))
        pairs = (
            one.withColumn("mask", F.explode(masks))
            .select(
                F.col("node").alias("a"), F.col("n").alias("an"),
                F.shiftleft("up", step).bitwiseOR(F.col("node").bitwiseAND(low).bitwiseXOR(F.col("mask"))).alias("b"),
                (F.col("spent") + F.bit_count("mask")).cast("int").alias("errors"),
            )
            .where((F.col("errors") <= budget) & (F.expr(f"shiftrightunsigned(a, {step}) <> shiftrightunsigned(b, {step})") | (F.col("a") <= F.col("b"))))
            .join(nodes.select(F.col("node").alias("b"), F.col("n").alias("bn")), "b")
            .select("a", "b", "errors", (F.greatest("an", "bn") > leaf).alias("large"))
        )
        pairs, _ = settled(pairs)
        done = pairs if depth == 64 else pairs.where("not large")
        ready.append((depth, done.select("a", "b", "errors")))
        large = pairs.where("large").select("a", "b", "errors")
    members = None
    for depth, tasks in ready:
        here = lambda side: F.struct(F.col("ab"[side]).alias("node"), F.lit(side).alias("side"))
        sides = tasks.select("a", "b", "errors", F.explode(F.when(F.col("a") == F.col("b"), F.array(here(0))).otherwise(F.array(here(0), here(1)))).alias("s"))
        sides, count = settled(sides.select(F.lit(depth).alias("depth"), "a", "b", "errors", "s.node", "s.side"))
        sides = F.broadcast(sides) if count <= BROADCAST_PAIRS else sides
        rows = prints.withColumn("node", F.shiftrightunsigned("fp", 64 - depth)).join(sides, "node")
        rows = rows.select("depth", "a", "b", "errors", "side", *prints.columns)
        members = rows if members is None else members.unionByName(rows)
    return members


def hamming_links(prints: DataFrame, budget: int = 2, leaf: int = 1 << 16, step: int = 4) -> DataFrame:
    """Links ``src, dst`` (long) that connect all fingerprints at ``budget`` or fewer differing bits.

    ``prints`` has distinct longs in ``fp``. Each pair of subtrees (``subtree_members``) is one task, which returns a spanning forest of
    its links, not all pairs.
    """
    members = subtree_members(prints.select("fp"), budget, leaf, step)
    return members.groupBy("depth", "a", "b").applyInArrow(lambda table: _join_group(table, budget), "src long, dst long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, budget: int = 2, leaf: int = 1 << 16
) -> DataFrame:
    """``id_col, fp, component_id``: every row with its fingerprint and its group's smallest id.

    Fingerprints at ``budget`` or fewer differing bits are linked, groups are closed transitively, texts
    without words share fingerprint zero. Repeated rows stay repeated; a null id takes no part in the
    minimum (a group of null ids only has a null component). An empty table gives an empty result. Further
    columns of ``docs`` are not read.
    """
    marked = cut_lineage(simhash(docs, id_col, text_col, shingle_words).select(F.col(id_col).alias("doc_id"), "fp"))
    prints = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(hamming_links(prints.select("fp"), budget, leaf))
    placed = linked.select(F.col("node").alias("fp"), "root").join(prints, "fp")
    named = with_least(placed, "root", "least", "fp", "component_id").select("fp", "component_id")
    # written out, so that both sides of the last join are plain exchanges and a hot fingerprint can be split
    known = cut_lineage(prints.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(known, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **options) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of their near-duplicate group; columns as they were.

    Without ``similarity`` groups are those of ``near_duplicates`` (fingerprints within a bit budget). With it, texts
    are linked at that Jaccard similarity of their word shingles or more, five words unless ``shingle_words`` says
    otherwise: fingerprints then have 256 bits and several tries, whose links ``near_copies`` checks exactly.
    Rows that repeat one id stand or fall together; rows with a null id cannot be told apart and stay
    only if a whole group has none.
    """
    from tidemark.llm.near_copies import near_copies  # which walks the trie of this module

    groups = near_duplicates(docs, id_col, text_col, **options) if similarity is None else near_copies(docs, id_col, text_col, least=similarity, **options)
    (name,) = free_name(docs, "keep")
    keep = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(name)).distinct()
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
