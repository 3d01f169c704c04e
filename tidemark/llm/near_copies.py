"""Groups of near copies by the exact Jaccard similarity of word shingles, with candidates from tries of wide SimHash fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, whole_text, written
from tidemark.llm.components import connected_components, with_least
from tidemark.llm.wide_prints import near_links, wide_prints

#: At most so many texts (digests of 16 bytes) are broadcast; more are joined by shuffle.
BROADCAST_TEXTS = 500_000
#: Nodes of a band, and shingles of theirs (8 bytes each), that one task compares with each other or with so many more.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Shingles that are counted at a time.
COUNTED = 1 << 20
#: Distinct shingles whose bits are compared at a time.
COLUMNS = 1 << 15


def shingle_set(text: str, shingle_words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles, with words as in ``simhash.fingerprint``.

    Fewer words than a shingle: the whole sequence is one. No word: empty.
    """
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hash_of = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]
    return np.unique(np.fromiter((hash_of(g, 42) for g in grams), np.uint64))


def digest(members: np.ndarray) -> bytes:
    """What stands for a set: 128 bits, so that no two sets of a corpus are taken for one."""
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _sketched(texts: DataFrame, id_type: str, shingle_words: int) -> DataFrame:
    """``doc_id, text_key, node, n, print``: a row's text, the digest and size of its set, and its fingerprint (null of an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 2, 1 << 20):
            sets = [shingle_set(t.as_py(), shingle_words) for t in part.column(2)]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            prints = pa.array([p.tobytes() if len(s) else None for p, s in zip(wide_prints(sets), sets)], pa.binary())
            columns = [part.column(0), part.column(1), pa.array([digest(s) for s in sets], pa.binary()), sizes, prints]
            yield pa.record_batch(columns, names=["doc_id", "text_key", "node", "n", "print"])

    return texts.mapInArrow(run, f"doc_id {id_type}, text_key binary, node binary, n long, print binary")


def _sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """``node, members`` of rows ``text_key, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1, 1 << 20):
            sets = [shingle_set(t.as_py(), shingle_words) for t in part.column(1)]
            yield pa.record_batch([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "members"])

    return texts.mapInArrow(run, "node binary, members array<long>")


def _members(nodes: DataFrame, texts: DataFrame, keys: DataFrame, shingle_words: int) -> DataFrame:
    """``node, members`` of the given nodes, ``keys`` having one ``text_key`` per ``node``.

    Sets are built anew, of the texts in question only: first these are picked where they lie, then one copy of each goes on.
    """
    ends = written(nodes.distinct().join(keys, "node").select("text_key"), "near-ends")
    few = ends.count() <= BROADCAST_TEXTS
    used = texts.select("text_key", "text").join(F.broadcast(ends) if few else ends, "text_key", "left_semi")
    return written(_sets(used.groupBy("text_key").agg(F.any_value("text").alias("text")), shingle_words), "near-sets")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs ``src, dst`` whose sets have a similarity of ``least`` or more."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"{c}_set"))
    joined = pairs.join(side("src"), "src").join(side("dst"), "dst")
    both = F.size(F.array_intersect("src_set", "dst_set"))
    return written(joined.where(both >= F.lit(least) * (F.size("src_set") + F.size("dst_set") - both) - 1e-9).select("src", "dst"), "near-links")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``, as counts of bits that rows of bits share.

    Values are hashes, so equal ranges of them hold about equally many; ranges of about ``COUNTED`` values are counted one after the other.
    """
    both = [*left, *right]
    total = np.zeros((len(left), len(right)), np.int64)
    ranges = sum(map(len, both)) // COUNTED + 1
    edges = [k * (1 << 64) // ranges for k in range(1, ranges)]
    cuts = [[0, *np.searchsorted(s, np.array(edges, np.uint64)).tolist(), len(s)] for s in (x.view(np.uint64) for x in both)]
    for k in range(ranges):
        _count([s[c[k] : c[k + 1]] for s, c in zip(both, cuts)], total)
    return total


def _count(both: list[np.ndarray], total: np.ndarray) -> None:
    """Adds what the first sets share with the others to ``total``."""
    first = len(total)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, code, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # a value that stands once is shared by none
    keep = times[code] > 1
    owner, code = owner[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for begin in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [begin, begin + COLUMNS])
        bit = (code[a:b] - begin).astype(np.uint64)
        rows = np.zeros((len(both), -(-(int(bit[-1]) + 1) // 64)), np.uint64)
        np.bitwise_or.at(rows, (owner[a:b], bit >> np.uint64(6)), np.uint64(1) << (bit & np.uint64(63)))
        for i in range(first):
            total[i] += np.bitwise_count(rows[first:] & rows[i]).sum(axis=1, dtype=np.int64)


def forest(left: list[np.ndarray], right: list[np.ndarray] | None, roots: list, least: float) -> Iterator[tuple[int, int]]:
    """Links that join all groups of alike sets: positions in ``left`` then ``right``, whose groups so far are ``roots``.

    All pairs of a set of ``left`` and one of ``right`` (or two of ``left``) are compared; those of one group give no link.
    """
    other = left if right is None else right
    offset = 0 if right is None else len(left)
    both = shared_counts(left, other)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in other])[None, :] - both
    alike = both >= least * sizes - 1e-6
    names: dict = {}
    group = np.array([names.setdefault(r, len(names)) for r in roots])
    for i in range(len(left)):
        found = np.nonzero(alike[i] & (group[offset : offset + len(other)] != group[i]))[0] + offset
        for label, first in zip(*np.unique(group[found], return_index=True)):
            yield i, int(found[first])
            group[group == label] = group[i]


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows that agree in ``names``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)))
        begin = 0
        for k, key in enumerate(keys):
            if key != last:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], k, key
        if len(keys) > begin:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _alike_in_bands(bands: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links ``src, dst`` that join all alike nodes of a band (rows ``key, node, n, root``) whose roots differ.

    Nodes of the band's largest group need not be compared with each other, so they are dealt out in blocks of their own; blocks of the
    other nodes meet each other and these. A block has about BLOCK nodes and BLOCK_SHINGLES shingles, whichever are fewer, and each pair of blocks is
    compared in one task, by exact counts of shared shingles. Pairs stay inside the task: only links that join groups come back. Work grows
    with a band's nodes times those outside its largest group.
    """
    groups = bands.groupBy("key", "root").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    totals = groups.groupBy("key").agg(F.max(F.struct("size", "shingles", "root")).alias("big"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"))
    blocks = lambda size, shingles: F.greatest(F.ceil(size / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    totals = totals.select("key", F.col("big.root").alias("major"), blocks(F.col("big.size"), F.col("big.shingles")).alias("majors"), blocks(F.col("size") - F.col("big.size"), F.col("shingles") - F.col("big.shingles")).alias("others"))
    rows = bands.join(totals, "key")
    major = F.col("root") == F.col("major")
    place = F.pmod(F.xxhash64("node"), F.when(major, F.col("majors")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("block", F.when(major, F.col("others") + place).otherwise(place))  # those of the largest group are numbered last
    last = F.when(major, F.col("others") - 1).otherwise(F.col("others") + F.col("majors") - 1)
    rows = rows.select("key", "node", "root", "block", F.explode(F.sequence(F.lit(0), last)).alias("with"))
    rows = rows.select("key", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), (F.col("block") > F.col("with")).alias("second"), "node", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["key", "p", "q"]):
            one = table["p"][0] == table["q"][0]
            second = table["second"].to_numpy(zero_copy_only=False)
            order = np.argsort(second, kind="stable")
            first = len(order) if one else int((~second).sum())
            if len(order) > 1 and (one or 0 < first < len(order)):
                nodes, roots = (np.array(table[c].to_pylist(), object)[order].tolist() for c in ("node", "root"))
                column = table["members"].combine_chunks()
                members = [column[int(k)].values.to_numpy().view(np.uint64) for k in order]
                links = list(forest(members[:first], None if one else members[first:], roots, least))
                if links:
                    yield pa.record_batch([pa.array([nodes[i] for i, _ in links], pa.binary()), pa.array([nodes[j] for _, j in links], pa.binary())], names=["src", "dst"])

    tasks = rows.join(sets, "node").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return written(tasks.mapInArrow(run, "src binary, dst binary"), "near-links")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """``id_col, component_id``: every row with the smallest id of its group.

    Two texts are linked if the Jaccard similarity of their shingle sets is ``least`` or more; groups are closed
    transitively; texts without words are alike. Candidates are the components (below: bands) of the links that the tries of
    ``wide_prints`` find between SimHash fingerprints. Each is compared with the first of its band first; then all nodes of
    a band that are not in one group yet are compared, however many a band holds. Rows with equal sets are one node (a 128-bit digest), so exact copies cost nothing.
    Repeated rows stay repeated; a null id takes no part in the minimum. ``docs`` is read up to three times.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(whole_text(text_col).cast("binary"))).alias("text_key"), whole_text(text_col).alias("text"))
    rows = written(_sketched(texts, docs.schema[id_col].dataType.simpleString(), shingle_words), "near-rows")
    keys = written(rows.groupBy("node").agg(F.min("text_key").alias("text_key"), F.min("doc_id").alias("first")), "near-nodes")
    nodes = written(rows.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("print").alias("print")).withColumn("id", F.xxhash64("node")), "near-prints")
    near = connected_components(near_links(nodes.where("n > 0").select("id", "print")))  # nodes of equal ids would only be compared once more
    banded = written(nodes.join(near.select(F.col("node").alias("id"), F.col("root").alias("key")), "id").select("key", "node", "n"), "near-bands")
    fits = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-6

    head = F.struct("node", "n")
    stars = with_least(banded.withColumn("head", head), "key", "head", "node", "m").where(F.col("node") != F.col("m.node"))
    tried = written(stars.where(fits(F.col("n"), F.col("m.n"))).select(F.col("m.node").alias("src"), F.col("node").alias("dst")).distinct(), "near-tried")
    node_keys = keys.select("node", "text_key")
    sets = _members(tried.select(F.explode(F.array("src", "dst")).alias("node")), texts, node_keys, shingle_words)
    links = _alike(tried, sets, least)

    placed = connected_components(links)
    marked = written(banded.join(placed, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "near-marked")
    mixed = marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = written(marked.join(mixed, "key"), "near-mixed")
    more = _members(left.select("node"), texts, node_keys, shingle_words)
    links = links.unionByName(_alike_in_bands(left, more, least))

    firsts = keys.select("node", "first")
    named = with_least(connected_components(links).join(firsts, "node"), "root", "first", "node", "component_id").select("node", "component_id")
    known = written(firsts.join(named, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id")), "near-known")
    return rows.select("doc_id", "node").join(known, "node").select(F.col("doc_id").alias(id_col), "component_id")
