"""SimHash fingerprints of 256 bits and links between them by tries over several orders of their bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.simhash import PAIR_BLOCK, _roots, subtree_members

#: Longs of a fingerprint. At a Jaccard similarity of 0.8 about 0.15 of the bits differ, 39 of 256 (standard deviation 5.7).
WORDS = 4
#: Most bits that linked fingerprints differ in, and most of their first two longs'. Unlike texts differ in 128 (8) and 64 (6).
BUDGET, HALF_BUDGET = 72, 46
#: Bits that a trie takes without an error before its walk begins. The bits in a random order are cut into 32 such pieces, and each
#: piece with the bits behind it is the order of one trie, so that fingerprints which differ in 31 bits or fewer agree in some piece.
EXACT = 8
#: Random orders of the bits, each for 32 tries.
ORDERS = 2
#: Bits of an order that a key keeps, below the 8 bits of the trie's number.
KEY = 56
#: Errors allowed below the exact bits while subtrees are larger than a leaf, and one more for each 8 bits in a task.
ERRORS = 2
#: Fingerprints of a leaf, which are compared directly, and of a pair of subtrees a side in one task.
LEAF, SUBTREE = 512, 1 << 16
#: Fingerprints of a task from which on those near one of so many pivots are linked to it and not compared with each other.
DENSE, PIVOTS = 2048, 4

_BITS = 64 * WORDS
_rng = np.random.default_rng(42)
_TURNS = [np.roll(order, -k) for order in (_rng.permutation(_BITS) for _ in range(ORDERS)) for k in range(0, _BITS, EXACT)]
_TRIES = np.stack(_TURNS)[:, :KEY]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _word(values: np.ndarray, k: int) -> np.ndarray:
    """The hashes themselves for the first long, which so is the fingerprint of ``simhash`` over distinct shingles; mixed anew for others."""
    if not k:
        return values
    z = values + np.uint64(k * int(_MIX[0]) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * _MIX[1]
    z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return z ^ (z >> np.uint64(31))


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of ``WORDS`` unsigned longs: bits set in over half of a set's hashes; zero of an empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ones = np.zeros((len(sets), WORDS, 64), np.int64)
    values = np.concatenate([*sets, np.zeros(0, np.uint64)])
    pieces = -(-sizes // 255)  # so many rows of bits are counted in one byte
    owner = np.repeat(np.arange(len(sets)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.append((np.cumsum(sizes) - sizes)[owner] + 255 * nth, len(values))
    for at in range(0, len(owner), 256):
        last = min(at + 256, len(owner))
        block = values[begin[at] : begin[last]]
        for k in range(WORDS):
            bits = np.unpackbits(np.ascontiguousarray(_word(block, k)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones[:, k], owner[at:last], np.add.reduceat(bits, begin[at:last] - begin[at], axis=0, dtype=np.uint8))
    return np.packbits(ones * 2 > sizes[:, None, None], axis=2, bitorder="little").view(np.uint64).reshape(len(sets), WORDS)


def trie_keys(prints: np.ndarray) -> np.ndarray:
    """The keys (signed longs) of each fingerprint in all tries: the trie's number, then its first bits in that trie's order."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    keys = np.zeros((len(prints), len(_TRIES), 8), np.uint8)
    keys[:, :, 0] = np.arange(len(_TRIES))
    keys[:, :, 1:] = np.packbits(bits[:, _TRIES], axis=2)
    return keys.view(">i8")[:, :, 0].astype(np.int64)


def _leaves(keys: np.ndarray, other: np.ndarray | None, depth: int, errors: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of two subtrees with sorted keys (of one with itself, ``other`` None) whose leaves are within the errors."""
    right = keys if other is None else other
    stack = [(depth, errors, 0, len(keys), 0, len(right))]
    while stack:
        t, spent, alo, ahi, blo, bhi = stack.pop()
        if ahi == alo or bhi == blo or spent > ERRORS + (t - 8 - EXACT) // 8:
            continue
        if t >= 64 or max(ahi - alo, bhi - blo) <= LEAF:
            yield alo, ahi, blo, bhi
            continue
        bit = np.uint64(1 << (63 - t))
        amid = alo + int(np.searchsorted(keys[alo:ahi] & bit, bit))
        bmid = blo + int(np.searchsorted(right[blo:bhi] & bit, bit))
        stack += [(t + 1, spent, alo, amid, blo, bmid), (t + 1, spent, amid, ahi, bmid, bhi), (t + 1, spent + 1, alo, amid, bmid, bhi)]
        if other is not None or (alo, ahi) != (blo, bhi):  # of a node with itself, one crossing pair is enough
            stack.append((t + 1, spent + 1, amid, ahi, blo, bmid))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _alike_leaves(keys: np.ndarray, prints: np.ndarray, others: np.ndarray | None, right: np.ndarray | None, depth: int, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of alike fingerprints of two subtrees, or of one: all pairs of leaves, by the first two longs, then by all."""
    left = np.ascontiguousarray(prints.T)
    right = left if right is None else np.ascontiguousarray(right.T)
    xor, spent = np.empty(128 * LEAF, np.uint64), np.empty((2, 128 * LEAF), np.uint8)
    for alo, ahi, blo, bhi in _leaves(keys, others, depth, errors):
        own = others is None and alo == blo
        for at in range(alo, ahi, 128):
            end = min(at + 128, ahi)
            for by in range(at if own else blo, bhi, LEAF):
                until = min(by + LEAF, bhi)
                shape = end - at, until - by
                x, counts, more = xor[: shape[0] * shape[1]].reshape(shape), *(c[: shape[0] * shape[1]].reshape(shape) for c in spent)
                np.bitwise_count(np.bitwise_xor(left[0, at:end, None], right[0, by:until], out=x), out=counts)
                np.bitwise_count(np.bitwise_xor(left[1, at:end, None], right[1, by:until], out=x), out=more)
                i, j = np.divmod(np.flatnonzero(np.add(counts, more, out=counts) <= HALF_BUDGET), shape[1])
                i, j = i + at, j + by
                if own:
                    i, j = i[keep := i < j], j[keep]
                near = np.bitwise_count(left[:, i] ^ right[:, j]).sum(axis=0, dtype=np.int64) <= BUDGET
                if near.any():
                    yield i[near], j[near]


def print_links(keys: np.ndarray, prints: np.ndarray, first: int, depth: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``src, dst`` that join what is alike in two subtrees, the first ``first`` positions and the rest (or one, if there is no rest).

    Linked are fingerprints whose leaves are within the errors and that differ in ``BUDGET`` bits or fewer. What lies near one of a few
    pivots is linked to it, and is compared with what does not, so that a large group of near copies is no work of all its pairs.
    """
    n, one = len(keys), first == len(keys)
    src, dst, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    part = np.full(n, -1)
    for p in range(PIVOTS if n > DENSE else 0):
        if not len(free := np.nonzero(part < 0)[0]):
            break
        pivot = free[len(free) // 2]
        near = free[_distance(prints[free], prints[pivot]) <= BUDGET]
        part[near] = p
        src.append(np.full(len(near), pivot))
        dst.append(near)
    order = np.argsort(keys, kind="stable")
    lists = [[(p, at) for p in range(-1, PIVOTS) if len(at := order[(part[order] == p) & here[order]])] for here in (np.arange(n) < first, np.arange(n) >= first)]
    left, right = lists[0], lists[0 if one else 1]
    for x, (p, a) in enumerate(left):
        for q, b in right[x:] if one else right:
            if p == q >= 0:
                continue
            same = one and p == q
            for i, j in _alike_leaves(keys[a], prints[a], None if same else keys[b], None if same else prints[b], depth, errors):
                src.append(a[i])
                dst.append(b[j])
                held += len(i)
                if held > 4 * PAIR_BLOCK:
                    root = _roots(n, src, dst)
                    linked = np.nonzero(root != np.arange(n))[0]
                    src, dst, held = [linked], [root[linked]], 0
    root = _roots(n, src, dst)
    linked = np.nonzero(root != np.arange(n))[0]
    return linked, root[linked]


def _join_prints(table: pa.Table) -> pa.Table:
    """One pair of subtrees: rows ``depth, errors, side, fp, id, w0`` and so on."""
    side = table.column("side").to_numpy()
    order = np.argsort(side, kind="stable")
    first = int((side == 0).sum())
    ids, keys = table.column("id").to_numpy()[order], table.column("fp").to_numpy().view(np.uint64)[order]
    prints = np.stack([table.column(f"w{k}").to_numpy().view(np.uint64)[order] for k in range(WORDS)], axis=1)
    src, dst = print_links(keys, prints, first, table.column("depth")[0].as_py(), table.column("errors")[0].as_py())
    least, roots = ids.copy(), np.unique(dst)
    np.minimum.at(least, dst, ids[src])
    src, dst = ids[np.append(src, roots)], least[np.append(dst, roots)]  # tries that find one group name one root, so that its links are mostly the same
    return pa.table({"src": pa.array(src[src != dst], pa.int64()), "dst": pa.array(dst[src != dst], pa.int64())})


def near_links(nodes: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """Links ``src, dst`` that join the ids of alike fingerprints, of rows ``id`` (long), ``print`` (bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prints = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, WORDS)
                words = np.repeat(prints.view(np.int64), len(_TRIES), axis=0)
                columns = [trie_keys(prints).ravel(), np.repeat(part.column(0).to_numpy(), len(_TRIES)), *(np.ascontiguousarray(w) for w in words.T)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["fp", "id", *(f"w{k}" for k in range(WORDS))])

    keyed = nodes.mapInArrow(run, "fp long, id long, " + ", ".join(f"w{k} long" for k in range(WORDS)))
    members = subtree_members(keyed, ERRORS, subtree, exact=8 + EXACT)
    links = members.groupBy("depth", "a", "b").applyInArrow(_join_prints, "src long, dst long")
    # a print has a root from each trie at most a few times; all but the least of its roots are handed to that one, so that tries do not add up
    roots = links.groupBy("src").agg(F.min("dst").alias("dst"), F.collect_set("dst").alias("others"))
    either = F.explode(F.transform("others", lambda other: F.when(other == F.col("dst"), F.col("src")).otherwise(other)))
    return roots.select(either.alias("src"), "dst").distinct()
