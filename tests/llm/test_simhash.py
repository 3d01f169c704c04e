import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components, with_least
from tidemark.llm.simhash import fingerprint, hamming_links, keep_one_per_group, near_duplicates, trie_links


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, budget=2):
    root = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= budget and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_fingerprint_equals_plain():
    random.seed(1)
    texts = ["", " \n", "A", "a B", "ÀB c\x1cd É", "x\ty\x0bz w", "w " * 500]
    texts += [" ".join(random.choice(["the", "A", "b", "É"]) for _ in range(random.randint(3, 40))) for _ in range(50)]
    for t in texts:
        assert fingerprint(t) % (1 << 64) == plain_fingerprint(t)


def test_groups_equal_brute_force(spark, docs):
    random.seed(2)
    base = [" ".join(random.choice("abcdefghij") * 3 for _ in range(60)) for _ in range(12)]
    texts = [*base, *base[:4], "", None, "one two"]
    for b in base:
        words = b.split()
        words[random.randrange(60)] = "zzz"
        texts.append(" ".join(words))
    prints = [plain_fingerprint(t or "") for t in texts]
    want = plain_groups(prints)
    for leaf in (1 << 16, 2):
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(texts), leaf=leaf).collect()}
        assert [got[k] for k in range(len(texts))] == want


def test_trie_finds_every_near_pair():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = [int(s) for s in seeds]
    for s in seeds[:20]:
        v = int(s)
        for _ in range(6):  # chains of two-bit steps
            v ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            values.append(v)
    fp = np.unique(np.array(values, np.uint64))
    src, dst = trie_links(fp, None, 0, 0, 2)
    root = {int(v): int(v) for v in fp}
    root |= {int(a): int(b) for a, b in zip(src, dst)}
    want = plain_groups([int(v) for v in fp])
    groups = {}
    for k, v in enumerate(fp):
        groups.setdefault(want[k], set()).add(root[int(v)])
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_dense_group_keeps_memory_and_links(spark):
    centre = 0x0123456789ABCDEF
    near = [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in near]
    prints = spark.createDataFrame(signed, "fp long")
    edges = hamming_links(prints, leaf=64)
    roots = connected_components(edges).select("root").distinct().count()
    assert roots == 1 and edges.count() < 12 * 16 * len(near)


def test_chain_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 101), (None, 3)], "src long, dst long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100}
    assert connected_components(edges.where("false")).count() == 0


def test_edge_rows(spark, docs):
    same = docs(["a b c d", "a b c d", None, ""], ids=[5, None, 7, 6]).withColumnRenamed("lang", "component_id")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in near_duplicates(same).collect())
    assert got == [(-1, 5), (5, 5), (6, 6), (7, 6)]
    kept = keep_one_per_group(same)
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 6] and kept.columns == same.columns
    assert near_duplicates(same.where("false")).count() == 0
    repeated = docs(["a b c", "a b c"], ids=[1, 1])
    assert near_duplicates(repeated).count() == 2


@pytest.mark.parametrize("hub, nodes", [(-1, 1_001), (500, 1_000), (5_000, 1_001)])
def test_hub_components(spark, hub, nodes):
    edges = spark.range(1_000).select(F.col("id").alias("src"), F.lit(hub).cast("long").alias("dst"))
    edges = edges.unionByName(spark.createDataFrame([(10_000, 10_001)], "src long, dst long"))
    got = connected_components(edges).groupBy("root").count().orderBy("root").collect()
    assert [tuple(r) for r in got] == [(min(hub, 0), nodes), (10_000, 2)]


def test_least_per_key_keeps_rows_and_nulls(spark):
    rows = spark.createDataFrame([("a", 3, 1), ("a", 2, 2), ("a", None, 3), ("b", None, 4), ("a", 2, 2)], "k string, v long, s long")
    got = with_least(rows, "k", "v", "s", "m").orderBy("s").collect()
    assert [tuple(r) for r in got] == [("a", 3, 1, 2), ("a", 2, 2, 2), ("a", 2, 2, 2), ("a", None, 3, 2), ("b", None, 4, None)]
