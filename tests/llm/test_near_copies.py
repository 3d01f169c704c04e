"""Near copies against brute force; planted copies from 0.8 to 0.97."""

import random

import pyarrow.parquet as pq

import corpus_pipeline
from tidemark.llm import near_copies as module
from tidemark.llm.near_copies import near_copies


def plain_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_alike(a, b):
    return (not a and not b) or len(a & b) >= 0.8 * len(a | b)


def plain_groups(texts):
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and plain_alike(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def planted(share, rng, words=200):
    """A text and a copy with changed words at its end, at a similarity just above ``share``."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for cut in range(words, 0, -1):
        copy = base[:cut] + ["new"] * (words - cut)
        a, b = plain_set(" ".join(base)), plain_set(" ".join(copy))
        if len(a & b) < share * len(a | b):
            return " ".join(base), last
        last = " ".join(copy)


def test_planted_copies_are_caught_by_the_stage(spark, docs):
    rng = random.Random(1)
    pairs = [planted(s, rng) for s in (0.8, 0.82, 0.85, 0.9, 0.95, 0.97) for _ in range(10)]
    kept = corpus_pipeline.near_dedup(spark, docs([t for p in pairs for t in p]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 2 * len(pairs), 2))


def test_groups_equal_brute_force(docs):
    rng = random.Random(2)
    texts = ["", None, "one two", "One  two", "a b c d e", "a b c d e f"]
    for _ in range(6):  # chains whose ends are not alike, below and above the limit, and a shared opening
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(12):
            texts.append(" ".join(words))
            at = rng.randrange(110)
            words[at : at + rng.randrange(1, 9)] = [f"w{rng.randrange(10**6)}"]
    want = plain_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_given_documents_equal_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = pq.read_table(path, columns=["doc_id", "text"]).sort_by("doc_id").to_pylist()
    want = {r["doc_id"]: rows[g]["doc_id"] for r, g in zip(rows, plain_groups([r["text"] for r in rows]))}
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.read.parquet(path)).collect()}
    assert got == want


def test_edge_rows(docs):
    same = docs(["a b c d", "a b c d", None, ""], ids=[5, None, 7, 6])
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in near_copies(same).collect()) == [(-1, 5), (5, 5), (6, 6), (7, 6)]
    assert near_copies(same.where("false")).count() == 0


def test_shared_counts_are_exact():
    import numpy as np

    rng = np.random.default_rng(5)
    draw = lambda: [np.unique(rng.integers(0, 9000, rng.integers(0, 4000)).astype(np.uint64)) for _ in range(7)]
    left, right = draw(), draw()
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert module.shared_counts(left, right).tolist() == want


def test_a_band_of_many_blocks(docs, monkeypatch):
    """Copies that are alike only along a chain or through one text, dealt out in small blocks."""
    monkeypatch.setattr(module, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    want = plain_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want and 1 < len(set(want)) < 60


def test_memory_of_many_long_texts():
    """512 unlike texts of 20,000 words: what a task takes beside the sets themselves."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 64, 20_000, np.uint64)) for _ in range(512)]
    sets[7] = sets[500]
    tracemalloc.start()
    links = list(module.forest(sets[:256], sets[256:], list(range(512)), 0.8))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert links == [(7, 500)] and peak < 200 * 2**20


def test_blocks_of_long_texts_and_of_a_large_group(docs, monkeypatch):
    """A band that is mostly one group, with chains and outliers, in blocks bounded by shingles."""
    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "BLOCK_SHINGLES", 700)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(90):
        words = list(base)
        for _ in range(1 if k < 60 else rng.choice([4, 5, 6, 7])):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    want = plain_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want and 1 < len(set(want)) < 40


def test_the_stage_takes_its_candidates_from_the_trie(docs, monkeypatch):
    """Without the walk of operator 1's trie no copy is found but texts of equal shingles."""
    from tidemark.llm import wide_prints

    walks, walk = [], wide_prints.subtree_members
    monkeypatch.setattr(wide_prints, "subtree_members", lambda prints, *a, **k: walks.append(1) or walk(prints.where("id is null"), *a, **k))
    base, copy = planted(0.9, random.Random(3))
    kept = corpus_pipeline.near_dedup(None, docs([base, copy, base.upper()]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1] and walks == [1]


def test_tries_miss_no_pair_at_the_limit():
    """2,000 pairs at 0.8 share the exact bits of some trie, stay in its errors two levels of eight bits deeper and within the budgets."""
    import numpy as np

    from tidemark.llm import wide_prints as w

    rng = np.random.default_rng(8)
    drawn = [rng.integers(0, 1 << 64, 250, np.uint64) for _ in range(2000)]
    left, right = w.wide_prints([v[:225] for v in drawn]), w.wide_prints([np.append(v[:200], v[225:]) for v in drawn])
    differ = w.trie_keys(left).view(np.uint64) ^ w.trie_keys(right).view(np.uint64)
    for depth in (0, 8):
        errors = np.bitwise_count((differ >> np.uint64(48 - depth)) & np.uint64((1 << depth) - 1))
        agree = (differ >> np.uint64(48) == 0) & (errors <= w.ERRORS + depth // 8)
        assert agree.any(axis=1).all()
    assert (w._distance(left, right) <= w.BUDGET).all() and (w._distance(left[:, :2], right[:, :2]) <= w.HALF_BUDGET).all()


def test_walk_and_pivots_equal_brute_force(monkeypatch):
    """Groups around centres and loose prints, in small leaves, in one subtree and between two."""
    import numpy as np

    from tidemark.llm import wide_prints as w
    from tidemark.llm.simhash import _roots

    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 64, (6, w.WORDS), np.uint64)
    noise = np.packbits(rng.random((900, 256)) < 0.13, axis=1).view(np.uint64)
    prints = np.concatenate([centres[rng.choice(6, 900, p=[0.6, 0.2, 0.1, 0.05, 0.03, 0.02])] ^ noise, rng.integers(0, 1 << 64, (300, w.WORDS), np.uint64)])[rng.permutation(1200)]
    keys = rng.integers(0, 1 << 40, 1200).astype(np.uint64)  # any order of the bits will do
    monkeypatch.setattr(w, "ERRORS", 64)
    for dense, leaf in ((10**6, 512), (10**6, 16), (100, 16)):
        monkeypatch.setattr(w, "DENSE", dense)
        monkeypatch.setattr(w, "LEAF", leaf)
        for first in (1200, 500):
            near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int) <= w.BUDGET
            if first < 1200 and dense > 1200:  # links inside a side are another task's, but pivots may give them
                near[:first, :first] = near[first:, first:] = False
            i, j = np.nonzero(near)
            src, dst = w.print_links(keys, prints, first, 24, 0)
            got = _roots(1200, [src], [dst])
            want = _roots(1200, [i], [j])
            if first < 1200 and dense < 1200:  # all links across are found, and no two groups joined that are not alike
                across = (i < first) & (j >= first)
                assert (got[i[across]] == got[j[across]]).all() and (want[src] == want[dst]).all()
            else:
                assert got.tolist() == want.tolist()


def test_subtrees_above_the_limit_go_deeper(spark):
    """Near copies of one text in tasks of at most 20 prints join as in one task."""
    import numpy as np

    from tidemark.llm import wide_prints as w
    from tidemark.llm.components import connected_components

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, (1, w.WORDS), np.uint64)
    prints = np.concatenate([base ^ np.packbits(rng.random((120, 256)) < 0.05, axis=1).view(np.uint64), rng.integers(0, 1 << 64, (80, w.WORDS), np.uint64)])
    nodes = spark.createDataFrame([(k, p.tobytes()) for k, p in enumerate(prints)], "id long, print binary")
    for subtree in (1 << 16, 20):
        links = w.near_links(nodes, subtree)
        assert {r["node"] for r in connected_components(links).where("root = 0").collect()} == set(range(120))
        assert links.count() < 20 * 120
