"""Near vectors and vector codes against brute force, their SQL, and edge rows."""

import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.helpers import duck, same_rows
from tidemark.llm import vector_codes, vector_near

SCHEMA = "vec_id long, embedding array<float>, label int"


def near_planted(rng, dims=16, labels=3):
    """Vectors of which groups lie within a few degrees, with chains, copies and multiples."""
    rows, k = [], 0
    for label in range(labels):
        for size in (1, 1, 1, 2, 5, 40):
            at = rng.standard_normal(dims)
            for _ in range(size):
                rows.append((k, (at + rng.standard_normal(dims) * 0.06).astype(np.float32).tolist(), label))
                at = at + rng.standard_normal(dims) * 0.02
                k += 1
        rows.append((k, rows[-1][1], label))
        rows.append((k + 1, [4 * x for x in rows[-1][1]], label))
        k += 2
    return rows


def plain_near(rows, least=0.98):
    def usable(r):
        return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if usable(r) else None for r in rows]
    alike = lambda i, j: i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least
    links = [[j for j in range(len(rows)) if alike(i, j)] for i in range(len(rows))]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i] if group[i] == i else []
        while todo:
            for j in links[todo.pop()]:
                if group[j] != i and group[j] >= i:
                    group[j] = i
                    todo.append(j)
    known = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return sorted((r[0] if r[0] is not None else -1, len(n), known[g] if known[g] is not None else -1, r[0] == known[g]) for r, n, g in zip(rows, links, group))


def result(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1, r["kept"]) for r in df.collect())


def test_near_vectors_equal_brute_force(spark):
    rows = near_planted(np.random.default_rng(3))
    random.Random(3).shuffle(rows)
    got = result(vector_near.near_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_near(rows) and sum(n for _, n, _, _ in got) > 500


def test_dense_groups_and_small_blocks(spark, monkeypatch):
    """Counts are whole where a window sees a small part of a group, which is dealt out in many blocks."""
    for name, value in (("BLOCK", 16), ("SMALL_BLOCK", 4), ("CHUNK", 8), ("ROWS_A_TASK", 50)):
        monkeypatch.setattr(vector_near, name, value)
    rng = np.random.default_rng(4)
    at = rng.standard_normal(16)
    rows = [(k, (at + rng.standard_normal(16) * s).astype(np.float32).tolist(), 1) for k, s in enumerate([0.05] * 60 + [0.2] * 60)]
    got = result(vector_near.near_vectors(spark.createDataFrame(rows, SCHEMA), window=4))
    assert got == plain_near(rows) and max(n for _, n, _, _ in got) > 50


def test_edge_vectors(spark):
    v = [1.0, 0.0, 0.5]
    rows = [(1, v, 1), (1, v, 1), (2, v, None), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 0.5], 1), (6, [1.0, float("nan"), 0.5], 1), (7, [1.0, float("inf"), 0.5], 1), (None, v, 1), (8, [], 1), (9, v[:2], 1), (10, [2e38, 0.0, 1e38], 1), (11, v, 2), (None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA + ", node string, n int, id string")
    assert result(vector_near.near_vectors(df)) == plain_near(rows)
    assert vector_near.near_vectors(df.where("false")).count() == 0
    texts = spark.createDataFrame([("b", v, "p"), ("a", v, "p"), ("c", v, "q")], "vec_id string, embedding array<double>, label string")
    assert {tuple(r) for r in vector_near.near_vectors(texts).collect()} == {("b", 1, "a", False), ("a", 1, "a", True), ("c", 0, "c", True)}


def test_pairs_at_the_limit_are_found_by_the_passes():
    """Recall of the windows alone, for pairs at 0.98 among many others."""
    rng = np.random.default_rng(5)
    dims, others, pairs = 64, 20_000, 400
    base = vector_near.units(rng.standard_normal((pairs, dims)))
    side = rng.standard_normal((pairs, dims))
    side = vector_near.units(side - np.einsum("ij,ij->i", side, base)[:, None] * base)
    unit = np.concatenate([base, 0.9801 * base + math.sqrt(1 - 0.9801**2) * side, vector_near.units(rng.standard_normal((others, dims)))])
    found = np.zeros(pairs, bool)
    for number in range(vector_near.PASSES):
        order = np.argsort(vector_near.order_keys(unit, number), kind="stable")
        src, dst = vector_near.window_links(unit[order], 0.98, vector_near.WINDOW)
        a, b = np.minimum(order[src], order[dst]), np.maximum(order[src], order[dst])
        found[a[(b - a == pairs) & (a < pairs)]] = True
    assert found.mean() > 0.98


# --- codes --------------------------------------------------------------------------------------


def plain_codes(rows):
    """The rounds in Python integers, every distance evaluated; the codebooks too."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    top = vector_codes.largest_component(d)
    whole = [[max(-top, min(top, math.floor(1024 * x))) for x in r[1]] for r in kept]
    cuts = [d * k // 4 for k in range(5)]
    parts = [[w[a:b] for w in whole] for a, b in zip(cuts, cuts[1:])]
    books = [p[:256] for p in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(4):
        for k in range(4):
            own = [near(x, books[k])[1] for x in parts[k]]
            fresh = list(books[k])
            for e in set(own):
                mine = [x for x, o in zip(parts[k], own) if o == e]
                fresh[e] = [sum(c) // len(mine) for c in zip(*mine)]
            books[k] = fresh
    found = [[near(x, books[k]) for x in parts[k]] for k in range(4)]
    errors = [sum(found[k][i][0] for k in range(4)) for i in range(len(kept))]
    labels = {}
    for r, e in zip(kept, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    return sorted((r[0] if r[0] is not None else -1, "".join(f"{found[k][i][1]:02x}" for k in range(4)), e, labels[r[2]]) for i, (r, e) in enumerate(zip(kept, errors))), books


def coded(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["code"], r["error"], r["label_error"]) for r in df.collect())


@pytest.mark.parametrize("dims", [3, 8, 10])
def test_codes_equal_the_plain_version(spark, dims):
    rng = np.random.default_rng(dims)
    centre = rng.standard_normal((30, dims))
    rows = [(int(k * 7 % 1009), (centre[k % 30] + rng.standard_normal(dims) * rng.choice([0, 0.1, 0.4])).astype(np.float32).tolist(), [1, 2, None][k % 3]) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, books = plain_codes(rows)
    assert coded(vector_codes.vector_codes(df)) == want
    import hashlib

    assert vector_codes.vector_codes(df).first()["codebooks_sha256"] == hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()


def test_edge_codes(spark):
    rows = [(3, [0.5, -0.25, 1.0, 0.0], 1), (1, [0.5, -0.2501, 1.0, 0.0], None), (1, [0.5, 0.25, 1.0, 0.0], None), (2, None, 1), (4, [1.0, None, 0.0, 0.0], 1), (5, [float("nan")] * 4, 1), (6, [1.0, float("-inf"), 0.0, 0.0], 1), (7, [], 1), (8, [1.0, 2.0], 1), (None, [1e38, -1e38, 0.0, 0.1], 2), (3, [0.5, -0.25, 1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", code string, id int")
    assert coded(vector_codes.vector_codes(df)) == plain_codes(rows)[0]
    assert vector_codes.vector_codes(df.where("false")).count() == 0 and vector_codes.vector_codes(df.where("vec_id = 2")).count() == 0


def test_pruning_skips_evaluations_and_no_tie():
    rng = np.random.default_rng(8)
    book = np.concatenate([rng.integers(-40, 40, (120, 4)), rng.integers(900, 990, (120, 4))])
    book = np.concatenate([book, book[:16]])  # equal entries: the lower index wins
    parts = np.concatenate([rng.integers(-50, 50, (500, 4)), rng.integers(880, 999, (500, 4))])
    pivots = vector_codes.pivots_of(book)
    evaluated = []

    def counted(a, b, real=vector_codes.squared):
        evaluated.append(math.prod(np.broadcast_shapes(a.shape, b.shape)[:-1]))
        return real(a, b)

    to_pivots, between = vector_codes._distances(parts, pivots), vector_codes._distances(pivots, book)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vector_codes, "squared", counted)
        nearest, best = vector_codes.assign(parts, to_pivots, book, between)
    every = ((parts[:, None, :] - book) ** 2).sum(axis=2)
    assert (nearest == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert sum(evaluated) < 0.5 * every.size


@pytest.mark.parametrize("name", ["op11_vector_near", "op13_vector_codes"])
def test_query_equals_its_sql(spark, name):
    path = "/root/testdata/sf0.01"
    same_rows(entry.queries()[name](spark, path), entry.oracle_sql()[name], duck(path))
