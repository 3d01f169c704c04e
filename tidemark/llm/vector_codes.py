"""Vector codes: four small codebooks trained in integers, with LAESA pivots to save distance evaluations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lookup, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Fixed pivots of a part position.
PIVOTS = 6
#: Entries evaluated at a time, in the order of their lower bounds.
WAVE = 16
#: Parts that a task assigns at a time.
BLOCK = 1024


def largest_component(dims: int) -> int:
    """The largest integer for which a squared distance over all components fits a long."""
    return 1 << ((62 - (dims - 1).bit_length()) // 2 - 1)


def _cuts(dims: int) -> list[int]:
    return [dims * k // PARTS for k in range(PARTS + 1)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    difference = a - b
    return np.einsum("...i,...i->...", difference, difference)


def pivots_of(book: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those chosen (ties to the lower index)."""
    chosen = [0]
    nearest = squared(book, book[0])
    while len(chosen) < min(count, len(book)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(book, book[chosen[-1]]))
    return book[chosen]


def assign(parts: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index) and exact squared distance of each row of ``parts``.

    ``to_pivots`` has their distances to the pivots and ``between`` the pivots' distances to the entries. The largest
    difference of the two over all pivots is a lower bound of the distance to an entry. Entries are evaluated in
    the order of their bounds, until the bound of the next one exceeds the best distance.
    """
    nearest, best = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    slack = 1e-6 * (float(to_pivots.max(initial=0)) + float(between.max(initial=0))) + 1e-6  # distances to pivots are kept in single precision
    for at in range(0, len(parts), BLOCK):
        own, known = parts[at : at + BLOCK], to_pivots[at : at + BLOCK]
        bound = np.zeros((len(own), len(book)), np.float32)
        for j in range(between.shape[0]):
            np.maximum(bound, np.abs(known[:, j, None] - between[j]), out=bound)
        order = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        found, least = np.full(len(own), len(book)), np.full(len(own), np.iinfo(np.int64).max)
        open_rows = np.arange(len(own))
        for begin in range(0, len(book), WAVE):
            if begin:
                open_rows = open_rows[bound[open_rows, begin] <= np.sqrt(least[open_rows].astype(np.float64)) + slack]
            if not len(open_rows):
                break
            entries = order[open_rows, begin : begin + WAVE]
            distance = squared(own[open_rows][:, None, :], book[entries])
            low = distance.min(axis=1)
            first = np.where(distance == low[:, None], entries, len(book)).min(axis=1)
            better = (low < least[open_rows]) | ((low == least[open_rows]) & (first < found[open_rows]))
            rows = open_rows[better]
            found[rows], least[rows] = first[better], low[better]
        nearest[at : at + BLOCK], best[at : at + BLOCK] = found, least
    return nearest, best


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(rows, -1) if rows else np.zeros((0, 0), kind)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` to each of ``b``."""
    return np.sqrt(np.stack([squared(a, row) for row in b], axis=1).astype(np.float64)).astype(np.float32)


class Books:
    """The codebooks of all part positions and the fixed pivots; small enough to go along with each task."""

    def __init__(self, first: np.ndarray):
        self.cuts = _cuts(first.shape[1])
        self.books = [first[:, a:b].copy() for a, b in zip(self.cuts, self.cuts[1:])]
        self.pivots = [pivots_of(book) for book in self.books]

    def between(self) -> list[np.ndarray]:
        return [_distances(p, b) for p, b in zip(self.pivots, self.books)]

    def measured(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of all parts to the pivots of their position, side by side."""
        return np.concatenate([_distances(vectors[:, a:b], p) for a, b, p in zip(self.cuts, self.cuts[1:], self.pivots)], axis=1)

    def assigned(self, batch: pa.RecordBatch, between: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        vectors = _matrix(batch.column("vector"), np.int64)
        known, at, found = _matrix(batch.column("known"), np.float32), 0, []
        for k, book in enumerate(self.books):
            width = len(self.pivots[k])
            found.append(assign(vectors[:, self.cuts[k] : self.cuts[k + 1]], known[:, at : at + width], book, between[k]))
            at += width
        return vectors, found

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for v in book.ravel().tolist()).encode()).hexdigest()


def _sums(table: DataFrame, books: Books) -> DataFrame:
    """``part, entry, place, total, n``: component sums of the parts assigned to each entry, added up inside a task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = books.between()
        sums = [np.zeros(b.shape, np.int64) for b in books.books]
        counts = np.zeros((PARTS, len(books.books[0])), np.int64)
        for batch in batches:
            vectors, found = books.assigned(batch, between)
            for k, (nearest, _) in enumerate(found):
                np.add.at(sums[k], nearest, vectors[:, books.cuts[k] : books.cuts[k + 1]])
                np.add.at(counts[k], nearest, 1)
        for k, total in enumerate(sums):
            used = np.nonzero(counts[k])[0]
            width = total.shape[1]
            if len(used) and width:
                columns = np.full(len(used) * width, k), np.repeat(used, width), np.tile(np.arange(width), len(used)), total[used].ravel(), np.repeat(counts[k][used], width)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "total", "n"])

    parts = table.mapInArrow(run, "part long, entry long, place long, total long, n long")
    return parts.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of every row with a usable vector.

    Rows whose vector is null or empty, holds a null or a value that is not finite, or has another length than that of the smallest
    kept id are left out. A component x becomes floor(1024 x) (at most ``largest_component``, so that
    distances fit a long); vectors are cut into 4 consecutive parts. The first entries of a part's codebook are that part of
    the 256 smallest ids (fewer if there are fewer rows; equal ids by vector, null ids last). Each of 4
    rounds assigns every part to its nearest entry and sets each used entry to the floor of its parts' mean.
    ``code`` has two hex digits a part, ``error`` is the sum of the four squared distances, ``label_error`` their sum
    over rows of the same label (nulls together; null beyond a long). Repeated rows stay repeated; no usable row gives
    an empty result; further columns are not read.

    Parts' distances to the fixed pivots are measured once and written next to the vectors; a round reads that
    table and sends back one row of sums per used entry, component and task. The codebooks, 256 times a vector, are all that passes the driver.
    """
    value = lambda x: x.cast("double")
    unusable = F.exists("vector", lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == float("inf")))
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")).where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(~unusable)
    order = [F.col("id").asc_nulls_last(), "vector"]
    outs = f"id {rows.schema[id_col].dataType.simpleString()}, label {rows.schema[label_col].dataType.simpleString()}, code string, error long"
    smallest = own.orderBy(*order).select(F.size("vector")).first()
    if smallest is None:
        none = own.where("false").selectExpr(f"id AS `{id_col}`", "'' AS code", "0L AS error", "0L AS label_error")
        return none.withColumn("codebooks_sha256", F.lit(""))
    (dims,) = smallest
    own = own.where(F.size("vector") == dims)
    top = float(largest_component(dims))

    def floored(vectors: np.ndarray) -> np.ndarray:
        return np.floor(np.clip(vectors * SCALE, -top, top)).astype(np.int64)

    first = own.orderBy(*order).limit(ENTRIES).select("vector").collect()
    books = Books(floored(np.array([r["vector"] for r in first], np.float64)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = floored(_matrix(batch.column("vector"), np.float64))
                lists = pa.array(list(vectors.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(books.measured(vectors)), pa.list_(pa.float32()))
                yield pa.record_batch([batch.column("id"), batch.column("label"), *lists], names=["id", "label", "vector", "known"])

    kinds = outs.split(", code")[0]
    table = written(own.mapInArrow(measure, f"{kinds}, vector array<int>, known array<float>"), "vector-parts")
    for _ in range(ROUNDS):
        for r in _sums(table.select("vector", "known"), books).collect():  # entries times components at most
            books.books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = books.between()
        for batch in batches:
            if batch.num_rows:
                _, found = books.assigned(batch, between)
                codes = ["".join(f"{v:02x}" for v in row) for row in zip(*(nearest.tolist() for nearest, _ in found))]
                error = np.sum([best for _, best in found], axis=0)
                yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(codes), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    coded = written(table.mapInArrow(code, outs), "vector-codes")
    totals = lookup(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).select(F.col("label").alias("same"), "label_error"))
    found = coded.join(totals, F.col("label").eqNullSafe(F.col("same")))
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle() -> str:
    """The same rounds in DuckDB, every distance evaluated."""
    ctes = [
        "kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0)",
        f"comp AS MATERIALIZED (SELECT vec_id, p, j, CAST(floor({SCALE} * CAST(embedding[p * len(embedding) // {PARTS} + j + 1] AS DOUBLE)) AS BIGINT) AS v FROM kept, range({PARTS}) r(p), range(len(embedding) // {PARTS}) s(j))",
        f"starts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES})",
        "book0 AS MATERIALIZED (SELECT p, e, j, v FROM comp JOIN starts USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(
            f"near{k} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS best FROM (SELECT c.vec_id, c.p, b.e, CAST(sum((c.v - b.v) * (c.v - b.v)) AS BIGINT) AS d "
            f"FROM comp c JOIN book{k} b ON b.p = c.p AND b.j = c.j GROUP BY ALL) GROUP BY ALL)"
        )
        if k < ROUNDS:
            ctes.append(
                f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN (SELECT c.p, n.best.e AS e, c.j, (sum(c.v) - ((sum(c.v) % count(*)) + count(*)) % count(*)) // count(*) AS v "
                f"FROM comp c JOIN near{k} n ON n.vec_id = c.vec_id AND n.p = c.p GROUP BY ALL) m ON m.p = b.p AND m.e = b.e AND m.j = b.j)"
            )
    ctes.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)")
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        f"(SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"
    )
