"""Near copies among vectors of a label: sorted projection passes with neighbour windows, then exact counts inside the groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.components import connected_components, with_least
from tidemark.llm.near_copies import _runs
from tidemark.llm.simhash import _roots

#: Orders that the vectors are sorted by, and how many of them one shuffle carries.
PASSES, TOGETHER = 16, 4
#: Sign hashes that an order puts one after the other.
BITS = 64
#: Neighbours behind a vector that it is compared with in an order.
WINDOW = 32
#: Rows of an order that a task walks through, and rows that it compares at a time.
ROWS_A_TASK, CHUNK = 20_000, 2048
#: Blocks that a group is cut into, and the least and largest number of its vectors in one.
BLOCKS, SMALL_BLOCK, BLOCK = 16, 128, 4096


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; no row is zero."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def order_keys(unit: np.ndarray, number: int, seed: int = 42) -> np.ndarray:
    """A long per row: the signs of ``BITS`` random projections of order ``number``, the first one in the highest bit."""
    planes = np.random.default_rng([seed, number, unit.shape[1]]).standard_normal((unit.shape[1], BITS))
    bits = np.packbits(unit @ planes >= 0, axis=1)
    return bits.view(">u8").ravel().astype(np.uint64).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _marked(rows: DataFrame, id_type: str, label_type: str, vector_type: str) -> DataFrame:
    """``id, label, node, dims, vector`` with ``node`` a 128-bit digest of label and vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = batch.column("vector").offsets.to_numpy(), batch.column("vector").values.to_numpy(zero_copy_only=False)
            labels = (str(v).encode("utf-8", "replace") + b"\0" for v in batch.column("label").to_pylist())
            nodes = [hashlib.blake2b(label + values[a:b].tobytes(), digest_size=16).digest() for label, a, b in zip(labels, offsets, offsets[1:])]
            dims = pa.array(np.diff(offsets).astype(np.int32))
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(nodes, pa.binary()), dims, batch.column("vector")], names=["id", "label", "node", "dims", "vector"])

    return rows.mapInArrow(run, f"id {id_type}, label {label_type}, node binary, dims int, vector {vector_type}")


def _keyed(nodes: DataFrame, numbers: range, label_type: str, vector_type: str) -> DataFrame:
    """``number, label, dims, key, node, vector``: each node once in each of the given orders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["dims"]):
            for batch in table.combine_chunks().to_batches(CHUNK):
                unit = units(_matrix(batch.column("vector")))
                for number in numbers:
                    keys = pa.array(order_keys(unit, number), pa.int64())
                    yield pa.record_batch([pa.array([number] * len(unit), pa.int32()), batch.column("label"), batch.column("dims"), keys, batch.column("node"), batch.column("vector")], names=["number", "label", "dims", "key", "node", "vector"])

    return nodes.mapInArrow(run, f"number int, label {label_type}, dims int, key long, node binary, vector {vector_type}")


def _forest(names: list, a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """Links between names that join what the pairs ``a, b`` of positions join."""
    if not len(a):
        return [], []
    root = _roots(len(names), [a], [b])
    linked = np.nonzero(root != np.arange(len(names)))[0]
    return [names[k] for k in linked], [names[k] for k in root[linked]]


def window_links(unit: np.ndarray, least: float, window: int, begin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most ``window`` apart with a cosine of ``least`` or more, the later one at ``begin`` or after."""
    src, dst = [], []
    for k in range(1, min(window, len(unit) - 1) + 1):
        low = max(begin - k, 0)
        near = np.nonzero(np.einsum("ij,ij->i", unit[low : len(unit) - k], unit[low + k :]) >= least)[0] + low
        src.append(near)
        dst.append(near + k)
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, int), np.zeros(0, int))


def _walked(orders: DataFrame, least: float, window: int, vector_type: str) -> DataFrame:
    """Links of neighbours inside the partitions of sorted rows, and the rows at the edges of each partition.

    A link has ``src, dst``. An edge row has its ``boundary`` (the number of the partition before it), its ``side`` (0 before, 1
    after), its ``place`` from the boundary on, its ``run`` (order, label and length), its node in ``src`` and its vector.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["src", "dst", "boundary", "side", "place", "run", "vector"]
        kind = None

        def edges(table: pa.Table, pid: int, side: int, label: str) -> pa.RecordBatch:
            rows = len(table)
            place = np.arange(rows) if side else np.arange(rows)[::-1]
            vector = table["vector"].combine_chunks()
            return pa.record_batch(
                [table["node"].combine_chunks(), pa.nulls(rows, pa.binary()), pa.array([pid - side] * rows, pa.int64()), pa.array([side] * rows, pa.int32()), pa.array(place, pa.int32()), pa.array([label] * rows), vector], names=names
            )

        first, tail, now, held = True, None, None, None
        for batch in batches:
            kind = batch.schema.field("vector").type
            for table in _runs(iter([batch]), ["number", "label", "dims"]):
                label = "\0".join(str(table[c][0].as_py()) for c in ("number", "dims", "label"))
                if label != now:
                    if now is not None:
                        first = False
                    now, held = label, None
                pid = table["pid"][0].as_py()
                for at in range(0, len(table), CHUNK):
                    fresh = table.slice(at, CHUNK)
                    if first and (held is None or len(held) < window):  # the partition's first rows
                        known = 0 if held is None else len(held)
                        part = edges(fresh.slice(0, window - known), pid, 1, label)
                        yield part if not known else part.set_column(4, "place", pa.array(np.arange(known, known + len(part)), pa.int32()))
                    block = fresh if held is None else pa.concat_tables([held, fresh])
                    begin = 0 if held is None else len(held)
                    src, dst = window_links(units(_matrix(block["vector"].combine_chunks())), least, window, begin)
                    if len(src):
                        src, dst = _forest(block["node"].to_pylist(), src, dst)
                        rows = len(src)
                        empty = pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.string()), pa.nulls(rows, kind)
                        yield pa.record_batch([pa.array(src, pa.binary()), pa.array(dst, pa.binary()), *empty], names=names)
                    held = block.slice(max(0, len(block) - window))
                tail = (pid, label)
        if tail is not None:
            yield edges(held, tail[0], 0, tail[1])

    return orders.mapInArrow(run, f"src binary, dst binary, boundary long, side int, place int, run string, vector {vector_type}")


def _across(edges: DataFrame, least: float, window: int) -> DataFrame:
    """Links over the boundaries of partitions, from at most two windows of rows each."""
    def join(table: pa.Table) -> pa.Table:
        side, place, run = (np.array(table[c].to_pylist()) for c in ("side", "place", "run"))
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
        src, dst = [], []
        if len(left) and len(right) and run[left[0]] == run[right[0]]:
            near = (place[left][:, None] + place[right][None, :] < window)
            unit = units(_matrix(table["vector"].combine_chunks()))
            a, b = np.nonzero(near & (unit[left] @ unit[right].T >= least))
            src, dst = _forest(table["src"].to_pylist(), left[a], right[b])
        return pa.table({"src": pa.array(src, pa.binary()), "dst": pa.array(dst, pa.binary())})

    return edges.groupBy("boundary").applyInArrow(join, "src binary, dst binary")


def found_links(nodes: DataFrame, rows: int, label_type: str, vector_type: str, least: float, passes: int, window: int) -> DataFrame:
    """Links ``src, dst`` of the nodes: in each order a vector meets the ``window`` ones behind it.

    A partition yields a spanning forest of its links, so links grow with vectors times orders, however large a group is.
    """
    found = []
    for begin in range(0, passes, TOGETHER):
        numbers = range(begin, min(begin + TOGETHER, passes))
        order = ["number", "label", "dims", "key", "node"]
        tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, rows * len(numbers) // ROWS_A_TASK + 1)
        sorted_rows = _keyed(nodes, numbers, label_type, vector_type).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        walked = written(_walked(sorted_rows.withColumn("pid", F.spark_partition_id().cast("long")), least, window, vector_type), "vector-walk")
        found.append(walked.where("boundary IS NULL").select("src", "dst"))
        found.append(_across(walked.where("boundary IS NOT NULL"), least, window))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _degrees(members: DataFrame, least: float) -> DataFrame:
    """``node, links``: to how many rows of its group (rows ``root, node, n, vector``) each node is linked, itself not counted.

    All links of a node lie inside its group. A group is dealt out in blocks, every pair of blocks being one task's, so pairs are counted where
    they are made and no pair leaves a task. Groups of middle size make BLOCKS blocks, so that 136 tasks share them; larger ones
    blocks of BLOCK nodes, so that a node is not copied more often than its group's size asks for.
    """
    size = members.groupBy("root").agg(F.count("*").alias("size"))
    width = F.least(F.lit(BLOCK), F.greatest(F.lit(SMALL_BLOCK), F.ceil(F.col("size") / BLOCKS)))
    rows = members.join(size, "root").withColumn("blocks", F.ceil(F.col("size") / width).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.select("root", "node", "n", "vector", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    rows = rows.select("root", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), (F.col("block") > F.col("with")).alias("second"), "node", "n", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["root", "p", "q"]):
            one, second = table["p"][0] == table["q"][0], table["second"].to_numpy(zero_copy_only=False)
            unit, copies = units(_matrix(table["vector"].combine_chunks())), table["n"].to_numpy()
            left = np.arange(len(unit)) if one else np.nonzero(~second)[0]
            right = left if one else np.nonzero(second)[0]
            links = np.zeros(len(unit), np.int64)
            for at in range(0, len(left), 512):
                some = left[at : at + 512]
                near = unit[some] @ unit[right].T >= least
                if one:
                    near[np.arange(len(some)), some] = False
                links[some] += near @ copies[right]
                if not one:
                    links[right] += copies[some] @ near
            yield pa.record_batch([table["node"].combine_chunks(), pa.array(links)], names=["node", "links"])

    dealt = rows.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")
    return dealt.mapInArrow(run, "node binary, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(
    rows: DataFrame, least: float = 0.98, passes: int = PASSES, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row: vectors of one label and length are linked at a cosine of ``least`` or more.

    Rows with a null label, or whose vector is null, empty, zero or holds a null or a value that is not finite, have no
    link and are kept. Equal vectors of a label are one node, so copies cost nothing. In each of ``passes`` orders the nodes are sorted
    by label and the concatenated signs of random projections, and each is compared with the ``window`` nodes behind
    it; links of all orders are joined to components. Windows see few of the links in a dense group, so every
    link inside the components is then counted exactly, in blocks; ``n_links`` thus misses only links between components.
    A pair at 0.98 agrees in the first 12 signs of an order with a chance of 0.45. ``component_id`` is the smallest id
    reachable (null ids take no part), ``kept`` whether it is the row's own. Repeated rows stay repeated; an empty table gives an
    empty result; further columns are not read.
    """
    kind = lambda c: rows.schema[c].dataType.simpleString()
    vector_type, label_type = kind(vector_col), kind(label_col)
    value = lambda x: x.cast("double")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: value(x) != 0)
    own = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).withColumn("usable", F.coalesce(usable, F.lit(False)))

    marked = written(_marked(own.where("usable").drop("usable"), kind(id_col), label_type, vector_type), "vector-rows")
    nodes = marked.groupBy("node").agg(F.any_value("label").alias("label"), F.any_value("dims").alias("dims"), F.any_value("vector").alias("vector"), F.count("*").alias("n"), F.min("id").alias("first"))
    nodes = written(nodes, "vector-nodes")
    links = found_links(nodes.select("label", "dims", "node", "vector"), nodes.count(), label_type, vector_type, least, passes, window)
    placed = written(connected_components(links), "vector-groups")
    degrees = written(_degrees(nodes.select("node", "n", "vector").join(placed, "node"), least), "vector-degrees")
    named = with_least(placed.join(nodes.select("node", "first"), "node"), "root", "first", "node", "component").select("node", "component")
    known = nodes.select("node", "n", "first").join(named, "node", "left").join(degrees, "node", "left")
    known = written(known.select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id")), "vector-known")
    linked = marked.select("id", "node").join(known, "node").select("id", "n_links", "component_id")
    alone = own.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(least: float = 0.98) -> str:
    """All pairs of a label in DuckDB, closed by the smallest id reached."""
    return f"""WITH RECURSIVE usable AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {least}),
    reached AS (SELECT DISTINCT src AS vec_id, src AS least_id FROM links UNION SELECT l.dst, r.least_id FROM reached r JOIN links l ON l.src = r.vec_id WHERE r.least_id < l.dst)
    SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept FROM embeddings e
    LEFT JOIN (SELECT src, count(*) AS n_links FROM links GROUP BY 1) n ON n.src = e.vec_id LEFT JOIN (SELECT vec_id, min(least_id) AS component_id FROM reached GROUP BY 1) c ON c.vec_id = e.vec_id"""
