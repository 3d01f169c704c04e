"""Media columns: content-addressed images in tar shards, described by digest, offset and length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_folder, sliced, whole_text, written

#: Samples in an image row; a payload is filled up to whole rows with FILL.
WIDTH, FILL = 576, b"\xff"
#: A task begins a new shard beyond this size.
SHARD_BYTES = 256 << 20
#: Signature and header chunk of a PNG: what a header-only read fetches.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

INDEX = "key binary, media_sha256 binary, shard string, offset long, length long, n_bytes long"
HEADER = "width int, height int, bit_depth int, color_type int"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
#: At most so many repeated contents (32 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 200_000


def payload_of(text: bytes) -> bytes:
    """The bytes filled up to a positive multiple of WIDTH."""
    return text + FILL * (-len(text) % WIDTH or (0 if text else WIDTH))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A lossless 8-bit grey image with WIDTH samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter, none
    filtered[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER_BYTES."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png made."""
    width, height, *_ = png_header(media)
    at, data = 8, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean and spread in thousandths, and the mean of 16 equal strips as hex digits pairs."""
    samples = np.frombuffer(payload, np.uint8)
    total, squares, n = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum()), len(samples)
    strips = samples.reshape(16, -1).sum(axis=1, dtype=np.int64) * 16 // n
    return f"grey8;{n // WIDTH}x{WIDTH};{total * 1000 // n};{(squares * n - total * total) * 1000 // (n * n)};{bytes(strips.tolist()).hex()}"


def _open_folder(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _once(docs: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """``key, text`` of every distinct content of ``docs``, ``keys`` having one row ``key`` per row.

    A content that stands once goes on from where it lies; of the others one copy each is taken, so only these are
    shuffled, and copies in one task are dropped before it.
    """
    repeated = written(keys.groupBy("key").count().where("count > 1").select("key"), "media-repeated")
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated
    rows = docs.select(_key(text_col).alias("key"), whole_text(text_col).alias("text"))
    copies = rows.join(side, "key", "left_semi").groupBy("key").agg(F.any_value("text").alias("text"))
    return rows.join(side, "key", "left_anti").unionByName(copies)


def _key(text_col: str):
    return F.unhex(F.sha2(whole_text(text_col).cast("binary"), 256))


def store_media(docs: DataFrame, folder: str | None = None, text_col: str = "text", level: int = 6, keys: DataFrame | None = None) -> DataFrame:
    """Write the texts of ``docs`` as images into tar shards below ``folder``; the index of what was written.

    Index rows (INDEX): ``key`` is the SHA-256 of the text, ``media_sha256`` that of the image and its name in
    the shard, ``offset, length`` where its bytes lie. Each content is stored once. A null text is stored as the empty one.
    Shards get fresh names and only the index of tasks that succeeded names them, so a task may run again after
    a lost executor. ``folder`` must be shared by all machines; by default it lies in the checkpoint folder.
    The index itself is written there as Parquet and read back. ``keys`` may bring the SHA-256 of every text as ``key``.
    """
    folder = folder or new_folder(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_folder(folder)
        store.create_dir(f"{root}/shards")
        out = name = None
        at = 0
        for part in sliced(batches, 1):
            rows = []
            for key, value in zip(part.column(0), part.column(1).cast(pa.binary())):
                text = value.as_py()
                media = to_png(payload_of(text), level)
                digest = hashlib.sha256(media).digest()
                if out is None or at > SHARD_BYTES:
                    if out is not None:
                        out.write(bytes(1024))
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.tar", 0
                    out = store.open_output_stream(f"{root}/shards/{name}")
                member = tarfile.TarInfo(f"{digest.hex()}.png")
                member.size = len(media)
                out.write(member.tobuf(tarfile.USTAR_FORMAT))
                out.write(media)
                out.write(bytes(-len(media) % 512))
                rows.append((key.as_py(), digest, name, at + 512, len(media), len(text)))
                at += 512 + len(media) + -len(media) % 512
            kinds = (pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if out is not None:
            out.write(bytes(1024))
            out.close()

    keys = docs.select(_key(text_col).alias("key")) if keys is None else keys
    _once(docs, keys, text_col).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    index = docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")
    return index.withColumn("shard", F.concat(F.lit(f"{folder}/shards/"), F.col("shard")))


def _ranges(batch: pa.RecordBatch, longest: int | None) -> Iterator[bytes]:
    """The bytes of each row's range, or their beginning; a shard stays open while rows follow in it."""
    name = source = None
    columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")]
    for shard, offset, length in zip(*columns):
        if shard != name:
            if source is not None:
                source.close()
            store, path = _open_folder(shard)
            name, source = shard, store.open_input_file(path)
        yield source.read_at(length if longest is None else min(length, longest), offset)
    if source is not None:
        source.close()


def by_shard(index: DataFrame) -> DataFrame:
    """Index rows in the order of their bytes, each shard in one task (a shard's size is bounded)."""
    return index.repartition("shard").sortWithinPartitions("shard", "offset")


def read_headers(index: DataFrame) -> DataFrame:
    """``index`` with the columns of HEADER, from reads of the first HEADER_BYTES of each image alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [png_header(head) for head in _ranges(batch, HEADER_BYTES)]
            columns = [pa.array(c, pa.int32()) for c in zip(*found)] if found else [pa.array([], pa.int32())] * 4
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, "width", "height", "bit_depth", "color_type"])

    return index.mapInArrow(run, f"{_columns(index)}, {HEADER}")


def read_features(index: DataFrame) -> DataFrame:
    """``index`` with the columns of FEATURES, computed from the stored bytes read back; bytes that do not fit their digest are an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            digests, shards = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("media_sha256", "shard"))
            for media, digest, shard in zip(_ranges(batch, None), digests, shards):
                if hashlib.sha256(media).digest() != digest:
                    raise ValueError(f"{shard} does not hold {digest.hex()} where the index says")
                payload = from_png(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature_of(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, *(x.split()[0] for x in FEATURES.split(", "))])

    return index.mapInArrow(run, f"{_columns(index)}, {FEATURES}")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, where its media lies, header metadata and features.

    Equal texts share one address and all values; a null text is the empty one; repeated and null ids are
    kept; an empty table gives an empty result; other columns are not read.
    """
    name = "doc"
    ids = written(docs.select(F.col(id_col).alias(name), _key(text_col).alias("key")), "media-keys")
    media = read_features(read_headers(by_shard(store_media(docs, folder, text_col, keys=ids.select("key")))))
    return ids.join(media, "key").drop("key").withColumnRenamed(name, id_col)
