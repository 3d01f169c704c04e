"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, whole_text

#: Bytes that the rolling hash looks at, and bits that must be set at a cut (1024 bytes a chunk on average).
WINDOW, CUT_BITS = 16, 10
#: What a worker remembers at most. Words are kept in two generations of half as many: what was not met again while the
#: younger one filled goes. A full memory of chunks is emptied.
MAX_WORDS, MAX_CHUNKS, MAX_WORD_BYTES = 400_000, 8_192, 256
#: Bytes of text that are cut and encoded at a time, or one text; the rolling hash takes some 40 bytes for each.
SLICE = 1 << 20
_ENCODERS: dict[str, Encoder] = {}


def cut_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks end in the bytes of several texts laid end to end.

    A polynomial rolling hash over the last WINDOW bytes, built by doubling, decides; texts begin at
    ``starts`` and a cut needs a whole window of its own text, so equal passages are cut alike wherever
    they stand.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    state = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    factor, width = 0xD6E8FEB86659FD93, 1
    while width < WINDOW:
        ahead = state.copy()
        ahead[width:] += state[:-width] * np.uint64(factor)
        state, width, factor = ahead, width * 2, factor * factor % (1 << 64)
    cuts = np.nonzero(state >> np.uint64(64 - CUT_BITS) == np.uint64((1 << CUT_BITS) - 1))[0] + 1
    own = starts[np.searchsorted(starts, cuts - 1, side="right") - 1]
    return cuts[cuts - own >= WINDOW]


def chunk_edges(texts: list[bytes]) -> Iterator[list[int]]:
    """For each text, where its chunks begin and end; an empty text has no chunk."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - [len(t) for t in texts]
    full = ends > starts
    cuts = cut_points(np.frombuffer(b"".join(texts), np.uint8), starts[full])
    marks = np.unique(np.concatenate([cuts, ends[full]]))
    for a, b in zip(starts.tolist(), ends.tolist()):
        inner = marks[np.searchsorted(marks, a, side="right") : np.searchsorted(marks, b, side="right")] - a
        yield [0, *inner.tolist()] if b > a else []


class Encoder:
    """Encodes texts chunk by chunk, remembering chunks and words.

    A chunk splits into a head up to its first ASCII white space, a body of whole words and a tail after
    its last one. The tokenizer never joins over white space, so a body has the same tokens wherever it
    stands and is encoded once. The tail of one chunk and the head of the next are encoded anew, together
    with any chunk between them without white space: from there on both sides agree with an
    encoding of the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        self.tokens = pa.array(names, pa.large_string())
        self.by_words = self.tokenizer.decoder is None and self._parts_at_spaces(names)

    def _parts_at_spaces(self, names: list[str]) -> bool:
        """Whether ids on both sides of ASCII white space are those of the sides, tried on a spread of the vocabulary."""
        words = [w for w in names[:: max(1, len(names) // 400)] if w and not any(c.isspace() for c in w)]
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        alone = {w: ids(w) for w in words}
        gaps = [" ", "\t", "\n", "\x0b", "\x0c", "\r", " \n "]
        return all(ids(a + gaps[k % len(gaps)] + b) == alone[a] + alone[b] for k, (a, b) in enumerate(zip(words, words[7:])))

    def learn(self, words: list[bytes]) -> None:
        """Remember the little-endian 32-bit ids of texts without ASCII white space.

        Many are encoded in one call, parted by spaces, and told apart by the offsets of their tokens.
        """
        for at in range(0, len(words), 4096):
            part = [w.decode("utf-8", "replace") for w in words[at : at + 4096]]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, "<i4")
            begins = np.fromiter((x for x, _ in found.offsets), np.int64, len(ids))
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            edges = np.searchsorted(begins, starts).tolist()
            for w, x, y in zip(words[at : at + 4096], edges, edges[1:]):
                self.words[w] = ids[x:y].tobytes()

    def recall(self, needed: set[bytes]) -> None:
        """Have ``needed`` in the younger generation, from the older one where that has them."""
        missing = [w for w in needed if w not in self.words]
        self.words.update((w, self.older[w]) for w in missing if w in self.older)
        self.learn([w for w in missing if w not in self.older])

    def split(self, chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
        """Head, words of the body, tail; None for a chunk without white space."""
        words = chunk.split()
        opens, closes = chunk[:1].isspace(), chunk[-1:].isspace()
        if len(words) == 1 and not opens and not closes:
            return None
        head = b"" if opens or not words else words.pop(0)
        tail = b"" if closes or not words else words.pop()
        return head, words, tail

    def batch(self, texts: list[bytes]) -> pa.ListArray:
        """Ids of several texts; a tokenizer that reads over white space encodes them whole."""
        if not self.by_words:
            whole = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return pa.array([e.ids for e in whole], pa.list_(pa.int32()))
        if len(self.words) > MAX_WORDS // 2:
            self.older, self.words = self.words, {}
        if len(self.chunks) > MAX_CHUNKS:
            self.chunks.clear()
        known, fresh, needed = self.chunks, {}, set()
        plans: list[list[tuple[bool, bytes]]] = []  # of each text: chunks whose body comes here (True), seams (False)
        for text, edges in zip(texts, chunk_edges(texts)):
            plan, seam = [], []
            for x, y in zip(edges, edges[1:]):
                chunk = text[x:y]
                if chunk not in known:
                    parts = self.split(chunk)
                    known[chunk] = parts and (parts[0], b"", parts[2])
                    if parts:
                        fresh[chunk] = parts[1]
                        needed.update(parts[1])
                if known[chunk] is None:
                    seam.append(chunk)
                    continue
                head, _, tail = known[chunk]
                if seam or head:
                    plan.append((False, b"".join([*seam, head])))
                plan.append((True, chunk))
                seam = [tail] if tail else []
            if seam:
                plan.append((False, b"".join(seam)))
            needed.update(key for body, key in plan if not body)
            plans.append(plan)
        self.recall(needed)
        for chunk, words in fresh.items():
            known[chunk] = known[chunk][0], b"".join(map(self.words.__getitem__, words)), known[chunk][2]
        out = [b"".join([known[key][1] if body else self.words[key] for body, key in plan]) for plan in plans]
        for w in needed:
            if len(w) > MAX_WORD_BYTES:
                self.words.pop(w, None)
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(out), "<i4"), pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids; without a decoder tokens are joined by spaces."""
        if not self.by_words:
            return pa.array([self.tokenizer.decode(x, skip_special_tokens=False) for x in ids.to_pylist()], pa.string())
        flat = ids.flatten()
        tokens = self.tokens.take(flat)
        offsets = pc.subtract(ids.offsets, ids.offsets[0]).cast(pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, tokens), pa.scalar(" ", pa.large_string())).cast(pa.string())


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_decode_shared(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_decode`` with each distinct chunk body encoded once in the cluster.

    Bodies are shuffled by their digest and encoded, their ids come back to the documents by digest and are put in order
    there; words over a joint are encoded with the document, from its chunks' heads and tails. For a tokenizer that
    parts at white space. A third of all rows with one chunk are split by adaptive execution in the join on digests.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        split = _encoder(path).split
        for part in sliced(batches, 2):
            texts = part.column(2).cast(pa.binary()).to_pylist()
            out: list[tuple] = []
            for k, (text, edges) in enumerate(zip(texts, chunk_edges(texts))):
                for pos, (x, y) in enumerate(zip(edges, edges[1:])):
                    if (found := split(text[x:y])) is None:
                        out.append((k, pos, text[x:y], None, None, None))
                    else:
                        body = b" ".join(found[1])
                        out.append((k, pos, found[0], found[2], xxhash.xxh3_128_digest(body), body))
                if len(edges) < 2:
                    out.append((k, 0, b"", None, None, None))
            place, *columns = zip(*out)
            place = pa.array(place)
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([part.column(0).take(place), part.column(1).take(place), *(pa.array(c, t) for c, t in zip(columns, types))], names=["row", "id", "pos", "head", "tail", "digest", "body"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for part in sliced(batches, 1):
            found = encoder.batch(part.column(1).to_pylist())
            yield pa.record_batch([part.column(0), pa.array([np.array(x, "<u4").tobytes() for x in found.to_pylist()], pa.binary())], names=["digest", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for part in batches:
            texts = []
            for chunks in part.column(1).to_pylist():
                plan, seam = [], b""
                for c in sorted(chunks, key=lambda c: c["pos"]):
                    seam += c["head"]
                    if c["tail"] is not None:
                        plan += [seam, c["ids"]]
                        seam = c["tail"]
                texts.append([*plan, seam])
            seams = encoder.batch([x for plan in texts for x in plan[::2]]).to_pylist()
            at, out = 0, []
            for plan in texts:
                ids: list[int] = []
                for k in range(0, len(plan), 2):
                    ids += seams[at]
                    at += 1
                    if k + 1 < len(plan):
                        ids += np.frombuffer(plan[k + 1], "<u4").tolist()
                out.append(ids)
            found = pa.array(out, pa.list_(pa.int32()))
            yield pa.record_batch([part.column(0), found, encoder.decode(found)], names=["id", "ids", "decoded"])

    chunks = rows.mapInArrow(cut, f"row long, id {kind}, pos int, head binary, tail binary, digest binary, body binary")
    bodies = chunks.where("digest IS NOT NULL").groupBy("digest").agg(F.any_value("body").alias("body")).mapInArrow(encode, "digest binary, ids binary")
    placed = chunks.drop("body").join(bodies, "digest", "left")
    grouped = placed.groupBy("row").agg(F.any_value("id").alias("id"), F.collect_list(F.struct("pos", "head", "tail", "ids")).alias("chunks"))
    return grouped.select("id", "chunks").mapInArrow(assemble, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>, decoded string``, one row per row of ``docs``.

    ``ids`` are those of the tokenizer file at ``path`` for the whole text without added special tokens
    (special tokens spelled in a text count as such), ``decoded`` the text of the ids. A null text counts as
    empty: no ids, empty text. Repeated rows get equal results, an empty table gives none, other columns are
    not read. Chunks are remembered per worker process, within fixed bounds: a chunk that
    several workers meet is encoded by each, since sharing would send every text or every id through a shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for part in sliced(batches, 1, SLICE):
            ids = encoder.batch(part.column(1).cast(pa.binary()).to_pylist())
            yield pa.record_batch([part.column(0), ids, encoder.decode(ids)], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), whole_text(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
