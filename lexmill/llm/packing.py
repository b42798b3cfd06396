"""Packing of documents into fixed-length sequences along a space-filling curve.

1. Each text is encoded; its ids' hashed signs, averaged, project the document to a few
   dimensions, and the direction gives its key on a Hilbert curve.  The encoded table is written
   to the shared folder, so that neither sampling nor a lost executor encodes twice.
2. The table is range-partitioned and sorted by (key, hash of the id, id, place in the table).  The
   hash spreads the copies of one text, which share a key, over range partitions, and the place
   those that have no id or the same one.  The number of ranges follows the bytes of the table.
3. Every partition is cut along the curve into full sequences.  Its tail is cut into sequences
   whose lengths are powers of two, which need no padding; so no sequence is padded at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .bpe_ids import encoder
from .words import mix, slices, utf8

DIMS, BITS, SEQUENCE = 4, 8, 1024
RANGE_BYTES, SMALL_RANGE, SMALL_RANGES = 64 << 20, 8 << 20, 8192  # compressed ids in a range: SMALL_RANGE while that makes no more than SMALL_RANGES
_U = np.uint64


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims) with ``bits`` bits a coordinate (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            on = (x[d] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            if d:
                x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, bounds: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Each row's key: hashed ids give signs, their mean a direction, the direction a cell."""
    signs = mix(np.arange(int(ids.max(initial=0)) + 1, dtype=np.uint64) + _U(1))
    vectors = np.empty((len(bounds) - 1, dims))
    for d in range(dims):
        total = np.concatenate([[0], np.cumsum((((signs >> _U(d)) & _U(1)).astype(np.int64) * 2 - 1)[ids])])
        vectors[:, d] = total[bounds[1:]] - total[bounds[:-1]]
    norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    unit = vectors / np.where(norm > 0, norm, 1)
    return hilbert_keys(np.clip(((unit + 1) * (1 << (bits - 1))).astype(np.int64), 0, (1 << bits) - 1), bits)


def encode_documents(docs: DataFrame, vocab_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, curve_key, n_tokens and the ids (compressed, little-endian) of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, pack = encoder(vocab_path), zstandard.ZstdCompressor(level=1)
        kind = "<u2" if e.size <= 1 << 16 else "<u4"
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                ids, bounds = e.rows(data, offsets[i : j + 1], end_id)
                raw = ids.astype(kind)
                blobs = [pack.compress(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(curve_keys(ids, bounds)), pa.array(np.diff(bounds)), pa.array(blobs, pa.binary())],
                    ["doc_id", "curve_key", "n_tokens", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, curve_key long, n_tokens long, ids binary")


class Stream:
    """The ids of a partition's documents, cut into sequences."""

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def __init__(self, partition: int, size: int) -> None:
        self.size, self.next = size, partition << 40
        self.ids, self.docs = np.zeros(0, np.uint32), []  # docs: (doc_id, tokens, start, ids here)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), 0, ids))

    def cut(self, last: bool) -> dict[str, list]:
        """The pieces of all full sequences, and of the tail if it is the ``last`` call."""
        ids = np.concatenate([d[3] for d in self.docs]) if self.docs else np.zeros(0, np.uint32)
        lengths = [self.size] * (len(ids) // self.size)
        rest = len(ids) % self.size
        if last:
            lengths += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        ends = np.cumsum([len(d[3]) for d in self.docs]).astype(np.int64)
        out = {k: [] for k in self.names}
        marks = np.unique(np.concatenate([edges, ends[ends <= edges[-1]]]))
        doc = np.searchsorted(ends, marks[:-1], "right")
        seq = np.searchsorted(edges, marks[:-1], "right") - 1
        for a, b, d, s in zip(marks[:-1].tolist(), marks[1:].tolist(), doc.tolist(), seq.tolist(), strict=True):
            doc_id, tokens, start, here = self.docs[d]
            row = (doc_id, start + a - (int(ends[d]) - len(here)), b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), tokens, self.next + s, a - int(edges[s]))
            for k, v in zip(self.names, row, strict=True):
                out[k].append(v)
        self.next += len(lengths)
        done = int(edges[-1])
        keep = int(np.searchsorted(ends, done, "right"))
        left = []
        for d, (doc_id, tokens, start, here) in enumerate(self.docs[keep:], keep):
            gone = max(0, done - (int(ends[d]) - len(here)))
            left.append((doc_id, tokens, start + gone, here[gone:]))
        self.docs = left
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocab_path: str, size: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of at most ``size`` (a power of two) ids.

    Every id of a document (its text's ids, then ``end_id``) lies in exactly one piece.  A null
    or empty text has the end id alone.  Repeated rows are packed each on its own; a null id
    stays null; other columns are not carried.  An empty table has no pieces.
    """
    wide = encoder(vocab_path).size > 1 << 16

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, unpack = Stream(TaskContext.get().partitionId(), size), zstandard.ZstdDecompressor()
        held = 0
        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(unpack.decompress(blob), "<u4" if wide else "<u2").astype(np.uint32)
                stream.add(doc_id, ids)
                held += len(ids)
                if held >= 1 << 20:
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in stream.cut(False).items()})
                    held = 0
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in stream.cut(True).items()})

    table = materialize(encode_documents(docs, vocab_path, end_id, id_col, text_col).withColumn("size", F.octet_length("ids")).withColumn("row", F.monotonically_increasing_id()), "packing")
    held = table.agg(F.sum("size").alias("n")).first()["n"] or 0
    ranges = max(-(-held // RANGE_BYTES), min(-(-held // SMALL_RANGE), SMALL_RANGES), 1)
    order = [F.col("curve_key"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("row")]
    return table.repartitionByRange(int(ranges), *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(cut, PIECES)
