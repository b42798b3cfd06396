"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

1. A text's fingerprint is its length and the values, modulo four primes below 2^31, of the polynomial whose
   coefficients are its bytes plus one.  Chunks of CHUNK bytes, counted from the end of the text, are hashed side by
   side as one matrix product: sums stay below 2^50, so float64 holds them exactly.  Two parts combine by
   H(ab) = H(a) B^|b| + H(b).
2. Texts above HUGE bytes are cut into pieces, which are rows of their own: their tasks hash them in parallel, and
   a text's pieces combine by the same rule.
3. Rows with equal fingerprints are compared, byte for byte, with the row of their group that would stay.
   Texts are dealt out as chunks of COMPARED bytes; leaders go to as many salts as their group has SALTED
   bytes, so a group of any size is spread, and a task holds one leader's chunk while the others stream by.
   Rows that differ form groups of their own in another turn; they are as many as fingerprints collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .words import mix, slices, utf8

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)  # the four largest below 2^31
CHUNK, TILE = 512, 2048  # bytes of a chunk, chunks hashed at once
HUGE, PIECE = 32 << 20, 8 << 20  # bytes, characters
COMPARED, SALTED = 1 << 20, 32 << 20
KEY = ["size", "h1", "h2", "h3", "h4"]
PRINT = "row_id long, size long, h1 long, h2 long, h3 long, h4 long"
_U = np.uint64


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class Polynomial:
    """The hash for some primes; fewer or smaller ones only make more collisions, which the comparison settles."""

    def __init__(self, primes: tuple[int, ...] = PRIMES) -> None:
        self.p = np.array(primes, _U)
        self.base = mix(np.arange(1, len(primes) + 1, dtype=_U)) % (self.p - _U(2)) + _U(2)
        self.weights = self.powers(self.base, CHUNK)[::-1].astype(np.float64)
        self.step = self.power(np.full(1, CHUNK))[0]

    def powers(self, base: np.ndarray, n: int) -> np.ndarray:
        """(n, primes) powers 0 to n - 1 of a base, by doubling."""
        out = np.ones((max(n, 1), len(self.p)), _U)
        have, at = 1, base % self.p
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * at % self.p
            have, at = have + more, at * at % self.p
        return out

    def power(self, exponents: np.ndarray) -> np.ndarray:
        """(len, primes) base ** exponent by square and multiply over all rows at once."""
        left = np.asarray(exponents, _U)[:, None]
        out, at = np.ones((len(left), len(self.p)), _U), np.broadcast_to(self.base % self.p, (len(left), len(self.p)))
        while left.any():
            out = np.where(left & _U(1), out * at % self.p, out)
            at, left = at * at % self.p, left >> _U(1)
        return out

    def combine(self, first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
        """Hashes of the joined texts, row by row."""
        return (first * self.power(second_bytes) % self.p + second) % self.p

    def of_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, primes) hashes of the rows of a text column; memory follows TILE and the longest row."""
        size = np.diff(offsets)
        out = np.zeros((len(size), len(self.p)), _U)
        chunks = np.maximum(-(-size // CHUNK), 1)
        for i, j in slices(np.concatenate([[0], np.cumsum(chunks)]), TILE):
            out[i:j] = self._tile(data[offsets[i] : offsets[j]], size[i:j], chunks[i:j])
        return out

    def _tile(self, part: np.ndarray, size: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        stop = np.cumsum(chunks)
        # Rows end where their last chunk ends; the zeros before a row add nothing to its polynomial.
        moved = np.repeat(stop * CHUNK - np.cumsum(size), size) + np.arange(len(part))
        sums = np.zeros((int(stop[-1]), len(self.p)), _U)
        flat = np.zeros(int(stop[-1]) * CHUNK, np.uint16)
        flat[moved] = part.astype(np.uint16) + 1
        for at in range(0, len(sums), TILE):
            m = flat[at * CHUNK : (at + TILE) * CHUNK].reshape(-1, CHUNK).astype(np.float64)
            sums[at : at + TILE] = (m @ self.weights).astype(_U) % self.p
        after = np.repeat(stop, chunks) - 1 - np.arange(len(sums))
        terms = sums * self.powers(self.step, int(chunks.max()))[after] % self.p
        return np.add.reduceat(terms, stop - chunks, axis=0) % self.p


def _hash_rows(primes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(primes)
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            h = poly.of_rows(data, offsets).astype(np.int64)
            columns = [*batch.columns[:-1], pa.array(np.diff(offsets)), *(pa.array(h[:, k % h.shape[1]].copy()) for k in range(4))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *KEY])

    return run


def _join_pieces(primes: tuple[int, ...]):
    """Texts from their pieces: rows (row_id, array of (piece, size, h1..h4) in order), at most 2 GB / PIECE of them a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(primes)
        for batch in batches:
            out = []
            for pieces in batch.column(1).to_pylist():
                h, size = np.zeros((1, len(poly.p)), _U), 0
                for p in pieces:
                    h = poly.combine(h, np.array([[p[f"h{k + 1}"] for k in range(len(poly.p))]], _U), np.array([p["size"]]))
                    size += p["size"]
                out.append([size, *(int(h[0, k % h.shape[1]]) for k in range(4))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))] if out else [batch.column(0), *[pa.array([], pa.int64())] * 5], ["row_id", *KEY])

    return run


def fingerprints(texts: DataFrame, primes: tuple[int, ...] = PRIMES, huge: int = HUGE, piece: int = PIECE) -> DataFrame:
    """row_id, size (bytes) and h1 to h4 of every row (row_id, text); texts above ``huge`` bytes by pieces of ``piece`` characters."""
    small = texts.filter(F.octet_length("text") <= huge).mapInArrow(_hash_rows(primes), PRINT)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int")), lambda i: F.struct(i.alias("piece"), F.substring("text", i * piece + 1, F.lit(piece)).alias("text")))
    pieces = texts.filter(F.octet_length("text") > huge).select("row_id", F.explode(cut).alias("p")).select("row_id", "p.piece", "p.text").repartition("row_id", "piece")
    hashed = pieces.mapInArrow(_hash_rows(primes), PRINT.replace("size", "piece int, size"))
    whole = hashed.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("piece", *KEY))).alias("pieces")).mapInArrow(_join_pieces(primes), PRINT)
    return small.unionByName(whole)


def _chunk_rows(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(4))
            n = np.maximum(-(-np.diff(offsets) // chunk), 1)
            row = np.repeat(np.arange(batch.num_rows), n)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            # Chunks lie end to end in the texts' buffer: only their offsets are made.
            edges = np.append(offsets[row] + number * chunk, offsets[-1]) - offsets[0]
            body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[offsets[0] : offsets[-1]]))])
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in range(4)), pa.array(number.astype(np.int32)), body], ["row_id", "leader", "salt", "other", "chunk", "body"])

    return run


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose chunk is not their leader's; each stream begins with the leader's chunk, the only one that is held."""
    held, key = None, None
    for batch in batches:
        at = list(zip(*(batch.column(c).to_pylist() for c in ("leader", "salt", "chunk")), strict=True))
        row, other, body, wrong = batch.column("row_id"), batch.column("other").to_pylist(), batch.column("body"), []
        for r in range(batch.num_rows):
            if not other[r]:
                key, held = at[r], body[r].as_py()
            elif key != at[r] or not body[r].as_buffer().equals(pa.py_buffer(held)):
                wrong.append(row[r].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.int64())], ["row_id"])


def _compare(texts: DataFrame, groups: DataFrame, prints: DataFrame, chunk: int, salted: int) -> DataFrame:
    """row_ids whose text is not that of their group's first row, whatever the fingerprints say."""
    of = groups.filter("n > 1").select(*KEY, F.col("first.row_id").alias("leader"), F.least(F.col("n") - 1, F.ceil(F.col("n") * F.greatest("size", F.lit(64)) / salted)).cast("int").alias("salts"))
    rows = prints.select("row_id", *KEY).join(of, KEY)
    mine = F.when(F.col("row_id") == F.col("leader"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int")))
    asked = rows.select("row_id", "leader", F.explode(mine).alias("salt"), (F.col("row_id") != F.col("leader")).alias("other"))
    chunks = asked.join(texts, "row_id").select("row_id", "leader", "salt", "other", "text").mapInArrow(_chunk_rows(chunk), "row_id long, leader long, salt int, other boolean, chunk int, body binary")
    streams = chunks.repartition("leader", "salt", "chunk").sortWithinPartitions("leader", "salt", "chunk", "other")
    return streams.mapInArrow(_differing, "row_id long").distinct()


class ExactGroups:
    """The groups of equal texts of a table.

    ``held`` has every row of ``docs`` with its row_id, as a struct ``row``; ``texts`` row_id and normalised text;
    ``verdicts`` row_id, doc_id, keep_id, group_size and kept.  Null texts count as empty.  The row with the smallest
    doc_id stays, a null id last; of rows that share it, one.  keep_id is null where a group has no id.  An empty
    table gives an empty result; columns of any name are left alone.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes: tuple[int, ...] = PRIMES, huge: int = HUGE, piece: int = PIECE, compared: int = COMPARED, salted: int = SALTED) -> None:
        whole = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        self.held = materialize(whole, "exact-rows")
        said = F.col("row").getField(text_col)
        self.texts = self.held.select("row_id", normalised(said).alias("text"))
        ids = self.held.select("row_id", F.col("row").getField(id_col).alias("doc_id"))
        # Ids and fingerprints come from two scans of one written table and meet once.
        prints = materialize(fingerprints(self.texts, primes, huge, piece).join(ids, "row_id"), "fingerprints")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first")
        parts, turn, open_rows = [], 0, prints
        while True:
            groups = materialize(open_rows.groupBy(*KEY).agg(first, F.count("*").alias("n")), "exact-groups")
            wrong = materialize(_compare(self.texts, groups, open_rows, compared, salted), "differing")
            if wrong.isEmpty():
                parts.append(open_rows.withColumn("turn", F.lit(turn)))
                break
            parts.append(open_rows.join(wrong, "row_id", "left_anti").withColumn("turn", F.lit(turn)))
            open_rows, turn = materialize(open_rows.join(wrong, "row_id", "left_semi"), "fingerprints"), turn + 1
        settled = parts[0]
        for p in parts[1:]:
            settled = settled.unionByName(p)
        if turn:
            groups = materialize(settled.groupBy(*KEY, "turn").agg(first, F.count("*").alias("n")), "exact-groups")
        else:
            groups = groups.withColumn("turn", F.lit(0))
        by = settled.join(groups, [*KEY, "turn"])
        self.verdicts = by.select("row_id", "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row_id") == F.col("first.row_id")).alias("kept"))


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the normalised text's SHA-256 of every row."""
    g = ExactGroups(docs, **options)
    return g.texts.select("row_id", F.sha2("text", 256).alias("text_sha256")).join(g.verdicts, "row_id").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def unique_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns unchanged."""
    g = ExactGroups(docs, **options)
    kept = g.held.join(g.verdicts.filter("kept").select("row_id"), "row_id", "left_semi")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
