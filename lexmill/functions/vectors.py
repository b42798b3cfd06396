"""Vector expressions on array columns, and the deterministic text embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1024
#: A text and the number of dimensions give a vector.
Embedder = Callable[[str, int], np.ndarray]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """0 for null or unequally long vectors; a zero norm divides by 1."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    return F.when(ok, dot(a, b) / F.when(norm == 0, 1.0).otherwise(norm)).otherwise(F.lit(0.0))


def is_valid(v: Column, dims: int) -> Column:
    """The right length, and every component a finite number."""
    return (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def embed(text: str, dims: int = DIMS) -> np.ndarray:
    """For each code point c: 1 at c mod dims and 0.5 at 31 c mod dims; then length 1."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    v = np.bincount(c % dims, minlength=dims) + 0.5 * np.bincount(31 * c % dims, minlength=dims)
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def embed_texts(rows: DataFrame, dims: int = DIMS, embedder: Embedder = embed, batch: int = 256) -> DataFrame:
    """``rows`` (doc_id, text) as doc_id and embedding, ``batch`` texts at a time; null texts count as empty.

    Every batch is checked before it goes on: a vector of another length, or with a component that is not finite, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vectors = [np.asarray(embedder(t or "", dims), np.float64) for t in part.column(1).to_pylist()]
                if any(v.shape != (dims,) or not np.isfinite(v).all() for v in vectors):
                    raise ValueError("VECTOR_INCOMPATIBLE")
                edges = pa.array(np.arange(len(vectors) + 1) * dims, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edges, pa.array(np.concatenate(vectors)))], ["doc_id", "embedding"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, embedding array<double>")
