"""Embedding whitening from an exact integer scatter matrix.

Tasks subtract a shift from the integer vectors and sum them and their products exactly: vectors are cut into limbs
small enough for float64 matrix products to be exact, and the totals are integers of any size.  They leave a task as
32-bit limbs of each cell, which Spark adds up by cell; (d + 1)(d + 2) / 2 cells come to the driver, whatever
the number of rows.  There n XᵀX - SSᵀ is formed in integers, becomes float only then, and is decomposed by eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_valid
from ..plans.scratch import materialize

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
SLICE, LIMB, LIMBS = 512, 22, 3  # rows of a product, bits of a limb: 2 * 22 bits times 512 rows stay below 2^53
WORDS = 6  # 32-bit words of a total
LONG = float((1 << 63) - (1 << 20))  # room for an offset


def common_length(rows: DataFrame, vec_col: str = "embedding") -> int:
    """The length that most vectors have, the longer one of equally many; 0 without vectors."""
    found = rows.filter(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]
    return 0 if found is None else found["d"]


def _floor(v: Column) -> Column:
    """floor as a double: F.floor gives a long, which large values do not fit."""
    return F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)


def integer_vectors(rows: DataFrame, scale: int, offset: int = 0, vec_col: str = "embedding") -> DataFrame:
    """``rows`` whose vectors are whole, finite and of the common length, with ``x`` = floor(scale * component) + offset as longs.

    Rows with another length, or with a component whose x no long holds, are left out.
    """
    d = common_length(rows, vec_col)
    good = rows.filter(is_valid(F.col(vec_col), d) if d else F.lit(False))
    scaled = F.transform(F.col(vec_col), lambda c: _floor(F.lit(float(scale)) * c.cast("double")))
    fits = good.withColumn("_scaled", scaled).filter(F.forall("_scaled", lambda v: F.abs(v) < LONG))
    return fits.withColumn("x", F.transform("_scaled", lambda v: v.cast("long") + offset)).drop("_scaled")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def exact_products(y: np.ndarray) -> np.ndarray:
    """yᵀy as an object array of Python integers, for at most 2^19 int64 rows."""
    d, limbs = y.shape[1], [y]
    if len(y) and max(abs(int(y.min())), abs(int(y.max()))) >= 1 << LIMB:
        limbs = [(y >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)] + [y >> (LIMB * (LIMBS - 1))]
    total = np.zeros((d, d), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            part = np.zeros((d, d), np.int64)
            for at in range(0, len(y), SLICE):
                part += (a[at : at + SLICE].astype(np.float64).T @ b[at : at + SLICE].astype(np.float64)).astype(np.int64)
            total += part.astype(object) * (1 << (LIMB * (i + j)))
    return total


def _scatter(dims: int, shift: list[int]):
    upper = np.triu_indices(dims + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1), object)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = matrix(batch.column(0).slice(at, 4096), dims)
                far = max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, shift))
                total[0, 0] += len(x)
                if far < 1 << 50:
                    y = x - np.array(shift, np.int64)
                    total[0, 1:] += y.sum(axis=0).astype(object)
                    total[1:, 1:] += exact_products(y)
                else:
                    y = x.astype(object) - np.array(shift, object)
                    total[0, 1:] += y.sum(axis=0)
                    total[1:, 1:] += exact_products(y.astype(np.int64)) if far < 1 << 63 else y.T @ y
        cells = total[upper]
        words = [np.array([(int(v) >> (32 * w)) & 0xFFFFFFFF if w < WORDS - 1 else int(v) >> (32 * w) for v in cells], np.int64) for w in range(WORDS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), *map(pa.array, words)], ["cell", *(f"w{w}" for w in range(WORDS))])

    return run


class Whitening:
    """n, the sums S of x, the covariance V, eigenvalues (falling) and unit eigenvectors (columns) of a table's integer vectors ``x``.

    A component whose eigenvalue is 0 to double precision has no scale: its whitened values are 0.
    """

    def __init__(self, vectors: DataFrame) -> None:
        first = vectors.select("x").first()
        self.n, self.dims, self.shift = 0, 0, []
        if first is None:
            return
        self.shift = list(first["x"])
        self.dims = len(self.shift)
        spec = "cell int, " + ", ".join(f"w{w} long" for w in range(WORDS))
        cells = vectors.select("x").mapInArrow(_scatter(self.dims, self.shift), spec).groupBy("cell").agg(*(F.sum(f"w{w}").alias(f"w{w}") for w in range(WORDS)))
        total = np.zeros((self.dims + 1, self.dims + 1), object)
        at = np.triu_indices(self.dims + 1)
        for r in cells.collect():
            total[at[0][r["cell"]], at[1][r["cell"]]] = sum(r[f"w{w}"] << (32 * w) for w in range(WORDS))
        total = np.triu(total) + np.triu(total, 1).T
        self.n, self.shifted = total[0, 0], total[0, 1:]
        self.sums = [int(s) + self.n * b for s, b in zip(self.shifted, self.shift, strict=True)]
        scatter = self.n * total[1:, 1:] - np.outer(self.shifted, self.shifted)
        self.covariance = np.array([[float(Fraction(int(v), self.n * self.n)) for v in row] for row in scatter])
        values, vectors_ = np.linalg.eigh(self.covariance)
        self.values, self.vectors = values[::-1].copy(), vectors_[:, ::-1].copy()
        biggest = np.abs(self.vectors).argmax(axis=0)
        self.vectors *= np.sign(self.vectors[biggest, np.arange(self.dims)])
        self.trace = float(np.trace(self.covariance))
        self.live = self.values > self.values[0] * self.dims * 2.0**-50

    def transform(self, vectors: DataFrame, id_col: str, components: int = COMPONENTS) -> DataFrame:
        """id, deviation (decimal; null beyond 38 digits) and whitened (array of up to ``components`` values) of every row."""
        kind = vectors.schema[id_col].dataType.simpleString()
        spec = f"{id_col} {kind}, deviation decimal(38,0), whitened array<double>"
        if not self.n:
            return vectors.sparkSession.createDataFrame([], spec)
        k, n, dims = min(components, self.dims), self.n, self.dims
        scale = np.where(self.live[:k], 1 / np.sqrt(np.where(self.live[:k], self.values[:k], 1.0)), 0.0)
        project, shift, sums = self.vectors[:, :k] * scale, np.array(self.shift, object), self.shifted

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = matrix(part.column(1), dims)
                    far = n * (max(abs(int(x.max()) - min(shift)), abs(int(x.min()) - max(shift))) + 1) + max(abs(int(s)) for s in sums)
                    if dims * far * far < 1 << 63:  # whole computation fits a long
                        z = n * (x - np.array(shift, np.int64)) - sums.astype(np.int64)
                        deviation = (z * z).sum(axis=1).tolist()
                    else:
                        z = n * (x.astype(object) - shift) - sums
                        deviation = (z * z).sum(axis=1).tolist()
                    values = pa.array([v if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
                    w = (z.astype(np.float64) / n) @ project
                    edges = pa.array(np.arange(len(w) + 1, dtype=np.int32) * k)
                    yield pa.RecordBatch.from_arrays([part.column(0), values, pa.ListArray.from_arrays(edges, pa.array(w.ravel()))], [id_col, "deviation", "whitened"])

        return vectors.select(id_col, "x").mapInArrow(run, spec)

    def identity_error(self, whitened: DataFrame, components: int = COMPONENTS) -> float:
        """Largest absolute entry of the covariance of the ``whitened`` rows minus the identity, over components with a scale.

        Centred on the rows' own means before anything is multiplied; two aggregates of one row each.
        """
        use = [c for c in range(min(components, self.dims)) if self.live[c]] if self.n else []
        if not use:
            return 0.0
        at = lambda c: F.get("whitened", F.lit(c))
        means = whitened.agg(*(F.avg(at(c)).alias(f"m{c}") for c in use)).first()
        pairs = [(a, b) for a in use for b in use if a <= b]
        found = whitened.agg(*(F.avg((at(a) - means[f"m{a}"]) * (at(b) - means[f"m{b}"])).alias(f"c{a}_{b}") for a, b in pairs)).first()
        return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, n, deviation (decimal), component (from 1), whitened, explained and identity_error of every row and component.

    Rows with a null vector, a null or non-finite entry, an entry beyond a long or a length that is not the commonest one
    take no part.  Null and repeated ids are rows like others.  Where all variance is 0, explained is 0.
    An empty table gives an empty result.
    """
    vectors = integer_vectors(rows.select(id_col, vec_col), SCALE, OFFSET, vec_col).select(id_col, "x")
    fit = Whitening(vectors)
    table = materialize(fit.transform(vectors, id_col, components), "whitened")
    error = fit.identity_error(table, components)
    shares = [float(v / fit.trace) if fit.trace > 0 else 0.0 for v in fit.values[: min(components, fit.dims)]] if fit.n else []
    explained = F.get(F.array(*map(F.lit, shares)), F.col("at")) if shares else F.lit(0.0)
    spread = table.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return spread.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(int(fit.n)).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
