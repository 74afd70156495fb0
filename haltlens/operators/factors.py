"""Low-rank factors of a sparse vector column: truncated singular value decomposition as a Spark ML stage.

The largest singular values and right vectors come from block Krylov iteration on the Gram operator v -> X'(X v). A pass takes one block of vectors through the rows:
each task folds its rows into one matrix of terms by block width, the matrices are summed by term in Spark, and what the driver holds (a few blocks, ``depth``, before
the basis is made anew from its best vectors) grows with the vocabulary, never with the rows. Work a pass is linear in the entries that are not zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltlens.sources import tables

#: Entries that a task multiplies at a time.
ENTRIES = 1 << 16


@dataclass(frozen=True)
class Factors:
    """``values`` fall; ``vectors`` is width by rank, the largest entry of each column positive. ``converged``: whether every residual is below the tolerance."""

    values: np.ndarray
    vectors: np.ndarray
    passes: int
    converged: bool


def entries(vector: str | Column) -> tuple[Column, Column]:
    """Places and values of a vector's stored entries, of dense and sparse vectors alike, in built-in expressions."""
    v = F.unwrap_udt(vector)
    return F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)), v["values"]


def rows_of(df: DataFrame, vector: str) -> DataFrame:
    """i (places) and v (values) of each row that has an entry; rows of none and null vectors add nothing to the Gram operator."""
    i, v = entries(F.col(vector))
    return df.filter(F.size(F.unwrap_udt(F.col(vector))["values"]) > 0).select(i.alias("i"), v.alias("v"))


def _chunks(lists: pa.ListArray, values: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row borders, places, values) of consecutive rows, about ENTRIES entries each; a longer row is one by itself."""
    border = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    place, value = lists.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    at = 0
    while at < len(lists):
        end = max(at + 1, int(np.searchsorted(border, border[at] + ENTRIES, "right")) - 1)
        yield border[at : end + 1] - border[at], place[border[at] : border[end]], value[border[at] : border[end]]
        at = end


def _times(border: np.ndarray, place: np.ndarray, value: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows of entries times a matrix: one row each, zero where a row has no entry."""
    out = np.zeros((len(border) - 1, right.shape[1]))
    some = np.flatnonzero(np.diff(border))
    if len(some):
        out[some] = np.add.reduceat(value[:, None] * right[place], border[some], axis=0)
    return out


def gram_product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """X'(X block) for ``rows`` as ``rows_of`` makes them: one pass. The block, bounded by the vocabulary, is what tasks are sent; sums are by term."""
    width, n = block.shape
    sent = rows.sparkSession.sparkContext.broadcast(block)
    names = [f"c{j}" for j in range(n)]
    schema = pa.schema([("term", pa.int32()), *[(c, pa.float64()) for c in names]])

    def run(batches):
        right, total = sent.value, None
        for b in batches:
            for border, place, value in _chunks(b.column(0), b.column(1)):
                total = np.zeros((width, n)) if total is None else total
                y = _times(border, place, value, right)
                owner = np.repeat(np.arange(len(border) - 1), np.diff(border))
                order = np.argsort(place, kind="stable")
                terms, first = np.unique(place[order], return_index=True)
                total[terms] += np.add.reduceat(value[order, None] * y[owner[order]], first, axis=0)
        if total is not None:
            seen = np.flatnonzero(np.any(total != 0, axis=1))
            for at in range(0, len(seen), 4096):
                part = seen[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[pa.array(total[part, j]) for j in range(n)]], schema=schema)

    told = rows.mapInArrow(run, ", ".join(["term int", *[f"{c} double" for c in names]]))
    got = told.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    sent.destroy()
    out = np.zeros((width, n))
    out[got["term"].to_numpy()] = got[names].to_numpy()
    return out


def _orthonormal(block: np.ndarray, basis: np.ndarray | None, size: float) -> np.ndarray:
    """Columns that span what ``block`` has beyond ``basis``; directions below rounding (of ``size``) are left out."""
    for _ in range(2):
        if basis is not None:
            block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-12 * size]
        size = 1e-3  # of unit columns: what the first round left is cleared of rounding by the second
    return block


def truncated_svd(rows: DataFrame, width: int, k: int, *, over: int = 8, tolerance: float = 1e-9, passes: int = 200, depth: int = 4, seed: int = 42) -> Factors:
    """The ``k`` largest singular values of the matrix whose rows ``rows_of`` made, and their right vectors; fewer where its rank is less. ``over``: vectors carried besides.

    Ends when the residual of each is below ``tolerance`` of the largest eigenvalue of X'X, when the basis spans all that the matrix can reach, or, not converged, after ``passes`` passes."""
    size = min(width, k + over)
    block = _orthonormal(np.random.default_rng(seed).standard_normal((width, size)), None, 1.0)
    basis, images, done = None, None, 0
    while True:
        image = gram_product(rows, block)
        done += 1
        basis, images = (block, image) if basis is None else (np.hstack([basis, block]), np.hstack([images, image]))
        inner = basis.T @ images
        value, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn, value = turn[:, ::-1][:, :size], value[::-1][:size]
        ritz, moved = basis @ turn, images @ turn
        left = moved - ritz * value
        top = max(value[0], 0.0)
        converged = top == 0 or float(np.linalg.norm(left[:, :k], axis=0).max()) <= tolerance * top
        if converged or done >= passes:
            break
        if basis.shape[1] + size > depth * size:
            basis, images = ritz, moved
        block = _orthonormal(left, basis, top)
        if not block.shape[1]:
            converged = True
            break
    kept = [j for j in range(min(k, len(value))) if value[j] > max(width, 1) * np.finfo(float).eps * top]
    vectors = ritz[:, kept]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))] < 0, -1.0, 1.0) if kept else vectors
    return Factors(np.sqrt(value[kept]), vectors, done, converged)


class _Rank(HasInputCol, HasOutputCol):
    k = Param(Params._dummy(), "k", "how many factors", TypeConverters.toInt)

    def getK(self) -> int:
        return self.getOrDefault(self.k)


class TruncatedSVD(Estimator, _Rank):
    """Fits the ``k`` largest factors of a vector column, uncentred; at most one less than rows and than width, and none at all where that leaves fewer than two."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, k=64):
        super().__init__()
        self._setDefault(k=64)
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> TruncatedSVDModel:
        column = self.getInputCol()
        v = F.unwrap_udt(F.col(column))
        n, width = df.agg(F.count(column), F.max(F.coalesce(v["size"], F.size(v["values"])))).first()
        k = min(self.getK(), (width or 0) - 1, n - 1)
        factors = Factors(np.zeros(0), np.zeros((width or 0, 0)), 0, True)
        if k >= 2:
            # passes read a written table: a lost executor costs a pass its tasks, not the features before it
            spark, path = df.sparkSession, tables.scratch(df.sparkSession, "svd-rows")
            rows_of(df, column).write.option("compression", "zstd").parquet(path)
            factors = truncated_svd(spark.read.parquet(path), width, k)
            p, fs = tables._file_system(spark, path)
            fs.delete(p, True)
        return self._copyValues(TruncatedSVDModel(factors))


class TruncatedSVDModel(Model, _Rank):
    """Rows to their coordinates on the right vectors: X V, of length zero where nothing was fitted, null where the vector is."""

    def __init__(self, factors: Factors | None = None):
        super().__init__()
        self.factors = factors

    def _transform(self, df: DataFrame) -> DataFrame:
        vectors = self.factors.vectors
        if not vectors.shape[1]:
            return df.withColumn(self.getOutputCol(), F.when(F.col(self.getInputCol()).isNotNull(), array_to_vector(F.array().cast("array<double>"))))
        sent = df.sparkSession.sparkContext.broadcast(vectors)

        @F.pandas_udf("array<double>")
        def project(places: pd.Series, values: pd.Series) -> pd.Series:
            sizes = [len(p) for p in places]
            border = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            out, at = [], 0
            while at < len(sizes):
                end = max(at + 1, int(np.searchsorted(border, border[at] + ENTRIES, "right")) - 1)
                flat = lambda s, kind: np.concatenate([np.asarray(x, kind) for x in s.iloc[at:end]])  # noqa: B023, E731
                out += list(_times(border[at : end + 1] - border[at], flat(places, np.int64), flat(values, float), sent.value))
                at = end
            return pd.Series(out)

        known = F.col(self.getInputCol()).isNotNull()
        i, v = entries(F.col(self.getInputCol()))
        none = lambda kind: F.array().cast(f"array<{kind}>")
        got = project(F.coalesce(F.when(F.size(v) > 0, i), none("int")), F.coalesce(v, none("double")))
        return df.withColumn(self.getOutputCol(), F.when(known, array_to_vector(got)))
