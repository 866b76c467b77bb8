"""Whitening of embeddings: principal components of the distinct vectors, scaled to unit variance.

Vectors become whole numbers, ``floor(scale * c)``. The fit list holds each distinct
vector once (a distinct aggregate: equal vectors meet after map-side combining, so a
vector that a third of the rows share is no hot key). Its rows are centred exactly, as
``n * x - S`` in whole numbers, and only then turned to doubles. MLlib's ``RowMatrix``
gives their Gramian, a tree aggregate of upper triangles; divided by n it is the
covariance. ``numpy.linalg.eigh`` runs on the driver, over a matrix of dimensions by
dimensions. The components are broadcast and applied in ``mapInPandas``, row by row.

What passes the driver grows with the square of the dimensions (``MAX_DIMENSIONS``), not
with the rows.

Defined cases: a row whose vector is null, or holds null, NaN or an infinity, is dropped;
so is an empty vector, which has no component. Vectors of several lengths are an error. Components
without variance (fewer distinct vectors than dimensions, constant entries) have
``explained`` 0 and a null ``whitened``; the identity error covers the others. Of a
component's two directions, the one whose largest entry is positive is taken. Ids may be
null or repeated. An empty table, or one without a usable vector, gives an empty result.
Sums that leave 64 bits are made in numbers of any size. Only the id and vector columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.scratch import Tables

#: Dimensions up to which the covariance goes to the driver, 128 MB.
MAX_DIMENSIONS = 4096
#: Results of 64-bit arithmetic are taken up to here.
SAFE = 1 << 62


@dataclass(frozen=True)
class Model:
    """n distinct vectors with the sums of their entries; components (row by row), eigenvalues, trace, and the identity error of the first kept ones."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    largest: int
    identity_error: float | None = None

    def scaled(self, keep: int) -> np.ndarray:
        """Dimension by component: what a centred vector is multiplied with; columns without variance are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues[:keep] > 0, self.components[:keep].T / np.sqrt(self.eigenvalues[:keep]), np.nan)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in 64 bits where they hold it, else as Python's whole numbers."""
        kind = np.int64 if 2 * self.n * max(1, self.largest) < SAFE else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n with one rounding."""
        return (self.offsets(x) / self.n).astype(float)


def whole(embeddings: DataFrame, vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """embeddings without unusable vectors, with _x: the entries as whole numbers."""
    entries = F.transform(vector_col, lambda c: c.cast("double"))
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.filter(usable).withColumn("_x", F.transform(entries, lambda c: F.floor(c * scale).cast("long")))


def _stacked(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.int64)


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: rows, the sums of the entries as decimal text, and the largest entry's size."""
    for frame in frames:
        if len(frame):
            x = _stacked(frame["_x"])
            largest = max(abs(int(x.min())), abs(int(x.max())))
            total = x.sum(axis=0) if len(x) * largest < SAFE else x.astype(object).sum(axis=0)
            yield pd.DataFrame({"i": np.arange(x.shape[1]), "s": [str(v) for v in total], "largest": str(largest), "n": len(x)})


def gramian(rows: DataFrame) -> np.ndarray:
    """The Gramian of a column of arrays of doubles, from MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(rows.columns[0]).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fit(distinct: DataFrame, keep: int) -> Model | None:
    """The model of a written table of distinct vectors (_x); None if it has no row."""
    lengths = [r[0] for r in distinct.groupBy(F.size("_x").alias("d")).count().orderBy("d").limit(3).collect()]
    if not lengths:
        return None
    if len(lengths) > 1 or lengths[0] > MAX_DIMENSIONS:
        raise ValueError(f"vectors must have one length of at most {MAX_DIMENSIONS}, not {lengths}")
    parts = distinct.mapInPandas(_sums, "i int, s string, largest string, n long")
    summed = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max(F.col("largest").cast("decimal(20,0)")).alias("largest"), F.sum("n").alias("n"))
    told = summed.orderBy("i").collect()
    empty = np.zeros((0, lengths[0]))
    model = Model(told[0]["n"], tuple(int(r["s"]) for r in told), empty, np.zeros(0), 0.0, max(int(r["largest"]) for r in told))

    def centred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"v": list(model.centred(_stacked(frame["_x"])))})

    covariance = gramian(distinct.mapInPandas(centred, "v array<double>")) / model.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1].T
    values = np.where(values > max(values[0], 0.0) * len(values) * np.finfo(float).eps, values, 0.0)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.argmax(np.abs(vectors), axis=1)])[:, None]
    made = Model(model.n, model.sums, vectors[:keep], values[:keep], float(np.trace(covariance)), model.largest)
    return Model(made.n, made.sums, made.components, made.eigenvalues, made.trace, made.largest, _identity_error(distinct, made, keep))


def _identity_error(distinct: DataFrame, model: Model, keep: int) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity, over components with variance."""
    live = model.eigenvalues[:keep] > 0
    if not live.any():
        return None

    def whitened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"v": list(model.centred(_stacked(frame["_x"])) @ model.scaled(keep)[:, live])})

    found = gramian(distinct.mapInPandas(whitened, "v array<double>")) / model.n
    return float(np.abs(found - np.eye(len(found))).max())


def whiten(embeddings: DataFrame, keep: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Per usable row and component up to keep: its id, component (from 1), n, deviation, whitened, explained, identity_error.

    deviation, the sum over dimensions of (n * x - S) ** 2, is exact, as decimal(38, 0);
    null where that cannot hold it.
    """
    spark = embeddings.sparkSession
    tables = Tables(spark)
    kind = embeddings.select(F.col(id_col)).schema[0].dataType.simpleString()
    fields = f"`{id_col}` {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    rows = whole(embeddings.select(id_col, vector_col), vector_col, scale).select(id_col, "_x")
    distinct = tables.write(rows.select("_x").distinct(), "whiten-distinct")
    model = fit(distinct, keep)
    tables.close()
    told = spark.sparkContext.broadcast(model)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = told.value
        for frame in frames:
            if not len(frame):
                continue
            x = _stacked(frame["_x"])
            offsets, many = model.offsets(x), min(keep, x.shape[1])
            largest = max(abs(int(offsets.min())), abs(int(offsets.max())))
            squares = offsets if x.shape[1] * largest**2 < SAFE else offsets.astype(object)
            deviation = [str(v) for v in (squares * squares).sum(axis=1)]
            whitened = (offsets / model.n).astype(float) @ model.scaled(many)
            yield pd.DataFrame(
                {
                    id_col: frame[id_col].repeat(many).to_numpy(),
                    "component": np.tile(np.arange(1, many + 1, dtype=np.int32), len(x)),
                    "n": model.n,
                    "deviation": np.repeat(deviation, many),
                    "whitened": whitened.ravel(),
                    "explained": np.tile(model.eigenvalues[:many] / model.trace if model.trace else np.zeros(many), len(x)),
                    "identity_error": model.identity_error,
                }
            )

    done = rows.mapInPandas(apply, fields)
    whitened = F.when(~F.isnan("whitened"), F.col("whitened")).alias("whitened")
    return done.select(id_col, "component", "n", F.expr("try_cast(deviation as decimal(38, 0))").alias("deviation"), whitened, "explained", "identity_error")
