"""Operator 12, whitening of embeddings: a randomised range finder over all centred rows.

The fit list is each distinct vector of longs once. Its sums are exact; V is the covariance of its centred rows, which
is never stored: a pass multiplies a block Q of a few columns by it, sum of (x - m)((x - m)'Q) / n, as partial sums that
Spark adds up by entry.

1. A random block of `components` + `oversampling` columns is multiplied by V `power` + 1 times, made orthonormal
   between the passes, so that it spans the leading directions.
2. Rayleigh-Ritz: with Q'VQ = W diag(e) W', the components are the columns of QW.
3. The residuals |V z - e z| of the wanted components tell whether they are eigenvectors to double precision. Where one
   of them is not, as in spectra without gaps, the block grows to the full dimension and one more pass gives them all.

The driver holds blocks of dimension x columns, never rows. Rows that are null, or hold null or non-finite entries or
such beyond 2**45 (whole numbers of doubles no more), take no part; vectors shorter than the longest one end in zeros;
rows that repeat count once in the fit list and are returned each, ids null or not. Components without variance have no
scale: `whitened` is null, and `explained` is null where nothing varies. A squared deviation that no long holds is null.
Without rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import shared, vectors

COMPONENTS = 4
OVERSAMPLING = 12
POWER = 3
#: A component is exact where its residual is below this part of the distance to the next eigenvalue.
EXACT = 1e-13
SEED = 12
_CHUNK = 4096
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n distinct rows with sums S by dimension; components as columns, their eigenvalues, the trace of V."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    full: bool

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def scaled(self) -> np.ndarray:
        """Directions over the roots of their eigenvalues; those without variance as zeros."""
        some = self.values > 0
        return self.directions * np.where(some, 1 / np.sqrt(np.where(some, self.values, 1)), 0)


def rows_of(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, written, and the dimension."""
    good = embeddings.where(vectors.usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), vectors.whole(F.col(vector_col)).alias("x"))
    rows, width = vectors.padded(good)
    return vectors.written_rows(rows, "whiten-rows"), width


def summed(fit: DataFrame, width: int, cells: int, block) -> np.ndarray:
    """The sum over fit (x) of block(rows as doubles), an array of `cells` doubles: by task, then by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            x = vectors.matrix(batch.column(0), width)
            for at in range(0, len(x), _CHUNK):
                total += block(x[at : at + _CHUNK].astype(np.float64)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int64)), pa.array(total)], names=["cell", "value"])

    got = fit.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(cells)
    out[got.column("cell").to_numpy()] = got.column("value").to_numpy()
    return out


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(n, sums by dimension), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = vectors.matrix(batch.column(0), width)
            for at in range(0, len(x), 512):
                # 512 numbers below 2**53 add up in a long.
                total = [a + b for a, b in zip(total, x[at : at + 512].sum(axis=0).tolist())]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int64()), pa.array([str(v) for v in (n, *total)])], names=["cell", "value"])

    got = fit.select("x").mapInArrow(run, "cell long, value string").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    by = {r.cell: int(r.value) for r in got}
    return by.get(-1, 0), [by.get(i, 0) for i in range(width)]


def applied(fit: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(VQ, trace of V) in one pass over the centred rows."""
    d, columns = q.shape

    def block(x: np.ndarray) -> np.ndarray:
        x = x - mean
        return np.append((x.T @ (x @ q)).reshape(-1), np.square(x).sum())

    out = summed(fit, d, d * columns + 1, block) / n
    return out[:-1].reshape(d, columns), float(out[-1])


def fitted(fit: DataFrame, width: int, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, power: int = POWER, exact: float = EXACT) -> Whitening:
    """The leading components of fit (x), distinct rows, some at least."""
    n, total = sums(fit, width)
    mean = np.array([s / n for s in total])
    wanted = min(components, width)
    columns = min(width, wanted + oversampling)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, columns)))[0]
    if columns < width:
        for _ in range(power + 1):
            q = np.linalg.qr(applied(fit, mean, n, q)[0])[0]
    while True:
        vq, trace = applied(fit, mean, n, q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        full = q.shape[1] == width
        z = q @ turn
        residual = np.linalg.norm(vq @ turn - z * values, axis=0)[:wanted]
        gap = np.abs(np.diff(values))[:wanted] if len(values) > 1 else values[:wanted]
        if full or (residual <= exact * np.maximum(gap, 0)).all():
            break
        # What the block spans stays; the rest of the space is added to it.
        q = np.linalg.qr(np.concatenate((q, np.eye(width)), axis=1))[0][:, :width]
    least = width * np.finfo(float).eps * max(float(values[0]), 0.0)
    values = np.where(values > least, values, 0.0)
    return Whitening(n, total, z[:, :wanted], values[:wanted], trace, full)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of (covariance of the whitened fit list - identity), over components with variance."""
    b, mean = model.scaled()[:, model.values > 0], model.mean
    k = b.shape[1]
    if not k:
        return None

    def block(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ b
        return np.append((w.T @ w).reshape(-1), w.sum(axis=0))

    out = summed(fit, len(mean), k * k + k, block) / model.n
    return float(np.abs(out[: k * k].reshape(k, k) - np.outer(out[k * k :], out[k * k :]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Sums over dimensions of (n * x - S)**2, exact; null where no long holds one."""
    reach = n * max(1, int(np.abs(x).max(initial=0))) + max(1, *(abs(s) for s in total)) if total else 1
    if reach * reach * max(1, len(total)) < 1 << 63:
        away = x * np.int64(n) - np.array(total, np.int64)
        return pa.array(np.einsum("ij,ij->i", away, away))
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def transformed(rows: DataFrame, model: Whitening, error: float | None) -> DataFrame:
    """ROWS: the digest of each of rows (vec_id, x), a row for each component."""
    width, k = model.directions.shape
    mean, b, some = model.mean, model.scaled(), model.values > 0
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column(1), width)
            own = np.arange(len(x)).repeat(k)
            white = ((x - mean) @ b).reshape(-1)
            columns = [batch.column(0).take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(own), model.n))]
            columns += [deviations(x, model.n, model.sums).take(pa.array(own)), pa.array(white, mask=~np.tile(some, len(x))), pa.array(explained * len(x), pa.float64()), pa.array([error] * len(own), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, ROWS)


def whitened(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """ROWS for every row that takes part and each component up to `components`."""
    rows, width = rows_of(embeddings, id_col, vector_col)
    if not width:
        # No rows, or vectors of no dimension, which have no components.
        return embeddings.sparkSession.createDataFrame([], ROWS)
    fit = vectors.written_rows(rows.select("x").distinct(), "whiten-fit")
    model = fitted(fit, width, components)
    out = transformed(rows, model, identity_error(fit, model))
    shared.dropped(fit)
    return out
