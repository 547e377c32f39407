"""Whitening of embeddings by a matrix-free block Lanczos method.

Entries become whole numbers (``floor(scale * c) + shift``), so that sums, deviations and the trace are
exact. The fit list, each distinct vector once, is staged; the covariance V over it is never formed. One
Spark pass multiplies it with a block of vectors: every task centres its rows before it multiplies
and gives a (dimension x block) partial sum, and rows of these add up by their index. The block Krylov
basis is orthogonalised twice against all of itself; when a block loses rank (an invariant
subspace, or fewer distinct vectors than columns) fresh directions replace the lost columns, and when the basis outgrows
``most`` columns the iteration restarts from its best Ritz vectors. It ends when the residuals
|Vu - eu| of all wanted components are at ``tol`` of the largest eigenvalue, or the basis spans the whole space, where they are exact.
The trace is the sum of the exact deviations, which gives the explained shares without the other eigenvalues. A
last pass measures the whitened covariance itself.

What reaches the driver is bounded by the dimension: sums, and products of V with a block. Nothing is broadcast but these.

Edge cases: a row goes if its vector is null, holds a null or non-finite entry, an entry so large that its whole number passes 2^40, or
has another length than most (of equally common lengths the longest counts). Repeated vectors count once in the fit, but every row is whitened; null and
repeated vec_ids keep their rows. Components with no variance (an eigenvalue of 0 up to rounding, so all of them
with one distinct vector) have no whitened values and are left out. A deviation beyond a long is null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**40
FLAT = 1e-11
"""An eigenvalue below this share of the trace is rounding."""


def whole(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x, the whole numbers of every row that stays."""
    entries = F.transform("embedding", lambda c: c.cast("double") * scale)
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = vectors.select("vec_id", entries.alias("e")).where(F.col("e").isNotNull() & (F.size("e") > 0) & fine)
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c) + shift).alias("x"))


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


@dataclass
class Fit:
    """The distinct vectors with their exact sums; products with their covariance."""

    xs: DataFrame
    n: int
    d: int
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @staticmethod
    def of(rows: DataFrame) -> Fit:
        """``rows``: x. Staged once, as every pass reads it."""
        xs = stage(rows.select("x").distinct(), "whitening-fit")
        n = xs.count()
        fit = Fit(xs, n, len(xs.first()["x"]) if n else 0)
        if n:
            fit.sums = fit._total(lambda x: x.sum(axis=0).reshape(-1, 1), 1, np.int64)[:, 0]
        return fit

    def _total(self, of_rows: Callable[[np.ndarray], np.ndarray], width: int, kind: type, height: int | None = None) -> np.ndarray:
        """Sum of ``of_rows`` (height x width) over all vectors: partial sums of each task meet by row, spread over the reducers."""
        d, height = self.d, height or self.d
        arrow, spark = (pa.int64(), "long") if kind is np.int64 else (pa.float64(), "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = np.zeros((height, width), kind)
            for batch in batches:
                part += of_rows(matrix(batch.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), *(pa.array(part[:, k], arrow) for k in range(width))], ["i", *(f"c{k}" for k in range(width))])

        parts = self.xs.select("x").mapInArrow(run, ", ".join(["i int", *(f"c{k} {spark}" for k in range(width))]))
        out = np.zeros((height, width), kind)
        for r in parts.groupBy("i").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(width))).collect():
            out[r["i"]] = r[1:]
        return out

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums = self.n, self.sums
        return lambda x: (n * x - sums) / n

    def times(self, block: np.ndarray) -> np.ndarray:
        """V @ block, in one pass."""
        centred, n = self.centred(), self.n

        def products(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ block)

        return self._total(products, block.shape[1], np.float64) / n


def orthonormal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """``block`` made orthonormal among itself and to ``basis``; columns that vanish are replaced by fresh directions while there are any."""
    d, room, out = len(block), block.shape[0] - basis.shape[1], []
    for column in block.T[: max(0, room)]:
        known = np.column_stack([basis, *out])
        for attempt in range(4):
            v = column if attempt == 0 else random.standard_normal(d)
            size = np.linalg.norm(v)
            for _ in range(3):
                v = v - known @ (known.T @ v)
            left = np.linalg.norm(v)
            if size > 0 and left > 1e-8 * size:
                out.append(v / left)
                break
    return np.column_stack(out) if out else np.zeros((d, 0))


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int | None = None, most: int | None = None, tol: float = 1e-13, passes: int = 300, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric matrix behind ``times``."""
    k = min(k, d)
    block = min(d, block or max(k, 8))
    most = min(d, max(most or 20 * block, k + 2 * block))
    random = np.random.default_rng(seed)
    q, vq = np.zeros((d, 0)), np.zeros((d, 0))
    new = orthonormal(random.standard_normal((d, block)), q, random)
    for _ in range(passes):
        q, vq = np.column_stack([q, new]), np.column_stack([vq, times(new)])
        small = q.T @ vq
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        ritz, images = q @ inner[:, :k], vq @ inner[:, :k]
        rest = images - ritz * values[:k]
        open_ = np.linalg.norm(rest, axis=0) > tol * max(values[0], np.finfo(float).tiny)
        if q.shape[1] >= d or q.shape[1] >= k and not open_.any():
            return values[:k], ritz / np.linalg.norm(ritz, axis=0)
        following = vq[:, -new.shape[1] :]
        if q.shape[1] + block > most:  # restart from the best; the product with V is linear, so it needs no pass
            keep = k + block
            following = np.column_stack([rest[:, open_], vq @ inner[:, k:keep] - (q @ inner[:, k:keep]) * values[k:keep]])[:, :block]
            q, vq = q @ inner[:, :keep], vq @ inner[:, :keep]
        new = orthonormal(following, q, random)
    raise RuntimeError(f"no convergence in {passes} passes")


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n*x - S)^2 over the dimensions."""
    y = n * x - sums
    if float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (sum(v * v for v in row) for row in y.tolist())]


def whiten(vectors: DataFrame, components: int = 16, **how) -> DataFrame:
    """A row for each vector that stays and each component: see ``WHITENED``. ``how`` goes to ``lanczos``."""
    spark = vectors.sparkSession
    rows = stage(whole(vectors), "whitening-rows")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], WHITENED)
    rows = rows.where(F.size("x") == lengths["d"])
    fit = Fit.of(rows)
    n, d, sums, centred = fit.n, fit.d, fit.sums, fit.centred()
    total = fit.xs.select("x").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(deviations(matrix(b.column(0), d), n, sums), pa.int64())], ["v"]) for b in batches), "v long")
    trace = float(total.agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), (F.count("*") - F.count("v")).alias("lost")).first()["s"] or 0) / n**3
    values, unit = lanczos(fit.times, d, components, **how) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    kept = values > FLAT * trace
    values, unit = values[kept], unit[:, kept]
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], WHITENED)
    to_white, explained = unit / np.sqrt(values), values / trace

    def products(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ to_white
        return w.T @ w

    error = float(np.abs(fit._total(products, k, np.float64, k) / n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(1, k + 1, dtype=np.int32)
        for batch in batches:
            x = matrix(batch.column(1), d)
            m = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            white = (centred(x) @ to_white).ravel()
            cols = [ids, pa.array(np.tile(numbers, m)), pa.array(np.full(m * k, n, np.int64)), deviation, pa.array(white), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, WHITENED)
