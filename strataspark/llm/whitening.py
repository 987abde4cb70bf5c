"""Principal components and whitening of embeddings, by a block Lanczos method that never forms the covariance.

Each pass over the rows gives V q for a block of q: rows are centred, multiplied with the block, and summed up as they lie, so
a pass moves one small matrix a partition. The driver holds only the basis: blocks of as many numbers as a vector has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .vectors import padded, usable, whole

#: Vectors of a block, and the residual, as a share of the largest eigenvalue, at which a pair has converged.
BLOCK, TOLERANCE = 8, 1e-13
#: A direction of a new block that is this much shorter than it was before orthogonalisation is lost (breakdown).
LOST = 1e-10
_SUM_PARTS = 32


def _rows(column: pa.ListArray, dims: int) -> np.ndarray:
    """The vectors of a column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(fit: DataFrame, f, dims: int, size: int) -> np.ndarray:
    """The sum over all rows of f(matrix of rows), which gives `size` numbers; one array of numbers a partition is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in small(batches, 4096):
            if batch.num_rows:
                total += f(_rows(batch.column(0), dims)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % _SUM_PARTS]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "v"])

    add = F.aggregate(F.collect_list("v"), F.array_repeat(F.lit(0.0), size), lambda a, v: F.zip_with(a, v, lambda x, y: x + y)).alias("v")
    # partitions are summed up in parts first, so that no task holds the arrays of all of them
    parts = fit.select("x").mapInArrow(run, "part bigint, v array<double>").groupBy("part").agg(add)
    return np.array(parts.agg(add).first()[0] or np.zeros(size))


def _totals(fit: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            x = _rows(batch.column(0), dims)
            wide = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array([str(int(s)) for s in x.astype(object if wide else np.int64).sum(axis=0)] if len(x) else ["0"] * dims)], names=["d", "s"])

    sums = fit.select("x").mapInArrow(run, "d bigint, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["d"]: int(r["s"]) for r in sums.collect()}
    return [found.get(d, 0) for d in range(dims)]


def _orthogonal(w: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, bool]:
    """Orthonormal columns that span what of w isn't in basis, and whether any direction was lost."""
    before = np.linalg.norm(w, axis=0).max(initial=0.0)
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    good = s > LOST * before
    u = u[:, good] - basis @ (basis.T @ u[:, good])
    return (np.linalg.qr(u)[0] if good.any() else u), bool((~good).any())


def block_lanczos(product, dims: int, k: int = 4, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and eigenvectors of the symmetric matrix that product(q) = V q gives.

    The basis grows by a block a product and is orthogonalised in full, twice. Where a block loses a direction, a random one that
    is orthogonal to the basis takes its place, so that repeated eigenvalues and invariant subspaces are found. Stops when the
    residuals |V y - e y| of the first k and of the one after are tolerance * e1 at most, or the basis spans all dimensions.
    """
    rng = np.random.default_rng(seed)
    k, block = min(k, dims), min(block, dims)
    basis, image = np.empty((dims, 0)), np.empty((dims, 0))
    new = np.linalg.qr(rng.normal(size=(dims, block)))[0]
    while True:
        out = product(new)
        basis, image = np.hstack([basis, new]), np.hstack([image, out])
        t = basis.T @ image
        e, s = np.linalg.eigh((t + t.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        first = min(k + 1, basis.shape[1])
        rest = np.linalg.norm(image @ s[:, :first] - (basis @ s[:, :first]) * e[:first], axis=0)
        if basis.shape[1] >= dims or (first > k and (rest <= tolerance * max(e[0], 0.0)).all()):
            return e[:k], basis @ s[:, :k]
        # the block's own product is the Krylov direction; the rest of the basis is projected out
        new, lost = _orthogonal(out, basis)
        more = min(block, dims - basis.shape[1]) - new.shape[1]
        if lost and more > 0:
            whole_basis = np.hstack([basis, new])
            new = np.hstack([new, _orthogonal(rng.normal(size=(dims, more)), whole_basis)[0]])
        new = new[:, : dims - basis.shape[1]]


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4) -> DataFrame:
    """Whitened coordinates of each usable row along the first k components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has a null or non-finite entry are dropped; a null id stays null. Components are of the distinct
    vectors of whole numbers, so copies change nothing; repeated rows get equal values each. Vectors of different lengths count as
    if zeros followed the shorter ones, of any length. Components without variance are left out, so equal vectors and one row
    alone give no rows, as an empty table does. Components with equal eigenvalues are any orthonormal ones of their space.
    deviation is null where it doesn't fit 64 bits. Other columns are ignored.
    """
    spark = rows.sparkSession
    base = stored(rows.where(usable(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("vec_id"), whole(F.col(vector_col)).alias("x")))
    base, dims = padded(base)
    fit = stored(base.select("x").distinct())
    out = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    n = fit.count()
    if not dims or not n:
        return spark.createDataFrame([], out)
    total = _totals(fit, dims)
    mean = np.array([s / n for s in total])

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return _summed(fit, part, dims, q.size).reshape(q.shape) / n

    trace = _summed(fit, lambda x: np.array([((x - mean) ** 2).sum()]), dims, 1)[0] / n  # of the rows' squared deviations
    values, vectors = block_lanczos(product, dims, k)
    live = values > 1e-12 * trace if trace > 0 else np.zeros(len(values), bool)
    values, vectors = values[live], vectors[:, live]
    m = len(values)
    if not m:
        return spark.createDataFrame([], out)
    scale = vectors / np.sqrt(values)

    def products(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scale
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    both = _summed(fit, products, dims, m * m + m) / n
    covariance = both[: m * m].reshape(m, m) - np.outer(both[m * m :], both[m * m :])
    error = float(np.abs(covariance - np.eye(m)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(total, dtype=object)
        for batch in small(batches, 2048):
            rows = batch.num_rows
            if not rows:
                continue
            x = _rows(batch.column(1), dims)
            biggest = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
            if dims * biggest**2 < 1 << 63:
                deviation = [int(v) for v in ((n * x - s.astype(np.int64)) ** 2).sum(axis=1)]
            else:
                deviation = [int(sum((n * int(a) - b) ** 2 for a, b in zip(r, total, strict=True))) for r in x]
            w = (x - mean) @ scale
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column(0)).take(pa.array(np.repeat(np.arange(rows), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)), pa.array(np.full(rows * m, n)),
                    pa.array([d if d < 1 << 63 else None for d in deviation for _ in range(m)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * m, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return base.select("vec_id", "x").mapInArrow(run, out)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """All usable embeddings along their first four components, whitened."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
