"""Embedding whitening (13): leading components of the vectors' covariance by FEAST contour integration.

Vectors are fixed-point: each entry becomes x = floor(256 c). Every different x vector counts once in the fit. Sums and
the covariance are partial sums of tasks, added up by matrix row. The components are eigenvectors of that matrix:

* inertia counts (signs of the pivots of a shifted factorization) bisect an interval that holds the largest
  eigenvalues and begins in a gap between two of them, and tell how many lie in it;
* a block of vectors is projected onto the interval's eigenspace by quadrature over a circle through its ends: each
  node is a complex shifted solve, and a Spark task of its own;
* Rayleigh-Ritz on the projected block gives eigenpairs; the block is projected again until their residuals vanish;
* if the pairs found in the interval are fewer than its inertia count, the block grows and the projection starts anew,
  so none is missed.

The matrix has one row per dimension: nothing that reaches the driver grows with the number of vectors. Whitened rows
are made in a second pass, their covariance in a third.

Defined results: vectors that are null, empty, or hold null or non-finite entries take no part; neither do vectors
whose length is not the most common one (of equally common ones the longest); repeated rows and ids have rows of their
own; a null id stays null; directions without variance (an eigenvalue under 1e-12 of the trace) are no components, so
an empty table or a single different vector gives an empty result; a deviation over 2^63 - 1 is null; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import cut_lineage, slim, table
from maskwright.llm.registry import query

SCALE, COMPONENTS = 256, 4
#: Quadrature nodes on the upper half of the circle, projections at most, and the residual that ends them (of the trace).
NODES, ROUNDS, CLOSE = 12, 20, 1e-15
#: Eigenvalues under this part of the trace are no variance.
FLAT = 1e-12


def fixed_point(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): entries as whole numbers of 1/256, rounded down; only usable vectors of the most common length."""
    rows = slim(vectors, vec_id=vec_id, v=embedding)
    usable = rows.where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, c -> c IS NULL OR isnan(c) OR abs(double(c)) = double('Infinity'))")
    x = usable.select("vec_id", F.expr(f"transform(v, c -> floor({SCALE} * double(c)))").alias("x"))
    lengths = x.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "dims")).alias("most")).select("most.dims")  # one row
    return x.join(F.broadcast(usual), F.size("x") == F.col("dims")).drop("dims")


def _matrix(column: pa.Array) -> np.ndarray:
    """The x vectors of a batch, one per row; all have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), n)), pa.array(total)], ["dim", "n", "total"])

    rows = fit.select("x").mapInArrow(run, "dim int, n bigint, total bigint").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()  # one row per dimension
    return (rows[0].n if rows else 0), np.array([r.total for r in rows], np.int64)


def _scatter(fit: DataFrame, mean: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Sum over the vectors of the outer product of what is left of ``mean`` (of its projection on ``basis``): centred before multiplying."""
    sent = fit.sparkSession.sparkContext.broadcast((mean, basis))  # one number per dimension and component

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = sent.value
        total = None
        for batch in batches:
            if batch.num_rows:
                rest = _matrix(batch.column("x")) - mean
                rest = rest if basis is None else rest @ basis
                total = rest.T @ rest + (0 if total is None else total)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    cells = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # dims x dims cells
    side = len(mean) if basis is None else basis.shape[1]
    out = np.zeros((side, side))
    out[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy()
    return (out + out.T) / 2


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above ``shift``: positive pivots of matrix - shift (Sylvester's law of inertia)."""
    left, found = matrix - shift * np.eye(len(matrix)), 0
    small = np.finfo(float).eps * max(float(np.abs(matrix).max()), abs(shift), 1e-300)
    for k in range(len(left)):
        pivot = left[k, k] if abs(left[k, k]) > small else -small
        found += pivot > 0
        column = left[k + 1 :, k].copy()
        left[k + 1 :, k + 1 :] -= np.outer(column, column / pivot)
    return int(found)


def interval(matrix: np.ndarray, k: int) -> tuple[float, float, int]:
    """(low, high, count): an interval with the ``count`` >= k largest eigenvalues that begins in the widest gap bisection finds below them."""
    high = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)  # no eigenvalue is larger
    floor, top = FLAT * float(np.trace(matrix)), high
    most = above(matrix, floor)
    if most <= k:
        return floor, high, most
    low = floor
    while top - low > 1e-13 * high:  # the k-th eigenvalue lies between
        middle = (low + top) / 2
        if above(matrix, middle) >= k:
            low = middle
        else:
            top = middle
    count = above(matrix, low)
    step = 1e-6 * high
    while count < len(matrix):  # down, until an empty stretch lies below: an end that touches no eigenvalue
        further = max(low - step, floor)
        if above(matrix, further) == count or further == floor:
            return (low + further) / 2 if further > floor else floor, high, above(matrix, (low + further) / 2 if further > floor else floor)
        low, count = further, above(matrix, further)
    return floor, high, above(matrix, floor)


def _projected(spark: SparkSession, matrix: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The block's part in the eigenspace of (low, high): sum over quadrature nodes of complex shifted solves, one node per task."""
    points, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    sent = spark.sparkContext.broadcast((matrix, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, block = sent.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                angle = np.pi / 2 * (1 - points[k])  # the upper half; the lower half is its conjugate
                turn = np.exp(1j * angle)
                solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, block.astype(complex))
                part = (weights[k] / 2 * radius * turn * solved).real
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["node", "part"])

    rows = spark.range(0, NODES, 1, NODES).mapInArrow(run, "node bigint, part binary").orderBy("node").collect()  # NODES blocks
    return sum(np.frombuffer(r.part).reshape(block.shape) for r in rows)


def feast(spark: SparkSession, matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns; fewer where fewer have variance."""
    size = len(matrix)
    low, high, count = interval(matrix, k)
    if not count:
        return np.zeros(0), np.zeros((size, 0))
    trace, width = float(np.trace(matrix)), min(size, count + count // 2 + 2)
    draw = np.random.default_rng(13)
    while True:
        block, last = draw.standard_normal((size, width)), np.inf
        for _ in range(ROUNDS):
            left, strength, _ = np.linalg.svd(_projected(spark, matrix, low, high, block), full_matrices=False)
            basis = left[:, strength > 1e-14 * strength[0]]
            values, inner = np.linalg.eigh(basis.T @ matrix @ basis)  # Rayleigh-Ritz
            vectors = basis @ inner
            inside = (values > low) & (values < high)
            rest = np.abs(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside]).max(initial=0.0)
            if inside.sum() == count and (rest <= CLOSE * trace or rest >= last / 2):  # as close as doubles get
                order = np.argsort(-values[inside], kind="stable")[:k]
                return values[inside][order], vectors[:, inside][:, order]
            last, block = rest, vectors
            if len(values) < count:
                break
        if width == size:
            raise ArithmeticError(f"{count} eigenvalues lie above {low}, {int(inside.sum())} were found")
        width = min(size, 2 * width)


def whitened(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = cut_lineage(fixed_point(vectors, vec_id, embedding))
    fit = cut_lineage(rows.select("x").distinct())
    n, sums = _sums(fit)
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], kind)
    mean = sums / n
    matrix = _scatter(fit, mean) / n
    values, directions = feast(spark, matrix, components)
    if not len(values):
        return spark.createDataFrame([], kind)
    basis = directions / np.sqrt(values)
    error = float(np.abs(_scatter(fit, mean, basis) / n - np.eye(len(values))).max())
    explained = values / np.trace(matrix)
    sent = spark.sparkContext.broadcast((mean, basis))
    exact = [int(s) for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = sent.value
        k = basis.shape[1]
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, len(mean)), np.int64)
            if len(x) and (max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, exact))) ** 2 * len(mean) < 1 << 63:
                deviation = ((n * x - np.array(exact, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [d if d < 1 << 63 else None for d in (sum((n * int(c) - s) ** 2 for c, s in zip(v, exact, strict=True)) for v in x)]
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                 pa.array(((x - mean) @ basis).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, kind)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
