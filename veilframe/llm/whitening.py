"""Whitening of embeddings onto their leading principal components, without their covariance matrix.

Matrix-free block subspace iteration: a pass of Spark over the rows computes V Q = X'(X Q) / n for a block Q of
orthonormal directions, X being the centred rows; V, a square of the dimension, is never formed. The product is
orthogonalised (QR) to the next block. Blocks are kept while they are few, with their products, so Rayleigh-Ritz over
all of them takes the best components that any of the passes so far can give; beyond that they are rotated to their
leading Ritz vectors. It ends when the residual |V u - e u| of every wanted component is at rounding, or when the blocks
span the whole space, where Rayleigh-Ritz is exact; that takes no more than dimension / block passes. A block is wider
than the wanted components, so repeated eigenvalues are met too.

Entries c become integers x = floor(1024 c) + 100000, so n and the sums S are exact and so are deviations, n x - S. Rows
are centred by S / n before anything is multiplied. A pass sends, for each task and dimension, one row of sums to a sum
by dimension; the driver holds dimension x kept blocks, never rows.

Dropped: null vectors, those with null or non-finite entries, with entries of 2^40 or more (x would not be exact in
double precision), and those whose length isn't the most frequent one (of equally frequent ones the greater). A row with a null id stays; repeated rows count as
often as they occur. With fewer dimensions than wanted components there are that many. A component without variance
(eigenvalue under 1e-12 of the first) has a null whitened and doesn't count for identity_error, which is null where no
component has any. A deviation that no long holds is null. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT, WANTED = 1024, 100_000, 8
#: Directions of a block besides the wanted ones; blocks kept before they are rotated to the leading ones.
EXTRA, BLOCKS = 8, 8
#: Residuals of components, of the first eigenvalue, that are taken for rounding; variance under it is none.
TOLERANCE, NOTHING = 1e-12, 1e-12
LARGEST = float(1 << 40)
#: Rows multiplied together.
ROWS = 4096


def sound(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding (doubles) of the vectors that take part, and their dimension, 0 for none."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)) & (F.size(e) > 0)
    rows = vectors.select("vec_id", e.alias("embedding")).where(F.coalesce(fine, F.lit(False)))
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = most["d"] if most else 0
    return rows.where(F.size("embedding") == dim), dim


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64) + SHIFT


def blocks(it: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ROWS rows, and their integer vectors."""
    for batch in it:
        for i in range(0, batch.num_rows, ROWS):
            b = batch.slice(i, ROWS)
            yield b, integers(b["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def summed(rows: DataFrame, dim: int, width: int, part: object, kind: str = "double") -> np.ndarray:
    """The sum over all rows of part(x), dimension-by-width values of a block of integer vectors: added up in the task, then by dimension in a shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(it, dim):
            got = part(x)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *[pa.array(c) for c in total.T]], ["i", *[f"c{j}" for j in range(width)]])

    names = [f"c{j}" for j in range(width)]
    parts = rows.select("embedding").mapInArrow(run, ", ".join(["i int", *[f"{c} {kind}" for c in names]]))
    got = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()  # a row a dimension
    return np.array([list(r)[1:] for r in got])


@dataclass
class Whitening:
    """What is learned: n, exact sums, the components as columns, their eigenvalues, the trace, and the passes it took."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residuals: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; NaN where a component has no variance."""
        has = self.values > NOTHING * max(self.values[0], 0.0)
        scale = np.where(has, np.sqrt(np.where(has, self.values, 1.0)), np.nan)
        return (x - self.mean) @ self.components / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; None where a long can't hold it."""
        apart = [np.abs(x - self.mean).max(initial=0.0) * self.n < float(1 << 62), np.square((x - self.mean) * self.n).sum(axis=1).max(initial=0.0) < float(1 << 62)]
        if all(apart):
            return np.square(self.n * x - self.sums).sum(axis=1).tolist()
        exact = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums.tolist(), strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions of block that are orthogonal to basis; those that add nothing go."""
    for _ in range(2):  # twice is enough for orthogonality at rounding
        block = block - basis @ (basis.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block


def leading(space: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values by falling size, the Ritz vectors, their products with V, and the residuals' norms."""
    h = space.T @ products
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors, images = space @ turn, products @ turn
    return values, vectors, images, np.linalg.norm(images - vectors * values, axis=0)


def fit(rows: DataFrame, dim: int, wanted: int = WANTED, extra: int = EXTRA, kept: int = BLOCKS, most: int = 500, seed: int = 0) -> Whitening | None:
    """The leading components of sound rows, whose residuals are proven to be at rounding; None for no rows."""
    counted = summed(rows, dim, 2, lambda x: np.stack([np.full(dim, len(x)), x.sum(axis=0)], axis=1), "long") if dim else np.empty((0, 2))
    if not len(counted):
        return None
    n, sums = int(counted[0, 0]), counted[:, 1].astype(np.int64)
    mean, wanted = sums / n, min(wanted, dim)
    width = min(dim, wanted + extra)
    space, products = np.empty((dim, 0)), np.empty((dim, 0))
    block = orthonormal(np.random.default_rng([dim, seed]).standard_normal((dim, width)), space)
    for done in range(1, most + 1):

        def product(x: np.ndarray, q: np.ndarray = block) -> np.ndarray:
            x = x - mean
            return np.concatenate([x.T @ (x @ q), np.square(x).sum(axis=0)[:, None]], axis=1)

        got = summed(rows, dim, block.shape[1] + 1, product) / n
        image, trace = got[:, :-1], float(got[:, -1].sum())
        space, products = np.concatenate([space, block], axis=1), np.concatenate([products, image], axis=1)
        values, vectors, images, residuals = leading(space, products)
        block = orthonormal(image, space) if space.shape[1] < dim else image[:, :0]
        if residuals[:wanted].max() <= TOLERANCE * max(values[0], 0.0) or not block.shape[1]:
            u = vectors[:, :wanted]
            u = u * np.sign(u[np.abs(u).argmax(axis=0), range(wanted)])
            return Whitening(n, sums, u, np.maximum(values[:wanted], 0.0), trace, done, residuals[:wanted])
        if space.shape[1] + block.shape[1] > kept * width:
            space, products = vectors[:, : 2 * width], images[:, : 2 * width]
    raise ArithmeticError(f"components not found in {most} passes")


def identity_error(rows: DataFrame, dim: int, w: Whitening) -> float | None:
    """The largest absolute entry of whitened's covariance minus the identity, measured in a pass over all rows."""
    has = w.values > NOTHING * w.values[0]
    k = int(has.sum())
    if not k:
        return None

    def moments(x: np.ndarray) -> np.ndarray:
        y = w.whitened(x)[:, has]
        return np.concatenate([y.T @ y, y.sum(axis=0)[:, None]], axis=1)

    got = summed(rows, dim, k + 1, moments) / w.n
    return float(np.abs(got[:, :k] - np.outer(got[:, k], got[:, k]) - np.eye(k)).max())


def whiten(rows: DataFrame, dim: int, w: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (an array, NaN where a component has no variance) of sound rows. Rows stay where they are."""
    schema = T.StructType([rows.schema["vec_id"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in blocks(it, dim):
            y = w.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(range(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(w.deviations(x), pa.int64()), lists], schema.names)

    return rows.mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound rows of embeddings on up to eight components, a row for each component."""
    rows, dim = sound(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    w = fit(rows, dim)
    if w is None:
        empty = "vec_id, 1 AS component, 0L AS n, 0L AS deviation, 0D AS whitened, 0D AS explained, 0D AS identity_error".split(", ")
        return rows.where(F.lit(False)).selectExpr(*empty)
    error = identity_error(rows, dim, w)
    explained = F.element_at(F.array(*[F.lit(float(e) / w.trace if w.trace > 0 else 0.0) for e in w.values]), F.col("at") + 1)
    out = whiten(rows, dim, w).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "y"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("y"), F.col("y")).alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
