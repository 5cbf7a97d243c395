"""Embedding whitening with exact moments by digit-slice products.

Entries become integers. Their sums and products are summed without rounding: every integer is split in limbs of 16
bits, products of limb matrices go through float64 BLAS over so few rows that each sum stays under 2^53, and the sums of
each power of 2^16 are carried as longs, added up by Spark and recombined as big integers on the driver. From these the
covariance is one exact rational, rounded once; its eigenvectors whiten the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mapped, rows_of, staged, struct

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
BITS, POWERS = 16, 8
#: Rows of one product: 2^18 * 2^16 * 2^16, of up to four pairs of limbs, is 2^52.
ROWS = 1 << 18
#: Components whose eigenvalue is at most this share of the largest count as null directions.
NULL = 1e-11
#: Numbers beyond this are held at it, as a long has no more room.
LIMIT = float(1 << 62)

MOMENTS = struct(dim=T.IntegerType(), i=T.IntegerType(), j=T.IntegerType(), **{f"p{k}": T.LongType() for k in range(POWERS)})
WHITE = struct(vec_id=T.LongType(), dim=T.IntegerType(), deviation=T.LongType(), deviation_digits=T.StringType(), white=T.ArrayType(T.DoubleType(), False))
PRODUCTS = struct(dim=T.IntegerType(), i=T.IntegerType(), j=T.IntegerType(), value=T.DoubleType())
OUTPUT = struct(vec_id=T.LongType(), component=T.IntegerType(), n=T.LongType(), deviation=T.LongType(), whitened=T.DoubleType(), explained=T.DoubleType(), identity_error=T.DoubleType(), deviation_digits=T.StringType())


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as sums of limbs * 2^(16 k); the last is signed, the others are not."""
    out, half = [], 1 << BITS - 1
    while x.size and (x.min() < -half or x.max() >= half):
        out.append((x & (1 << BITS) - 1).astype(np.float64))
        x = x >> BITS
    return [*out, x.astype(np.float64)]


def carried(sums: np.ndarray) -> np.ndarray:
    """The same numbers with all but the last power under 2^16."""
    for k in range(POWERS - 1):
        up = sums[k] >> BITS
        sums[k] -= up << BITS
        sums[k + 1] += up
    return sums


def moments(x: np.ndarray) -> np.ndarray:
    """(power, d + 1, d + 1): products of the columns of x, and in the last row and column their sums and the number of rows."""
    d = x.shape[1]
    out = np.zeros((POWERS, d + 1, d + 1), np.int64)
    for lo in range(0, len(x), ROWS):
        own = limbs(np.concatenate([x[lo : lo + ROWS], np.ones((len(x[lo : lo + ROWS]), 1), np.int64)], axis=1))
        for a, left in enumerate(own):
            for b, right in enumerate(own):
                out[a + b] += (left.T @ right).astype(np.int64)
        carried(out)
    return out


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(64 c) + 1000000 of the entries of vectors of one length."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        yield dim, batch if (sizes == dim).all() else batch.filter(pa.array(sizes == dim))


def fit_list(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows whose vector has only finite entries."""
    rows = rows_of(embeddings, vec_id="long", embedding="array<double>")
    return rows.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


@dataclass
class Model:
    """Exact mean as whole part and rest over n, components in columns, and their eigenvalues."""

    n: int
    whole: np.ndarray
    rest: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def model_of(n: int, sums: list[int], products: list[list[int]], keep: int) -> Model:
    d = len(sums)
    v = np.array([[(n * products[min(i, j)][max(i, j)] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    rank = min(keep, int((e > NULL * max(e[0], 0)).sum()))
    u = u[:, :rank] * np.where(u[np.abs(u[:, :rank]).argmax(0), np.arange(rank)] < 0, -1.0, 1.0)
    return Model(n, np.array([s // n for s in sums], np.int64), [s % n for s in sums], u, e[:rank], float(np.trace(v)))


def fit(rows: DataFrame, keep: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vector, from all rows. What comes to the driver has a fixed size for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, own in by_length(batch):
                found = moments(integers(own.column("embedding"), dim))
                total[dim] = carried(total[dim] + found) if dim in total else found
        for dim, sums in total.items():
            i, j = np.triu_indices(dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), *(pa.array(x.astype(np.int32)) for x in (i, j)), *(pa.array(p[i, j]) for p in sums)], names=MOMENTS.names)

    exact: dict[int, dict[tuple[int, int], int]] = {}
    for r in mapped(rows, run, MOMENTS).groupBy("dim", "i", "j").agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(POWERS))).collect():
        exact.setdefault(r.dim, {})[r.i, r.j] = sum(r[f"p{k}"] << BITS * k for k in range(POWERS))
    return {d: model_of(g[d, d], [g[i, d] for i in range(d)], [[g[i, j] if j >= i else 0 for j in range(d)] for i in range(d)], keep) for d, g in exact.items()}


def deviations(y: np.ndarray, model: Model) -> list[int]:
    """Sum over dimensions of (n x - S)^2, for y = x - whole: in longs where these surely have room, else in big integers."""
    if not len(y):
        return []
    most = model.n * (int(np.abs(y).max()) + 1)
    if most * most * y.shape[1] < 1 << 63:
        return ((model.n * y - np.array(model.rest, np.int64)) ** 2).sum(1).tolist()
    return ((model.n * y.astype(object) - np.array(model.rest, object)) ** 2).sum(1).tolist()


def whiten(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """vec_id, length, deviation and whitened components of each row."""
    shipped = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in by_length(batch):
                model = shipped.value[dim]
                y = integers(own.column("embedding"), dim) - model.whole
                spread = deviations(y, model)
                white = (y - np.array([r / model.n for r in model.rest])) @ model.components / np.sqrt(model.eigenvalues)
                fits = [v < 1 << 63 for v in spread]
                cuts = pa.array(np.arange(len(y) + 1, dtype=np.int32) * white.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id"), pa.array(np.full(len(y), dim, np.int32)), pa.array([v if ok else None for v, ok in zip(spread, fits)], pa.int64()), pa.array([None if ok else str(v) for v, ok in zip(spread, fits)], pa.string()), pa.ListArray.from_arrays(cuts, pa.array(white.reshape(-1)))],
                    names=WHITE.names,
                )

    return mapped(rows, run, WHITE)


def identity_errors(white: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Of each length the largest entry of |covariance of the whitened rows - identity|, centred by their own mean."""
    means = {d: np.zeros(len(m.eigenvalues)) for d, m in models.items()}
    for r in white.select("dim", F.posexplode("white")).groupBy("dim", "pos").agg(F.avg("col").alias("mean")).collect():
        means[r.dim][r.pos] = r.mean
    shipped = white.sparkSession.sparkContext.broadcast(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            own, dims = batch.column("white"), batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                mean = shipped.value[dim]
                part = own.filter(pa.array(dims == dim)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)) - mean if len(mean) else np.zeros((0, 0))
                total[dim] = total.get(dim, 0) + part.T @ part
        for dim, sums in total.items():
            i, j = np.triu_indices(len(sums))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), *(pa.array(x.astype(np.int32)) for x in (i, j)), pa.array(sums[i, j])], names=PRODUCTS.names)

    errors = dict.fromkeys(models, 0.0)
    for r in mapped(white.select("dim", "white"), run, PRODUCTS).groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect():
        errors[r.dim] = max(errors[r.dim], abs(r.value / models[r.dim].n - (r.i == r.j)))
    return errors


def whitened(embeddings: DataFrame, keep: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component up to ``keep``: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null, NaN or infinity are dropped, and so are empty ones; all others are fitted on,
    repeated rows and null ids included; further columns are not read. Vectors of another length have a model of their
    own. Directions without variance (an eigenvalue of at most 1e-11 of the largest) give no component, so that a table
    of one vector, of equal vectors, or an empty one gives no row. Components of equal eigenvalues may be any basis.
    A deviation that a long can't hold is null, with its digits in deviation_digits (else null). Entries from 7e16 on are
    held at 2^62. The sign of a component makes its largest entry positive.
    """
    spark = embeddings.sparkSession
    rows = fit_list(embeddings)
    models = fit(rows, keep)
    if not models:
        return spark.createDataFrame([], OUTPUT)
    white = staged(whiten(rows, models), "whitened")
    errors = identity_errors(white, models)
    known = [(d, k, m.n, float(m.eigenvalues[k] / m.trace), float(errors[d])) for d, m in models.items() for k in range(len(m.eigenvalues))]
    by = F.broadcast(spark.createDataFrame(known, "dim int, pos int, n long, explained double, identity_error double"))
    return white.select("vec_id", "dim", "deviation", "deviation_digits", F.posexplode("white").alias("pos", "whitened")).join(by, ["dim", "pos"]).select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
