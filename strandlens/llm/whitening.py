"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries c become integers x = floor(SCALE * c) + SHIFT. Passes over the vectors: the sums S of each dimension; the
scatter of centred vectors, a triangle of sums from each task; the whitened vectors' covariance; the result. Only these sums,
of dimensions squared at most, reach the driver. With P'VP = LL' (pivoted, so that L shows the rank), rotations of L's columns
make them orthogonal: LJ = UE, so their squared norms are V's eigenvalues and the normalised columns its eigenvectors,
without V being squared or multiplied again. Round-robin pairing rotates half as many pairs as there are columns at once.

Centring: x - S/n is taken as (x - c) - (S - nc)/n for whole c near S/n, so that the large shift leaves before any product;
deviations are whole numbers throughout, and one that a long can't hold is an error.

Vectors that are null, empty or hold a null or non-finite entry take no part. All vectors need one length: those of another
than the most frequent (of equals the smaller) are left out too. Null ids and repeated rows stay, each with its rows;
other columns are left out. Where V has a lower rank, there are only as many components: none for one vector or equal ones,
and an empty table has no rows. Equal eigenvalues have any orthonormal basis of theirs, the same for all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlens.llm.store import table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Vectors that a kernel holds at a time.
ROWS = 4096


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and the order p with v[p][:, p] = L @ L.T; L has as many columns as v has rank."""
    d = len(v)
    rest, order, lower = v.diagonal().copy(), np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        j = k + int(np.argmax(rest[k:]))
        if not rest[j] > least:
            return lower[:, :k], order
        for x in (order, rest, lower):
            x[[k, j]] = x[[j, k]]
        lower[k, k] = np.sqrt(rest[k])
        lower[k + 1 :, k] = (v[order[k + 1 :], order[k]] - lower[k + 1 :, :k] @ lower[k, :k]) / lower[k, k]
        rest[k + 1 :] -= lower[k + 1 :, k] ** 2
    return lower, order


def one_sided_jacobi(lower: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """`lower` times rotations that make its columns orthogonal."""
    a = lower.copy()
    n = a.shape[1]
    if n % 2:
        a = np.concatenate([a, np.zeros((len(a), 1))], axis=1)
    seats = np.arange(a.shape[1])
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            do = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            do &= alpha * beta > 0
            if do.any():
                turned = True
                zeta = (beta - alpha)[do] / (2 * gamma[do])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                a[:, p[do]], a[:, q[do]] = c * x[:, do] - s * y[:, do], s * x[:, do] + c * y[:, do]
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if not turned:
            break
    return a[:, :n]


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of v, falling, and unit eigenvectors as columns; as many as v has rank."""
    lower, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(lower)
    values = (turned * turned).sum(0)
    rank = np.argsort(-values, kind="stable")
    vectors = np.zeros_like(turned)
    vectors[order] = turned / np.sqrt(values)
    return values[rank], vectors[:, rank]


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray  # of each dimension, whole
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column for each
    trace: float

    @property
    def near(self) -> np.ndarray:
        """Whole numbers near the means."""
        return (self.sums + self.n // 2) // self.n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - (self.sums - self.n * self.near) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        small, rest = x - self.near, self.sums - self.n * self.near
        most = self.n * float(np.abs(small).max(initial=0)) + float(np.abs(rest).max(initial=0))
        if most * most * x.shape[1] >= 2.0**62:
            small, rest = small.astype(object), rest.astype(object)
        found = ((self.n * small - rest) ** 2).sum(axis=1)
        if found.dtype == object and len(found) and max(found) >= 1 << 63:
            raise OverflowError("a deviation is too large for a long")
        return found.astype(np.int64)


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns vec_id, x (array<long>) of the vectors that take part."""
    entries = F.col(vector).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    good = rows.select(F.col(key).alias("vec_id"), entries.alias("v")).filter((F.size("v") > 0) & F.forall("v", finite))
    return good.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))


def blocks(batches, d: int | None = None):
    """From Arrow batches: the batch's slice and its vectors as a matrix, ROWS at a time; of length d, or of each length."""
    for batch in batches:
        sizes = np.diff(batch.column("x").offsets.to_numpy())
        for length in np.unique(sizes) if d is None else [d]:
            own = batch if (sizes == length).all() else batch.filter(pa.array(sizes == length))
            for i in range(0, own.num_rows, ROWS):
                part = own.slice(i, ROWS)
                yield part, part.column("x").flatten().to_numpy().reshape(-1, length)


def summed(x: DataFrame, entries, fields: str) -> dict:
    """Sums of what `entries` gives for each partition: from batches to (keys..., value) columns."""
    names = [f.split()[0] for f in fields.split(", ")]
    found = x.mapInArrow(entries, fields).groupBy(*names[:-1]).agg(F.sum(names[-1]).alias("sum"))
    return {tuple(r[:-1]): r[-1] for r in found.collect()}


def gathered(make, d: int):
    """A kernel that sums make(block) over a partition and gives the upper triangle as i, j, value."""

    def run(batches):
        total = 0
        for _, x in blocks(batches, d):
            z = make(x)
            total = total + z.T @ z
        if not np.isscalar(total):
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "value"])

    return run


def square(sums: dict, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    for (i, j), value in sums.items():
        out[i, j] = out[j, i] = value
    return out


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors of column x; None if there are none."""

    def counts(batches):
        totals: dict = {}
        for _, part in blocks(batches):
            own = np.concatenate([part.sum(axis=0), [len(part)]])
            totals[part.shape[1]] = totals.get(part.shape[1], 0) + own
        for d, own in totals.items():
            yield pa.record_batch([pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(own)], names=["d", "i", "value"])

    sums = summed(x, counts, "d int, i int, value long")
    if not sums:
        return None
    n, d = max(((v, -d) for (d, i), v in sums.items() if i == d))
    d = -d
    model = Whitening(n, np.array([sums[d, i] for i in range(d)], np.int64), np.zeros(0), np.zeros((d, 0)), 0.0)
    v = square(summed(x, gathered(model.centred, d), "i int, j int, value double"), d) / n
    values, vectors = principal(v)
    return Whitening(n, model.sums, values[:components], vectors[:, :components], float(np.trace(v)))


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over all of them."""
    k = len(model.values)
    ones = lambda rows: np.concatenate([model.whitened(rows), np.ones((len(rows), 1))], axis=1)  # noqa: E731  the last column sums z
    found = square(summed(x, gathered(ones, len(model.sums)), "i int, j int, value double"), k + 1)
    mean = found[:k, k] / model.n
    return float(np.abs(found[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(x: DataFrame, model: Whitening) -> DataFrame:
    """`x` (vec_id, x) with deviation and whitened (array<double>, a value for each component)."""
    kind = x.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for part, rows in blocks(batches, len(model.sums)):
            z = model.whitened(rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.record_batch([part.column("vec_id"), pa.array(model.deviations(rows)), lists], names=["vec_id", "deviation", "whitened"])

    return x.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "embeddings"))


def components_of(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and component, by the contract of op13."""
    x = integers(rows, key, vector)
    model = fit(x)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], RESULT)
    error = identity_error(x, model)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = whiten(x, model).select(F.col("vec_id").cast("long").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
