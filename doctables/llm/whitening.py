"""Whitening of embeddings by an incremental eigendecomposition.

Entries become whole numbers, so sums and deviations are exact. What is decomposed is the scatter
(the covariance before its division).

1. Each task keeps the mean and the spectrum of its vectors: a centred vector adds a matrix of rank
   one, whose new eigenvalues solve the secular equation between the old ones; entries without
   weight and eigenvalues that meet are deflated. A batch of more vectors than dimensions first
   becomes its triangular factor, whose few rows have the same scatter; a last update moves the mean.
2. Spectra are combined by the same updates, one per eigenvector and one for the means, in rounds of
   ``FAN`` at a time until as many are left.
3. A pass over all vectors projects the covariance on that basis (Rayleigh-Ritz); the small matrix's
   eigenvectors turn the basis into the components.
4. A last pass measures the covariance of the whitened vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import stored

# An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
FAN = 16
# Eigenvalues below this share of the largest one count as zero.
LEAST_SHARE = 2.0**-40
_EPS = np.finfo(np.float64).eps
# Entries beyond are no whole numbers that differences can be taken of.
_LARGEST = 2.0**60


def _gaps(d: np.ndarray, rho: float) -> np.ndarray:
    """Distance from each pole to the next root's upper bound."""
    return np.append(np.diff(d), rho)


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_j^2 / (d_j - x)), one above each of the ascending distinct poles ``d``,
    for ``z`` of norm 1 without zeros: the roots, and ``d_j - root_i`` at (i, j).

    Each root is kept as its distance from the nearer pole, so small differences are exact. Steps of a
    rational interpolation are halved back into the bracket where they leave it.
    """
    k = len(d)
    gap = _gaps(d, rho)
    weights = rho * z * z
    rows = np.arange(k)
    below = rows[None, :] <= rows[:, None]
    # The sign in the middle says which pole is nearer.
    middle = d + gap / 2
    at_middle = 1 + (weights / ((d[None, :] - d[:, None]) - (gap / 2)[:, None])).sum(1)
    origin = np.where((at_middle < 0) & (rows < k - 1), rows + 1, rows)
    poles = d[None, :] - d[origin][:, None]
    left = origin == rows
    lo = np.where(left, 0.0, -gap / 2)
    hi = np.where(left, np.where(rows < k - 1, gap / 2, gap), 0.0)
    # The last root may lie in either half.
    if at_middle[-1] < 0:
        lo[-1] = gap[-1] / 2
    mu = (lo + hi) / 2
    del middle
    active = rows
    for _ in range(200):
        delta = poles[active] - mu[active, None]
        terms = weights / delta
        f = 1 + terms.sum(1)
        done = np.abs(f) <= _EPS * k * (1 + np.abs(terms).sum(1))
        lo[active] = np.where(f < 0, mu[active], lo[active])
        hi[active] = np.where(f > 0, mu[active], hi[active])
        done |= (hi[active] - lo[active]) <= 2 * _EPS * np.maximum(np.abs(lo[active]), np.abs(hi[active]))
        slopes = terms / delta
        psi, phi = np.where(below[active], slopes, 0).sum(1), np.where(below[active], 0, slopes).sum(1)
        own = poles[active, active] - mu[active]
        following = np.where(active < k - 1, poles[active, np.minimum(active + 1, k - 1)], gap[-1]) - mu[active]
        a = (own + following) * f - own * following * (psi + phi)
        b = own * following * f
        c = f - own * psi - following * phi
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        to = mu[active] + step
        inside = np.isfinite(to) & (to > lo[active]) & (to < hi[active])
        to = np.where(inside, to, (lo[active] + hi[active]) / 2)
        mu[active] = np.where(done, mu[active], to)
        active = active[~done]
        if not len(active):
            break
    return d[origin] + mu, poles - mu[:, None]


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``q diag(d) q' + rho v v'``, ``rho`` > 0."""
    z = q.T @ v
    size = float(z @ z)
    rho *= size
    if not rho > 0:
        return d, q
    z = z / np.sqrt(size)
    q = q.copy()
    least = 8 * _EPS * max(abs(d[-1]), abs(d[0]), rho)
    # Deflation: no weight, or two eigenvalues that meet (a rotation gives one of them all the weight).
    weighty = rho * np.abs(z) > least
    kept: list[int] = []
    for j in np.flatnonzero(weighty).tolist():
        if kept:
            i = kept[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if (d[j] - d[i]) * abs(c * s) <= least:
                z[j], z[i] = r, 0.0
                q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
                d = d.copy()
                d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                kept.pop()
        kept.append(j)
    if not kept:
        return d, q
    at = np.array(kept)
    poles = d[at]
    roots, delta = secular_roots(poles, z[at], rho)
    # Weights for which the roots are exact, so that the vectors are orthogonal.
    apart = poles[:, None] - poles[None, :]
    np.fill_diagonal(apart, 1.0)
    weights = np.sqrt(np.abs(np.prod(-delta / apart, axis=0)) / rho) * np.where(z[at] < 0, -1.0, 1.0)
    turn = weights[:, None] / delta.T
    turn /= np.linalg.norm(turn, axis=0)
    d = d.copy()
    q[:, at] = q[:, at] @ turn
    d[at] = roots
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Count, mean (above ``OFFSET``), exact sums, and eigendecomposition of the scatter of some vectors."""

    def __init__(self, dims: int) -> None:
        self.n = 0
        self.mean = np.zeros(dims)
        self.sums = [0] * dims
        self.values = np.zeros(dims)
        self.vectors = np.eye(dims)

    def _moved(self, n: int, mean: np.ndarray) -> None:
        """The means of both sides become one."""
        gap = mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, gap, self.n * n / (self.n + n))
        self.mean = self.mean + gap * (n / (self.n + n))
        self.n += n

    def add(self, x: np.ndarray) -> None:
        """Add whole vectors, one row each."""
        high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
        self.sums = [s + (h << 32) + w for s, h, w in zip(self.sums, high, low)]
        rows = (x - OFFSET).astype(np.float64)
        if len(rows) <= rows.shape[1]:
            for row in rows:
                self._moved(1, row)
            return
        mean = rows.mean(0)
        for row in np.linalg.qr(rows - mean, mode="r"):
            self.values, self.vectors = rank_one(self.values, self.vectors, row, 1.0)
        self._moved(len(rows), mean)

    def combine(self, other: Spectrum) -> None:
        for value, vector in zip(other.values.tolist(), other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        self._moved(other.n, other.mean)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]

    def row(self, part: int) -> dict:
        return {
            "part": part, "n": self.n, "high": [s >> 32 for s in self.sums], "low": [s & 0xFFFFFFFF for s in self.sums],
            "mean": self.mean.tolist(), "value": self.values.tolist(), "vector": self.vectors.ravel().tolist(),
        }

    @staticmethod
    def of(row: dict) -> Spectrum:
        out = Spectrum(len(row["mean"]))
        out.n = row["n"]
        out.sums = [(h << 32) + w for h, w in zip(row["high"], row["low"])]
        out.mean, out.values = np.array(row["mean"]), np.array(row["value"])
        out.vectors = np.array(row["vector"]).reshape(len(out.mean), -1)
        return out


_STATE = "part long, n long, high array<long>, low array<long>, mean array<double>, value array<double>, vector array<double>"
_STATE_SCHEMA = pa.schema(
    [("part", pa.int64()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]
    + [(name, pa.list_(pa.float64())) for name in ("mean", "value", "vector")]
)


def _whole(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``dims`` finite entries, and these as whole numbers."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    rows = np.flatnonzero((sizes == dims) & pc.is_valid(column).to_numpy(zero_copy_only=False))
    entries = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    x = np.floor(SCALE * entries[offsets[rows][:, None] + np.arange(dims)])
    with np.errstate(invalid="ignore"):
        good = (np.abs(x) < _LARGEST).all(1)
    return rows[good], x[good].astype(np.int64) + OFFSET


def _dimensions(vectors: DataFrame) -> int:
    """The commonest length; of equally common ones the greatest."""
    usable = F.forall("vector", lambda c: c.isNotNull() & (F.abs(F.floor(c * SCALE).cast("double")) < _LARGEST) & (F.abs(c * SCALE) < _LARGEST))
    sizes = vectors.filter((F.size("vector") > 0) & usable).groupBy(F.size("vector").alias("dims")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("dims")).first()
    return 0 if first is None else first["dims"]


def _spectra(vectors: DataFrame, dims: int) -> DataFrame:
    """One spectrum per task that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Spectrum(dims)
        for batch in batches:
            _, x = _whole(batch.column(0), dims)
            if len(x):
                own.add(x)
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row(TaskContext.get().partitionId())], _STATE_SCHEMA)

    return vectors.select("vector").mapInArrow(run, _STATE)


def _combined(table: pa.Table) -> pa.Table:
    rows = sorted(table.select(_STATE_SCHEMA.names).to_pylist(), key=lambda r: r["part"])
    out = Spectrum.of(rows[0])
    for row in rows[1:]:
        out.combine(Spectrum.of(row))
    return pa.Table.from_pylist([out.row(rows[0]["part"] // FAN)], _STATE_SCHEMA)


def _total(spectra: DataFrame) -> Spectrum | None:
    """All spectra as one. The driver combines the last ``FAN``."""
    top = spectra.agg(F.max("part")).first()[0]
    while top is not None and top >= FAN:
        spectra = spectra.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(_combined, _STATE)
        top //= FAN
    rows = [r.asDict() for r in spectra.collect()]
    return Spectrum.of(_combined(pa.Table.from_pylist(rows, _STATE_SCHEMA)).to_pylist()[0]) if rows else None


def _products(vectors: DataFrame, dims: int, reference: np.ndarray, rest: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of products of all vectors, centred and projected on a basis. Centres are whole
    numbers and their rest, so that no digits are lost."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            _, x = _whole(batch.column(0), dims)
            if len(x):
                y = ((x - reference).astype(np.float64) - rest) @ basis
                total[0] += y.sum(0)
                total[1:] += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    sums = vectors.select("vector").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros((k + 1) * k)
    for row in sums.collect():  # (k + 1) * k rows
        out[row["at"]] = row["value"]
    return out[:k], out[k:].reshape(k, k)


@dataclass
class Whitening:
    """Components by falling eigenvalue, one column each, and what they were found from."""

    dims: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and the rest."""
        reference = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(reference, np.int64), np.array([(s - self.n * r) / self.n for s, r in zip(self.sums, reference)])


def _column(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.select(F.col(column).cast("array<double>").alias("vector"))


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The leading principal components of all usable vectors; None if there are none.

    Vectors of another length than the commonest one (of equally common ones the greatest) are not
    used, nor those that are null or empty or have a null, non-finite or enormous (2^54) entry. Components
    without variance are left out, so equal vectors have none. Repeated vectors count as often as they come.
    """
    own = _column(vectors, column)
    dims = _dimensions(own)
    total = _total(stored(_spectra(own, dims), "spectra")) if dims else None
    if total is None:
        return None
    out = Whitening(dims, total.n, total.sums, total.vectors, total.values, total.values, 0.0)
    reference, rest = out.centre()
    _, products = _products(own, dims, reference, rest, total.vectors)
    values, turn = np.linalg.eigh(products / total.n)
    trace = float(np.trace(products)) / total.n
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(float(values.max()) * LEAST_SHARE, 0.0)]
    out.components, out.eigenvalues = total.vectors @ turn[:, order], values[order]
    out.explained = out.eigenvalues / trace
    if len(order):
        sums, squares = _products(own, dims, reference, rest, out.components / np.sqrt(out.eigenvalues))
        mean = sums / out.n
        out.identity_error = float(np.abs(squares / out.n - np.outer(mean, mean) - np.eye(len(order))).max())
    return out


_OUT = [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
_OUT_SCHEMA = pa.schema([*_OUT, ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_OUT_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _deviations(x: np.ndarray, model: Whitening, reference: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null where no long holds it."""
    rest = [s - model.n * int(r) for s, r in zip(model.sums, reference)]
    gap = x - reference
    largest = model.n * (int(np.abs(gap).max()) + 1)
    if largest * largest * model.dims < 1 << 63:
        return pa.array(((gap * model.n - np.array(rest)) ** 2).sum(1))
    exact = [sum((model.n * g - r) ** 2 for g, r in zip(row, rest)) for row in gap.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whitened(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Each usable vector's value on every component: ``vec_id``, ``component`` (from 1), ``n``,
    ``deviation`` (exact; null where no long holds it), ``whitened``, ``explained``, ``identity_error``.

    Vectors that ``fit`` does not use give no rows, repeated rows and rows without an id give theirs.
    Without a model, as of an empty table, there are no rows. Other columns are ignored.
    """
    own = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("vector"))
    if model is None:
        return own.sparkSession.createDataFrame([], _OUT_DDL)
    reference, rest = model.centre()
    basis = model.components / np.sqrt(model.eigenvalues)
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _whole(batch.column(1), model.dims)
            if not len(rows) or not k:
                continue
            each = np.repeat(np.arange(len(rows)), k)
            values = ((x - reference).astype(np.float64) - rest) @ basis
            columns = [
                batch.column(0).take(pa.array(rows)).take(pa.array(each)),
                np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)),
                np.full(len(each), model.n),
                _deviations(x, model, reference).take(pa.array(each)),
                values.ravel(),
                np.tile(model.explained, len(rows)),
                np.full(len(each), model.identity_error),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, _OUT_SCHEMA)], schema=_OUT_SCHEMA)

    return own.mapInArrow(run, _OUT_DDL)
