"""Whitening of vectors on the leading eigenvectors of their covariance, by Jacobi-Davidson.

The covariance is never formed.  Its product with a block of vectors is one pass
over the distinct rows: every task centres its rows in exact integers, multiplies
and sends one small partial sum.  On the driver lives only what has the size of a
few vectors: a search space with its products, Rayleigh-Ritz on it, the converged
pairs, which are locked, and for the others the correction equation, projected
against all current pairs and solved for the whole block by a few steps of MINRES.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.llm.base import stored
from foreshock.llm.text import to_batch
from foreshock.llm.vectors import common_size, matrix

#: Entries become whole numbers floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Vectors searched besides the wanted ones.
SPARE = 4
#: Steps of MINRES per correction, and the size of the search space in blocks.
INNER, WIDE = 4, 4
#: Bytes of partial sums that one product sends to the driver at most.
PARTIAL_BYTES = 64 << 20

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(x: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Basis of what ``x`` has beside the orthonormal columns ``against``; directions lost in rounding are left out."""
    for _ in range(2):
        size = np.linalg.norm(x, axis=0)
        x = x[:, size > 0] / size[size > 0]
        x = x - against @ (against.T @ x)
    x = x[:, np.linalg.norm(x, axis=0) > 1e-8]
    if not x.shape[1]:
        return x
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    x = u[:, s > 1e-8 * s[0]]
    x = x - against @ (against.T @ x)
    return np.linalg.qr(x)[0]


def minres(apply: Product, rhs: np.ndarray, steps: int, tolerance: float = 1e-3) -> np.ndarray:
    """Columns x with ``apply`` (x) near ``rhs``, each column its own system; every step is one application to the block."""
    x = np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v_old, v = np.zeros_like(rhs), rhs / first
    w_old, w = np.zeros_like(rhs), np.zeros_like(rhs)
    c_old, s_old, c, s = (np.full(rhs.shape[1], f) for f in (1.0, 0.0, 1.0, 0.0))
    eta, link = beta.copy(), np.zeros(rhs.shape[1])
    for _ in range(steps):
        p = apply(v) - link * v_old
        alpha = (v * p).sum(0)
        p -= alpha * v
        new = np.linalg.norm(p, axis=0)
        r3, r2, r1 = s_old * link, s * alpha + c_old * c * link, c * alpha - c_old * s * link
        top = np.hypot(r1, new)
        safe = np.where(top > 0, top, 1.0)
        c_old, s_old, c, s = c, s, np.where(top > 0, r1 / safe, 1.0), np.where(top > 0, new / safe, 0.0)
        w_old, w = w, np.where(top > 0, (v - r2 * w - r3 * w_old) / safe, 0.0)
        x += c * eta * w
        eta = -s * eta
        if (np.abs(eta) <= tolerance * beta).all():
            break
        v_old, v, link = v, p / np.where(new > 0, new, 1.0), new
    return x


@dataclass
class Pairs:
    """Eigenvalues (falling), unit eigenvectors as columns, their residuals' lengths, and how many products were made."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def jacobi_davidson(product: Product, d: int, wanted: int, seed: int = 1, rounds: int = 200) -> Pairs:
    """The ``wanted`` leading eigenpairs of a symmetric positive operator on ``d`` entries, to double precision.

    A pair is locked when its residual is at most 4 d eps times the largest
    eigenvalue, or when the search space is everything that is left.
    """
    wanted = min(wanted, d)
    block = min(d, wanted + SPARE)
    made = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal made
        made += 1
        return product(q)

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    vq = times(q)
    values, locked = np.zeros(0), np.zeros((d, 0))
    for _ in range(rounds):
        theta, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, q, vq = theta[order], q @ turn[:, order], vq @ turn[:, order]
        scale = max(theta.max(initial=0.0), values.max(initial=0.0))
        left = wanted - len(values)
        residual = vq[:, :left] - q[:, :left] * theta[:left]
        residual -= locked @ (locked.T @ residual)
        whole = q.shape[1] + len(values) >= d
        good = (np.linalg.norm(residual, axis=0) <= 4 * d * np.finfo(float).eps * scale) | whole
        ready = left if good.all() else int(np.argmin(good))
        values, locked = np.concatenate([values, theta[:ready]]), np.concatenate([locked, q[:, :ready]], axis=1)
        theta, q, vq, residual = theta[ready:], q[:, ready:], vq[:, ready:], residual[:, ready:]
        if len(values) == wanted:
            break
        if q.shape[1] + residual.shape[1] > WIDE * block:
            q, vq, theta = q[:, :block], vq[:, :block], theta[:block]
        m = residual.shape[1]
        aside, shift = np.concatenate([locked, q[:, :m]], axis=1), theta[:m]
        project = lambda x: x - aside @ (aside.T @ x)  # noqa: B023, E731
        correction = minres(lambda x: project(times(x) - shift * x), project(-residual), INNER)  # noqa: B023
        fresh = _orthonormal(correction, np.concatenate([locked, q], axis=1))
        if not fresh.shape[1]:  # nothing new: the corrections are below rounding; go on in a random direction
            fresh = _orthonormal(np.random.default_rng(seed + made).standard_normal((d, 1)), np.concatenate([locked, q], axis=1))
        q, vq = np.concatenate([q, fresh], axis=1), np.concatenate([vq, times(fresh)], axis=1)
    else:
        raise RuntimeError("eigenpairs did not reach double precision")
    order = np.argsort(-values, kind="stable")
    values, locked = values[order], locked[:, order]
    size = np.linalg.norm(times(locked) - locked * values, axis=0)
    return Pairs(values, locked, size, made)


@dataclass
class Whitening:
    """n distinct rows with sums ``total`` per entry, leading eigenpairs of their covariance, its trace, and the worst entry of the whitened covariance minus the identity."""

    d: int
    n: int
    total: np.ndarray
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    residuals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float = 0.0
    products: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.total) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - total) ** 2 of every row, exact; None where it exceeds 64 bits."""
        t = self.n * x - self.total
        if np.abs(t).max(initial=0) < 2.0**31.5 / max(1, self.d) ** 0.5 * 0.999:
            return (t * t).sum(1).tolist()
        exact = [sum(v * v for v in row) for row in t.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _whole(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    place, x = matrix(column, d)
    return place, np.floor(SCALE * np.clip(x, -(2.0**46), 2.0**46)).astype(np.int64) + SHIFT


def _accumulate(fit: DataFrame, d: int, size: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "<f8") -> np.ndarray:
    """Sum of ``part`` (``size`` numbers) over all rows of the fit list; each task sends one sum, and there are few enough tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for b in batches:
            if b.num_rows:
                total += part(np.frombuffer(b"".join(b.column("x").to_pylist()), "<i8").reshape(-1, d)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    tasks = max(32, min(1024, PARTIAL_BYTES // (8 * size)))
    rows = fit.coalesce(tasks).mapInArrow(run, "total binary").collect()
    return np.sum([np.frombuffer(r["total"], kind) for r in rows], axis=0, dtype=kind) if rows else np.zeros(size, kind)


def fit_whitening(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Model of the distinct usable rows of ``vectors`` (embedding); None if there are none.

    Null vectors, those with null or non-finite entries and those of another size
    than most have are left out.  Components whose eigenvalue is rounding alone do
    not exist: there are at most as many as the rank.
    """
    d = common_size(vectors)
    if not d:
        return None

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in _whole(b.column("embedding"), d)[1]], pa.binary())], ["x"])

    fit = stored(vectors.select("embedding").mapInArrow(whole, "x binary").distinct(), "distinct-vectors")
    sums = _accumulate(fit, d, d + 1, lambda x: np.concatenate([[len(x)], x.sum(0)]), "<i8")
    if not sums[0]:
        return None
    model = Whitening(d, int(sums[0]), sums[1:].copy())

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = model.centred(x)
            return c.T @ (c @ q)

        return _accumulate(fit, d, q.size, part).reshape(q.shape) / model.n

    found = jacobi_davidson(product, d, components)
    real = found.values > 4 * d * np.finfo(float).eps * max(found.values.max(initial=0.0), 0.0)
    model.values, model.vectors, model.residuals, model.products = found.values[real], found.vectors[:, real], found.residuals[real], found.products
    k = len(model.values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.concatenate([[(model.centred(x) ** 2).sum()], w.sum(0), (w.T @ w).ravel()])

    seen = _accumulate(fit, d, 1 + k + k * k, spread)
    model.trace = float(seen[0] / model.n)
    mean = seen[1 : 1 + k] / model.n
    model.identity_error = float(np.abs(seen[1 + k :].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return model


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (one number per component) of every usable row of ``vectors`` (vec_id, embedding); repeated rows and null ids stay."""
    out = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, x = _whole(b.column("embedding"), model.d)
            w = model.project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield to_batch(out, vec_id=b.column("vec_id").take(pa.array(place)), deviation=model.deviation(x), whitened=lists)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whitened_components(vectors: DataFrame, components: int = 16) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit_whitening(vectors, components)
    if model is None:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if len(model.values) else F.array().cast("array<double>")
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
