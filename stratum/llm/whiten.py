"""Whitening of embeddings: the leading eigenvectors of their covariance, by Jacobi-Davidson.

An entry c counts as the integer floor(SCALE * c) + SHIFT, so sums over rows are
exact.  The covariance V (divisor n, rows centred before they are multiplied) is
never built: Spark gives V times a few vectors, one pass over the rows.  Partial
products of tasks are added by further tasks, some hundred each, so that what
the driver gets is one matrix of dimensions x vectors.

Jacobi-Davidson keeps a small basis.  Each round takes the Ritz vectors of the
basis (Rayleigh-Ritz), locks the leading ones whose residual is at the rounding
error of a product, and extends the basis by approximate solutions t of

    (I - K K') (V - theta I) (I - K K') t = -r      K: locked and wanted vectors

from a few steps of MINRES, for all wanted vectors in lockstep, so that one pass
serves them all.  A full basis is restarted from its leading Ritz vectors.  The
locked vectors' products are taken anew at the end, for a last Rayleigh-Ritz.

Rows whose vector is null, or has null or non-finite entries, take no part, nor
do those with entries of 2^50 and more (their integers' squares leave exact
range) or of another length than the most frequent one (of equally frequent
ones, the longest).  Repeated rows and null ids count like any.  Components with
eigenvalues at rounding error (constant or dependent dimensions, few rows) are
not given, so there may be fewer than asked for, or none; without rows there are
none.  Which of two opposite vectors stands for a component is fixed: its entry
largest in size is positive, the first of those that tie.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import staged

SCALE, SHIFT = 1024, 100_000
#: Entries from which on a row takes no part.
HUGE = float(1 << 50)
#: Components; vectors of the first basis beyond them; columns at which a basis is restarted.
COMPONENTS, EXTRA, LARGEST = 8, 4, 48
#: Steps of MINRES in a round, and rounds.
STEPS, ROUNDS = 8, 200
#: Bytes of a block of rows, and partial results that one task adds up.
BLOCK, FAN = 1 << 20, 128
EPS = float(np.finfo(float).eps)


# -- Jacobi-Davidson -----------------------------------------------------


def _orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The columns of ``t`` that are new to the bases, orthonormal; each is projected twice."""
    out = np.zeros((len(t), 0))
    for v in t.T:
        size = np.linalg.norm(v)
        if not np.isfinite(size) or size == 0:
            continue
        v = v / size
        for _ in range(2):
            for b in (*bases, out):
                v = v - b @ (b.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def minres(product: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, least: float) -> np.ndarray:
    """Approximate solutions of one symmetric system a column, in lockstep, up to ``steps`` or a residual of ``least``, relative."""
    size = np.linalg.norm(rhs, axis=0)
    x, w, w_old, v_old = (np.zeros_like(rhs) for _ in range(4))
    v, beta, eta = rhs / np.where(size > 0, size, 1), size.copy(), size.copy()
    cos, cos_old, sin, sin_old = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    live = size > 0
    for _ in range(steps):
        if not live.any():
            break
        y = product(v)
        alpha = (v * y).sum(0)
        y = y - alpha * v - beta * v_old
        after = np.linalg.norm(y, axis=0)
        delta = cos * alpha - cos_old * sin * beta
        rho = np.hypot(delta, after)
        live = live & (rho > 0)
        safe = np.where(rho > 0, rho, 1)
        w, w_old = (v - sin_old * beta * w_old - (sin * alpha + cos_old * cos * beta) * w) / safe, w
        cos, cos_old, sin, sin_old = delta / safe, cos, after / safe, sin
        x = x + np.where(live, cos * eta, 0) * w
        eta = -sin * eta
        live = live & (np.abs(eta) > least * size) & (after > 0)
        v, v_old, beta = y / np.where(after > 0, after, 1), v, after
    return x


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values, falling, and the rotation to their vectors."""
    h = basis.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], turn[:, ::-1]


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, trace: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, vectors (columns) and residual norms of the leading eigenpairs of a positive matrix; rounding-size ones are left out."""
    rng = np.random.default_rng(7)
    locked, k = np.zeros((dim, 0)), min(k, dim)
    basis = _orthonormal(rng.normal(size=(dim, min(dim, k + EXTRA))))
    image = product(basis)
    best, stuck = math.inf, 0
    for turn_no in range(ROUNDS):
        values, turn = _ritz(basis, image)
        basis, image = basis @ turn, image @ turn
        top = max(values[0], trace / dim)
        # What a product's rounding leaves: n terms of size sqrt(V_jj e), summed in blocks.
        reach = 16 * EPS * math.sqrt(trace * top)
        rest = image - basis * values
        rest -= locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        full = basis.shape[1] + locked.shape[1] == dim
        best, stuck = (size[0], 0) if size[0] < best / 2 else (best, stuck + 1)
        allowed = 1000 * reach if full or stuck >= 6 else reach
        n = 0
        while n < min(len(values), k - locked.shape[1]) and size[n] <= allowed:
            n += 1
        if n:
            locked = np.column_stack([locked, _orthonormal(basis[:, :n], locked)])
            basis, image, rest, values = basis[:, n:], image[:, n:], rest[:, n:], values[n:]
            best, stuck = math.inf, 0
        wanted = min(k - locked.shape[1], len(values))
        if not wanted:
            break
        if basis.shape[1] + wanted > min(LARGEST, dim):
            keep = min(basis.shape[1], wanted + EXTRA)
            basis, image = basis[:, :keep], image[:, :keep]
        known = np.column_stack([locked, basis[:, :wanted]])
        inside = lambda z: z - known @ (known.T @ z)  # noqa: B023, E731
        shift = values[:wanted]
        fix = minres(lambda z: inside(product(inside(z)) - shift * z), -inside(rest[:, :wanted]), STEPS, max(0.5 ** (turn_no + 2), 1e-4))  # noqa: B023
        new = _orthonormal(fix, locked, basis)
        if not new.shape[1]:
            new = _orthonormal(rng.normal(size=(dim, 1)), locked, basis)
        if new.shape[1]:
            basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    else:
        raise RuntimeError(f"{locked.shape[1]} of {k} eigenvectors converged in {ROUNDS} rounds")
    image = product(locked)
    values, turn = _ritz(locked, image)
    vectors = locked @ turn
    size = np.linalg.norm(image @ turn - vectors * values, axis=0)
    good = values > 64 * dim * EPS * max(values[0], 0)
    return values[good], vectors[:, good], size[good]


# -- rows in Spark -------------------------------------------------------


def _fit_rows(rows: DataFrame, vector: Column) -> DataFrame:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < HUGE, F.lit(False)))  # NaN is greater than any number
    return rows.filter(F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False)))


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _added(parts: DataFrame, shape: tuple[int, ...], tasks: int) -> np.ndarray:
    """The sum of partial results, one row each, by a tree of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for y in b.column(0).to_pylist():
                total += np.frombuffer(y).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["y"])

    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).mapInArrow(add, "y binary")
    total = np.zeros(shape)
    for r in parts.collect():
        total += np.frombuffer(r["y"]).reshape(shape)
    return total


class Rows:
    """Rows in blocks of integers less ``near`` (the rounded means), and passes over them."""

    def __init__(self, blocks: DataFrame, dim: int, n: int, rest: np.ndarray):
        self.blocks, self.dim, self.n, self.rest = blocks, dim, n, rest
        self.tasks = blocks.rdd.getNumPartitions()

    def total(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over blocks of ``of`` (centred rows)."""
        dim, rest = self.dim, self.rest

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in batches:
                for x in b.column(0):
                    total += of(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, dim) - rest)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["y"])

        return _added(self.blocks.mapInArrow(partial, "y binary"), shape, self.tasks)

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``."""
        return self.total(lambda x: x.T @ (x @ q), q.shape) / self.n


@dataclass
class Whitening:
    dim: int
    n: int
    #: Rounded means, and exact sums of the integers less those.
    near: list[int]
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float

    @property
    def rest(self) -> np.ndarray:
        """Means of the integers less ``near``, rounded once."""
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def fit(rows: DataFrame, vector_col: str = "embedding", k: int = COMPONENTS) -> Whitening:
    """The whitening of all rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    rows = _fit_rows(rows.select(vector.alias("v")), F.col("v"))
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return Whitening(0, 0, [], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    dim, n = lengths[0]["dim"], lengths[0]["count"]
    rows = rows.filter(F.size("v") == dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for b in batches:
            x = _integers(b.column(0), dim)
            if len(x):
                exact = x if int(np.abs(x).max()) < (1 << 62) // len(x) else x.astype(object)
                total = [a + int(s) for a, s in zip(total, exact.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["j", "s"])

    # One row a dimension comes to the driver.
    got = {r["j"]: int(r["s"]) for r in rows.mapInArrow(sums, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").alias("s")).collect()}
    near = [(2 * got[j] + n) // (2 * n) for j in range(dim)]
    left = [got[j] - n * near[j] for j in range(dim)]
    height, about = max(1, BLOCK // (8 * dim)), np.array(near, np.int64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            x = _integers(b.column(0), dim) - about
            while sum(map(len, held)) + len(x) >= height:
                take = height - sum(map(len, held))
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(h.tobytes() for h in [*held, x[:take]])], pa.binary())], ["x"])
                held, x = [], x[take:]
            held.append(x)
        if sum(map(len, held)):
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(h.tobytes() for h in held)], pa.binary())], ["x"])

    data = Rows(staged(rows.mapInArrow(blocks, "x binary"), "blocks"), dim, n, np.array([s / n for s in left]))
    trace = float(data.total(lambda x: np.array((x * x).sum()), ())) / n
    if not trace > 0:
        return Whitening(dim, n, near, left, np.zeros(0), np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0)
    values, vectors, residuals = jacobi_davidson(data.product, dim, k, trace)
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1, 1)
    white, m = vectors / np.sqrt(values), len(values)
    mean = data.total(lambda x: (x @ white).sum(0), (m,)) / n

    def squares(x: np.ndarray) -> np.ndarray:
        w = x @ white - mean
        return w.T @ w

    off = data.total(squares, (m, m)) / n - np.eye(m)
    return Whitening(dim, n, near, left, values, vectors, residuals, trace, float(np.abs(off).max()))


def whitened(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>), one row per row that takes part.

    The deviation is the exact sum over dimensions of (n * x - S)^2."""
    dim, n, near, rest = model.dim, model.n, np.array(model.near, np.int64), model.rest
    white = model.vectors / np.sqrt(model.values)
    sums = np.array(model.sums, object)
    small = max((abs(s) for s in model.sums), default=0)
    rows = _fit_rows(rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")), F.col("v")).filter(F.size("v") == dim)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _integers(b.column("v"), dim) - near
            if not len(x):
                continue
            high = int(np.abs(x).max())
            exact = x if dim * high * max(high, small) < 1 << 62 else x.astype(object)
            s = sums.astype(np.int64) if exact is x else sums
            constant = sum(v * v for v in model.sums)
            deviation = [Decimal(n * n * int(a) - 2 * n * int(c) + constant) for a, c in zip((exact * exact).sum(1), exact @ s)]
            y = (x - rest) @ white
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(deviation, pa.decimal128(38, 0)), lists], ["id", "deviation", "whitened"])

    return rows.mapInArrow(of, f"id {rows.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")
