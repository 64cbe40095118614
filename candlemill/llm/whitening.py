"""Whitening of embeddings by principal components found without ever forming a covariance matrix.

Entries become whole numbers x = floor(256 c). The fit list is each distinct x vector once, written in blocks of rows.
The components are the leading eigenvectors of its covariance V, found by the Jacobi-Davidson method: the only thing
Spark computes about V is the product of V with a few vectors, as sums over blocks of (x - mean) ((x - mean) . u),
added up exactly by tasks. Around it, on matrices of as many rows as a vector has entries:

* Rayleigh-Ritz in a search space gives Ritz pairs; those whose residual is down to rounding are locked, in order.
* For the others MINRES solves the correction equation (I - QQ') (V - t I) (I - QQ') s = -r, Q being the locked and the
  current Ritz vectors. All equations advance together, so a step is one pass over the blocks, however many there are.
* The corrections widen the search space, which falls back to its best vectors when it is full.

Rows whose vector is null, or holds null, non-finite entries or ones too large for a long (256 c beyond 2^63) are left
out. Repeated rows stay in the result and count once in the fit. Vectors of different lengths are different tables: each
length has its own fit list, n and components; a vector without entries has no components and thus no rows. A component
along which the fit list does not vary (always so for n = 1) has no direction of its own: its whitened is null, explained
is 0 and it is left out of identity_error. Equal eigenvalues: any orthonormal basis of their space. A null vec_id is a
value like others. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.scratch import Scratch

BLOCK_ROWS = 1024
#: Partial sums are added in this many groups before the driver adds the groups.
GROUPS = 32
GUARD = 4
#: MINRES steps of a correction. On flat spectra a few steps and a wider search space take the fewest passes.
MOST_STEPS = 4
MOST_ROUNDS = 300
EPS = np.finfo(float).eps


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that take part, entries as longs."""
    entry = F.col("embedding").cast("array<double>")
    fits = F.forall(entry, lambda c: c.isNotNull() & (F.abs(c * 256) < 2.0**63))  # NaN counts as larger than any number
    rows = vectors.select("vec_id", F.when(fits, entry).alias("c")).where("c is not null")
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(c * 256) + 0).alias("x"))


def blocks(rows: DataFrame) -> DataFrame:
    """(dim, data): each distinct x once, as blocks of little-endian longs, rows of one length to a block."""

    def pack(batches):
        waiting: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            x = batch.column(0)
            sizes = np.diff(x.offsets.to_numpy())
            values = x.flatten().to_numpy()
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                whole_rows = values.reshape(-1, dim) if len(at) == len(sizes) and dim else values[(ends[at, None] - dim) + np.arange(dim)]
                waiting.setdefault(dim, []).append(whole_rows)
                if sum(map(len, waiting[dim])) >= BLOCK_ROWS:
                    yield from _blocks(dim, np.concatenate(waiting.pop(dim)))
        for dim, parts in waiting.items():
            yield from _blocks(dim, np.concatenate(parts))

    return rows.select("x").distinct().where(F.size("x") > 0).mapInArrow(pack, "dim int, data binary")


def _blocks(dim: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    data = [np.ascontiguousarray(x[i : i + BLOCK_ROWS], "<i8").tobytes() for i in range(0, len(x), BLOCK_ROWS)]
    yield pa.RecordBatch.from_arrays([pa.array([dim] * len(data), pa.int32()), pa.array(data, pa.binary())], ["dim", "data"])


def _matrices(batches, dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for data in batch.column(0):
            yield np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dim)


def _exact_sum(x: np.ndarray) -> list[int]:
    """Column sums of longs as Python numbers, whatever their size."""
    if float(np.abs(x.astype(float)).max(initial=0.0)) * len(x) < 2.0**62:
        return x.sum(0).tolist()
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(h << 32) + v for h, v in zip(high.sum(0).tolist(), low.sum(0).tolist(), strict=True)]


def counts(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the exact sums S of the fit list."""

    def add(batches):
        rows, total = 0, [0] * dim
        for x in _matrices(batches, dim):
            rows += len(x)
            total = [a + b for a, b in zip(total, _exact_sum(x), strict=True)]
        sums = pa.array([Decimal(v) for v in [rows, *total]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), sums], ["at", "total"])

    parts = fit.select("data").mapInArrow(add, "at int, total decimal(38,0)")
    found = {r.at: int(r.total) for r in parts.groupBy("at").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dim)]


def centred_sum(fit: DataFrame, dim: int, mean: np.ndarray, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of `value` of the centred block.

    Blocks are added pairwise inside NumPy, then by a task, by GROUPS and by the driver, each time rounding once, so that
    the sum is good to double precision whatever the number of blocks and does not depend on the order tasks end in.
    """

    def add(parts: list[np.ndarray]) -> bytes:
        stacked = np.stack(parts).reshape(len(parts), -1)
        return np.array([math.fsum(c) for c in stacked.T.tolist()]).tobytes()

    def one(batches):
        parts: list[np.ndarray] = []
        for x in _matrices(batches, dim):
            parts.append(value(x - mean).ravel())
            if len(parts) == 256:
                parts = [np.frombuffer(add(parts))]
        if parts:
            from pyspark import TaskContext

            group = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([add(parts)], pa.binary())], ["at", "part"])

    def group(key, table):
        return pa.table({"part": pa.array([add([np.frombuffer(p.as_buffer()) for p in table.column("part")])], pa.binary())})

    rows = fit.select("data").mapInArrow(one, "at int, part binary").groupBy("at").applyInArrow(group, "part binary").collect()
    return np.frombuffer(add([np.frombuffer(r.part) for r in rows]))


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, least: float) -> np.ndarray:
    """Solutions of apply(t) = b, a column each, by MINRES in lockstep; ends when all residuals are `least` times b's."""
    norm = np.linalg.norm(b, axis=0)
    beta = norm.copy()
    v_old, v = np.zeros_like(b), b / np.where(beta > 0, beta, 1)
    w_old, w, t = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c_old = c = np.ones_like(beta)
    s_old = s = np.zeros_like(beta)
    rest = beta.copy()
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        beta_next = np.linalg.norm(p, axis=0)
        delta, across = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta
        turn = np.hypot(delta, beta_next)
        live = (turn > EPS * norm) & (np.abs(rest) > least * norm)
        safe = np.where(turn > 0, turn, 1)
        w_old, w = w, (v - s_old * beta * w_old - across * w) / safe
        c_old, c, s_old, s = c, delta / safe, s, beta_next / safe
        t = t + np.where(live, c * rest, 0) * w
        rest = np.where(live, -s * rest, 0)
        if not np.any(np.abs(rest) > least * norm):
            break
        v_old, v, beta = v, p / np.where(beta_next > 0, beta_next, 1), beta_next
    return t


def _orthonormal(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Directions of `new` outside the span of `old`, as orthonormal columns; those that are rounding only go."""
    for _ in range(3):
        new = new - old @ (old.T @ new)
        scale = np.linalg.norm(new, axis=0)
        new = new[:, scale > 1e-8] if _ else new[:, scale > 0] / scale[scale > 0]
        if not new.shape[1]:
            return new
        new, r = np.linalg.qr(new)
        new = new[:, np.abs(np.diag(r)) > 1e-8]
    return new


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of the `want` largest of a symmetric matrix given by its products.

    `product` takes and returns `dim` x k matrices. A pair is locked once its residual is within rounding of the largest
    eigenvalue, all pairs before it are, and the product it was computed from is a fresh one.
    """
    draw = np.random.default_rng(dim)
    width = min(dim, want + GUARD)
    most = min(dim, 8 * width + 8)
    basis = np.linalg.qr(draw.normal(size=(dim, width)))[0]
    image = product(basis)
    fresh = True
    for round_no in range(MOST_ROUNDS):
        h = basis.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn[:, :width], image @ turn[:, :width]
        residual = moved - ritz * values[:width]
        size = np.linalg.norm(residual, axis=0)
        top = float(np.abs(values).max())
        allowed = 4 * EPS * math.sqrt(dim) * top
        good = size[:want] <= allowed
        locked = int(np.argmin(good)) if not good.all() else want
        if locked == want:
            if fresh:
                return values[:want], ritz[:, :want]
            basis, image, fresh = np.linalg.qr(ritz)[0], None, True
            image = product(basis)
            continue
        fresh = False
        active = np.flatnonzero(size[:want] > allowed)
        q = ritz[:, :want]
        theta = values[active]

        def outside(s: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            return s - q @ (q.T @ s)

        def equation(s: np.ndarray, theta: np.ndarray = theta, outside=outside) -> np.ndarray:
            s = outside(s)
            return outside(product(s) - theta * s)

        if basis.shape[1] + len(active) > most:
            basis, image = ritz, moved
        room = dim - basis.shape[1]
        if room == 0:
            # The space is whole: what is left is the rounding of products added up over rounds.
            basis = np.linalg.qr(basis @ turn)[0]
            image, fresh = product(basis), True
            h = basis.T @ image
            values, turn = np.linalg.eigh((h + h.T) / 2)
            return values[::-1][:want], (basis @ turn[:, ::-1])[:, :want]
        s = minres(equation, -outside(residual[:, active]), min(MOST_STEPS, room), max(2.0 ** -(4 + 2 * round_no), 1e-3))
        new = _orthonormal(s, basis)
        if not new.shape[1]:
            new = _orthonormal(residual[:, active], basis)
        if not new.shape[1]:
            new = _orthonormal(draw.normal(size=(dim, 1)), basis)
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    raise RuntimeError(f"residuals {size[:want] / max(top, EPS)} of the largest eigenvalue after {MOST_ROUNDS} rounds")


class Whitening:
    """What `fit_whitening` found for one length: n, S, eigenvalues, components as columns, explained, identity_error."""

    def __init__(self, fit: DataFrame, dim: int, want: int) -> None:
        self.dim = dim
        self.n, self.sums = counts(fit, dim)
        self.mean = np.array([s / self.n for s in self.sums])
        self.passes = 0

        def product(u: np.ndarray) -> np.ndarray:
            self.passes += 1
            return centred_sum(fit, dim, self.mean, lambda x: x.T @ (x @ u)).reshape(u.shape) / self.n

        want = min(want, dim)
        trace = float(centred_sum(fit, dim, self.mean, lambda x: np.array([(x * x).sum()]))[0]) / self.n
        if trace > 0:
            self.values, self.axes = jacobi_davidson(product, dim, want)
        else:
            self.values, self.axes = np.zeros(want), np.eye(dim)[:, :want]
        self.varies = self.values > dim * EPS * trace
        self.explained = np.where(self.varies, self.values / trace, 0.0) if trace > 0 else np.zeros(want)
        self.scale = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, self.values, 1)), 0.0)
        turned = self.axes * self.scale
        # Whitened rows are centred up to rounding; their own mean goes as well before they are multiplied.
        mean = centred_sum(fit, dim, self.mean, lambda x: (x @ turned).sum(0)) / self.n

        def square(x: np.ndarray) -> np.ndarray:
            w = x @ turned - mean
            return w.T @ w

        own = centred_sum(fit, dim, self.mean, square).reshape(want, want) / self.n
        error = np.abs(own - np.eye(want))[np.ix_(self.varies, self.varies)]
        self.identity_error = float(error.max(initial=0.0))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums over entries of (n x - S)^2; null where it has more than 38 digits."""
    rough = np.square(n * x.astype(float) - np.array(sums, float)).sum(1)
    if rough.max(initial=0.0) < 2.0**61 and n * float(np.abs(x.astype(float)).max(initial=0.0)) < 2.0**61:
        return pa.array(np.square(n * x - np.array(sums, np.int64)).sum(1)).cast(pa.decimal128(38, 0))
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def fit_whitening(vectors: DataFrame, components: int = 4) -> list[Whitening]:
    """The whitening of each length of vector, shortest first."""
    scratch = Scratch(vectors.sparkSession)
    fit = scratch.keep(blocks(whole(vectors)), "whole_vectors")
    found = [Whitening(fit.where(F.col("dim") == r.dim), r.dim, components) for r in fit.select("dim").distinct().orderBy("dim").collect()]
    scratch.drop(fit)
    return found


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    `deviation` is a decimal(38,0), null where the exact value is longer.
    """
    models = {m.dim: m for m in fit_whitening(vectors, components)}
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    models = {d: (m.n, m.sums, m.mean, m.axes * m.scale, m.varies, m.explained, m.identity_error) for d, m in models.items()}

    def project(batches):
        for batch in batches:
            x = batch.column(1)
            sizes = np.diff(x.offsets.to_numpy())
            values, ends = x.flatten().to_numpy(), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                if dim not in models:
                    continue
                n, sums, mean, axes, varies, explained, error = models[dim]
                at = np.flatnonzero(sizes == dim)
                rows = values[(ends[at, None] - dim) + np.arange(dim)]
                k = axes.shape[1]
                w = (rows - mean) @ axes
                copies = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[copies])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(copies), n, np.int64)),
                        _deviations(rows, n, sums).take(pa.array(copies)), pa.array(w.ravel(), mask=np.tile(~varies, len(at))), pa.array(np.tile(explained, len(at))), pa.array(np.full(len(copies), error)),
                    ],
                    names,
                )

    return whole(vectors).mapInArrow(project, f"vec_id {id_type}, {kind}")
