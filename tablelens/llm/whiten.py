"""Whitening of embeddings by the leading eigenvectors of their covariance.

Tasks add up exact sums, then centred products, and send matrices of the size of one
vector squared; the driver holds that one matrix. There it is brought to tridiagonal form by
Householder reflections, the leading eigenvalues are enclosed by bisection on Sturm counts,
and each eigenvector comes from inverse iteration, kept orthogonal to those before it
whose eigenvalues lie close. The projection goes to the tasks as a broadcast of
components times dimensions. Nothing else depends on the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import written

LONG = 2**63
#: Vectors of a batch put into one product.
ROWS = 4_096
#: Eigenvalues of one cluster lie within this share of the largest.
CLUSTER = 1e-3
#: A component has variance if its eigenvalue is above this share of the trace, by dimensions.
RANK = 4 * np.finfo(float).eps


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, off, q)`` with ``q.T @ a @ q`` tridiagonal, for a symmetric ``a``."""
    a = np.array(a, float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if scale == 0 or not np.any(x[1:]):
            continue
        x /= scale
        x[0] += math.copysign(np.linalg.norm(x), x[0])
        v = x / np.linalg.norm(x)
        part = a[k + 1 :, k + 1 :]
        w = part @ v
        w -= (v @ w) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        column = a[k + 1 :, k]
        column -= 2 * v * (v @ column)
        a[k, k + 1 :] = column
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), q


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value of ``at``: the Sturm counts, which are
    the negative pivots of the shifted matrix."""
    count = np.zeros(len(at), int)
    norm = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)))
    least = max(np.finfo(float).tiny, np.finfo(float).eps * norm * np.finfo(float).eps)
    pivot = np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of a tridiagonal matrix, falling, to the last bits."""
    n = len(diagonal)
    around = np.r_[0.0, np.abs(off), 0.0]
    reach = around[:-1] + around[1:]
    pad = 2 * np.finfo(float).eps * float(np.abs(diagonal).max() + reach.max()) + np.finfo(float).tiny
    low = np.full(k, (diagonal - reach).min() - pad)
    high = np.full(k, (diagonal + reach).max() + pad)
    place = n - 1 - np.arange(k)  # from below, counted from zero
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        above = below(diagonal, off, middle) <= place
        low = np.where(open_ & above, middle, low)
        high = np.where(open_ & ~above, middle, high)


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, rhs: np.ndarray) -> np.ndarray:
    """Solve ``(T - shift) x = rhs`` by elimination with row exchanges; a pivot that
    vanishes is replaced by a tiny one, as inverse iteration wants it."""
    n = len(diagonal)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0))
    tiny = np.finfo(float).eps * norm or np.finfo(float).tiny
    d = (diagonal - shift).tolist()
    upper, second, x = [*off.tolist(), 0.0], [0.0] * n, rhs.tolist()
    for i in range(n - 1):
        low, next_d, next_u = float(off[i]), d[i + 1], upper[i + 1]
        if abs(d[i]) >= abs(low):
            pivot = d[i] = d[i] or tiny
            f = low / pivot
            d[i + 1] = next_d - f * upper[i]
        else:
            f = d[i] / low
            d[i], upper[i], second[i], held = low, next_d, next_u, upper[i]
            d[i + 1], upper[i + 1] = held - f * next_d, -f * next_u
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= f * x[i]
    for i in reversed(range(n)):
        after = upper[i] * x[i + 1] if i + 1 < n else 0.0
        beyond = second[i] * x[i + 2] if i + 2 < n else 0.0
        pivot = d[i] if abs(d[i]) > tiny * np.finfo(float).eps else math.copysign(tiny, d[i])
        x[i] = (x[i] - after - beyond) / pivot
        if abs(x[i]) > 1e150:  # keep within range: only the direction counts
            x = [v / 1e150 for v in x]
    return np.array(x)


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of a tridiagonal matrix for its leading eigenvalues, as columns."""
    n, random = len(diagonal), np.random.default_rng(0)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0))
    found = np.zeros((n, len(values)))
    start, used = 0, math.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            start = k
        # Equal eigenvalues are told apart by a few last bits, or the same vector returns.
        used = min(value, used - 4 * np.finfo(float).eps * norm) if k > start else value
        cluster = found[:, start:k]
        x = random.standard_normal(n)
        for _ in range(8):
            before = x
            x = solve_shifted(diagonal, off, used, x / np.linalg.norm(x))
            for _ in range(2):
                x = x - cluster @ (cluster.T @ x)
            x /= np.linalg.norm(x)
            if abs(abs(x @ before) - 1) < 4 * np.finfo(float).eps:
                break
        found[:, k] = x
    return found


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as columns. Of
    either sign, each vector has its largest entry positive."""
    scale = float(np.abs(covariance).max()) or 1.0  # so that no square leaves the range of a double
    diagonal, off, q = householder(covariance / scale)
    values = leading_values(diagonal, off, k)
    vectors = q @ vectors_of(diagonal, off, values)
    largest = np.abs(vectors).argmax(axis=0)
    return values * scale, vectors * np.sign(vectors[largest, np.arange(k)])


@dataclass(frozen=True)
class Whitening:
    """What is known of the fit list: ``n`` vectors of whole numbers, their sums, and the
    components with eigenvalues."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def real(self) -> np.ndarray:
        """Which components have any variance."""
        return self.values > RANK * len(self.sums) * self.trace


def whole_numbers(vectors: pa.Array, scale: int, offset: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that take part, and their entries as ``floor(scale * c) + offset``.

    A row takes part unless its vector is NULL or holds a NULL or a number that is not
    finite. Shorter vectors are filled up with zeros to ``size``. Values beyond 64 bits
    take the nearest. The numbers are 64-bit integers or, where they are large, Python's.
    """
    flat = vectors.flatten().cast(pa.float64())
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(int)
    entries = flat.to_numpy(zero_copy_only=False)  # NULL as not a number
    owner = np.repeat(np.arange(len(vectors)), lengths)
    sound = vectors.is_valid().to_numpy(zero_copy_only=False)
    sound[owner[~np.isfinite(entries)]] = False
    rows = np.flatnonzero(sound)
    width = int(lengths[rows].max(initial=0)) if size is None else size
    scaled = np.zeros((len(vectors), width))
    column = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = sound[owner]
    with np.errstate(over="ignore"):
        scaled[owner[inside], column[inside]] = np.floor(scale * entries[inside])
    scaled = scaled[rows]
    if np.abs(scaled).max(initial=0) + abs(offset) < 2**53:
        return rows, scaled.astype(np.int64) + offset
    exact = np.frompyfunc(lambda v: min(max(_whole(v) + offset, -LONG), LONG - 1), 1, 1)
    return rows, exact(scaled)


def _whole(value: float) -> int:
    return int(value) if math.isfinite(value) else (LONG if value > 0 else -LONG)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: 64-bit integers where they hold it, else Python's."""
    most = max(map(abs, sums), default=0)
    if x.dtype != object and n * int(np.abs(x).max(initial=0)) + most < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared_length(d: np.ndarray) -> list[int | None]:
    """The exact sums of squares by row; NULL where 64 bits do not hold one."""
    most = int(np.abs(d).max(initial=0)) if d.size else 0
    if d.dtype != object and most * most * max(d.shape[1], 1) < LONG:
        return (d * d).sum(axis=1).tolist()
    exact = (d.astype(object) ** 2).sum(axis=1).tolist() if d.shape[1] else [0] * len(d)
    return [v if v < LONG else None for v in map(int, exact)]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _products(rows: DataFrame, width: int, centred) -> np.ndarray:
    """The sum of ``c.T @ c`` over all batches, where ``centred`` gives ``c`` of a batch."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in _steps(batches):
            c = centred(batch)
            total += c.T @ c
        i, j = np.triu_indices(width)
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "v"])

    summed = rows.mapInArrow(multiply, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = np.zeros((width, width))
    for i, j, v in summed.toArrow().to_pandas().itertuples(index=False):
        found[i, j] = found[j, i] = v
    return found


def fit_whitening(vectors: DataFrame, k: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening:
    """Fit on the column ``embedding`` of all rows that take part (see ``whole_numbers``)."""
    rows = vectors.select("embedding")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for batch in _steps(batches):
            own, x = whole_numbers(batch.column(0), scale, offset)
            n += len(own)
            # 4,096 numbers below 2**53 fit 64 bits; larger ones are Python's.
            batch_sums = [int(v) for v in x.sum(axis=0)] if len(own) else []
            # A vector that ends earlier has a zero entry, which counts as the offset.
            longer = max(len(sums), len(batch_sums))
            sums += [offset * (n - len(own))] * (longer - len(sums))
            batch_sums += [offset * len(own)] * (longer - len(batch_sums))
            sums = [a + b for a, b in zip(sums, batch_sums, strict=True)]
        columns = [pa.array(range(-1, len(sums)), pa.int32()), pa.array([str(v) for v in (n, *sums)])]
        counts = pa.array([n] * (len(sums) + 1), pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, counts], ["dim", "total", "n"])

    summed = (
        rows.mapInArrow(add, "dim int, total string, n long")
        .groupBy("dim")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        .collect()
    )
    by_dim = {r.dim: r for r in summed}
    n, width = int(by_dim[-1].total) if by_dim else 0, len(by_dim) - 1 if by_dim else 0
    # Tasks in which all vectors end before a dimension did not name it.
    sums = [int(by_dim[d].total) + offset * (n - by_dim[d].n) for d in range(width)]
    if not n or not width:
        return Whitening(n, sums, 0.0, np.zeros(0), np.zeros((width, 0)))

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        _, x = whole_numbers(batch.column(0), scale, offset, width)
        return deviations(x, n, sums).astype(float) / n

    covariance = _products(rows, width, centred) / n
    trace = float(np.trace(covariance))
    values, components = leading_components(covariance, min(k, width))
    return Whitening(n, sums, trace, values, components)


def whitened_vectors(vectors: DataFrame, fit: Whitening, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``(vec_id, deviation, whitened)`` of all rows that take part, ``whitened`` an array
    with one number per component: NULL where the component has no variance."""
    width = len(fit.sums)
    real = fit.real
    weights = fit.vectors[:, real] / np.sqrt(fit.values[real])
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            own, x = whole_numbers(batch.column("embedding"), scale, offset, width)
            d = deviations(x, fit.n, fit.sums)
            found = np.full((len(own), len(real)), np.nan)
            found[:, real] = (d.astype(float) / fit.n) @ shared.value
            flat = pa.array(found.ravel(), mask=np.isnan(found.ravel()))
            starts = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(real))
            columns = [
                batch.column("vec_id").take(pa.array(own)),
                pa.array(squared_length(d), pa.int64()),
                pa.ListArray.from_arrays(starts, flat),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", "embedding")
    return rows.mapInArrow(project, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, fit: Whitening) -> float:
    """How far the covariance of ``whitened``, over all rows, is from the identity: the
    largest absolute entry of the difference, over components with variance."""
    real = np.flatnonzero(fit.real)
    if not len(real):
        return 0.0
    means = rows.agg(*[(F.sum(F.get("whitened", F.lit(int(c)))) / fit.n).alias(f"m{c}") for c in real]).first()
    means = np.array(means, float)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column(0)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)[:, real] - means

    covariance = _products(rows.select("whitened"), len(real), centred) / fit.n
    return float(np.abs(covariance - np.eye(len(real))).max())


def whiten(vectors: DataFrame, k: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Whiten ``(vec_id, embedding)``: one row per vector and component, up to ``k``.

    The result is ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.
    An entry ``c`` becomes the whole number ``x = floor(scale * c) + offset``, held within 64 bits.
    ``n`` vectors are fitted, those returned; ``deviation`` is the exact sum over dimensions of
    ``(n * x - S) ** 2`` with the sums ``S`` (NULL where 64 bits do not hold it);
    ``whitened`` is ``x - S / n`` on the component, over the root of its eigenvalue;
    ``explained`` the eigenvalue's share of the trace; ``identity_error`` is measured over
    all whitened rows.

    Rows whose vector is NULL or holds a NULL or a number that is not finite take no part.
    Shorter vectors are filled up with zeros. Repeated rows and ids count each time, NULL ids
    stay. A component without variance (of equal rows, say) has ``whitened`` NULL and
    ``explained`` 0. Without rows, or without dimensions, nothing is returned.
    """
    fit = fit_whitening(vectors, k, scale, offset)
    if not len(fit.values):
        fields = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {fields}")
    rows = written(whitened_vectors(vectors, fit, scale, offset))
    error = identity_error(rows, fit)
    explained = [float(e / fit.trace) if r else 0.0 for e, r in zip(fit.values, fit.real, strict=True)]
    shares = F.array(*[F.lit(e) for e in explained])
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
