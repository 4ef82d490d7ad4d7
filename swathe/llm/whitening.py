"""Embedding whitening (operator 11).

Sums and the centred covariance are gathered from partial results of every task. The covariance, whose
size is the vectors' length squared, is decomposed on the driver: Householder reflections make it
tridiagonal, bisection over Sturm counts finds the leading eigenvalues, inverse iteration their
vectors, which are made orthogonal inside clusters of close eigenvalues. The components are broadcast
and every row is projected on them.

Components are scaled to integers x = floor(1024 c) + 100000 first; (n x - S) is then exact, and
centring loses nothing. Rows left out are those of ``embeddings.whole_vectors``. Repeated rows count and
are returned as often as they occur, a null ``vec_id`` stays null, tied eigenvalues take any basis of
their space. A component without variance (all vectors equal along it) has ``explained`` 0 and a null
``whitened``. ``deviation`` is null where it does not fit a 64-bit integer. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.llm.embeddings import matrix, whole_vectors

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
EPS = float(np.finfo(float).eps)
CLUSTER = 1e-3            # eigenvalues closer than this share of the norm are made orthogonal
LONG = 1 << 63


# -- the symmetric eigenproblem -------------------------------------------------------

def tridiagonal(symmetric: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections, first to last."""
    a = np.array(symmetric, "float64")
    mirrors: list[np.ndarray | None] = []
    off = np.zeros(max(len(a) - 1, 0))
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        away = math.copysign(float(np.linalg.norm(v)), v[0])
        off[k] = -away
        v[0] += away
        length = np.linalg.norm(v)
        if length == 0:
            mirrors.append(None)
            continue
        v /= length
        rest = a[k + 1:, k + 1:]
        image = rest @ v
        image -= v * (v @ image)
        rest -= 2 * (np.outer(v, image) + np.outer(image, v))
        mirrors.append(v)
    if len(a) > 1:
        off[-1] = a[-1, -2]
    return np.diag(a).copy(), off, mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative pivots of T - at."""
    least = EPS * EPS * max(1.0, float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)))
    pivot = diagonal[0] - at
    below = (pivot < 0).astype("int64")
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = diagonal[i] - at - off[i - 1] ** 2 / pivot
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low = np.full(count, float((diagonal - reach).min()))
    high = np.full(count, float((diagonal + reach).max()))
    high += np.abs(high) * EPS + 1e-300
    below_wanted = len(diagonal) - 1 - np.arange(count)
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return low
        up = sturm_counts(diagonal, off, middle) <= below_wanted
        low, high = np.where(open_ & up, middle, low), np.where(open_ & ~up, middle, high)


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - value) z = right by elimination with row exchanges; pivots under ``least`` become ``least``."""
    n = len(diagonal)
    d, u, l = (diagonal - value).tolist(), [*off.tolist(), 0.0], off.tolist()
    second, z = [0.0] * n, right.tolist()
    for i in range(n - 1):
        if abs(l[i]) > abs(d[i]):
            d[i], u[i], second[i], d[i + 1], u[i + 1], low = l[i], d[i + 1], u[i + 1], u[i], 0.0, d[i]
            z[i], z[i + 1] = z[i + 1], z[i]
        else:
            d[i] = d[i] if abs(d[i]) >= least else math.copysign(least, d[i])
            low = l[i]
        factor = low / d[i]
        d[i + 1] -= factor * u[i]
        u[i + 1] -= factor * second[i]
        z[i + 1] -= factor * z[i]
    d[-1] = d[-1] if abs(d[-1]) >= least else math.copysign(least, d[-1])
    for i in range(n - 1, -1, -1):
        above = z[i]
        if i + 1 < n:
            above -= u[i] * z[i + 1]
        if i + 2 < n:
            above -= second[i] * z[i + 2]
        z[i] = above / d[i]
    return np.array(z)


def leading_components(symmetric: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows), falling."""
    count = min(count, len(symmetric))
    diagonal, off, mirrors = tridiagonal(symmetric)
    values = leading_values(diagonal, off, count)
    norm = float(np.abs(diagonal).max(initial=0) + 2 * np.abs(off).max(initial=0))
    if norm == 0:
        return np.zeros(count), np.eye(count, len(symmetric))
    least = EPS * norm
    random = np.random.default_rng(11)
    vectors: list[np.ndarray] = []
    cluster = 0
    for k in range(count):
        if k and values[k - 1] - values[k] > CLUSTER * norm:
            cluster = k
        # Equal values are pulled apart a little, so that each iteration meets a solvable system.
        value = values[k] - (k - cluster) * 2 * least
        z = random.standard_normal(len(diagonal))
        for _ in range(6):
            z = solve_shifted(diagonal, off, value, z / np.linalg.norm(z), least)
            for _ in range(2):
                for near in vectors[cluster:]:
                    z -= near * (near @ z)
        vectors.append(z / np.linalg.norm(z))
    rows = np.array(vectors).reshape(count, len(diagonal))
    for k, mirror in reversed(list(enumerate(mirrors))):
        if mirror is not None:
            rows[:, k + 1:] -= 2 * np.outer(rows[:, k + 1:] @ mirror, mirror)
    return values, rows


# -- distributed sums ------------------------------------------------------------------

def _whole(column: pa.Array) -> np.ndarray:
    return np.floor(SCALE * matrix(column)).astype("int64") + SHIFT


def _summed(rows: DataFrame, of_batch, kind: str) -> list:
    """Sums over all rows of the arrays that ``of_batch`` gives for a batch, added up per task and then by position."""
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_batch(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(kinds[kind]))], ["part"])
    parts = rows.select("vector").mapInArrow(run, f"part array<{kind}>")
    found = parts.select(F.posexplode("part").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value"))
    return [r["value"] for r in sorted(found.collect(), key=lambda r: r["place"])]


def fit(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(n, S): the number of vectors and their exact sums."""
    def sums(batch):
        x = _whole(batch.column("vector"))
        return np.append(len(x), x.sum(axis=0))
    found = _summed(rows, sums, "long")
    return (int(found[0]), np.array(found[1:], "int64")) if found else (0, np.empty(0, "int64"))


def _centred(column: pa.Array, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S as integers."""
    return n * _whole(column) - sums


def covariance(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Divisor n; rows are centred before they are multiplied."""
    upper = np.triu_indices(len(sums))

    def products(batch):
        y = _centred(batch.column("vector"), n, sums) / n
        return (y.T @ y)[upper]
    out = np.zeros((len(sums), len(sums)))
    out[upper] = np.array(_summed(rows, products, "double")) / n
    return out + np.triu(out, 1).T


def identity_error(rows: DataFrame, n: int, sums: np.ndarray, into: np.ndarray) -> float:
    """Largest entry of |covariance of the whitened rows - identity|. Every batch is centred on its own
    mean; the batches' means are added back around the mean of all."""
    k = into.shape[1]

    def moments(batch):
        w = _centred(batch.column("vector"), n, sums) / n @ into
        mean = w.mean(axis=0)
        w -= mean
        return np.concatenate([len(w) * mean, (w.T @ w + len(w) * np.outer(mean, mean)).ravel()])
    found = np.array(_summed(rows, moments, "double")) / n
    spread = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return float(np.abs(spread - np.eye(k)).max(initial=0.0))


def _deviations(y: np.ndarray) -> list[int | None]:
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * y.shape[1] < LONG:
        return (y * y).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in y.tolist()]
    return [v if v < LONG else None for v in exact]


def whiten(table: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component."""
    rows, length = whole_vectors(table, column=column)
    n, sums = fit(rows)
    spread = covariance(rows, n, sums) if n else np.zeros((length, length))
    values, vectors = leading_components(spread, components) if length else (np.empty(0), np.empty((0, 0)))
    total = float(np.trace(spread))
    # What rounding alone can make of a zero is no variance.
    real = values > max(length, 1) * 4 * EPS * max(total, 0.0)
    into = (vectors[real] / np.sqrt(values[real])[:, None]).T if length else np.empty((0, 0))
    error = identity_error(rows, n, sums, into) if real.any() else 0.0
    explained = np.where(real, values / total if total > 0 else 0.0, 0.0)
    shared = table.sparkSession.sparkContext.broadcast((sums, into, explained, np.cumsum(real) - 1, real))
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def project(batches):
        sums, into, explained, place, real = shared.value
        many = len(real)
        for batch in batches:
            if not batch.num_rows or not many:
                continue
            y = _centred(batch.column("vector"), n, sums)
            w = y / n @ into if real.any() else np.zeros((len(y), 1))
            again = np.repeat(np.arange(len(y)), many)
            white = pa.array(np.where(real, w[:, np.maximum(place, 0)], 0.0).ravel(), mask=np.tile(~real, len(y)))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, many + 1, dtype="int32"), len(y))),
                pa.array(np.full(len(again), n)), pa.array(_deviations(y), pa.int64()).take(pa.array(again)), white,
                pa.array(np.tile(explained, len(y))), pa.array(np.full(len(again), error))], names)
    return rows.select("vec_id", "vector").mapInArrow(project, schema)
