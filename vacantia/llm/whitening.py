"""Whitening of embeddings by the leading eigenvectors of their covariance.

The eigenvectors come from a block Jacobi-Davidson method that never forms the covariance: a
product with it is one pass over the vectors, in which each task centres its rows and multiplies
them twice, and Spark adds the tasks' sums. The driver holds a few columns of one entry per
dimension. Each step extracts Ritz pairs from a small subspace and locks those whose residual
has reached double precision; for the others the projected correction equation is solved
by MINRES, all of them side by side so that one pass serves every column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import map_batches
from vacantia.scratch import stage

# --- fixed values: steps of a unit, components ---
STEPS = 256
COMPONENTS = 4
# --- end of fixed values ---
SEED = 1
SUBSPACE = 40  # columns of the subspace before it is restarted from the best Ritz vectors
INNER_STEPS = 4
INNER_REDUCTION = 0.05
PRECISION = 64 * np.finfo(float).eps  # a residual's size against the largest eigenvalue
ROUNDING = 1e-11  # below this a residual may also lock because it falls no more
MAX_STEPS = 200
LONG = 2**63

Product = Callable[[np.ndarray], np.ndarray]


@dataclass
class Whitening:
    """Fitted numbers: of how many distinct vectors, their sums, and per component."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


# --- vectors as whole steps ---


def usable(embedding: Column) -> Column:
    """Neither null nor with a null, NaN or infinite entry."""
    bad = F.exists(
        embedding,
        lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")),
    )
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole_steps(embedding: Column, steps: int = STEPS) -> Column:
    """floor(steps * entry) of each entry, as longs; entries beyond those are the largest."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * F.lit(float(steps))))


def _padded(x: Column, dimension: int) -> Column:
    """Vectors shorter than the longest end in zeros."""
    missing = F.lit(dimension) - F.size(x)
    zeros = F.array_repeat(F.lit(0).cast("bigint"), missing)
    return F.when(missing > 0, F.concat(x, zeros)).otherwise(x)


def _matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """The batch's vectors as the rows of an integer matrix."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, dimension)


# --- sums over all vectors ---


def _sums(
    fit: DataFrame, dimension: int, size: int, kind: str, of: Callable[[np.ndarray], np.ndarray]
) -> list[tuple[int, object]]:
    """(place, sum) of `size` numbers that are worked out from each batch of rows. A task adds up
    its batches, Spark the tasks; one row per place comes to the driver."""
    text = kind != "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = total + of(_matrix(batch, dimension))
        if not isinstance(total, int):
            values = pa.array(map(str, total) if text else total, pa.string() if text else pa.float64())
            places = pa.array(np.arange(size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([places, values], ["place", "value"])

    parts = fit.select("x").mapInArrow(run, f"place int, value {'string' if text else 'double'}")
    added = parts.groupBy("place").agg(F.sum(F.col("value").cast(kind)).alias("value"))
    return [tuple(row) for row in added.collect()]


def _exact(x: np.ndarray) -> np.ndarray:
    """The rows as they are if their sums surely fit, else as Python's integers."""
    return x if _largest(x) * len(x) < LONG else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _column_sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Row count and exact sum of each dimension."""

    def of(x: np.ndarray) -> np.ndarray:
        return np.array([len(x), *map(int, _exact(x).sum(axis=0))], object)

    sums = {p: int(s) for p, s in _sums(fit, dimension, dimension + 1, "decimal(38,0)", of)}
    return sums.get(0, 0), [sums.get(place, 0) for place in range(1, dimension + 1)]


def _matrix_sum(
    fit: DataFrame, dimension: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """The sum over all batches of a matrix that is worked out from each batch's rows."""
    size = shape[0] * shape[1]
    result = np.zeros(size)
    for place, value in _sums(fit, dimension, size, "double", lambda x: of(x).ravel()):
        result[place] = value
    return result.reshape(shape)


# --- eigenvectors ---


def _orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The columns made orthogonal to `against` and each other; dependent ones are left out."""
    kept = against
    for column in columns.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            column = column - kept @ (kept.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-10 * size and left > 0:
            kept = np.column_stack([kept, column / left])
    return kept[:, against.shape[1] :]


def minres(
    product: Product, right: np.ndarray, steps: int = INNER_STEPS, reduction: float = INNER_REDUCTION
) -> np.ndarray:
    """Approximate solutions of symmetric, possibly indefinite systems, one per column. All
    columns take their steps together, so a step is one product for all of them."""
    size = np.linalg.norm(right, axis=0)
    tiny = np.finfo(float).tiny
    found = np.zeros_like(right)
    before, now = np.zeros_like(right), right / np.maximum(size, tiny)
    way_before, way = np.zeros_like(right), np.zeros_like(right)
    beta, eta = np.zeros_like(size), size.copy()
    cos_before, cos, sin_before, sin = (
        np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    )
    active = size > 0
    for _ in range(steps):
        if not active.any():
            break
        after = product(now) - beta * before
        alpha = (now * after).sum(axis=0)
        after -= alpha * now
        beta_after = np.linalg.norm(after, axis=0)
        delta = cos * alpha - cos_before * sin * beta
        rho = np.hypot(delta, beta_after)
        upper = sin * alpha + cos_before * cos * beta
        above = sin_before * beta
        active &= rho > tiny
        safe = np.where(active, rho, 1.0)
        way_before, way = way, (now - above * way_before - upper * way) / safe
        cos_before, sin_before, cos, sin = cos, sin, delta / safe, beta_after / safe
        found += np.where(active, cos * eta, 0.0) * way
        eta = np.where(active, -sin * eta, eta)
        active &= (np.abs(eta) > reduction * size) & (beta_after > 1e-14 * np.abs(alpha))
        before, now, beta = now, after / np.maximum(beta_after, tiny), beta_after
    return found


def jacobi_davidson(
    product: Product, dimension: int, wanted: int, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric product and their eigenvectors.

    Ritz pairs are locked in falling order, each when its residual is at double precision of
    the largest eigenvalue, or, once it is close, when rounding in the sums lets it fall no
    further. Later steps are orthogonal to what is locked.
    """
    wanted = min(wanted, dimension)
    locked, values = np.zeros((dimension, 0)), np.zeros(0)
    start = np.random.default_rng(seed).standard_normal((dimension, min(wanted + 4, dimension)))
    basis = _orthonormal(start, locked)
    image = product(basis)
    best = np.full(wanted, np.inf)  # the smallest residual of each wanted pair so far
    for _ in range(MAX_STEPS):
        small = basis.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        open_ = wanted - len(values)
        theta = ritz[:open_]
        u, image_u = basis @ turn[:, :open_], image @ turn[:, :open_]
        residual = image_u - theta * u
        residual -= locked @ (locked.T @ residual)
        sizes = np.linalg.norm(residual, axis=0)
        scale = max(abs(values[0]) if len(values) else 0.0, abs(theta[0]), np.finfo(float).tiny)
        whole = basis.shape[1] + len(values) == dimension
        done = 0
        for size, least in zip(sizes, best[len(values) :]):
            stuck = size <= ROUNDING * scale and size > 0.5 * least
            if not (whole or size <= PRECISION * scale or stuck):
                break
            done += 1
        first = len(values)
        best[first:] = np.minimum(best[first:], sizes)
        values = np.append(values, theta[:done])
        locked = np.column_stack([locked, u[:, :done]])
        if len(values) == wanted:
            return values, locked
        rest = turn[:, done:]
        if basis.shape[1] - done + open_ > SUBSPACE:
            rest = rest[:, : wanted + 4]
        basis, image = basis @ rest, image @ rest
        # The correction equations of the pairs that are still open.
        theta, residual = theta[done:], residual[:, done:]
        held = np.column_stack([locked, u[:, done:]])

        def free(columns: np.ndarray) -> np.ndarray:
            return columns - held @ (held.T @ columns)

        corrections = minres(lambda p: free(product(p) - theta * p), -free(residual))
        new = _orthonormal(corrections, np.column_stack([locked, basis]))
        if not new.shape[1]:
            # What is left has no direction of its own: take any.
            fresh = np.random.default_rng(seed + len(values) + 1).standard_normal((dimension, wanted))
            new = _orthonormal(fresh, np.column_stack([locked, basis]))
        if new.shape[1]:
            basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    raise RuntimeError(f"eigenvectors did not settle in {MAX_STEPS} steps")


# --- the operator ---


def fit(vectors: DataFrame, dimension: int, components: int = COMPONENTS, seed: int = SEED) -> Whitening:
    """Fit to a table of distinct vectors `x` of whole steps, all of one dimension. Components
    without variance, beyond rounding, are left out."""
    n, sums = _column_sums(vectors, dimension)
    nothing = Whitening(n, sums, np.zeros(0), np.zeros((dimension, 0)), 0.0, 0.0)
    if n < 2 or dimension == 0:
        return nothing
    centre = nothing.centre

    def product(columns: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            centred = x - centre
            return centred.T @ (centred @ columns)

        return _matrix_sum(vectors, dimension, columns.shape, of) / n

    spread = _matrix_sum(vectors, dimension, (1, 1), lambda x: ((x - centre) ** 2).sum(keepdims=True))
    trace = float(spread[0, 0]) / n
    if trace <= 0:
        return nothing
    values, found = jacobi_davidson(product, dimension, components, seed)
    sound = values > dimension * np.finfo(float).eps * trace * 16
    values, found = values[sound], found[:, sound]
    white = found / np.sqrt(values)
    shape = (len(values) + 1, len(values))

    def moments(x: np.ndarray) -> np.ndarray:
        whitened = (x - centre) @ white
        return np.vstack([whitened.T @ whitened, whitened.sum(axis=0)])

    moment = _matrix_sum(vectors, dimension, shape, moments) / n
    covariance = moment[:-1] - np.outer(moment[-1], moment[-1])
    error = float(np.abs(covariance - np.eye(len(values))).max(initial=0.0))
    return Whitening(n, sums, values, found, trace, error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)^2 of each row; null from 2^63 on."""
    bound = n * _largest(x) + max(map(abs, sums), default=0)
    if bound * bound * max(1, x.shape[1]) < LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [d if d < LONG else None for d in exact.tolist()]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, seed: int = SEED) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each
    usable row of `embeddings` and component, numbered from 1 by falling variance.

    Rows whose vector is null or holds null or non-finite entries are left out. The fit uses
    each distinct vector of whole steps once; n counts them. Vectors shorter than the longest
    end in zeros. Repeated rows and rows without vec_id are kept as they come. Components without
    variance are left out: an empty table, or one of equal vectors, gives no rows. Deviations
    from 2^63 on are null. Other columns are not read.

    The distinct vectors are the only thing shuffled; the others are passes over them.
    """
    rows = embeddings.where(usable(F.col("embedding"))).select(
        "vec_id", whole_steps(F.col("embedding")).alias("x")
    )
    dimension = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.select("vec_id", _padded(F.col("x"), dimension).alias("x"))
    fitted = fit(stage(rows.select("x").distinct(), "vectors"), dimension, components, seed)
    found = len(fitted.values)
    white = fitted.vectors / np.sqrt(fitted.values)
    explained = fitted.values / (fitted.trace or 1.0)
    centre = fitted.centre if fitted.n else np.zeros(dimension)

    def make(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch, dimension)
        count = len(x) if found else 0
        deviations = _deviations(x, fitted.n, fitted.sums) if count else []
        at = np.repeat(np.arange(count), found)
        return {
            "vec_id": pc.take(batch.column("vec_id"), pa.array(at)),
            "component": np.tile(np.arange(1, found + 1, dtype=np.int32), count),
            "n": np.full(count * found, fitted.n),
            "deviation": pc.take(pa.array(deviations, pa.int64()), pa.array(at)),
            "whitened": ((x - centre) @ white).ravel() if count else np.zeros(0),
            "explained": np.tile(explained, count),
            "identity_error": np.full(count * found, fitted.identity_error),
        }

    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    return map_batches(rows, schema, make)

