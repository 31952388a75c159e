"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never built. What is distributed is the product of it with a narrow block of directions: every task centres its
vectors, multiplies them with the block and the result with the vectors again, and Spark adds the tasks' entries up. A polynomial
recurrence over such products damps the spectrum below the block, the block is made orthonormal again (QR), and Rayleigh-Ritz turns it towards the
eigenvectors, until the residual of every wanted pair certifies it.

Entries count as whole numbers, x = floor(1024 * entry) + 100000, so sums are exact, and a row is centred by a whole number first and by the rest
below one after that: nothing is lost to the large common offset. What reaches the driver are the sums and the entries of a product, dimensions x
BLOCK numbers, whatever the number of rows. Sums of fractions are added in any order, so results of reruns may differ in the last digits.

Defined results: rows whose vector is null, empty, or has null or non-finite entries are dropped, as are entries beyond LARGEST, which no 64-bit
number holds after scaling; vectors of another length than the commonest one (of equally common ones, the longest) are dropped as well. Repeated
rows and null ids count as rows. Directions without variance are no components, so equal vectors, a single vector and an empty table give an empty
result. ``deviation`` is null where it is beyond 64 bits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkguard.llm.common import saved

COMPONENTS = 8
# Directions that are iterated beyond the wanted ones: the spectrum below them is damped.
GUARDS = 16
# Degrees of the filter, the gain it aims at, and the ratio of gains within the block that keeps its columns apart.
LEAST_DEGREE, MOST_DEGREE, GAIN, SPREAD = 3, 20, 1e7, 1e10
# A pair is certified when its residual is below this share of the largest eigenvalue, times the root of the dimensions.
RESIDUAL, MOST_ROUNDS = 2e-14, 100
# The scale and the offset of whole entries.
SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 50)


def whole_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that remain, written once."""
    entry = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    read = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), entry.alias("e")).where(F.size("e") > 0).where(fine)
    x = F.transform("e", lambda c: F.floor(c * SCALE) + OFFSET)
    rows = saved(read.select("vec_id", x.alias("x"), F.size("e").alias("d")), "whiten-rows")
    common = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.col("d") == (common[0]["d"] if common else 0)).select("vec_id", "x")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column(b.schema.names.index("x")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _summed(rows: DataFrame, made: Callable[[Iterator[np.ndarray]], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all tasks of the array that each makes of its rows, flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = made(_matrix(b) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], ["at", "value"])

    found = rows.select("x").mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r["at"] + 1 for r in found), default=0), np.int64 if kind == "long" else float)
    for r in found:
        out[r["at"]] = r["value"]
    return out


@dataclass
class Centre:
    """Number of rows and exact sums; a mean is a whole number and a rest below one."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])


def centre(rows: DataFrame) -> Centre:
    def add(found: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros(0, np.int64)
        for x in found:
            high = x >> 32  # halves of the numbers, so that no sum runs over
            part = np.r_[len(x), high.sum(0), (x - (high << 32)).sum(0)]
            total = part if not len(total) else total + part
        return total

    found = _summed(rows, add, "long").tolist()
    d = len(found) // 2
    return Centre(found[0] if found else 0, [(a << 32) + b for a, b in zip(found[1 : d + 1], found[d + 1 :], strict=True)])


def _product(rows: DataFrame, at: Centre, block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance matrix times ``block``, and its trace: one pass over the rows."""
    whole, rest = at.whole, at.rest

    def multiply(found: Iterator[np.ndarray]) -> np.ndarray:
        total, squares = np.zeros(block.shape), 0.0
        for x in found:
            c = (x - whole) - rest
            total += c.T @ (c @ block)
            squares += np.vdot(c, c)
        return np.r_[total.ravel(), squares]

    out = _summed(rows, multiply, "double") / at.n
    return out[:-1].reshape(block.shape), float(out[-1])


def filter_degree(values: np.ndarray, wanted: int) -> int:
    """Degree that damps what lies below the block by about GAIN against the last wanted value, and keeps the block's own gains within SPREAD."""
    half = max(values[-1], values[0] * 1e-12) / 2
    first, last = (np.log((z := max(v / half - 1, 1 + 1e-9)) + np.sqrt(z * z - 1)) for v in (values[0], values[wanted - 1]))
    most = np.log(SPREAD) / max(first - last, 1e-9)
    return int(np.clip(min(np.ceil(np.log(GAIN) / last), most), LEAST_DEGREE, MOST_DEGREE))


def filtered(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, product: np.ndarray, values: np.ndarray, degree: int) -> np.ndarray:
    """The Chebyshev polynomial that is small on [0, least value of the block], applied to the block; scaled to one at the largest value."""
    half = max(values[-1], values[0] * 1e-12) / 2
    first = half / (values[0] - half)
    sigma, before = first, block
    now = (product - half * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


@dataclass
class Whitening:
    """Centre, eigenvalues (falling) and unit eigenvectors (columns) of the wanted components, the trace, and the passes taken."""

    at: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def fit(rows: DataFrame, components: int = COMPONENTS, seed: int = 1) -> Whitening:
    """The first ``components`` eigenpairs of the covariance matrix of ``rows`` (as of ``whole_rows``)."""
    at = centre(rows)
    d = len(at.sums)
    none = Whitening(at, np.zeros(0), np.zeros((d, 0)), 0.0, np.zeros(0), 0)
    if not at.n:
        return none
    wide, wanted = min(d, components + GUARDS), min(d, components)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, wide)))[0]
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return _product(rows, at, q)[0]

    for _ in range(MOST_ROUNDS):
        product, trace = _product(rows, at, block)
        passes += 1
        if not trace > 0:
            return none
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        residuals = np.linalg.norm(product - block * values, axis=0)[:wanted]
        # Below this, values are rounding errors: such directions have no variance.
        floor = values[0] * 1e-13 * d
        if residuals.max() <= RESIDUAL * np.sqrt(d) * values[0]:
            keep = values[:wanted] > floor
            vectors = block[:, :wanted][:, keep]
            signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
            return Whitening(at, values[:wanted][keep], vectors * signs, trace, residuals[keep], passes)
        block = np.linalg.qr(filtered(times, block, product, values, filter_degree(values, wanted)))[0]
    raise RuntimeError(f"eigenpairs not certified after {passes} passes: residuals {residuals.max():.3g} of {values[0]:.3g}")


def _whitener(model: Whitening) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    whole, rest, turn = model.at.whole, model.at.rest, model.vectors / np.sqrt(model.values)

    def whiten(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centred vectors and their whitened coordinates."""
        c = (x - whole) - rest
        return c, c @ turn

    return whiten


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened coordinates' covariance minus the identity."""
    whiten, k = _whitener(model), len(model.values)

    def add(found: Iterator[np.ndarray]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for x in found:
            y = whiten(x)[1]
            total += np.vstack([y.T @ y, y.sum(0)])
        return total.ravel()

    total = _summed(rows, add, "double").reshape(k + 1, k) / model.at.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per row and component; nothing is shuffled."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k, n = len(model.values), model.at.n
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    error, share, whiten = identity_error(rows, model), model.values / model.trace, _whitener(model)
    # Multiples of n are taken from the rest of a sum that is below n; both wrap around 2**64 alike, and only the total must fit.
    whole, below = model.at.whole, np.array([s % n for s in model.at.sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b)
            c, y = whiten(x)
            off = np.int64(n) * (x - whole) - below
            fits = ((c * n) ** 2).sum(1) < 9.2e18
            deviation = pa.array((off * off).sum(1).repeat(k), mask=~fits.repeat(k))
            rows_of = pa.array(np.arange(b.num_rows).repeat(k))
            columns = [b.column(b.schema.names.index("vec_id")).take(rows_of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows))]
            columns += [pa.array(np.full(b.num_rows * k, n, np.int64)), deviation, pa.array(y.ravel()), pa.array(np.tile(share, b.num_rows))]
            columns.append(pa.array(np.full(b.num_rows * k, error)))
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
