"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The rows of X are the centred, distinct vectors.  Step j multiplies both ways
over the distributed rows:

    alpha_j u_j = X v_j - beta_(j-1) u_(j-1)
    beta_j v_(j+1) = X' u_j - alpha_j v_j

and both sides are fully reorthogonalised: v against all earlier v, u against
all earlier u.  The right vectors are as long as a row and live on the driver.
The left ones are as long as the table and are never stored: u_j = X z_j with
a z_j as long as a row, so a task makes its part of every u again from its rows.
One pass per step returns X'(X z), |X z| and the products of X z with all
earlier u; it is repeated with a corrected z if those products are not zero to
rounding.  Losing an executor costs the passes nothing but their tasks.

The SVD of the small bidiagonal matrix gives components and deviations.  It
stops when the residuals of the wanted triplets are at rounding level, or
after as many steps as a row has entries.  Krylov vectors of one start see one
direction of a repeated deviation, so an early stop is proved: the process
runs again on what is orthogonal to the found components, and if a larger
deviation turns up there, it joins them.

Entries become floor(scale * c), exact integers, so counts, sums and the
squared distances from the mean are exact; centring subtracts the whole part
of the mean exactly and then its fraction.  (A constant added to every entry
changes nothing in the result.)

What reaches the driver: per pass one number per dimension and step.  Rows
stay spread; a vector that fills a third of the table is one row of the fit
list and is dropped before the shuffle on each side.

Defined cases: a null vector or one with a null, NaN or infinite entry has no
rows; vectors shorter than the longest count as filled up with zeros (c = 0);
repeated and null ids each get their rows; directions without variance (a
deviation under 1e-10 of the largest) are not components, so a table of equal
vectors, like an empty one, gives no rows; a squared distance beyond a long
is null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import unpack, whole_vectors

#: Rows of a block.
BLOCK = 4096
#: Products with earlier vectors, relative to the length, that count as zero.
ORTHOGONAL = 1e-13
#: Relative residual at which a triplet has converged.
CONVERGED = 1e-15
#: Deviations under this share of the largest are zero.
RANK = 1e-10


@dataclass(frozen=True)
class Fit:
    """Count, sums and components of a fit list."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # dims x k, unit columns
    eigenvalues: np.ndarray  # of the covariance
    explained: np.ndarray
    identity_error: float
    passes: int

    @property
    def whole_mean(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """Sums less n times the whole part of the mean: 0 to n - 1."""
        return [s % self.n for s in self.sums]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed vectors to blocks of (rows, dim, longs)."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.column(0).slice(i, BLOCK).to_pylist()
            dim = max((len(v) - 1) // v[0] for v in part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(part)], pa.int64()), pa.array([dim], pa.int32()),
                 pa.array([unpack(part, dim).tobytes()], pa.binary())], names=["rows", "dim", "data"])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for rows, dim, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield np.frombuffer(data, np.int64).reshape(rows, dim)


def _centred(x: np.ndarray, whole: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    if x.shape[1] < len(whole):
        x = np.pad(x, ((0, 0), (0, len(whole) - x.shape[1])))
    return (x - whole).astype(np.float64) - fraction


def _sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum per dimension."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, []
        for x in _block_rows(batches):
            n += len(x)
            total += [0] * (x.shape[1] - len(total))
            big = len(x) and x.shape[1] and max(abs(int(x.min())), int(x.max())) * len(x) >= 2 ** 62
            sums = (x.astype(object) if big else x).sum(axis=0).tolist()
            for i, s in enumerate(sums):
                total[i] += s
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(total)), pa.int32()), pa.array([str(v) for v in [n, *total]])], names=["at", "s"])

    got = dict(blocks.mapInArrow(partial, "at int, s string").groupBy("at")
               .agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())
    n = int(got.pop(-1, 0) or 0)
    return n, [int(got[i]) for i in range(len(got))]


def _summed(blocks: DataFrame, share: Callable[[np.ndarray], np.ndarray],
            whole: np.ndarray, fraction: np.ndarray) -> np.ndarray:
    """Sum over all blocks of ``share(centred rows)``, a vector of fixed length."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _block_rows(batches):
            part = share(_centred(x, whole, fraction))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                             names=["at", "s"])

    got = blocks.mapInArrow(partial, "at int, s double").groupBy("at").agg(F.sum("s")).collect()
    out = np.empty(len(got))
    for at, s in got:
        out[at] = s
    return out


def _off(w: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``w`` less its part in the span of ``basis`` (twice is enough)."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            w = w - b.T @ (b @ w)
    return w


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], np.ndarray], dims: int, want: int,
                  locked: list[np.ndarray], seed: int, converged: float = CONVERGED,
                  ) -> tuple[np.ndarray, np.ndarray, bool]:
    """The ``want`` largest deviations of the rows and their components (as
    rows), on the complement of ``locked``; and whether the whole complement was
    seen (else the process stopped early).

    ``product(z, Z)`` is one pass over the rows: X'Xz, |Xz|^2 and, for every
    column of Z, the product of Xz with it under X (that of the left vectors)."""
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = []
    left_z: list[np.ndarray] = []
    entries: list[tuple[int, int, float]] = []  # (left, right, value) of the bidiagonal matrix
    largest, beta, last = 0.0, 0.0, -1  # last: number of the left vector that beta couples to

    def fresh() -> np.ndarray | None:
        for _ in range(4):
            w = rng.standard_normal(dims)
            size = np.linalg.norm(w)
            w = _off(w, locked + right)
            if np.linalg.norm(w) > 1e-8 * size:
                return w / np.linalg.norm(w)
        return None

    early = False
    v = fresh() if len(locked) < dims else None
    while v is not None:
        j = len(right)
        right.append(v)
        z = v - beta * left_z[last] if beta else v
        if beta:
            entries.append((last, j, beta))
        for _ in range(3):
            earlier = np.array(left_z).T if left_z else np.zeros((dims, 0))
            got = product(z, earlier)
            back, square, shared = got[:dims], max(got[dims], 0.0), got[dims + 1:]
            alpha = float(np.sqrt(square))
            if alpha <= RANK * largest or not len(shared) or np.abs(shared).max() <= ORTHOGONAL * alpha:
                break
            z = z - earlier @ shared
        largest = max(largest, alpha, beta)
        if alpha > RANK * largest and alpha > 0:
            last = len(left_z)
            left_z.append(z / alpha)
            entries.append((last, j, alpha))
            w = _off(back / alpha - alpha * v, locked + right)
            beta = float(np.linalg.norm(w))
        else:
            beta = 0.0
        if len(right) + len(locked) >= dims:
            break
        if beta > RANK * largest:
            v = w / beta
        else:  # an invariant space: go on in a new direction
            beta, v = 0.0, fresh()
        if len(right) >= want and left_z:
            p, s, _ = _svd(entries, len(left_z), len(right))
            rest = beta * np.abs(p[last, :want])
            if len(s) >= want and rest.max() <= converged * s[0]:
                early = True
                break
    if not left_z:
        return np.zeros(0), np.zeros((0, dims)), not early
    _, s, q = _svd(entries, len(left_z), len(right))
    vectors = q[:want] @ np.array(right)
    return s[:want], vectors / np.linalg.norm(vectors, axis=1, keepdims=True), not early


def _svd(entries: list[tuple[int, int, float]], rows: int, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.zeros((rows, cols))
    for i, j, value in entries:
        b[i, j] = value
    return np.linalg.svd(b, full_matrices=False)


def fit_components(blocks: DataFrame, k: int = 16, seed: int = 11) -> Fit | None:
    """Components of the rows in ``blocks``; None if they have no variance."""
    n, sums = _sums(blocks)
    dims = len(sums)
    if not n or not dims:
        return None
    whole = np.array([s // n for s in sums], np.int64)
    fraction = np.array([(s % n) / n for s in sums])
    passes = 0

    def product(z: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def share(x: np.ndarray) -> np.ndarray:
            p = x @ z
            return np.concatenate([x.T @ p, [p @ p], (x @ earlier).T @ p])

        return _summed(blocks, share, whole, fraction)

    want = min(k, dims)
    deviations, found, complete = bidiagonalise(product, dims, want, [], seed)
    while not complete:
        # proof of an early stop: nothing larger outside of what was found
        more, others, _ = bidiagonalise(product, dims, 1, list(found), seed + passes, 1e-8)
        if not len(more) or more[0] <= deviations[want - 1] * (1 + 1e-9):
            break
        more, others, _ = bidiagonalise(product, dims, want, list(found), seed + passes)
        found, deviations = np.concatenate([found, others]), np.concatenate([deviations, more])
        order = np.argsort(-deviations, kind="stable")[:want]
        found, deviations = found[order], deviations[order]
    keep = deviations > RANK * deviations.max(initial=0.0)
    if not keep.any():
        return None
    deviations, found = deviations[keep], found[keep]
    turn = np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])
    components = (found * turn[:, None]).T
    values = deviations ** 2 / n
    scaled = components / np.sqrt(values)
    kept = len(values)

    def share(x: np.ndarray) -> np.ndarray:
        w = x @ scaled
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0), [(x * x).sum()]])

    got = _summed(blocks, share, whole, fraction)
    mean = got[kept * kept:-1] / n
    cov = got[:kept * kept].reshape(kept, kept) / n - np.outer(mean, mean)
    return Fit(n, tuple(sums), components, values, values / (got[-1] / n),
               float(np.abs(cov - np.eye(kept)).max()), passes + 2)


def _squared_distance(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, exactly; None beyond a long."""
    rest = fit.rest
    y = x - fit.whole_mean
    bound = (max(abs(int(y.min(initial=0))), int(y.max(initial=0))) + 1) * fit.n
    if bound * bound * len(rest) < 2 ** 63:
        z = fit.n * y - np.array(rest, np.int64)
        return (z * z).sum(axis=1).tolist()
    z = fit.n * (x.astype(object) - fit.whole_mean.astype(object)) - np.array(rest, object)
    return [s if s < 2 ** 63 else None for s in (z * z).sum(axis=1).tolist()]


def whitened(rows: DataFrame, fit: Fit) -> DataFrame:
    """Each row (vec_id, v) under the components of ``fit``."""
    scaled = fit.components / np.sqrt(fit.eigenvalues)
    fraction = np.array([r / fit.n for r in fit.rest])
    dims, k = scaled.shape

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                x = unpack(batch.column(1).slice(i, BLOCK).to_pylist(), dims)
                w = _centred(x, fit.whole_mean, fraction) @ scaled
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, BLOCK).take(pa.array(each)),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(each), fit.n)),
                     pa.array(_squared_distance(x, fit), pa.int64()).take(pa.array(each)),
                     pa.array(w.ravel()), pa.array(np.tile(fit.explained, len(x))),
                     pa.array(np.full(len(each), fit.identity_error))], names=_NAMES)

    return rows.select("vec_id", "v").mapInArrow(project, _RESULT)


_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def whiten(vectors: DataFrame, k: int = 16, scale: float = 64.0) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding) and component up to ``k``:
    vec_id, component, n (size of the fit list), deviation (squared distance
    from the mean times n^2, exact), whitened, explained (the component's share
    of the variance) and identity_error (of the whitened covariance).

    One exchange (the distinct vectors, at most 8 bytes per entry); the blocks
    are written once and read once per pass, from memory where they fit."""
    rows = whole_vectors(vectors, scale)
    spark = vectors.sparkSession
    blocks = cut(rows.select("v").distinct().mapInArrow(_blocks, "rows long, dim int, data binary"))
    most = spark.sparkContext.defaultParallelism
    if blocks.rdd.getNumPartitions() > most:
        size = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
        blocks = blocks.coalesce(max(most, int(size // (64 << 20))))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit = fit_components(blocks, k)
    finally:
        blocks.unpersist()
    if fit is None:
        return spark.createDataFrame([], _RESULT)
    return whitened(rows, fit)
