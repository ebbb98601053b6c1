"""Whitening of embeddings: a mean from exact sums, a covariance of centred vectors, and a projection."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, tidy

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Vectors of one product, and levels of the tree that merges what the tasks found.
ROWS, DEPTH = 4096, 2
#: Share of the trace from which an eigenvalue counts as above 0.
NOTHING = 1e-12


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows of a list array whose vector is not null, empty or with null or non-finite entries, as
    (rows, whole numbers) for each length that occurs. Entries outside a long are kept as nearest longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    good = pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False)
    c = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    wrong = np.concatenate([[0], np.cumsum(~good)])
    fine = (wrong[ends] == wrong[ends - sizes]) & (sizes > 0)
    out = []
    for size in np.unique(sizes[fine]):
        rows = np.flatnonzero(fine & (sizes == size))
        x = np.floor(SCALE * c[(ends - sizes)[rows, None] + np.arange(size)])
        out.append((rows, np.clip(x, -(2.0**62), 2.0**62).astype(np.int64) + SHIFT))
    return fine, out


def _sums(column: str, vectors: DataFrame) -> Counter:
    """For each length its vectors and the exact sums of their entries, as Python integers."""

    def run(batches):
        found = {}
        for batch in batches:
            for _, x in whole_vectors(batch.column(0))[1]:
                n, high, low = found.setdefault(x.shape[1], [0, *np.zeros((2, x.shape[1]), np.int64)])
                found[x.shape[1]] = [n + len(x), high + (x >> 31).sum(0), low + (x & 0x7FFFFFFF).sum(0)]
        if found:
            rows = [(size, n, (high.astype(object) * (1 << 31) + low)) for size, (n, high, low) in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([[str(v) for v in r[2]] for r in rows])], ["size", "n", "sums"]
            )

    def add(a, row):
        n, sums = a.get(row[0], (0, None))
        own = [int(v) for v in row[2]]
        a[row[0]] = (n + row[1], own if sums is None else [x + y for x, y in zip(sums, own, strict=True)])
        return a

    def merge(a, b):
        for size, (n, sums) in b.items():
            add(a, (size, n, sums))
        return a

    parts = bounded(vectors.select(column)).mapInArrow(tidy(run), "size long, n long, sums array<string>")
    return parts.rdd.treeAggregate({}, add, merge, DEPTH)


class Whitening:
    """Mean and components of whole-number vectors.

    ``n`` vectors have the entry sums ``sums`` (exact). ``values`` are the eigenvalues that are above 0,
    falling, ``components`` the unit eigenvectors beside them, a row each, whose entry furthest from 0
    (the first of equals) is positive; ``trace`` is the covariance's trace."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int = COMPONENTS):
        self.n, self.sums = n, sums
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.trace = float(np.trace(covariance))
        order = order[values[order] > NOTHING * max(self.trace, 0.0)]
        self.values, self.components = values[order], vectors[:, order].T
        far = np.abs(self.components).argmax(1)
        self.components *= np.sign(self.components[np.arange(len(far)), far])[:, None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, each entry to double precision."""
        return centred(x, self.n, self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of whole-number vectors, a row each."""
        return self.centred(x) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n * x - sums)², exact; None if it fits no long."""
        furthest = max(self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0), 1)
        if furthest * furthest * max(1, x.shape[1]) < 1 << 63:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(1)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole part of the mean is taken off exactly, then its fraction."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(np.float64) - np.array([(s % n) / n for s in sums])


def _moments(vectors: DataFrame, column: str, size: int, made) -> np.ndarray:
    """The sum over all vectors of outer products of ``made(x)``, merged in a tree over the tasks."""

    def run(batches):
        total = 0.0
        for batch in batches:
            for _, x in whole_vectors(batch.column(0))[1]:
                if x.shape[1] == size:
                    for at in range(0, len(x), ROWS):
                        y = made(x[at : at + ROWS])
                        total = total + y.T @ y
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def add(a, row):
        b = np.frombuffer(row[0])
        return b if a is None else a + b

    def merge(a, b):
        return b if a is None else a if b is None else a + b

    parts = bounded(vectors.select(column)).mapInArrow(tidy(run), "sum binary")
    total = parts.rdd.treeAggregate(None, add, merge, DEPTH)
    return total.reshape(int(round(len(total) ** 0.5)), -1)


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Two passes over all vectors of the commonest length (of the longer one of equals): exact sums of whole
    numbers give the mean, then centred outer products give the covariance, whose d x d numbers are
    all that reaches the driver. None if no vector takes part."""
    found = _sums(vector_col, vectors)
    if not found:
        return None
    size = max(found, key=lambda s: (found[s][0], s))
    n, sums = found[size]
    return Whitening(n, sums, _moments(vectors, vector_col, size, lambda x: centred(x, n, sums)) / n, components)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error.

    Vectors that are null or empty or hold null or non-finite entries are dropped, and so are those
    that are not of the commonest length. One row for each other vector and each of the first
    ``components`` components whose eigenvalue is above 0: a table without variance gives no row, an
    empty one neither. Repeated rows count as often as they stand there, null ids are kept, other
    columns are ignored whatever their names. Equal eigenvalues stand in the order LAPACK gives them.
    A deviation that fits no long is null.

    ``identity_error`` comes from a third pass, which sums outer products of whitened vectors.
    """
    model = fit_whitening(vectors, vector_col, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    size, k = len(model.sums), len(model.values)
    error = float(np.abs(_moments(vectors, vector_col, size, lambda x: shared.value.project(x)) / model.n - np.eye(k)).max())

    def run(batches):
        model = shared.value
        shares = model.values / model.trace
        for batch in batches:
            for rows, x in whole_vectors(batch.column(1))[1]:
                if x.shape[1] != size:
                    continue
                for at in range(0, len(x), ROWS):
                    some, m = x[at : at + ROWS], len(x[at : at + ROWS])
                    ids = batch.column(0).take(pa.array(np.repeat(rows[at : at + ROWS], k)))
                    columns = [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array([v for v in model.deviation(some) for _ in range(k)], pa.int64()),
                        pa.array(model.project(some).ravel()),
                        pa.array(np.tile(shares, m)),
                        pa.array(np.full(m * k, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col))
    return bounded(rows).mapInArrow(tidy(run), schema)
