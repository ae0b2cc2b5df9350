"""Embedding whitening by Chan merging.

Every partition reduces its vectors to a count, the exact sums, the local mean and the centred scatter; ``treeReduce``
merges two such states with the pairwise formula (scatters add up, plus the outer product of the difference of means
times n_a * n_b / n).  The driver holds a few states of d x d doubles, takes the eigenvectors of the covariance (eigh)
and sends them out; a second pass whitens all vectors and reduces them by the same formula, which verifies that their
covariance is the identity; the last pass returns them.

An entry c becomes the integer floor(1024 * c) + 100000, so sums and deviations are exact.

Nulls and edge cases: rows whose vector is null, empty or holds null or non-finite entries are dropped; vectors of
several lengths, and entries of 2^38 or more, are refused with a ValueError; a component without variance (equal
vectors, fewer vectors than dimensions, one vector) has a null ``whitened`` and an ``explained`` of 0; without any
vector the result is empty; repeated and null ids are rows like others; other columns are ignored.  Squared deviations
are exact; one that doesn't fit into 64 bits (from about 3 million unit vectors on) is null.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries from here on have no exact place in the integers that are summed.
LARGEST = float(1 << 38)
#: A component whose eigenvalue is below this share of the largest has no variance that doubles can tell from rounding.
LEAST = 1e-11


@dataclass
class Moments:
    """Count, exact sums (of integers), mean and centred scatter of some rows."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    mean: np.ndarray = field(default_factory=lambda: np.empty(0))
    scatter: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        if not len(x):
            return cls()
        if x.dtype == np.int64:
            sums = [int(s) for s in x.sum(axis=0)]
            mean = np.array([s / len(x) for s in sums])
        else:
            sums, mean = [], x.mean(axis=0)
        centred = x - mean
        return cls(len(x), sums, mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if other.n else self
        if len(self.mean) != len(other.mean):
            raise ValueError(f"vectors of {len(self.mean)} and of {len(other.mean)} entries")
        n = self.n + other.n
        delta = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        if self.sums:
            sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
            mean = np.array([s / n for s in sums])
        else:
            sums, mean = [], self.mean + delta * (other.n / n)
        return Moments(n, sums, mean, scatter)


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, their vectors as integers) of the vectors without null or non-finite entries."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are NaN
    ends = np.cumsum(sizes)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    good = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    if not len(good):
        return good, np.empty((0, 0), np.int64)
    width = int(sizes[good[0]])
    if (sizes[good] != width).any():
        raise ValueError(f"vectors of {width} and of other numbers of entries")
    x = flat[(ends[good] - width)[:, None] + np.arange(width)[None, :]]
    if (np.abs(x) >= LARGEST).any():
        raise ValueError(f"entries of {LARGEST:.0f} or more can't be whitened")
    return good, np.floor(SCALE * x).astype(np.int64) + SHIFT


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x - mean as doubles, the exact sum of (n * x - S)^2 of each row, whether it fits into 64 bits)."""
    most = max(abs(int(x.max())), abs(int(x.min())))
    if n * most + max(map(abs, sums)) < 1 << 62:
        off = n * x - np.array(sums, np.int64)
    else:
        off = n * x.astype(object) - np.array(sums, object)
    doubles = off.astype(np.float64)
    rough = (doubles * doubles).sum(axis=1) / float(1 << 63)
    squares, fits = np.zeros(len(x), np.int64), rough < 1 - 1e-9
    small = off[fits].astype(np.int64)
    squares[fits] = (small * small).sum(axis=1)
    for k in np.flatnonzero(~fits & (rough < 1 + 1e-9)).tolist():  # too near to tell in doubles
        if (exact := sum(int(v) ** 2 for v in off[k])) < 1 << 63:
            squares[k], fits[k] = exact, True
    return doubles / n, squares, fits


@dataclass
class Whitening:
    """Components in columns, already divided by the root of their eigenvalue (NaN without variance)."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, m: Moments, components: int) -> Whitening:
        values, vectors = np.linalg.eigh(m.scatter / m.n)
        by = np.argsort(-values, kind="stable")[:components]
        total = float(np.trace(m.scatter) / m.n)
        kept, vectors = np.maximum(values[by], 0.0), vectors[:, by]
        vectors = vectors * np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(by))])
        alive = kept > LEAST * max(float(values.max()), 0.0)
        weights = np.where(alive, vectors / np.sqrt(np.where(alive, kept, 1.0)), np.nan)
        return cls(m.n, m.sums, weights, np.where(alive, kept / total if total else 0.0, 0.0))


def _reduced(rows: DataFrame, state) -> Moments:
    """``state(column)`` of each partition's vectors, merged along a tree; no more than about 32 states meet in the driver."""

    def partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Moments()
        for batch in batches:
            held = held.merged(state(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["state"])

    states = rows.mapInArrow(partition, "state binary").rdd.map(lambda row: pickle.loads(row[0]))
    many = states.getNumPartitions()
    if not many:
        return Moments()
    return states.treeReduce(Moments.merged, depth=max(2, int(np.ceil(np.log(many) / np.log(16)))))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    context = vectors.sparkSession.sparkContext
    schema = f"vec_id {source.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    moments = _reduced(source.select("v"), lambda column: Moments.of(integers(column)[1]))
    if not moments.n:
        return vectors.sparkSession.createDataFrame([], schema)
    model = Whitening.of(moments, components)
    sent = context.broadcast(model)
    alive = np.flatnonzero(np.isfinite(model.weights).all(axis=0))

    def projected(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        rows, x = integers(column)
        if not len(rows):
            return rows, pa.array([], pa.int64()), np.empty((0, 0))
        centred, squares, fits = deviations(x, sent.value.n, sent.value.sums)
        return rows, pa.array(squares, pa.int64(), mask=~fits), centred @ sent.value.weights

    error = None
    if len(alive):
        check = _reduced(source.select("v"), lambda column: Moments.of(z[:, alive]) if len(z := projected(column)[2]) else Moments())
        error = float(np.abs(check.scatter / check.n - np.eye(len(alive))).max())

    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = sent.value.explained
        k = len(explained)
        for batch in batches:
            rows, squares, z = projected(batch.column("v"))
            if not len(rows):
                continue
            m = len(rows) * k
            flat = z.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, sent.value.n, np.int64)),
                    squares.take(pa.array(np.repeat(np.arange(len(rows)), k))), pa.array(flat, mask=~np.isfinite(flat)), pa.array(np.tile(explained, len(rows))), pa.array([error] * m, pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return source.mapInArrow(out, schema)
