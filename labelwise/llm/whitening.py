"""Whitening of vectors by an incremental eigendecomposition.

Vectors are integer: entry ``c`` is ``floor(scale * c)``. The fit list is each distinct integer vector once; it is found by a
grouping that combines before its shuffle, so copies never meet.

1. Every partition of the fit list keeps a spectrum: count, mean, eigenvalues and eigenvectors of its scatter. Centred vectors come in by
   rank-one updates. A block of more vectors than dimensions is first condensed, chunk by chunk, to as many directions with the
   same scatter (the triangular factor of the centred block), so an update is paid per direction, not per vector; the
   difference of the means is one more.
2. A rank-one update (``update``) rotates into the eigenvectors, deflates (tiny weights and equal eigenvalues leave their
   eigenpairs alone), solves the secular equation for the rest by bisection from the nearest pole, and recomputes the weights
   from the roots (Gu and Eisenstat, 1994), which keeps the eigenvectors orthogonal.
3. Spectra are combined in a tree of ``FAN`` by successive rank-one updates along one spectrum's eigenvectors and the difference
   of the means. A spectrum has ``dimension ** 2`` numbers whatever the input; one is left for the driver.
4. One distributed Rayleigh-Ritz pass with the exact mean: the fit list's covariance inside the spectrum's basis is summed by partitions and its small
   eigenproblem turns the basis, which brings the components to double precision.

Components are numbered from 1 by falling eigenvalue; signs make the entry of largest size positive. Components whose
eigenvalue is zero (below 1e-12 of the trace) have no whitened values and are not returned.

Nulls: vectors that are null or hold null or non-finite entries are dropped; a null id is kept. A vector shorter than the longest
one is read as if zeros followed (an empty one is all zeros). Entries past a bigint are held at its ends. Repeated rows are rows of
the result, but once in the fit list. Equal eigenvalues: any basis of their space, the same for all rows. Empty tables, or a
fit list of one vector, give empty results. A ``deviation`` past a bigint is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
COMPONENTS = 4
FAN = 8                  # spectra that one task combines
CHUNK = 4096             # vectors that are condensed at once
CONDENSE = 64            # vectors of a block, per dimension (one chunk at least)
ZERO = 1e-12             # share of the trace below which an eigenvalue is zero
_MAX = (1 << 63) - 1
_STEPS = 110             # bisection steps: past the spacing of doubles


@dataclass
class Spectrum:
    """``n`` vectors, their mean and the eigenvalues (ascending) and eigenvectors (columns) of their scatter."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> "Spectrum":
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, d: int) -> "Spectrum":
        x = np.frombuffer(raw)
        return cls(int(x[0]), x[1:d + 1], x[d + 1:2 * d + 1], x[2 * d + 1:].reshape(d, d))


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(weights / (poles - x))``, one above each of the ascending poles, as the index of the nearest pole and the
    distance from it. Weights are positive; all roots are bisected at once."""
    k = len(poles)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    gaps = upper - poles
    between = poles[None] - poles[:, None]                       # pole j seen from pole i

    def value(origin: np.ndarray, offset: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 + (weights / (between[origin] - offset[:, None])).sum(1)

    own = np.arange(k)
    right = (value(own, gaps / 2) < 0) & (own < k - 1)           # the root lies in the upper half: start from the next pole
    origin = own + right
    low, high = np.where(right, -gaps / 2, 0.0), np.where(right, 0.0, np.where(own < k - 1, gaps / 2, gaps))
    for _ in range(_STEPS):
        middle = (low + high) / 2
        below = value(origin, middle) < 0
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return origin, (low + high) / 2


def update(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors after ``direction direction^T`` is added."""
    z = vectors.T @ direction
    weight = z @ z
    if not weight > 0:
        return values, vectors
    small = 8 * np.finfo(float).eps * max(np.abs(values).max(), weight)
    values, vectors = values.copy(), vectors.copy()
    last = -1                                                    # the last pole that still has a weight
    for i in range(len(values)):                                 # equal poles: turn their weight into one of them
        if abs(z[i]) * np.sqrt(weight) <= small:
            z[i] = 0
            continue
        if last >= 0 and values[i] - values[last] <= small:
            r = np.hypot(z[i], z[last])
            c, s = z[i] / r, z[last] / r
            a, b = vectors[:, last].copy(), vectors[:, i].copy()
            vectors[:, last], vectors[:, i] = c * a - s * b, s * a + c * b
            z[last], z[i] = 0, r
        last = i
    live = np.flatnonzero(z)
    if len(live):
        poles, own = values[live], z[live]
        origin, offset = secular_roots(poles, own * own)
        away = poles[None] - poles[origin][:, None] - offset[:, None]        # pole j from root i
        away[away == 0] = np.finfo(float).tiny
        apart = poles[None] - poles[:, None]                                 # pole j from pole i
        np.fill_diagonal(apart, 1.0)
        ratio = away / apart                                                 # root i - pole j over pole i - pole j
        np.fill_diagonal(ratio, -np.diag(away))
        exact = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=0))), own)
        turn = exact[None] / away
        turn /= np.linalg.norm(turn, axis=1, keepdims=True)
        vectors[:, live] = vectors[:, live] @ turn.T
        values[live] = poles[origin] + offset
        order = np.argsort(values, kind="stable")
        values, vectors = values[order], vectors[:, order]
    return values, vectors


@dataclass
class Block:
    """Centred directions of ``n`` vectors: the rows' scatter is theirs."""

    n: int
    mean: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "Block":
        mean = x.mean(axis=0)
        return cls(len(x), mean, x - mean).condensed()

    def condensed(self) -> "Block":
        return self if len(self.rows) <= self.rows.shape[1] else Block(self.n, self.mean, np.linalg.qr(self.rows, mode="r"))

    def __add__(self, other: "Block") -> "Block":
        n, away = self.n + other.n, other.mean - self.mean
        rows = np.concatenate([self.rows, other.rows, [away * np.sqrt(self.n * other.n / n)]])
        return Block(n, self.mean + away * (other.n / n), rows).condensed()


def add_block(spectrum: Spectrum, block: Block) -> Spectrum:
    """The spectrum with the vectors of a block added."""
    return _with(spectrum, block.n, block.mean, block.rows)


def combine(a: Spectrum, b: Spectrum) -> Spectrum:
    """The spectrum of two fit lists together."""
    return _with(a, b.n, b.mean, (b.vectors * np.sqrt(np.maximum(b.values, 0))).T) if b.n else a


def _with(spectrum: Spectrum, m: int, mean: np.ndarray, rows: np.ndarray) -> Spectrum:
    n = spectrum.n
    values, vectors = spectrum.values, spectrum.vectors
    for row in rows:
        values, vectors = update(values, vectors, row)
    if n:
        values, vectors = update(values, vectors, (mean - spectrum.mean) * np.sqrt(n * m / (n + m)))
    return Spectrum(n + m, spectrum.mean + (mean - spectrum.mean) * (m / (n + m)), values, vectors)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Integer vectors of a list column, filled up with zeros to ``d`` entries."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (size == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(size), d), np.int64)
    out[np.arange(d) < size[:, None]] = flat
    return out


def _exact_sums(x: np.ndarray) -> list[int]:
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(b) for h, b in zip(high, low)]


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` of the vectors without null or non-finite entries."""
    entry = F.col("embedding")
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return (table.where(F.col("embedding").isNotNull() & ~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x")))


@dataclass
class Fit:
    """``n`` fit vectors, exact sums, and the basis (columns, falling eigenvalue) with its eigenvalues and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    basis: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` without cancellation: whole parts are subtracted as integers."""
        whole = np.array([min(max(s // self.n, -_MAX), _MAX) for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        if len(x) and max(int(np.abs(x).max()), int(np.abs(whole).max())) >= 1 << 62:
            return x.astype(float) - whole - part
        return (x - whole) - part

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.centred(x) @ self.basis[:, :k] / np.sqrt(self.values[:k])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of ``(n x - S)^2``."""
        top = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0)
        if top * top * max(self.dimension, 1) <= _MAX:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        found = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [v if v <= _MAX else None for v in found]


def _spectra(vectors: DataFrame, d: int) -> DataFrame:
    """``part, spectrum`` of every partition; sums are exact, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums, block, number = Spectrum.empty(d), [0] * d, None, 0
        for b in batches:
            x = _matrix(b.column(0), d)
            number = b.column(1)[0].as_py() if b.num_rows else number
            sums = [s + t for s, t in zip(sums, _exact_sums(x))]
            for a in range(0, len(x), CHUNK):
                chunk = Block.of(x[a:a + CHUNK].astype(float))
                block = chunk if block is None else block + chunk
                if block.n >= max(CHUNK, CONDENSE * d):
                    spectrum, block = add_block(spectrum, block), None
        if block is not None:
            spectrum = add_block(spectrum, block)
        if spectrum.n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "spectrum": [spectrum.pack()],
                                              "sums": [[str(s) for s in sums]]})

    return (vectors.select("x", F.spark_partition_id().alias("part"))
            .mapInArrow(run, "part int, spectrum binary, sums array<string>"))


def _combined(spectra: DataFrame, parts: int, d: int) -> tuple[Spectrum, list[int]]:
    """All spectra as one, by a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Spectrum, list[int]]] = {}
        for b in batches:
            for row in b.to_pylist():
                own, sums = Spectrum.unpack(row["spectrum"], d), [int(s) for s in row["sums"]]
                if row["part"] in held:
                    old, before = held[row["part"]]
                    own, sums = combine(old, own), [s + t for s, t in zip(before, sums)]
                held[row["part"]] = own, sums
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.int32()), "spectrum": pa.array([s.pack() for s, _ in held.values()], pa.binary()),
                                          "sums": pa.array([[str(t) for t in sums] for _, sums in held.values()], pa.list_(pa.string()))})

    while parts > FAN:
        groups = -(-parts // FAN)
        grouped = spectra.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        spectra = stored(grouped.repartitionById(groups, F.col("part")).mapInArrow(
            run, "part int, spectrum binary, sums array<string>"), "spectra")
        parts = groups
    total, sums = Spectrum.empty(d), [0] * d
    for row in spectra.orderBy("part").collect():                            # at most FAN spectra
        total = combine(total, Spectrum.unpack(row.spectrum, d))
        sums = [s + int(t) for s, t in zip(sums, row.sums)]
    return total, sums


def _summed(vectors: DataFrame, k: int, fit: Fit, project) -> np.ndarray:
    """Sum over the fit list of the outer products of ``project(x)`` (``k`` numbers) with itself, and of ``project(x)``."""
    given = vectors.sparkSession.sparkContext.broadcast(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            y = project(given.value, _matrix(b.column(0), given.value.dimension))
            total[:k] += y.T @ y
            total[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"row": pa.array(range(k + 1), pa.int32()), "sums": [r.tolist() for r in total]})

    rows = (vectors.select("x").mapInArrow(run, "row int, sums array<double>").select("row", F.posexplode("sums").alias("col", "v"))
            .groupBy("row", "col").agg(F.sum("v").alias("v")).collect())     # (k + 1) x k numbers
    out = np.zeros((k + 1, k))
    for r in rows:
        out[r.row, r.col] = r.v
    return out


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """Each distinct vector once (``x``, a stored table), the number of them and their dimension."""
    distinct = stored(vectors.select("x").distinct(), "fit_vectors")
    size = distinct.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n")).collect()[0]
    if not size.n or size.a == size.d:
        return distinct, size.n, size.d or 0
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(size.d) - F.size("x"))
    distinct = stored(distinct.select(F.concat("x", zeros).alias("x")).distinct(), "fit_vectors")
    return distinct, distinct.count(), size.d


def fit(distinct: DataFrame, d: int) -> Fit:
    """Mean, eigenvalues and components of a fit list of ``d`` dimensions."""
    spectra = stored(_spectra(distinct, d), "spectra")
    parts = spectra.agg(F.max("part").alias("p")).collect()[0].p + 1
    spectrum, sums = _combined(spectra, parts, d)
    order = np.argsort(-spectrum.values, kind="stable")
    basis = np.linalg.qr(spectrum.vectors[:, order])[0]
    start = Fit(spectrum.n, sums, np.ones(d), basis, 1.0)
    # Rayleigh-Ritz: the covariance in this basis, from exactly centred vectors
    inside = _summed(distinct, d, start, lambda f, x: f.centred(x) @ f.basis)[:d] / spectrum.n
    values, turn = np.linalg.eigh((inside + inside.T) / 2)
    values, basis = values[::-1], basis @ turn[:, ::-1]
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return Fit(spectrum.n, sums, values, basis, float(values.sum()))


FIELDS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for the first components of every vector of
    ``table`` (``vec_id``, ``embedding``), centred and scaled by the fit list of the same table."""
    spark = table.sparkSession
    vectors = integer_vectors(table, scale)
    distinct, n, d = fit_list(vectors)
    if n < 2 or not d:
        return spark.createDataFrame([], FIELDS)
    model = fit(distinct, d)
    k = int((model.values[:components] > ZERO * model.trace).sum())
    if not k:
        return spark.createDataFrame([], FIELDS)
    sums = _summed(distinct, k, model, lambda f, x: f.whiten(x, k))
    covariance = sums[:k] / n - np.outer(sums[k], sums[k]) / n / n
    error = float(np.abs(covariance - np.eye(k)).max())
    given = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = _matrix(b.column(1), d), b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, n)), pa.array([v for v in given.value.deviations(x) for _ in range(k)], pa.int64()),
                 pa.array(given.value.whiten(x, k).ravel()), pa.array(np.tile(given.value.values[:k] / given.value.trace, m)),
                 pa.array(np.full(m * k, error))], [f.split()[0] for f in FIELDS.split(", ")])

    return vectors.mapInArrow(run, FIELDS)
