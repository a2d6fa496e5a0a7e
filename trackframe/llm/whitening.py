"""Whitening of embeddings by an incremental eigendecomposition.

Every task holds the spectrum of the vectors it has seen: their number, mean, and the eigenvalues and eigenvectors
of their scatter. A vector changes the scatter by one centred rank-one term; the new eigenvalues are the roots of
the secular equation, one between each two old ones, and the new eigenvectors follow from them. Directions that
the term does not touch, and all but one direction of equal eigenvalues, are set aside first (deflation). Two
spectra are combined by one rank-one update per eigenpair of the one and one for the distance of their means;
tasks combine a bounded number of spectra in rounds until one is left.

The updates need not be accurate to the last bit: their basis, made orthonormal, is refined by one Rayleigh-Ritz
step. Tasks project the centred vectors on it, the small matrix of products is solved, and its rotation gives the
components to double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackframe.session import cut_lineage

SCALE = 256.0
FAN = 16            # partial results that a task combines in a round
ROUNDS = 60         # of the root finder; a handful is usual
EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots m of 1 + sum(z2 / (d - m)) for rising d and positive z2: one above each d, below the next.

    Returned are the roots, and the matrix d[j] - m[i], whose small entries are exact because every root is found
    as a distance to the nearer of its two poles.
    """
    k = len(d)
    top = d[-1] + z2.sum()
    upper = np.append(d[1:], top)
    gap = upper - d
    middle = (d[:, None] - (d + gap / 2)[None, :])           # [j, i]
    at_middle = 1 + (z2[:, None] / middle).sum(axis=0)
    right = at_middle < 0                                     # the root is in the upper half of its interval
    right[-1] = False
    origin = np.where(right, upper, d)
    delta = d[:, None] - origin[None, :]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(at_middle < 0, gap, gap / 2))
    low[-1], high[-1] = 0.0, gap[-1]
    t = np.where(right, -gap / 4, gap / 4)
    below = np.arange(k)[:, None] <= np.arange(k)[None, :]   # poles at or below the root
    a0, b0 = d - origin, upper - origin
    for _ in range(ROUNDS):
        inverse = 1 / (delta - t)
        terms = z2[:, None] * inverse
        w = 1 + terms.sum(axis=0)
        open_ = np.abs(w) > EPS * k * (1 + np.abs(terms).sum(axis=0))
        open_ &= high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high))
        if not open_.any():
            break
        low, high = np.where(w < 0, t, low), np.where(w < 0, high, t)
        slopes = terms * inverse
        psi, phi = np.where(below, slopes, 0).sum(axis=0), np.where(below, 0, slopes).sum(axis=0)
        # the equation is matched, with its slopes on both sides, by one with the two nearest poles only
        a, b = a0 - t, b0 - t
        c = w - a * psi - b * phi
        p, q = (a + b) * w - a * b * (psi + phi), a * b * w
        root = np.sqrt(np.abs(p * p - 4 * q * c))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step = np.where(np.isfinite(step) & (w * step < 0), step, -w / (psi + phi))
        new = t + step
        outside = ~((new > low) & (new < high))
        t = np.where(open_, np.where(outside, (low + high) / 2, new), t)
    return origin + t, delta - t


def rank_one(values: np.ndarray, vectors: np.ndarray, weight: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and the eigenvectors of vectors diag(values) vectors' + weight v v'."""
    z = vectors.T @ v
    size = weight * (z @ z)
    if size == 0:
        return values, vectors
    small = 8 * EPS * max(abs(values[-1]), abs(values[0]), size)
    vectors = vectors.copy()
    start = 0
    for end in [*(np.flatnonzero(np.diff(values) > small) + 1), len(values)]:  # runs of equal eigenvalues
        while start < end:
            stop = start + int(np.searchsorted(values[start:end], values[start] + small, "right"))
            if stop - start > 1:  # turned so that only the last of them is touched
                part = z[start:stop]
                length = np.linalg.norm(part)
                if length > 0:
                    u = part.copy()
                    u[-1] += math.copysign(length, u[-1])
                    u /= np.linalg.norm(u)
                    block = vectors[:, start:stop]
                    vectors[:, start:stop] = block - 2 * np.outer(block @ u, u)
                    z[start:stop - 1], z[stop - 1] = 0.0, -math.copysign(length, part[-1])
            start = stop
    touched = np.flatnonzero(weight * np.abs(z) * math.sqrt(z @ z) > small)
    if not len(touched):
        return values, vectors
    d, zt = values[touched], z[touched]
    roots, distance = secular_roots(d, weight * zt * zt)     # distance[j, i] = d[j] - roots[i]
    between = d[None, :] - d[:, None]                         # [j, i] = d[i] - d[j]
    np.fill_diagonal(between, 1.0)
    # weights that have these roots exactly, so that the vectors made from them are orthogonal
    exact = np.sqrt(np.abs(np.prod(-distance / between, axis=1)))
    rotation = np.copysign(exact, zt)[:, None] / distance
    rotation /= np.linalg.norm(rotation, axis=0)
    vectors[:, touched] = vectors[:, touched] @ rotation
    values = values.copy()
    values[touched] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, exact sums, mean, and eigenpairs of the scatter of the vectors seen."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean = 0, [0] * d, np.zeros(d)
        self.values, self.vectors = np.zeros(d), np.eye(d)

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        away = x - self.mean
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, (self.n - 1) / self.n, away)

    def combine(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, float(value), vector)
        n, away = self.n + other.n, other.mean - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / n, away)
        self.mean = self.mean + away * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]

    def row(self) -> dict:
        return {"n": self.n, "exact": [str(s) for s in self.sums], "mean": self.mean.tolist(),
                "one": self.values.tolist(), "two": self.vectors.ravel().tolist()}

    @staticmethod
    def of(row: dict) -> Spectrum:
        s = Spectrum(len(row["mean"]))
        s.n, s.sums, s.mean = row["n"], [int(v) for v in row["exact"]], np.array(row["mean"])
        s.values, s.vectors = np.array(row["one"]), np.array(row["two"]).reshape(len(s.mean), -1)
        return s


class Products:
    """Number, mean and sums of products of centred rows of numbers."""

    def __init__(self, d: int):
        self.n, self.mean, self.products = 0, np.zeros(d), np.zeros((d, d))

    def add(self, rows: np.ndarray) -> None:
        new = Products(rows.shape[1])
        new.n, new.mean = len(rows), rows.mean(axis=0)
        centred = rows - new.mean
        new.products = centred.T @ centred
        self.combine(new)

    def combine(self, other: Products) -> None:
        n, away = self.n + other.n, other.mean - self.mean
        if n:
            self.products = self.products + other.products + np.outer(away, away) * (self.n * other.n / n)
            self.mean = self.mean + away * (other.n / n)
            self.n = n

    def row(self) -> dict:
        return {"n": self.n, "exact": [], "mean": self.mean.tolist(), "one": [], "two": self.products.ravel().tolist()}

    @staticmethod
    def of(row: dict) -> Products:
        p = Products(len(row["mean"]))
        p.n, p.mean, p.products = row["n"], np.array(row["mean"]), np.array(row["two"]).reshape(len(p.mean), -1)
        return p


PARTIAL = pa.schema([("place", pa.int64()), ("n", pa.int64()), ("exact", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())),
                     ("one", pa.list_(pa.float64())), ("two", pa.list_(pa.float64()))])
PARTIAL_SQL = "place long, n long, exact array<string>, mean array<double>, one array<double>, two array<double>"


def partial(batches: Iterator[pa.RecordBatch], start: Callable, add: Callable) -> Iterator[pa.RecordBatch]:
    """One row with what a task found, or none if it had no rows."""
    from pyspark import TaskContext

    state, some = start(), False
    for batch in batches:
        if batch.num_rows:
            add(state, batch)
            some = True
    if some:
        yield pa.RecordBatch.from_pylist([{"place": TaskContext.get().partitionId(), **state.row()}], PARTIAL)


def combined(rows: DataFrame, kind: type, partitions: int):
    """All partial results as one, FAN of them in a task and round; None if there are none."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for batch in batches:
            for row in batch.to_pylist():
                group = row["place"] // FAN
                if state is not None and group != now:
                    yield pa.RecordBatch.from_pylist([{"place": now, **state.row()}], PARTIAL)
                    state = None
                if state is None:
                    state, now = kind.of(row), group
                else:
                    state.combine(kind.of(row))
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"place": now, **state.row()}], PARTIAL)

    while partitions > 1:
        partitions = -(-partitions // FAN)
        rows = cut_lineage(rows.repartition(partitions, F.floor(F.col("place") / F.lit(FAN))).sortWithinPartitions("place")
                           .mapInArrow(combine, PARTIAL_SQL))
    found = rows.collect()
    return kind.of(found[0].asDict()) if found else None


def matrix(column, d: int) -> np.ndarray:
    """Rows of a list column as 64-bit integers; rows with fewer than d entries are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d)[None, :] < sizes[:, None]] = flat
    return out


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows whose vector has numbers only: x is floor(256 * entry), at the border of a long
    where it lies beyond."""
    ok = F.col(vector).isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    least, most = F.lit(-float(1 << 63)), F.lit(float((1 << 63) - 1024))
    x = F.transform(vector, lambda e: F.floor(F.greatest(F.least(e.cast("double") * F.lit(SCALE), most), least)))
    return rows.filter(ok).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))


class Whitening:
    """What a fit gives: n, the exact sums, d, the components as columns with their eigenvalues, trace and error."""

    def __init__(self, n, sums, components, values, trace, error):
        self.n, self.sums, self.components, self.values, self.trace, self.error = n, sums, components, values, trace, error
        self.mean = np.array([s / n for s in sums])  # of exact integers

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Columns by component; a component without variance gives nan."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x.astype(np.float64) - self.mean) @ self.components / np.where(self.values > 0, np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - S)^2) of every row, exact; None where a long cannot hold it."""
        most = self.n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(abs(s) for s in self.sums) if x.size else 0
        if len(self.sums) * most * most < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def fitted(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Fit over the distinct x of `integer_vectors`; None without any entry.

    Equal vectors are combined before they are shuffled. The driver sees one spectrum and two small matrices.
    Vectors shorter than the longest one are filled with zeros before they are compared.
    """
    spark = vectors.sparkSession
    longest = vectors.agg(F.max(F.size("x"))).first()[0]
    if not longest:
        return None
    d = int(longest)
    same_size = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
    fit = cut_lineage(vectors.select(same_size.alias("x")).distinct())
    tasks = fit.rdd.getNumPartitions()

    def spectrum(batches):
        def add(s, batch):
            x = matrix(batch.column(0), d)
            s.sums = [a + b for a, b in zip(s.sums, _exact_sums(x))]
            for v in x.astype(np.float64):
                s.add(v)

        return partial(batches, lambda: Spectrum(d), add)

    whole = combined(fit.mapInArrow(spectrum, PARTIAL_SQL), Spectrum, tasks)
    basis = np.linalg.qr(whole.vectors[:, ::-1])[0]
    first = Whitening(whole.n, whole.sums, basis, np.ones(d), 0.0, None)
    shared = spark.sparkContext.broadcast(first)

    def products(batches):
        return partial(batches, lambda: Products(d), lambda p, b: p.add(shared.value.whitened(matrix(b.column(0), d))))

    ritz = combined(fit.mapInArrow(products, PARTIAL_SQL), Products, tasks).products / whole.n
    values, rotation = np.linalg.eigh((ritz + ritz.T) / 2)
    values, rotation = values[::-1], rotation[:, ::-1]
    trace = float(values.sum())
    k = min(components, d)
    kept = basis @ rotation[:, :k]
    kept /= np.linalg.norm(kept, axis=0)
    kept *= np.where(kept[np.abs(kept).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    some = np.where(values[:k] > 64 * EPS * d * max(trace, 0.0), values[:k], 0.0)
    result = Whitening(whole.n, whole.sums, kept, some, trace, None)
    real = np.flatnonzero(some > 0)
    if len(real):
        made = spark.sparkContext.broadcast(result)

        def checks(batches):
            return partial(batches, lambda: Products(len(real)),
                           lambda p, b: p.add(made.value.whitened(matrix(b.column(0), d))[:, real]))

        found = combined(fit.mapInArrow(checks, PARTIAL_SQL), Products, tasks).products / whole.n
        result.error = float(np.abs(found - np.eye(len(real))).max())
    return result


def _exact_sums(x: np.ndarray) -> list[int]:
    if not x.size or max(abs(int(x.max())), abs(int(x.min()))) * len(x) < 1 << 63:
        return x.sum(axis=0).tolist()
    return [sum(map(int, column)) for column in x.T]


OUT = {"vec_id": pa.int64(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(),
       "explained": pa.float64(), "identity_error": pa.float64()}


def whitened(embeddings: DataFrame, components: int = 4, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row with a vector of
    numbers, for the first components.

    Rows whose vector is null or holds null or non-finite entries go. Repeated rows, repeated and null ids stay and
    count once in the fit. Vectors shorter than the longest are filled with zeros. A component without variance
    (fewer distinct vectors than dimensions, equal vectors) has a null whitened value and is left out of the error,
    which is null if there is no other; without any variance explained is null as well. Equal eigenvalues leave
    the choice of their components open. A table without vectors, or with empty ones only, gives no rows.
    A deviation beyond a long is null. Other columns are not read.
    """
    spark = embeddings.sparkSession
    vectors = integer_vectors(embeddings, vec_id, vector)
    fit = fitted(vectors, components)
    schema = ", ".join(f"{k} {dict(int64='long', int32='int', double='double')[str(t)]}" for k, t in OUT.items())
    if fit is None:
        return spark.createDataFrame([], schema)
    shared, d = spark.sparkContext.broadcast(fit), len(fit.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        k = f.components.shape[1]
        explained = [float(v / f.trace) if f.trace > 0 else None for v in f.values]
        for batch in batches:
            x, m = matrix(batch.column(1), d), batch.num_rows
            names = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            far = [v for v in f.deviation(x) for _ in range(k)]
            values = f.whitened(x).ravel()
            columns = [names, np.tile(np.arange(1, k + 1), m), np.full(m * k, f.n), far,
                       pa.array(values, mask=np.isnan(values)), explained * m, [f.error] * (m * k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c
                                              for c, t in zip(columns, OUT.values())], list(OUT))

    return vectors.mapInArrow(project, schema)
