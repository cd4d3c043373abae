"""Whitening of embeddings by shifted CholeskyQR.

Entries become integers, ``floor(64 c) + 1000000``, so sums are exact. Rows are centred on the exact
means before anything is multiplied. Each pass forms the Gram matrix of the rows as they are so far:
a task adds up its own rows in blocks, and one row of a matrix from every task is summed in one
stream. The driver factors the d x d sum; the next pass takes rows through triangular solves with
all factors so far. The first factor is that of the Gram matrix with a small shift on its diagonal,
which never breaks down; later ones need the shift only while rows are far from orthogonal. The
product of the factors is R of the centred rows, its singular values over sqrt(n) are those of the
covariance, to the precision of R and not of its square.

Bounds: the driver, each broadcast and each task hold a few d x d matrices, d at most ``MAX_DIM``;
rows stream. Sums and Gram matrices are of all rows.

Defined results: rows with a null vector, or a null or non-finite entry in it, are dropped; so are
vectors whose length is not the most frequent one (of equally frequent ones the greatest). Entries
are held at +-2**52 after scaling. ``deviation`` is null where it does not fit a long. Directions
without variance (singular values below ``d`` roundings of the greatest) are no components; equal
vectors, a single row or an empty table have none, and their rows get an empty list. A component's
greatest entry is positive. Repeated rows and null ids are rows like others. All columns of the
input travel in one struct ``record``, so no name of theirs can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pactlane.llm.sharding import quoted

KEPT = 32
SCALE, OFFSET, CLIP = 64.0, 1_000_000, float(1 << 52)
BLOCK_ROWS = 4096
MAX_DIM = 2048
PASSES = 4
LOW = 26  # bits of the low half of an entry in exact sums
EPS = float(np.finfo(np.float64).eps)


def valid(vector: Column) -> Column:
    """Vectors without null and non-finite entries."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: entry(x.cast("double")))


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the usable rows, their entries as integers)."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    keep = size == dim if dim else np.zeros(len(size), bool)
    start = (np.cumsum(size) - size)[keep]
    rows = flat[start[:, None] + np.arange(dim)] if len(start) else np.empty((0, dim))
    finite = np.isfinite(rows).all(axis=1)
    keep[np.flatnonzero(keep)[~finite]] = False
    return keep, np.floor(np.clip(SCALE * rows[finite], -CLIP, CLIP)).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield integers(batch.column(0).slice(at, BLOCK_ROWS), dim)[1]


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for x in _blocks(batches, dim):
            n += len(x)
            high += (x >> LOW).sum(axis=0)
            low += (x & ((1 << LOW) - 1)).sum(axis=0)
        columns = [np.arange(-1, dim), np.concatenate(([n], high)), np.concatenate(([0], low))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "high", "low"])

    return run


@dataclass
class Centre:
    """Exact sums over ``n`` rows; means as an integer and the rest of it."""

    n: int
    sums: list[int]

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x minus its mean, rounded once."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole).astype(np.float64) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) squared; integers wrap, so what fits a long is exact."""
        far = self.n * self.rows(x)
        n, s = np.int64(self.n), np.array([v & (1 << 64) - 1 for v in self.sums], np.uint64).view(np.int64)
        with np.errstate(over="ignore"):
            d = x * n - s
            exact = (d * d).sum(axis=1)
        return [v if f < 2.0**63 and v >= 0 else None for v, f in zip(exact.tolist(), (far * far).sum(axis=1).tolist(), strict=True)]


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of upper triangular ``r``, one column after the other."""
    out = np.empty_like(rows)
    for j in range(r.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _gram(centre: Centre, dim: int, factors: list[np.ndarray], last: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, dim):
            q = centre.rows(x)
            for r in factors:
                q = solved(q, r)
            if last is not None:
                q = np.hstack((q @ last, np.ones((len(q), 1))))
            total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            rows = [total[i, i:].tobytes() for i in range(len(total))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["i", "part"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by matrix row -> their sums."""
    where, total = None, None
    out: list[tuple[int, bytes]] = []
    for batch in batches:
        for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(part)
            if i != where:
                if total is not None:
                    out.append((where, total.tobytes()))
                where, total = i, part
            else:
                total = total + part
    if total is not None:
        out.append((where, total.tobytes()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["i", "total"])


def gram(vectors: DataFrame, centre: Centre, dim: int, factors: list[np.ndarray], last: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows after all triangular solves; with ``last`` of the rows times
    ``last`` and a column of ones. d rows come to the driver."""
    parts = vectors.mapInArrow(_gram(centre, dim, factors, last), "i int, part binary")
    total = parts.repartition("i").sortWithinPartitions("i").mapInArrow(_added, "i int, total binary").collect()
    size = dim if last is None else last.shape[1] + 1
    out = np.zeros((size, size))
    for i, row in total:
        out[i, i:] = np.frombuffer(row)
    return out + np.triu(out, 1).T


def factor(g: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = g, or g and a shift that outweighs its rounding."""
    shift = 11 * len(g) * (BLOCK_ROWS + len(g) + 1) * EPS * float(np.trace(g)) if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, EPS * float(np.trace(g)))


@dataclass
class Whitening:
    """Fitted components (columns of ``basis``, scaled to whiten centred rows) and what tells their quality."""

    centre: Centre
    dim: int
    basis: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def r_factor(vectors: DataFrame, centre: Centre, dim: int) -> np.ndarray:
    """R of the centred rows, composed of the factors of all passes."""
    factors: list[np.ndarray] = []
    r = np.eye(dim)
    if not dim:
        return r
    for k in range(PASSES):
        g = gram(vectors, centre, dim, factors)
        low, high = np.linalg.eigvalsh(g)[[0, -1]]
        if high <= 0:
            return np.zeros((dim, dim))
        done = k and np.abs(g - np.eye(dim)).max() < 1e-8
        if not done and k == PASSES - 1:  # directions that stay without length: the root needs no inverse
            w, v = np.linalg.eigh(g)
            return v @ np.diag(np.sqrt(np.maximum(w, 0))) @ v.T @ r
        part = factor(g, shifted=not done and (not k or low < 1e-6 * high))
        factors.append(part)
        r = part @ r
        if done:
            break
    return r


def fit(df: DataFrame, column: str, kept: int = KEPT) -> Whitening | None:
    """Components of all usable vectors in ``column`` (at most ``kept``); None without any."""
    vectors = df.select(F.col(quoted(column)).alias("v"))
    usable = vectors.where(valid(F.col("v")))
    best = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if best is None:
        return None
    dim = best["dim"]
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries: more than {MAX_DIM}")
    found = vectors.mapInArrow(_sums(dim), "k long, high long, low long").groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.count("*")).collect()
    by = {r["k"]: r for r in found}
    centre = Centre(by[-1]["high"], [(by[k]["high"] << LOW) + by[k]["low"] for k in range(dim)])
    r = r_factor(vectors, centre, dim)
    _, sigma, vt = np.linalg.svd(r)
    top = sigma.max(initial=0.0)
    rank = int((sigma > dim * EPS * top).sum())
    components = vt[: min(kept, rank)].T
    if components.size:
        components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
    values = sigma**2 / centre.n
    size = components.shape[1]
    basis = components / np.sqrt(values[:size])
    error = 0.0
    if size:
        g = gram(vectors, centre, dim, [], basis) / centre.n
        error = float(np.abs(g[:-1, :-1] - np.outer(g[:-1, -1], g[:-1, -1]) - np.eye(size)).max())
    return Whitening(centre, dim, basis, components, values[:size], values[:size] / max(values.sum(), np.finfo(float).tiny), error)


def _whiten(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                keep, x = integers(batch.column(1), model.dim)
                white = model.centre.rows(x) @ model.basis
                size = white.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), pa.array(white.reshape(-1)))
                record = batch.column(0).filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([record, lists, pa.array(model.centre.deviations(x), pa.int64())], names=["record", "whitened", "deviation"])

    return run


def transform(df: DataFrame, column: str, model: Whitening | None, keep: list[str] | None = None) -> DataFrame:
    """record (the columns ``keep``, or all), whitened (one value for each component) and deviation of
    every usable row."""
    record = F.struct(*[F.col(quoted(c)) for c in (keep if keep is not None else df.columns)]).alias("record")
    rows = df.select(record, F.col(quoted(column)).alias("v"))
    schema = StructType([rows.schema["record"], StructField("whitened", ArrayType(DoubleType())), StructField("deviation", LongType())])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_whiten(model), schema)


def by_component(white: DataFrame, model: Whitening | None) -> DataFrame:
    """One row for each record and component: component (from 1), n, deviation, whitened, explained, identity_error."""
    shares = F.array(*[F.lit(float(e)) for e in (model.explained if model else [])]).cast("array<double>")
    out = white.select("record", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select(
        "record", (F.col("k") + 1).alias("component"), F.lit(model.centre.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
