"""Whitening of embeddings by polarisation of variances.

Entries become whole numbers x, so every sum below is exact.  Over the fit list, which holds each distinct vector once, the squares of the centred
values of every dimension and of the sum of every pair of dimensions are added up; a covariance is half of what the variance of a sum exceeds
the two variances by: cov(i, j) = (var(i + j) - var(i) - var(j)) / 2.  The d x d matrix is put together on the driver (d (d + 1) / 2 numbers, whatever
the number of rows) and decomposed by ``eigh``.

Squares are taken of x - q, where q is the mean rounded down, and n of them are corrected by the remainder of the division: n times the sum of squares
less the squared remainder is, exactly, the sum of (n x - S)^2 over n.  Sums leave a task as limbs of ``LIMB`` bits and are combined before the shuffle.

Defined cases: a missing vector, or one with a missing, infinite or NaN entry, is dropped; whole numbers beyond 64 bits are cut to
their range; vectors whose length is not the most frequent one of the fit list (ties: the longest) are returned with nulls in place of numbers; empty
vectors have no components, so no rows; where a component has no variance (fewer than two distinct vectors, or linear dependence) ``whitened`` is null
and ``identity_error`` is taken over the others; a deviation beyond 64 bits is null; repeated and missing ids are rows of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import store

SCALE = 256
#: Rows that are squared together.
ROWS = 2048
LIMB = 40
LIMBS = 5
#: Below this a product or sum fits 64 bits with room to spare.
SAFE = 1 << 61


def packed(x: np.ndarray) -> bytes:
    """Bytes of a vector in the narrowest whole-number type that holds it: equal vectors have equal bytes."""
    for kind in ("<i2", "<i4"):
        limits = np.iinfo(kind)
        if len(x) == 0 or (x.min() >= limits.min and x.max() <= limits.max):
            return b"%c" % np.dtype(kind).itemsize + x.astype(kind).tobytes()
    return b"\x08" + x.astype("<i8").tobytes()


def unpacked(column: pa.Array) -> np.ndarray:
    """Matrix of the vectors of a batch, all of one length."""
    return np.stack([np.frombuffer(v, f"<i{v[0]}", offset=1).astype(np.int64) for v in column.to_pylist()])


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, d, x): packed vectors and their lengths; rows that cannot be used are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keep, lengths, out = batch.column(0), [], [], []
            lists = batch.column(1)
            for i in range(batch.num_rows):
                row = lists[i]
                if not row.is_valid or row.values.null_count:
                    continue
                v = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                with np.errstate(over="ignore"):
                    y = np.floor(SCALE * v) + 0.0
                low, high = y <= -(2.0**63), y >= 2.0**63
                x = np.where(low | high, 0, y).astype(np.int64)
                x[low], x[high] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
                keep.append(i)
                lengths.append(len(x))
                out.append(packed(x))
            yield pa.RecordBatch.from_pydict({"id": pc.take(ids, pa.array(keep, pa.int64())), "d": pa.array(lengths, pa.int32()), "x": pa.array(out, pa.binary())})

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, d int, x binary")


def limbs(value: int) -> list[int]:
    """``value`` as digits of LIMB bits, the last one signed; digits of many numbers may be added up."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def totals(fit: DataFrame, width: int, sums_of) -> list[int]:
    """Exact totals over all rows of the ``width`` columns that ``sums_of`` gives for a matrix of vectors: one list of sums a matrix."""
    names = [f"l{k}" for k in range(LIMBS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = [0] * width
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                acc = [a + b for a, b in zip(acc, sums_of(unpacked(batch.column(0).slice(at, ROWS))), strict=True)]
        digits = np.array([limbs(a) for a in acc], object).reshape(width, LIMBS)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(width), pa.int32()), **{n: pa.array(digits[:, k].tolist(), pa.int64()) for k, n in enumerate(names)}})

    parts = fit.select("x").mapInArrow(run, "at int, " + ", ".join(f"{n} long" for n in names))
    out = [0] * width
    for row in parts.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).collect():  # one row a column
        out[row["at"]] = sum(row[n] << (LIMB * k) for k, n in enumerate(names))
    return out


def largest(z: np.ndarray) -> int:
    return max(-int(z.min()), int(z.max())) if z.size else 0


def exact_sums(z: np.ndarray) -> list[int]:
    """Column sums, in 64 bits where they fit."""
    most = largest(z)
    return z.sum(0).tolist() if most * len(z) < SAFE else z.astype(object).sum(0).tolist()


def square_sums(z: np.ndarray) -> list[int]:
    """Column sums of squares, in 64 bits where they fit."""
    most = largest(z)
    return np.einsum("ij,ij->j", z, z).tolist() if most * most * len(z) < SAFE else (z.astype(object) ** 2).sum(0).tolist()


def centred(x: np.ndarray, q: list[int]) -> np.ndarray:
    """``x`` less the rounded mean, in 64 bits where every difference and pair sum fits."""
    wide = max(map(abs, q), default=0) > SAFE >> 2 or largest(x) > SAFE >> 2
    return x.astype(object) - np.array(q, object) if wide else x - np.array(q, np.int64)


@dataclass(frozen=True)
class Whitener:
    """Exact moments of the fit list and what follows from them."""

    n: int
    q: list[int]
    r: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    positive: np.ndarray

    @property
    def components(self) -> int:
        return len(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        z, r = centred(x, self.q), np.array(self.r, object)
        if z.dtype != object and (self.n * (largest(z) + 1)) ** 2 * x.shape[1] < SAFE:
            return ((self.n * z - r.astype(np.int64)) ** 2).sum(1).tolist()
        found = ((self.n * z.astype(object) - r) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in found]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components at unit variance; NaN where a component has none."""
        mean = np.array([r / self.n for r in self.r])
        root = np.sqrt(np.where(self.positive, self.values, np.nan))
        return ((centred(x, self.q).astype(np.float64) - mean) @ self.vectors) / root


def fit(rows: DataFrame, most: int = 4) -> tuple[Whitener, DataFrame] | None:
    """The whitener of the distinct vectors among rows (d, x), and these vectors (x); None without any."""
    distinct = store(rows.select("d", "x").distinct(), "fit")
    lengths = distinct.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or lengths["d"] == 0:
        return None
    d, n = lengths["d"], lengths["n"]
    fitted = distinct.filter(F.col("d") == d)

    sums = totals(fitted, d, exact_sums)
    q, r = [s // n for s in sums], [s % n for s in sums]
    left, right = np.triu_indices(d, 1)

    def squares(x: np.ndarray) -> list[int]:
        z = centred(x, q)
        return square_sums(z) + square_sums(z[:, left] + z[:, right])

    found = totals(fitted, d + len(left), squares)
    # n^2 times the variance of every dimension, then of every sum of two
    own = [n * found[i] - r[i] ** 2 for i in range(d)]
    covariance = np.zeros((d, d))
    for i in range(d):
        covariance[i, i] = own[i] / n**2
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        pair = n * found[d + k] - (r[i] + r[j]) ** 2
        covariance[i, j] = covariance[j, i] = ((pair - own[i] - own[j]) // 2) / n**2
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][: min(most, d)], vectors[:, ::-1][:, : min(most, d)]
    trace = sum(own) / n**2
    return Whitener(n, q, r, vectors, values, trace, values > max(trace, 0.0) * 1e-12 * d), fitted


def identity_error(fitted: DataFrame, model: Whitener) -> float | None:
    """Largest absolute entry of the measured covariance of the whitened fit list minus the identity."""
    c = model.components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(c), np.zeros((c, c))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = model.whitened(unpacked(batch.column(0).slice(at, ROWS)))
                total += w.sum(0)
                products += w.T @ w
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(c + c * c), pa.int32()), "v": pa.array([*total, *products.ravel()], pa.float64())})

    found = np.zeros(c + c * c)
    for row in fitted.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # c (c + 1) rows
        found[row["at"]] = row["v"] / model.n
    mean = found[:c]
    off = np.abs(found[c:].reshape(c, c) - np.outer(mean, mean) - np.eye(c))[np.ix_(model.positive, model.positive)]
    return float(off.max()) if off.size else None


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 4) -> DataFrame:
    """One row per usable row and component: the id, component, n, deviation, whitened, explained, identity_error."""
    rows = store(quantised(vectors, id_col, vector_col), "quantised")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows, most)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    model, fit_list = fitted
    error, c = identity_error(fit_list, model), model.components
    d = len(model.q)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            known = pc.equal(batch.column(1), d)
            for fits, part in ((True, batch.filter(known)), (False, batch.filter(pc.and_(pc.invert(known), pc.greater(batch.column(1), 0))))):
                m = part.num_rows
                if not m:
                    continue
                if fits:
                    x = unpacked(part.column(2))
                    deviation = np.repeat(np.array(model.deviations(x), object), c).tolist()
                    w = model.whitened(x).ravel()
                    white = pa.array(w, pa.float64(), mask=np.isnan(w))
                else:
                    deviation, white = [None] * (m * c), pa.nulls(m * c, pa.float64())
                yield pa.RecordBatch.from_pydict({
                    id_col: pc.take(part.column(0), pa.array(np.repeat(np.arange(m), c))), "component": pa.array(np.tile(np.arange(1, c + 1), m), pa.int32()),
                    "n": pa.array(np.full(m * c, model.n), pa.int64()), "deviation": pa.array(deviation, pa.int64()), "whitened": white,
                    "explained": pa.array(explained * m, pa.float64()), "identity_error": pa.array([error] * (m * c), pa.float64())})

    return rows.mapInArrow(run, schema)
