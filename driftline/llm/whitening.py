"""Whitening of embeddings by an exact covariance.

Entries c become whole numbers x = floor(scale * c) + offset. Over the fit list
(every distinct x vector once; n vectors, sums S) each task centres a block of rows
exactly, y = n * x - S, splits y into limbs of LIMB bits and multiplies the limbs'
matrices with float64 BLAS: a product of two limbs summed over a block stays below
2^53, so every one is exact. Products of equal shift are added as 64-bit numbers,
recombined as big integers at the end of a task, and cut into 32-bit digits that
Spark sums up by (i, j, digit). The driver gets one d x d matrix of whole numbers
M = sum of y y', of which V = M / n^3 is the covariance, and decomposes it. The
decomposition is refined in fixed point with the same exact products, so the
eigenvectors are right to double precision even where eigenvalues lie close.

Whitened values are (x - S / n) projected on a component over sqrt(e). Their
covariance over the fit list is summed up in a pass of its own, and its largest
distance from the identity is returned with every row.

Defined cases: rows whose vector is null, or holds a null or an entry that is not
finite, are dropped; repeated rows stay and count once in the fit list; a null key
is carried; vectors of each width are whitened among themselves (n, S and V are
those of their width), and an empty vector has no components; a component without
variance (e at most d * 2^-52 of the largest one) can't be whitened and is left
out; an entry of 2^56 or more is an error, since x would not fit 64 bits;
``deviation`` is null where 38 decimal digits do not hold it; an empty table gives
an empty result. Other columns are carried; one with the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from .names import fresh

#: Bits of a limb and rows of a block: 2 * 20 + 11 bits at most, and float64 holds 53.
LIMB, ROWS = 20, 1 << 11
#: Blocks added up as 64-bit numbers before they become big integers, and bits of the digits that Spark sums up.
HELD, DIGIT = 1 << 9, 32
#: Fractional bits of the refinement and its rounds (each doubles the right digits).
POINT, ROUNDS = 120, 3
RESULT = "n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed whole numbers (int64 or Python's) as float64 matrices, y = sum of limb k * 2^(k * LIMB); only the last one is signed."""
    out = []
    while y.size and (y.max() >= 1 << LIMB or y.min() < -(1 << LIMB)):
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


def products(left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
    """left' @ right by shift: int64 matrices of which entry s counts 2^(s * LIMB) times. At most ROWS rows."""
    out = [np.int64(0)] * (len(left) + len(right) - 1)
    for k, a in enumerate(left):
        for m, b in enumerate(right):
            out[k + m] = out[k + m] + (a.T @ b).astype(np.int64)
    return out


def recombined(by_shift: list[np.ndarray]) -> np.ndarray:
    return sum(g.astype(object) << (s * LIMB) for s, g in enumerate(by_shift))


def multiplied(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right of matrices of Python's whole numbers, exactly."""
    blocks = range(0, left.shape[1], ROWS)
    return sum(recombined(products(limbs(left[:, lo : lo + ROWS].T), limbs(right[lo : lo + ROWS]))) for lo in blocks)


class Gram:
    """Running sum of y' y over blocks of rows."""

    def __init__(self, width: int):
        self.held, self.blocks, self.total = [], 0, np.zeros((width, width), object)

    def add(self, y: np.ndarray) -> None:
        parts = limbs(y)
        for s, g in enumerate(products(parts, parts)):
            if s < len(self.held):
                self.held[s] = self.held[s] + g
            else:
                self.held.append(g)
        self.blocks += 1
        if self.blocks % HELD == 0:
            self.value()

    def value(self) -> np.ndarray:
        if self.held:
            self.total, self.held = self.total + recombined(self.held), []
        return self.total


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, as int64 where that holds it."""
    if not x.size:
        return x
    middle = np.array([s // n for s in sums], object)
    rest = sums - n * middle  # below n
    if max(map(abs, middle)) < 1 << 62:
        z = x - middle.astype(np.int64) if np.abs(x).max() < 1 << 62 else x.astype(object) - middle
        if max(abs(int(z.max())), abs(int(z.min()))) * n + n < 1 << 62:
            return z.astype(np.int64) * np.int64(n) - rest.astype(np.int64)
    return (x.astype(object) - middle) * n - rest


def blocks_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their matrix) for each width of a list column, at most ROWS at a time."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    width = np.diff(offsets)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for lo in range(0, len(rows), ROWS):
            part = rows[lo : lo + ROWS]
            yield part, flat[(offsets[part][:, None] + np.arange(w)).ravel()].reshape(len(part), w)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for _, x in blocks_of(batch.column(0)):
            if x.shape[1]:
                yield x.shape[1], x


def _digits(width: int, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(width, i, j, digit, value): big integers as sums of value * 2^(digit * DIGIT), the last digit signed."""
    for digit in range(1 << 16):
        last = all(-(1 << DIGIT) <= v < 1 << DIGIT for v in value)
        own = value if last else value & ((1 << DIGIT) - 1)
        columns = [np.full(len(i), width), i, j, np.full(len(i), digit), own.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["width", "i", "j", "digit", "value"])
        if last:
            return
        value = value >> DIGIT


def _summed(df: DataFrame, task) -> dict[int, dict[tuple[int, int], int]]:
    """For each width {(i, j): sum of the tasks' big integers}."""
    digits = df.mapInArrow(task, "width long, i long, j long, digit long, value long")
    out: dict[int, dict[tuple[int, int], int]] = {}
    for batch in digits.groupBy("width", "i", "j", "digit").agg(F.sum("value").alias("value")).toArrow().to_batches():
        for w, i, j, digit, value in zip(*(c.to_pylist() for c in batch.columns)):
            own = out.setdefault(w, {})
            own[i, j] = own.get((i, j), 0) + (value << (digit * DIGIT))
    return out


def _sums(batches):
    found: dict[int, np.ndarray] = {}
    for w, x in _matrices(batches):
        low, high = (x & ((1 << DIGIT) - 1)).sum(0), (x >> DIGIT).sum(0)
        own = np.concatenate([low.astype(object) + (high.astype(object) << DIGIT), [len(x)]])
        found[w] = found[w] + own if w in found else own
    for w, total in found.items():  # entry w is the number of rows
        yield from _digits(w, np.arange(w + 1), np.zeros(w + 1, np.int64), total)


def _grams(lists: dict[int, tuple[int, np.ndarray]]):
    def task(batches):
        found: dict[int, Gram] = {}
        for w, x in _matrices(batches):
            found.setdefault(w, Gram(w)).add(centred(x, *lists[w]))
        for w, gram in found.items():
            i, j = np.triu_indices(w)
            yield from _digits(w, i, j, gram.value()[i, j])

    return task


@dataclass(frozen=True)
class Whitening:
    """What turns the vectors of one width into whitened ones."""

    n: int
    sums: np.ndarray  # of the fit list's x, Python's whole numbers
    values: np.ndarray  # eigenvalues of the components kept
    vectors: np.ndarray  # their unit eigenvectors, one a column
    explained: np.ndarray
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened rows, and the exact sum of (n * x - S)^2 of each row."""
        y = centred(x, self.n, self.sums)
        small = y.dtype == np.int64 and (not y.size or max(int(y.max()), -int(y.min())) ** 2 * y.shape[1] < 1 << 63)
        deviation = (y * y if small else y.astype(object) ** 2).sum(1)
        return (y / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values), deviation


def decomposed(m: np.ndarray, n: int, sums: np.ndarray, components: int) -> Whitening:
    """Of V = m / n^3, from whole numbers; eigenpairs are refined until they are right to double precision."""
    d, trace, one = len(m), int(sum(m.diagonal())), 1 << POINT
    if trace == 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), np.zeros(0))
    a = (m * one) // trace  # eigenvalues of a sum to one
    fixed = lambda f: np.vectorize(lambda v: int(np.ldexp(v, 62)) << (POINT - 62), otypes=[object])(f)
    real = lambda f: (f / one).astype(np.float64)
    x, eye = fixed(np.linalg.eigh(real(a))[1][:, ::-1]), np.zeros((d, d), object)
    eye[np.diag_indices(d)] = one
    for _ in range(ROUNDS):  # E solves the first-order equations of A (X + X E) = (X + X E) D and orthogonality
        r = eye - (multiplied(x.T, x) >> POINT)
        s = multiplied(x.T, multiplied(a, x) >> POINT) >> POINT
        value = (s.diagonal() * one) // (one - r.diagonal())
        off = real(s + ((r * value[None, :]) >> POINT))
        np.fill_diagonal(off, 0)
        gap = real(value[None, :] - value[:, None])
        near = np.abs(gap) <= 2 * (np.abs(off).max() + np.abs(real(r)).max())
        e = np.where(near, real(r) / 2, off / np.where(near, 1, gap))
        x = x + fixed(real(x) @ e)
    order = sorted(range(d), key=lambda k: -value[k])
    kept = [k for k in order[:components] if value[k] > 0 and value[k] / value[order[0]] > d * 2.0**-52]
    values = np.array([(int(value[k]) * trace) / (one * n**3) for k in kept])
    return Whitening(n, sums, values, real(x)[:, kept], real(value[kept]))


def _covariances(fits: dict[int, Whitening]):
    def task(batches):
        found: dict[int, np.ndarray] = {}
        for w, x in _matrices(batches):
            z = fits[w].apply(x)[0]
            found[w] = found.get(w, 0) + z.T @ z
        for w, total in found.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), w)), pa.array(i), pa.array(j), pa.array(total.ravel())], ["width", "i", "j", "value"])

    return task


def fit(x: DataFrame, components: int = 16) -> dict[int, Whitening]:
    """Whitenings by width from a stored fit list (one array column of longs, rows distinct)."""
    lists = {}
    for w, found in _summed(x, _sums).items():
        lists[w] = found[w, 0], np.array([found[k, 0] for k in range(w)], object)
    fits = {}
    for w, found in _summed(x, _grams(lists)).items():
        m = np.zeros((w, w), object)
        for (i, j), value in found.items():
            m[i, j] = m[j, i] = value
        fits[w] = decomposed(m, *lists[w], components)
    errors = {w: np.zeros((len(f.values),) * 2) for w, f in fits.items()}
    # whitened values are centred: the sum of n * x - S over the fit list is zero
    for row in x.mapInArrow(_covariances(fits), "width long, i long, j long, value double").groupBy("width", "i", "j").agg(F.sum("value").alias("value")).toArrow().to_pylist():
        errors[row["width"]][row["i"], row["j"]] = row["value"] / fits[row["width"]].n
    worst = {w: float(np.abs(e - np.eye(len(e))).max()) if len(e) else 0.0 for w, e in errors.items()}
    return {w: Whitening(f.n, f.sums, f.values, f.vectors, f.explained, worst[w]) for w, f in fits.items()}


def _applied(spark: SparkSession, fits: dict[int, Whitening], schema: pa.Schema):
    model = spark.sparkContext.broadcast(fits)  # a d x d problem's components, whatever the number of rows

    def task(batches):
        for batch in batches:
            size = batch.num_rows
            found = [[None] * size for _ in range(5)]
            for rows, x in blocks_of(batch.column(batch.num_columns - 1)):
                f = model.value.get(x.shape[1])
                if f is None:  # vectors without entries
                    continue
                white, deviation = f.apply(x)
                explained = f.explained.tolist()
                for at, w, dev in zip(rows.tolist(), white.tolist(), deviation.tolist()):
                    for column, v in zip(found, (f.n, dev if dev < 10**38 else None, w, explained, f.identity_error)):
                        column[at] = v
            kinds = [pa.int64(), pa.decimal128(38, 0), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], ["n", "deviation", "whitened", "explained", "identity_error"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=schema)

    return task


def whole_vectors(df: DataFrame, vector: str, scale: int, offset: int, out: str) -> DataFrame:
    """``df`` with the vector's whole numbers in ``out``, without rows that have none."""
    column = F.col(f"`{vector}`")
    sound = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    number = lambda c: F.when(F.abs(c) < float(1 << 56), F.floor(c * scale) + offset).otherwise(F.raise_error(F.lit("an entry does not fit 64 bits")).cast("long"))
    return df.filter(column.isNotNull() & F.coalesce(sound, F.lit(False))).withColumn(out, F.transform(column.cast("array<double>"), number))


def whiten(df: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, vector: str = "embedding", out: str = "white") -> DataFrame:
    """``df`` without unusable rows and with ``out``: struct of n, deviation, whitened and explained (an entry for each component), identity_error."""
    spark = df.sparkSession
    df = df.drop(out) if out != vector else df
    (x,) = fresh(df, "whole")
    rows = whole_vectors(df, vector, scale, offset, x)
    fits = fit(stored(rows.select(x).distinct(), "fit-list"), components)
    kept = [f for f in rows.schema.fields[:-1] if f.name != out]
    plain = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)]  # names with dots do not pass through mapInArrow
    schema = T.StructType([*plain, T.StructField(out, T.StructType.fromDDL(RESULT))])
    rows = rows.select(*[F.col(f"`{f.name}`").alias(p.name) for f, p in zip(kept, plain)], x)
    return rows.mapInArrow(_applied(spark, fits, schema.names), schema).toDF(*[f.name for f in kept], out)
