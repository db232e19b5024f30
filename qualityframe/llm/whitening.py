"""Whitening of embeddings: covariance eigenvectors by spectrum slicing.

Method. Entries c become whole numbers x = floor(64 c) + 1000000; the fit list holds each
different x-vector once. Spark sums it exactly, then sums products centred on the exact
mean. The leading eigenvalues of the covariance V are sliced apart on the driver, which
holds V only (dimension squared): the LDL' factorization of V - sI, with one and two wide
pivots, has as many positive pivots as V has eigenvalues above s, so bisection of s ends
in intervals with one eigenvalue each. Inverse iteration enters an interval, Rayleigh
quotient iteration converges cubically inside it, and the counts on both sides of the
result certify its number. Eigenvalues closer than rounding stay together and share an
orthonormal basis.

Equal vectors meet in a group by packed bytes, summed up by task first, so a vector that
fills a third of the table is one row to a task. Products are summed in a task, one matrix
row a record, and added per matrix row.

Defined cases: rows without a usable vector (null, a null or non-finite entry, a length
other than `dimension`, by default the commonest, ties to the longer) are left out;
|64 c| beyond 2^53 counts as 2^53; null ids and repeated rows keep their rows; without
rows there is no result; a component whose eigenvalue is zero to rounding has a null
`whitened` and explains 0; a deviation that no long can hold is null; there are at most
as many components as dimensions; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

STEPS = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = 1 << 53
CELLS_AT_ONCE = 1 << 20
LONG = 1 << 62
PIVOT = (1 + sqrt(17)) / 8
EPS = float(np.finfo(float).eps)


# ---- vectors as whole numbers -------------------------------------------------------


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest length of a vector, the longer one of equally common."""
    sizes = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count()
    first = sizes.orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return first.d if first else 0


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are usable, and those as doubles, one a row."""
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width) if width else np.empty(0, np.int64)
    flat = column.take(pa.array(rows)).flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), width)
    good = np.isfinite(values).all(axis=1)
    return rows[good], values[good]


def grid(values: np.ndarray) -> np.ndarray:
    """x - 1000000 of each entry."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * STEPS), -LARGEST, LARGEST).astype(np.int64)


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row's bytes in the narrowest whole numbers that hold it."""
    widest = np.abs(rows).max(axis=1, initial=0)
    out = [b""] * len(rows)
    for kind, least, most in ((np.int8, -1, 1 << 7), (np.int16, 1 << 7, 1 << 15), (np.int64, 1 << 15, 1 << 62)):
        at = np.flatnonzero((widest >= least) & (widest < most))
        for i, row in zip(at.tolist(), rows[at].astype(kind)):
            out[i] = row.tobytes()
    return out


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(rows), width), np.int64)
    sizes = np.array([len(r) // width for r in rows])
    for kind in (np.int8, np.int16, np.int64):
        at = np.flatnonzero(sizes == kind().itemsize)
        out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(len(at), width)
    return out


def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of vector entries."""
    rows = max(1, CELLS_AT_ONCE // max(1, width))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def fit_list(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Each different x-vector once, packed, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width):
            rows = packed(grid(matrix(batch.column(0), width)[1]))
            yield pa.RecordBatch.from_pydict({"x": pa.array(rows, pa.binary())})

    doubles = df.select(F.col(vector).cast("array<double>").alias("v"))
    return stored(doubles.mapInArrow(run, "x binary").distinct(), "fit-list")


# ---- sums over the fit list ---------------------------------------------------------


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of x - 1000000 in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in slices(batches, width):
            rows = unpacked(batch.column(0).to_pylist(), width)
            exact = rows if np.abs(rows).max(initial=0) * len(rows) < LONG else rows.astype(object)
            total = [a + int(b) for a, b in zip(total, exact.sum(axis=0))]
            n += len(rows)
        kind = pa.decimal128(38, 0)
        sums = pa.array([n, *total], pa.int64() if max(map(abs, [n, *total])) < LONG else kind).cast(kind)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, width), pa.int32()), "s": sums})

    parts = fit.mapInArrow(run, "i int, s decimal(38,0)")
    found = {i: int(s) for i, s in parts.groupBy("i").agg(F.sum("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n without cancellation: whole parts are subtracted as whole numbers."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - n * r) / n for s, r in zip(sums, near)])
    return (rows - np.array(near, np.int64)).astype(np.float64) - rest


def products(fit: DataFrame, width: int, n: int, sums: list[int], onto: np.ndarray | None = None) -> np.ndarray:
    """The covariance of the fit list, or of its projection `onto` some columns."""
    size = width if onto is None else onto.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in slices(batches, width):
            rows = centred(unpacked(batch.column(0).to_pylist(), width), n, sums)
            rows = rows if onto is None else rows @ onto
            total += rows.T @ rows
        cells = [row.tobytes() for row in total]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "cells": cells})

    def add(rows: pa.Table) -> pa.Table:
        parts = np.frombuffer(b"".join(rows.column("cells").to_pylist())).reshape(-1, size)
        total = [parts.sum(axis=0).tobytes()]
        return pa.table({"i": rows.column("i").slice(0, 1), "cells": pa.array(total, pa.binary())})

    kind = "i int, cells binary"
    rows = fit.mapInArrow(run, kind).groupBy("i").applyInArrow(add, kind).collect()
    total = np.array([np.frombuffer(cells) for _, cells in sorted(rows, key=lambda r: r.i)])
    return (total + total.T) / (2 * n) if len(total) else np.zeros((size, size))


# ---- spectrum slicing ---------------------------------------------------------------


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric `v` exceed `shift`: positive pivots of the
    LDL' factorization of v - shift I with full symmetric pivoting."""
    w = v - shift * np.eye(len(v))
    positive = 0
    while len(w):
        size = len(w)
        diagonal = np.abs(w.diagonal())
        k = int(diagonal.argmax())
        off = np.abs(w)
        np.fill_diagonal(off, 0)
        i, j = divmod(int(off.argmax()), size)
        if diagonal[k] >= PIVOT * off[i, j]:
            if not diagonal[k]:
                break  # what is left is zero
            chosen = [k]
            positive += bool(w[k, k] > 0)
        else:
            chosen = [i, j]  # its determinant is negative: one pivot of each sign
            positive += 1
        left = np.delete(np.arange(size), chosen)
        border = w[np.ix_(left, chosen)]
        block = w[np.ix_(chosen, chosen)]
        w = w[np.ix_(left, left)] - border @ np.linalg.solve(block, border.T)
        w = (w + w.T) / 2
    return positive


def isolated(v: np.ndarray, wanted: int, top: float, width: float) -> Iterator[tuple[float, float, int, int]]:
    """Intervals (low, high, first, last) from the top: the eigenvalues numbered first to
    last lie inside; more than one only if the interval is narrower than `width`."""
    waiting = [(-width, top, len(v), 0)]
    while waiting:
        low, high, below, over = waiting.pop()
        if below == over or over >= wanted:
            continue
        if below - over == 1 or high - low <= width:
            yield low, high, over + 1, below
            continue
        middle = (low + high) / 2
        count = above(v, middle)
        waiting += [(low, middle, below, count), (middle, high, count, over)]


def solved(v: np.ndarray, shift: float, vectors: np.ndarray, nudge: float) -> np.ndarray:
    """One step of inverse iteration, orthonormal."""
    while True:
        try:
            out = np.linalg.solve(v - shift * np.eye(len(v)), vectors)
        except np.linalg.LinAlgError:
            out = np.full_like(vectors, np.inf)
        if np.isfinite(out).all():
            return np.linalg.qr(out)[0]
        shift += nudge
        nudge *= 2


def settled(v: np.ndarray, low: float, high: float, start: np.ndarray, noise: float) -> tuple[float, np.ndarray]:
    """The one eigenpair inside (low, high): the interval is halved by counts until
    Rayleigh quotient iteration from its middle ends inside."""
    over = above(v, high)
    while True:
        x = start
        for _ in range(2):
            x = solved(v, (low + high) / 2, x, noise)
        best = None
        for _ in range(12):
            e = float(x[:, 0] @ v @ x[:, 0])
            miss = float(np.linalg.norm(v @ x - e * x))
            if best is not None and miss >= best[2]:
                break
            best = (e, x, miss)
            x = solved(v, e, x, noise)
        e, x, miss = best
        if (low - noise <= e <= high + noise and miss <= 16 * noise) or high - low <= noise / 4:
            return e, x[:, 0]
        middle = (low + high) / 2
        low, high = (middle, high) if above(v, middle) > over else (low, middle)


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    size = len(v)
    wanted = min(wanted, size)
    top = min(float(np.trace(v)), float(np.abs(v).sum(axis=1).max(initial=0)))
    if not size or top <= 0:
        return np.zeros(wanted), np.eye(size)[:, :wanted]
    noise = size * EPS * top
    start = np.random.default_rng(size).standard_normal((size, size))
    values: list[float] = []
    columns: list[np.ndarray] = []
    for low, high, first, last in isolated(v, wanted, top + noise, 4 * noise):
        if first == last:
            e, x = settled(v, low, high, start[:, :1], noise)
            found = [(e, x)]
        else:
            x = start[:, : last - first + 1]
            for _ in range(4):
                x = solved(v, (low + high) / 2, x, noise)
            turned = x.T @ v @ x
            found = sorted(((float(turned[i, i]), x[:, i]) for i in range(x.shape[1])), key=lambda p: -p[0])
        edge = 32 * noise
        if above(v, found[0][0] + edge) > first - 1 or above(v, found[-1][0] - edge) < last:
            raise ArithmeticError(f"eigenvalues {first} to {last} are not certified by their counts")
        for e, x in found:
            for other in columns:
                x = x - other * (other @ x)
            values.append(e)
            columns.append(x / np.linalg.norm(x))
    return np.array(values[:wanted]), np.column_stack(columns[:wanted])


# ---- the operator -------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A fitted whitening: `vectors` has one unit eigenvector a column."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    @property
    def scales(self) -> np.ndarray:
        """Columns that take a centred vector to its whitened entries; zero where none is."""
        tiny = len(self.sums) * EPS * self.trace * 64
        kept = self.values > tiny
        return self.vectors * np.where(kept, 1 / np.sqrt(np.where(kept, self.values, 1)), 0)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if s else 0.0 for e, s in zip(self.values, self.scales.any(axis=0))]


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, width: int | None = None) -> Model:
    """Fit on every different vector of the table."""
    width = dimension(df, vector) if width is None else width
    rows = fit_list(df, vector, width)
    n, sums = exact_sums(rows, width)
    if not n:
        return Model(0, sums, np.empty(0), np.empty((width, 0)), 0.0, 0.0)
    v = products(rows, width, n, sums)
    values, vectors = leading(v, components)
    model = Model(n, sums, values, vectors, float(np.trace(v)), 0.0)
    onto = model.scales[:, model.scales.any(axis=0)]
    error = 0.0
    if onto.shape[1]:
        error = float(np.abs(products(rows, width, n, sums, onto) - np.eye(onto.shape[1])).max())
    discard(rows)
    return Model(n, sums, values, vectors, model.trace, error)


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of every row, exact; null where no long can hold it."""
    far = float(np.abs(rows).max(initial=0)) * n + max(map(abs, sums), default=0)
    if far * far * max(1, len(sums)) < LONG:
        return ((rows * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((rows.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(d) if d < 1 << 63 else None for d in exact]


def whitened(df: DataFrame, model: Model, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, deviation and the whitened entries of every usable vector."""
    width, scales = len(model.sums), model.scales
    empty = ~scales.any(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width):
            at, values = matrix(batch.column(1), width)
            if not model.n or not len(at):
                continue
            rows = grid(values)
            out = centred(rows, model.n, model.sums) @ scales
            flat = pa.array(out.ravel(), mask=np.tile(empty, len(out)))
            ends = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
            made = [pa.array(deviations(rows, model.n, model.sums), pa.int64()), pa.ListArray.from_arrays(ends, flat)]
            keys = batch.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([keys, *made], ["key", "deviation", "whitened"])

    read = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    kind = df.schema[key].dataType.simpleString()
    out = read.mapInArrow(run, f"key {kind}, deviation long, whitened array<double>")
    return out.withColumnRenamed("key", key)


def op12(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    model = fit(vectors, "embedding", components)
    share = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    rows = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("i") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("i")).alias("explained"),
        F.lit(model.error).alias("identity_error"),
    )
