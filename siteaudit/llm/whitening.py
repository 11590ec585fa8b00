"""Whitening of embeddings by upper-triangle column aggregates.

Every vector becomes whole numbers x = floor(scale * c) + shift, one column a dimension. One aggregation
gives count, sums and extremes of all columns; a second one, of generated SQL expressions, sums the
centred products of every pair of dimensions i <= j. Columns are centred by the whole number nearest to
their mean, so that products and sums stay whole and no order of rows changes them; what is left of the
centring is taken off exactly on the driver, which holds d(d+3)/2 numbers and no rows. LAPACK decomposes
the covariance. Rows are projected in Arrow batches, and the whitened columns' covariance is summed the
same way and held against the identity.

Sums are 64-bit where count and extremes show that they fit, else decimals of 38 digits. More than
``PAIRS`` pairs take several aggregations, each over its own pairs.

Rows are left out if the vector is null or holds null or non-finite entries, or entries whose x
has no 64-bit value, or if its length is not that of most rows (the longer one on a tie). An empty
vector has no components. A component whose eigenvalue is none (``NONE`` of the trace, or all of it zero)
has null ``whitened``; ``explained`` is null where there is no variance at all. ``deviation`` is
null where it has no 64-bit value. Ties and repeated rows stay rows; an eigenvector's largest entry (the
first of them) is positive. An empty table gives no rows. Columns other than key and vector, whatever
their names, are ignored; a null key stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.llm.common import bound_batches, discard, materialize, tidy

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
PAIRS = 4096
NONE = 1e-14
_WHOLE = 1 << 63


@dataclass(frozen=True)
class Fit:
    """What the fit list says: count, sums a dimension, covariance, eigenvalues (falling) and their
    vectors as columns."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))


def whole_columns(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """``key`` and x0, x1, ... of the rows that count, written, and the number of dimensions."""
    own = rows.select(rows[key].alias("key"), rows[vector].cast("array<double>").alias("v"))
    # a product beyond 2^63 has no whole value: NaN and infinities fail the comparison as well
    fit = own.where("v IS NOT NULL AND forall(v, c -> c IS NOT NULL AND abs(c) < double('Infinity'))")
    fit = fit.where(f"forall(v, c -> abs(c * {scale}D) < {float(_WHOLE - 4096 - abs(shift))}D)")
    lengths = fit.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    xs = [f"CAST(floor(v[{i}] * {scale}D) AS BIGINT) + {shift}L AS x{i}" for i in range(d)]
    return materialize(fit.where(F.size("v") == d).selectExpr("key", *xs), "whole"), d


def _summed(x: DataFrame, expressions: list[str]) -> list[int]:
    """Values of aggregate expressions, so many of them at a time."""
    out: list[int] = []
    for s in range(0, len(expressions), PAIRS):
        row = x.selectExpr(*(f"{e} AS a{i}" for i, e in enumerate(expressions[s : s + PAIRS]))).first()
        out += [int(v) for v in row]
    return out


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def nearest(total: int, n: int) -> int:
    """The whole number nearest to total / n."""
    return (2 * total + n) // (2 * n)


def decompose(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.argmax(np.abs(vectors).round(12), axis=0)
    return values, vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)


def fit(x: DataFrame, d: int) -> Fit | None:
    """Statistics of the columns x0 ... of the fit list; None if it has no rows or no columns."""
    n = x.count()
    if not n or not d:
        return None
    wide = "DECIMAL(38,0)"
    low_high = _summed(x, [f"{f}(x{i})" for i in range(d) for f in ("min", "max")])
    low, high = low_high[::2], low_high[1::2]
    fits = n * max(map(abs, low_high)) < _WHOLE
    sums = _summed(x, [f"sum(x{i})" if fits else f"sum(CAST(x{i} AS {wide}))" for i in range(d)])
    mid = [nearest(s, n) for s in sums]
    reach = [max(hi - m, m - lo) for lo, hi, m in zip(low, high, mid, strict=True)]

    def product(i: int, j: int) -> str:
        if n * max(1, reach[i]) * max(1, reach[j]) < _WHOLE:
            return f"sum((x{i} - {mid[i]}L) * (x{j} - {mid[j]}L))"
        a, b = (f"CAST(CAST(x{k} AS DECIMAL(20,0)) - {mid[k]} AS DECIMAL(19,0))" for k in (i, j))
        return f"sum(CAST({a} * {b} AS {wide}))"

    pairs = _pairs(d)
    products = _summed(x, [product(i, j) for i, j in pairs])
    left = [s - n * m for s, m in zip(sums, mid, strict=True)]  # at most n/2: the mean is left / n beside mid
    covariance = np.empty((d, d))
    for (i, j), p in zip(pairs, products, strict=True):
        covariance[i, j] = covariance[j, i] = (n * p - left[i] * left[j]) / (n * n)
    return Fit(n, sums, covariance, *decompose(covariance))


def project(x: DataFrame, found: Fit, components: int = COMPONENTS) -> DataFrame:
    """``key``, ``deviation`` and whitened components w1, w2, ... of every row of the columns x0 ..."""
    n, sums, d = found.n, found.sums, len(found.sums)
    k = min(components, d)
    mid = [nearest(s, n) for s in sums]
    centre = np.array(mid, np.int64)
    rest = np.array([(s - n * m) / n for s, m in zip(sums, mid, strict=True)])
    there = found.values[:k] > NONE * max(found.trace, 0.0)
    onto = found.vectors[:, :k] / np.sqrt(np.where(there, found.values[:k], 1.0))
    exact = n * n * (2**40) * d < _WHOLE  # while rows stay within 2^20 of the centre
    schema = T.StructType([T.StructField("key", x.schema["key"].dataType), T.StructField("deviation", T.LongType()), *(T.StructField(f"w{c + 1}", T.DoubleType()) for c in range(k))])
    names = schema.names
    left = [s - n * m for s, m in zip(sums, mid, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(d)]) - centre
            if exact and (not off.size or np.abs(off).max() < 2**20 - 1):
                deviation = ((n * off - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
            else:  # numbers of any size
                deviation = [sum((n * v - s) ** 2 for v, s in zip(row, left, strict=True)) for row in off.tolist()]
            whitened = (off - rest) @ onto
            cols = [pa.array(whitened[:, c], pa.float64()) if there[c] else pa.nulls(len(off), pa.float64()) for c in range(k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v if v < _WHOLE else None for v in deviation], pa.int64()), *cols], names)

    bound_batches(x.sparkSession)
    return x.select("key", *(f"x{i}" for i in range(d))).mapInArrow(tidy(run), schema)


def identity_error(whitened: DataFrame, there: list[int]) -> float | None:
    """The largest absolute entry of the covariance of the columns w of ``there``, minus the identity."""
    if not there:
        return None
    means = whitened.agg(*(F.avg(f"w{c}").alias(f"w{c}") for c in there)).first()
    pairs = [(a, b) for i, a in enumerate(there) for b in there[i:]]
    sums = whitened.selectExpr(*(f"avg((w{a} - ({means[f'w{a}']!r}D)) * (w{b} - ({means[f'w{b}']!r}D))) AS a{i}" for i, (a, b) in enumerate(pairs))).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(sums, pairs, strict=True))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each row that counts and each of its first ``components`` components: ``key``, component,
    n, deviation, whitened, explained and identity_error."""
    x, d = whole_columns(rows, key, vector, scale, shift)
    found = fit(x, d)
    kind = rows.schema[key].dataType.simpleString()
    if found is None:
        discard(x)
        empty = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty).withColumnRenamed("key", key)
    whitened = materialize(project(x, found, components), "whitened")
    discard(x)
    k = min(components, d)
    error = identity_error(whitened, [c + 1 for c in range(k) if found.values[c] > NONE * max(found.trace, 0.0)])
    each = [
        F.struct(F.lit(c + 1).alias("component"), F.col(f"w{c + 1}").alias("whitened"), F.lit(float(found.values[c]) / found.trace if found.trace > 0 else None).cast("double").alias("explained"))
        for c in range(k)
    ]
    long = whitened.select("key", "deviation", F.explode(F.array(*each)).alias("c"))
    return long.select(F.col("key").alias(key), F.col("c.component").cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
