"""Embedding whitening from variances alone (polarisation).

Entries become integers, ``x = floor(scale * c) + shift``. Every dimension and
every sum of two dimensions has a variance; a covariance is half of what the
variance of a sum exceeds the two variances by. All sums are exact integers:
vectors are centred at the integer part of the mean before they are squared,
and the remainder of the mean is taken out of the totals. Tasks send one total
for each dimension and pair; the driver holds ``d * (d + 1) / 2`` integers,
whatever the number of vectors, builds the covariance as correctly rounded
ratios and takes its eigenvectors.
"""
from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm._store import stored

SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues below this share of the largest are rounding, not variance.
RANK_SHARE = 1e-10
_ROWS = 1024


def usable(vector: Column) -> Column:
    """Neither the vector nor an entry is null, NaN or infinite, and there is an entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def as_integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + shift)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equally long rows as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return values.reshape(len(column), -1)


def _exact(y: np.ndarray, factor: int = 1) -> np.ndarray:
    """``y`` in 64 bits where ``factor`` times a square of its largest entry fits, else in Python integers."""
    most = int(max(-int(y.min()), int(y.max()), 0)) if y.size else 0
    return y if factor * most * most < 2**62 else y.astype(object)


def _totals(rows: DataFrame, per_batch, width: int) -> list[int]:
    """Sums of ``per_batch(matrix)`` (``width`` exact integers) over all batches of the list column of ``rows``."""
    def add(batches):
        held = [0] * width
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                for k, v in enumerate(per_batch(_matrix(batch.column(0).slice(lo, _ROWS)))):
                    held[k] += int(v)
        if any(held):
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(v) for v in held], pa.decimal128(38, 0))], ["k", "v"])

    sums = rows.mapInArrow(add, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").cast("string").alias("v"))
    out = [0] * width
    for r in sums.collect():
        out[r["k"]] = int(r["v"])
    return out


@dataclass
class Whitening:
    """Fit of :func:`fit`: ``mean`` as integer part and remainder over ``n``, components as columns, their eigenvalues."""

    n: int
    whole: list[int]
    rest: list[int]
    covariance: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of integer vectors (rows)."""
        y = (x - np.array(self.whole, np.int64)).astype(np.float64) - np.array(self.rest, np.float64) / self.n
        return (y @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sum over the dimensions of ``(n * x - S) ** 2`` for each row."""
        y = x - np.array(self.whole, np.int64)
        most = int(np.abs(y).max(initial=0)) + 1
        if x.shape[1] * (self.n * most) ** 2 < 2**62:
            d = self.n * y - np.array(self.rest, np.int64)
        else:
            d = self.n * y.astype(object) - np.array(self.rest, dtype=object)
        return [int(v) for v in (d * d).sum(axis=1)]


def polarised(n: int, rest: list[int], own: list[int], pairs: list[int]) -> np.ndarray:
    """Covariance (divisor ``n``) from the sums of squares of each dimension and of each pair's sum.

    The values were centred at the integer part of their mean; ``rest`` are
    the sums of what is left. Each entry is one division of exact integers.
    """
    d = len(own)
    around = [n * s - r * r for s, r in zip(own, rest)]
    out = np.empty((d, d))
    at = 0
    for i in range(d):
        out[i, i] = around[i] / (n * n)
        for j in range(i + 1, d):
            both = n * pairs[at] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - around[i] - around[j]) / (2 * n * n)
            at += 1
    return out


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """Whitening of the distinct rows of the one list column of ``vectors``; None without rows."""
    first = vectors.limit(1).collect()
    if not first:
        return None
    d = len(first[0][0])
    *sums, n = _totals(vectors, lambda x: [*_exact(x).sum(axis=0), len(x)], d + 1)
    whole = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole)]
    centre = np.array(whole, np.int64)

    def squares(x):
        y = _exact(x - centre, 4 * len(x))
        out = [(y * y).sum(axis=0)]
        for i in range(d - 1):
            both = y[:, i + 1:] + y[:, i:i + 1]
            out.append((both * both).sum(axis=0))
        return np.concatenate(out)

    totals = _totals(vectors, squares, d * (d + 1) // 2)
    covariance = polarised(n, rest, totals[:d], totals[d:])
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1]
    values, axes = values[order], axes[:, order]
    real = int((values > RANK_SHARE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    top = min(components, real)
    model = Whitening(n, whole, rest, covariance, axes[:, :top], values[:top])
    model.identity_error = _identity_error(vectors, model)
    return model


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit vectors' covariance less the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def gather(batches):
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                z = shared.value.project(_matrix(batch.column(0).slice(lo, _ROWS)))
                products += z.T @ z
                sums += z.sum(axis=0)
        flat = np.concatenate([products.ravel(), sums])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["k", "v"])

    flat = np.zeros(k * k + k)
    for r in vectors.mapInArrow(gather, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        flat[r["k"]] = r["v"]
    mean = flat[k * k:] / model.n
    return float(np.abs(flat[:k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error, deviation_wide)``: a row for each vector and component.

    Rows whose vector is null, empty, or holds null, NaN or infinite entries
    are dropped; so are vectors of another length than most have (of equally
    frequent lengths the largest counts). The fit takes each distinct integer
    vector once, so repeated rows don't weigh more; every row is projected.
    Components without variance do not exist: where all vectors are equal, or
    there are none, no rows come out. A null id stays null, and columns
    beside the two are not read, so they may have any name. ``deviation`` is null where the exact sum passes a long;
    ``deviation_wide`` has it always. An entry beyond a long's range raises.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    lengths = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    fitted = base.where(F.size("v") == d).select("id", as_integers(F.col("v"), scale, shift).alias("x"))
    model = fit(stored(fitted.select("x").distinct(), "whitening-fit"), components) if lengths else None
    id_type = base.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, {SCHEMA}"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(model)
    k = len(model.values)
    explained = model.values / np.trace(model.covariance)

    def project(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                ids, x = batch.column(0).slice(lo, _ROWS), _matrix(batch.column(1).slice(lo, _ROWS))
                n = len(x)
                each = pa.array(np.repeat(np.arange(n), k))
                wide = m.deviations(x)
                yield pa.RecordBatch.from_arrays([
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m.n, np.int64)),
                    pa.array([v if v < 2**63 else None for v in wide], pa.int64()).take(each), pa.array(m.project(x).ravel()),
                    pa.array(np.tile(explained, n)), pa.array(np.full(n * k, m.identity_error)),
                    pa.array([Decimal(v) for v in wide], pa.decimal128(38, 0)).take(each)],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"])

    return fitted.mapInArrow(project, schema).withColumnRenamed("id", id_col)
