"""Prefix aggregates over long series without a task that holds a whole series."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FOLD = {"min": F.min, "max": F.max, "sum": F.sum}


def _joined(kind: str, a: Column, b: Column) -> Column:
    """Aggregates of two parts as one of both (null: an empty part)."""
    if kind == "sum":
        return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.least(a, b) if kind == "min" else F.greatest(a, b)


def prefix_scan(df: DataFrame, by: list[str], order: str, folds: dict[str, tuple[str, str]], size: int = 1 << 14, levels: int = 3) -> DataFrame:
    """``df`` with, for each ``name: (kind, column)`` of ``folds``, that aggregate over all earlier rows of the series.

    ``order`` numbers the rows of a series (distinct, 0 or more, gaps
    allowed), below ``size ** levels``. The series is cut into blocks of
    ``size`` numbers; each block is one row for the level above, which gets
    its own prefix the same way and is joined back. So a window never holds
    more than ``size`` rows, whatever the length of the series. ``df`` is read twice a
    level: hand in a table, not a costly plan. The first row has nulls.
    """
    at = f"_block{levels}"
    cut = df.withColumn(at, F.floor(F.col(order) / size).cast("bigint"))
    own = Window.partitionBy(*by, at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = {name: _FOLD[kind](col).over(own) for name, (kind, col) in folds.items()}
    if levels == 1:
        checked = F.when(F.col(at) == 0, F.col(at)).otherwise(F.raise_error(F.lit(f"{order} is too large: more levels are needed")))
        return cut.withColumn(at, checked.cast("bigint")).withColumns(inside).drop(at)
    totals = cut.groupBy(*by, at).agg(*(_FOLD[kind](col).alias(name) for name, (kind, col) in folds.items()))
    totals = totals.withColumnsRenamed({n: f"_{n}_total" for n in folds})
    above = prefix_scan(totals, by, at, {n: (kind, f"_{n}_total") for n, (kind, _) in folds.items()}, size, levels - 1)
    above = above.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col(at).alias("_of"),
                         *(F.col(n).alias(f"_{n}_above") for n in folds))
    on = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)] + [F.col(at) == F.col("_of")]
    met = cut.withColumns(inside).join(above, on)
    for name, (kind, _) in folds.items():
        met = met.withColumn(name, _joined(kind, F.col(f"_{name}_above"), F.col(name)))
    return met.drop(at, "_of", *(f"_by{i}" for i in range(len(by))), *(f"_{n}_above" for n in folds))
