"""Relational glue: anti-joins, keyed lookups, fan-out, resume, first-N."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import is_blank


def nonblank(df: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` is non-null and not only blanks."""
    return df.filter(~is_blank(F.col(col)))


def unannotated(notes: DataFrame, annotated: DataFrame, key: str = "pn_num",
                text: str = "pn_history") -> DataFrame:
    """Notes never annotated (``left_anti``), with a non-blank text."""
    return nonblank(notes.join(annotated.select(key), key, "left_anti"), text)


def dedupe_last(df: DataFrame, keys: list[str], order: str, value_cols: list[str]) -> DataFrame:
    """One row per key keeping the values of the row with the largest ``order``
    (a dict built row by row keeps the last duplicate)."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.col(order)).alias(c) for c in value_cols])


def lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, default="") -> DataFrame:
    """Left join one value by key with a default for misses (``dict.get(k, '')``)."""
    r = right.select(*keys, F.col(value).alias("_v"))
    return left.join(r, keys, "left").withColumn(value, F.coalesce(F.col("_v"), F.lit(default))).drop("_v")


def case_fanout(notes: DataFrame, features: DataFrame, case: str = "case_num") -> DataFrame:
    """Each note with every feature of its case (equi-join, no cartesian product)."""
    return notes.join(features, case)


def resume(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Work still to do: ``todo`` rows whose key is not in the ``done`` table."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def head_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` rows by an explicit order (file order is not a contract)."""
    return df.orderBy(*order).limit(int(n))
