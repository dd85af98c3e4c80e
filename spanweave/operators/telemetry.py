"""Training and benchmark telemetry analytics (batch).

A training log is a long table ``run, step, wall_time, tag, value``; the
operators here pivot it, summarise series per run, find best and last
values, early-stopping points, normalised comparison matrices and timing.
Every operator takes an explicit order column: file order is never assumed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.scan import prefix_scan
from spanweave.session import unique_dir
from spanweave.sources.files import materialize_once

# Fixed mapping of the driver's event types onto training-log tags.
TAG_OF_EVENT = {"view": "loss", "click": "eval_loss", "purchase": "grad_norm", "signup": "learning_rate",
                "error": "eval_runtime"}
TAGS = ["loss", "eval_loss", "grad_norm", "learning_rate", "eval_runtime"]


def tag_expr(event_type: Column) -> Column:
    e = None
    for k, v in TAG_OF_EVENT.items():
        e = (F.when(event_type == k, F.lit(v)) if e is None else e.when(event_type == k, F.lit(v)))
    return e


def training_log(events: DataFrame, n_runs: int = 8) -> DataFrame:
    """Events as a sparse training log: one metric per row, ``step`` numbered per run by time.

    A run may hold any share of the rows, so it is numbered by hours: rows
    within an hour by a window, plus the count of all hours before (a table
    of runs and hours).
    """
    ev = events.select(
        F.concat(F.lit("run"), F.pmod("user_id", F.lit(n_runs)).cast("string")).alias("run"),
        "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("wall_time"),
        tag_expr(F.col("event_type")).alias("tag"), F.col("value"), F.col("props"))
    ev = ev.withColumn("_hour", F.floor(F.col("wall_time") / 3600))
    before = Window.partitionBy("run").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = ev.groupBy("run", "_hour").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("run").alias("_run"), F.col("_hour").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy("run", "_hour").orderBy("ts", "event_id")
    ev = (ev.withColumn("_row", F.row_number().over(w)).join(hours, (F.col("run") == F.col("_run")) & F.col("_hour").eqNullSafe(F.col("_of")))
          .withColumn("step", (F.col("_before") + F.col("_row")).cast("int")).drop("_run", "_of", "_before", "_row", "_hour"))
    for t in TAGS:
        ev = ev.withColumn(t, F.when(F.col("tag") == t, F.col("value")))
    return ev


def event_pivot(log: DataFrame, keys: list[str], tag: str = "tag", value: str = "value",
                tags: list[str] = TAGS, prefix: str = "train/") -> DataFrame:
    """Tag/value events to one column per tag (explicit tag list, prefix stripped)."""
    t = F.regexp_replace(F.col(tag), "^" + prefix.replace("/", "\\/"), "")
    return log.withColumn("_tag", t).groupBy(*keys).pivot("_tag", tags).agg(F.avg(value))


def series_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """mean / sample std / min / max of the non-null values."""
    d = df.filter(F.col(col).isNotNull())
    return d.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                              F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("n"))


def best_step(df: DataFrame, by: list[str], metric: str, step: str = "step") -> DataFrame:
    """Minimum of ``metric`` and the first step reaching it (idxmin)."""
    d = df.filter(F.col(metric).isNotNull())
    return d.groupBy(*by).agg(F.min(metric).alias(f"best_{metric}"),
                              F.min_by(step, F.struct(F.col(metric), F.col(step))).alias("best_step"))


def last_row_value(df: DataFrame, by: list[str], col: str, order: str = "step") -> DataFrame:
    """Value on the last row by ``order``, null kept (``iloc[-1]``)."""
    return df.groupBy(*by).agg(F.max_by(F.struct(F.col(col).alias("v")), F.col(order))["v"].alias(f"last_{col}"))


def last_nonnull_value(df: DataFrame, by: list[str], col: str, order: str = "step") -> DataFrame:
    """Last non-null value by ``order`` (``groupby().last()``)."""
    d = df.filter(F.col(col).isNotNull())
    return d.groupBy(*by).agg(F.max_by(col, F.col(order)).alias(f"last_{col}"))


def minutes_since_start(df: DataFrame, by: list[str], t: str, where: Column) -> DataFrame:
    """``(t - min(t) over run) / 60`` over the rows selected by ``where``."""
    d = df.filter(where)
    first = d.groupBy(*by).agg(F.min(t).alias("_first"))
    return d.join(first, by).withColumn("minutes", (F.col(t) - F.col("_first")) / 60.0).drop("_first")


def tail(df: DataFrame, by: list[str], step: str, n: int) -> DataFrame:
    """The last ``n`` rows per group by ``step``, which numbers the rows of a group from 1 without gaps."""
    last = df.groupBy(*by).agg(F.max(step).alias("_last"))
    return df.join(last, by).filter(F.col(step) > F.col("_last") - n).drop("_last")


def early_stop(df: DataFrame, by: list[str], metric: str, step: str = "step", patience: int = 3, size: int = 1 << 14) -> DataFrame:
    """First step where ``patience`` consecutive evaluations did not improve the best
    (strictly lower) value; runs that never stop are absent.

    ``step`` is distinct within a run and 0 or more. A run may have any number
    of evaluations: best values and counts are prefix scans over blocks of
    ``size`` steps (:func:`prefix_scan`), and streaks go on across their
    borders. Both tables that are read more than once are written first.
    """
    spark = df.sparkSession
    evals = materialize_once(df.filter(F.col(metric).isNotNull()).select(*by, F.col(step).cast("bigint").alias("_step"), F.col(metric).alias("_value"),
                                                                         F.lit(1).alias("_one")), unique_dir(spark, "evals"))
    seen = prefix_scan(evals, by, "_step", {"_best": ("min", "_value"), "_before": ("sum", "_one")}, size)
    number = F.coalesce("_before", F.lit(0)) + 1
    better = F.col("_best").isNull() | (F.col("_value") < F.col("_best"))
    marked = seen.select(*by, "_step", number.alias("_no"), F.when(better, number).alias("_better"))
    marked = materialize_once(marked, unique_dir(spark, "evals-marked"))
    late = prefix_scan(marked, by, "_step", {"_last": ("max", "_better")}, size)
    stops = late.filter(F.col("_better").isNull() & (F.col("_no") - F.col("_last") == patience))
    return stops.groupBy(*by).agg(F.min("_step").cast(df.schema[step].dataType).alias("stop_step"))


def minmax_scores(wide: DataFrame, id_col: str, metrics: dict[str, bool]) -> DataFrame:
    """Unpivot metrics, min-max normalise each across ids, invert the lower-is-better
    ones; a constant or null metric scores 0.5.  ``metrics``: name -> lower_is_better."""
    long = wide.unpivot([id_col], list(metrics), "metric", "value")
    w = Window.partitionBy("metric")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    lower = F.col("metric").isin([m for m, low in metrics.items() if low])
    norm = (F.col("value") - lo) / (hi - lo)
    score = F.when(F.col("value").isNull() | (hi == lo) | hi.isNull(), F.lit(0.5)) \
             .otherwise(F.when(lower, 1.0 - norm).otherwise(norm))
    return long.select(id_col, "metric", score.alias("score"))


def hms(seconds: Column) -> Column:
    """Elapsed ``HH:MM:SS`` from whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
