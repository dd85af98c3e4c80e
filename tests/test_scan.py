"""Prefix scans and early stopping over many blocks, against a plain walk."""
import random

import pytest
from pyspark.sql import functions as F

from spanweave.operators.scan import prefix_scan
from spanweave.operators.telemetry import early_stop


def walk(rows, patience):
    stops = {}
    for run in {r for r, _, _ in rows}:
        best, streak = None, 0
        for _, step, v in sorted((x for x in rows if x[0] == run and x[2] is not None), key=lambda x: x[1]):
            if best is None or v < best:
                best, streak = v, 0
            else:
                streak += 1
            if streak == patience and run not in stops:
                stops[run] = step
    return stops


@pytest.mark.parametrize("size", [2, 7, 1 << 14])
def test_early_stop_across_blocks(spark, size):
    rng = random.Random(size)
    rows = []
    for run in ("a", "b", "c", None):
        v = 100.0
        for step in rng.sample(range(size ** 3 if size < 10 else 300), 8 if size == 2 else 200):
            rows.append((run, step, None if rng.random() < 0.2 else v + rng.random() - step / 3))
    rows += [("lone", 3, 1.0), ("never", 1, None), ("equal", 0, 1.0), ("equal", 1, 1.0), ("equal", 5, 1.0), ("equal", 7, 1.0)]
    df = spark.createDataFrame(rows, "run string, step int, eval_loss double").repartition(4)
    got = {r["run"]: r["stop_step"] for r in early_stop(df, ["run"], "eval_loss", patience=3, size=size).collect()}
    assert got == walk(rows, 3) and got["equal"] == 7


def test_one_run_of_many_blocks(spark):
    df = spark.range(60000).select(F.lit("r").alias("run"), F.col("id").cast("int").alias("step"),
                                   F.when(F.col("id") < 59000, -F.col("id")).otherwise(0).cast("double").alias("eval_loss"))
    assert [tuple(r) for r in early_stop(df, ["run"], "eval_loss", patience=500, size=64).collect()] == [("r", 59499)]
    assert early_stop(df.limit(0), ["run"], "eval_loss").collect() == []


def test_scan_is_exclusive_and_bounded(spark):
    rows = [("x", i, i % 5) for i in range(27)]
    df = spark.createDataFrame(rows, "g string, at int, v int")
    got = {r["at"]: (r["low"], r["total"]) for r in prefix_scan(df, ["g"], "at", {"low": ("min", "v"), "total": ("sum", "v")}, 3, 3).collect()}
    for i in range(27):
        before = [v for _, j, v in rows if j < i]
        assert got[i] == ((min(before), sum(before)) if before else (None, None))
    plan = prefix_scan(df, ["g"], "at", {"low": ("min", "v")}, 3, 3)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("_block" in x for x in windows)
    with pytest.raises(Exception, match="more levels"):
        prefix_scan(df, ["g"], "at", {"low": ("min", "v")}, 2, 2).collect()
