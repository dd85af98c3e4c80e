"""kNN vs NumPy brute force; streaming telemetry equals the batch aggregate."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.operators.retrieval import knn_topk
from tests.conftest import SF


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_knn_matches_numpy(spark, parts):
    rng = np.random.default_rng(parts)
    C = rng.normal(size=(60, 8))
    Q = rng.normal(size=(4, 8))
    C[10] = C[11]  # exact tie: smaller id must win
    corpus = spark.createDataFrame([(i, C[i].tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(100 + j, Q[j].tolist()) for j in range(4)], "query_id long, embedding array<double>")
    got = knn_topk(queries, corpus.repartition(parts), 3).orderBy("query_id", "rank").collect()
    Cn = C / np.linalg.norm(C, axis=1, keepdims=True)
    Qn = Q / np.linalg.norm(Q, axis=1, keepdims=True)
    S = Qn @ Cn.T
    for j in range(4):
        want = sorted(range(60), key=lambda i: (-round(S[j, i], 12), i))[:3]
        assert [r["vec_id"] for r in got if r["query_id"] == 100 + j] == want


def test_stream_windows_equal_batch(spark):
    from spanweave.streaming.jobs import telemetry_windows
    ev = spark.read.parquet(f"{SF}/events.parquet")
    s = telemetry_windows(spark, ev).select("window_start", "run", "n_events")
    b = (ev.withColumn("run", F.concat(F.lit("run"), F.pmod("user_id", F.lit(8)).cast("string")))
           .groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("window_start"), "run")
           .agg(F.count(F.lit(1)).alias("n_events")))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))
