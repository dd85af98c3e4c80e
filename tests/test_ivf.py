"""Inverted file: all probes give the exact result, tuned probes a recall, every row is indexed."""
import numpy as np
from pyspark.sql import functions as F

from spanweave.operators import ivf
from spanweave.operators.retrieval import knn_topk


def _clustered(spark, n=1500, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 3
    v = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim))
    v[: n // 3] = v[0]  # a third of all rows is one vector
    rows = [(i, v[i].tolist()) for i in range(n)] + [(n, None), (n + 1, [0.0] * dim), (5, v[5].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_index_holds_every_row_and_all_probes_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ivf, "CORPUS_BLOCK", 100)
    corpus = _clustered(spark)
    queries = corpus.where("vec_id % 20 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    index = ivf.build_index(corpus, n_lists=10)
    held = index.blocks.select("list", F.size("c_ids").alias("n"), F.explode("c_ids").alias("id"))
    assert sorted(r["id"] for r in held.collect()) == sorted([*range(1500), 1501, 5])
    assert held.agg(F.max("n")).first()[0] <= 100 and held.select("list").distinct().count() > 5
    assert _rows(ivf.search(index, queries, 4, probes=len(index.centroids))) == _rows(knn_topk(queries, corpus, 4))


def test_tuned_probes_reach_the_recall(spark):
    corpus = _clustered(spark, seed=8)
    queries = corpus.where("vec_id % 20 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    index = ivf.tune_probes(ivf.build_index(corpus), corpus, 3, n_queries=100)
    exact = {(q, v) for q, _, v, _ in _rows(knn_topk(queries, corpus, 3))}
    found = {(q, v) for q, _, v, _ in _rows(ivf.search(index, queries, 3))}
    assert len(exact & found) >= 0.9 * len(exact)
    assert index.probes < len(index.centroids)


def test_empty_sides(spark):
    corpus = _clustered(spark, 40)
    queries = corpus.select(F.col("vec_id").alias("query_id"), "embedding")
    empty = ivf.tune_probes(ivf.build_index(corpus.limit(0)), corpus.limit(0))
    assert ivf.search(empty, queries).count() == 0
    assert ivf.search(ivf.build_index(corpus.where("vec_id = 40")), queries).count() == 0
    zero = ivf.build_index(corpus.where("vec_id = 41"))
    assert {r["vec_id"] for r in ivf.search(zero, queries).collect()} == {41}
    assert ivf.search(ivf.build_index(corpus), queries.limit(0)).count() == 0
