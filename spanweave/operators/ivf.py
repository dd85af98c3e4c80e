"""Approximate nearest neighbours by an inverted file, opt-in beside the exact ``knn_topk``.

Centroids come from k-means on a bounded sample; every corpus row lies in the
list of its nearest centroid. A list is a folder of Parquet rows, each a block
of at most ``CORPUS_BLOCK`` vectors, so a list that holds a third of the
corpus is many rows in many tasks. A query meets the blocks of its nearest
lists only, and their rows are ranked by the exact inner product. The number
of lists to probe is taken from sampled rows whose true neighbours an exact
search finds, so it follows the data: vectors without clusters need most lists.
"""
from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.retrieval import CORPUS_BLOCK, QUERY_BLOCK, best_of_blocks, knn_topk, l2_normalize, top_ranks
from spanweave.session import unique_dir

SAMPLE_ROWS = 65_536
ROWS_PER_LIST = 32  # of the sample, so centroids are never more than SAMPLE_ROWS / ROWS_PER_LIST


@dataclass
class IvfIndex:
    """``centroids`` (one row a list), the stored ``blocks`` of all corpus rows, and lists probed a query."""

    centroids: np.ndarray
    blocks: DataFrame
    id_type: str
    probes: int


def _units(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("_id"), l2_normalize(vec).alias("_vec"))


def _sample(rows: DataFrame, n: int, of: int, seed: int, name: str) -> DataFrame:
    """``n`` random rows of ``of``, written to the shared store. About twice as many are drawn before the cut, so no more ever meet."""
    drawn = rows.withColumn("_r", F.rand(seed)).where(F.col("_r") < min(1.0, (2 * n + 100) / max(of, 1)))
    path = unique_dir(rows.sparkSession, name)
    drawn.orderBy("_r").limit(n).drop("_r").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _centroids(units: DataFrame, n_lists: int | None, sample_rows: int, seed: int) -> np.ndarray:
    """Cosine k-means on ``sample_rows`` random non-zero vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    full = units.where(F.exists("_vec", lambda x: x != 0)).select("_vec")
    rows = full.count()
    some = _sample(full, sample_rows, rows, seed, "ivf-sample")
    held = some.count()
    if not held:  # no vector, or all of them zero: one list
        return np.zeros((0, 0)) if units.isEmpty() else np.asarray(units.first()._vec)[None, :]
    lists = max(1, min(n_lists or isqrt(rows), held // ROWS_PER_LIST))
    if lists == 1:
        return np.asarray(some.first()[0])[None, :]
    fit = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="v").fit(some.select(array_to_vector("_vec").alias("v")))
    found = np.array(fit.clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def build_index(corpus: DataFrame, *, cid: str = "vec_id", vec: str = "embedding", n_lists: int | None = None, probes: int = 8,
                sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> IvfIndex:
    """Index of every row of ``corpus`` with a vector; the root of their number of lists unless ``n_lists`` says otherwise.

    Lists are at most ``sample_rows / 32``. An all-zero vector lies in some
    list; a null vector is in none (exact search leaves it out too).
    """
    spark = corpus.sparkSession
    units, id_type = _units(corpus, cid, vec), dict(corpus.dtypes)[cid]
    centres = _centroids(units, n_lists, sample_rows, seed)
    if not len(centres):
        return IvfIndex(centres, spark.createDataFrame([], f"list int, c_ids array<{id_type}>, c_matrix array<double>, c_dim int"), id_type, probes)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                flat = np.stack(pdf["_vec"].to_numpy())
                yield pd.DataFrame({"list": np.argmax(flat @ shared.value.T, axis=1).astype(np.int32), "_id": pdf["_id"], "_vec": pdf["_vec"]})

    path = unique_dir(spark, "ivf-rows")
    units.mapInPandas(assign, f"list int, _id {id_type}, _vec array<double>").write.parquet(path)
    rows = spark.read.parquet(path)
    parts = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CORPUS_BLOCK).alias("_parts"))  # one row a list
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # of a stored table: the same in every attempt
    rows = rows.join(F.broadcast(parts), "list").withColumn("_part", F.col("_row") % F.col("_parts"))

    def pack(batches):
        for pdf in batches:
            for at, part in pdf.groupby("list", sort=False):
                for lo in range(0, len(part), CORPUS_BLOCK):
                    own = part.iloc[lo:lo + CORPUS_BLOCK]
                    flat = np.concatenate(own["_vec"].to_list())
                    yield pd.DataFrame({"list": [at], "c_ids": [own["_id"].tolist()], "c_matrix": [flat], "c_dim": [len(flat) // len(own)]})

    blocks = (rows.repartition("list", "_part").sortWithinPartitions("list").select("list", "_id", "_vec")
              .mapInPandas(pack, f"list int, c_ids array<{id_type}>, c_matrix array<double>, c_dim int"))
    path = unique_dir(spark, "ivf-lists")
    blocks.write.partitionBy("list").parquet(path)
    stored = spark.read.schema(f"c_ids array<{id_type}>, c_matrix array<double>, c_dim int, list int").parquet(path)
    return IvfIndex(centres, stored, id_type, min(probes, len(centres)))


def search(index: IvfIndex, queries: DataFrame, k: int = 3, *, qid: str = "query_id", cid: str = "vec_id", vec: str = "embedding",
           probes: int | None = None) -> DataFrame:
    """``(qid, cid, score, rank)``: the best ``k`` rows of the nearest ``probes`` lists of each query, ties by ``cid``.

    With as many probes as lists the result is that of ``knn_topk``. A query
    without a vector, or an index without rows, gives no rows.
    """
    q_type, n = dict(queries.dtypes)[qid], index.probes if probes is None else min(probes, len(index.centroids))
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def probe(batches):
        for pdf in batches:
            if not len(pdf) or not len(shared.value):
                continue
            flat = np.stack(pdf["_vec"].to_numpy())
            near = np.argsort(-(flat @ shared.value.T), axis=1, kind="stable")[:, :n]
            for at in np.unique(near).tolist():
                own = np.flatnonzero((near == at).any(axis=1))
                for lo in range(0, len(own), QUERY_BLOCK):
                    some = own[lo:lo + QUERY_BLOCK]
                    yield pd.DataFrame({"list": [at], "q_ids": [pdf["_id"].iloc[some].tolist()], "q_matrix": [flat[some].ravel()], "q_dim": [flat.shape[1]]})

    met = _units(queries, qid, vec).mapInPandas(probe, f"list int, q_ids array<{q_type}>, q_matrix array<double>, q_dim int")
    found = best_of_blocks(index.blocks.join(met, "list").drop("list"), k, cid, q_type, index.id_type)
    return top_ranks(found, k, cid).withColumnRenamed("query_id", qid)


def tune_probes(index: IvfIndex, corpus: DataFrame, k: int = 3, *, cid: str = "vec_id", vec: str = "embedding", target: float = 0.95,
                n_queries: int = 256, seed: int = 7) -> IvfIndex:
    """The index with the fewest probes that find ``target`` of the true neighbours of ``n_queries`` sampled rows.

    One exact search of the sampled rows against all rows; a row is no
    neighbour of itself. The driver sees the vectors of the sampled rows and
    of their ``k`` neighbours, nothing else.
    """
    if len(index.centroids) < 2:
        return index
    rows = corpus.where(F.col(vec).isNotNull()).select(F.col(cid).alias("_id"), F.col(vec).alias("_vec"))
    asked = _sample(rows, n_queries, rows.count(), seed, "ivf-asked")
    near = knn_topk(asked.withColumnRenamed("_id", "query_id"), rows, k + 1, cid="_id", vec="_vec").where("query_id <> _id")
    near = near.join(F.broadcast(asked.select(F.col("_id").alias("query_id"), F.col("_vec").alias("q"))), "query_id")
    pairs = rows.join(F.broadcast(near.select("query_id", "_id", "q", "rank")), "_id")
    pairs = pairs.select("query_id", "_id", "rank", "q", "_vec").dropDuplicates(["query_id", "_id"]).toPandas()
    if pairs.empty:
        return index
    pairs = pairs.sort_values(["query_id", "rank"]).groupby("query_id").head(k)
    scores = np.stack(pairs["q"].to_numpy()) @ index.centroids.T
    home = np.argmax(np.stack(pairs["_vec"].to_numpy()) @ index.centroids.T, axis=1)
    place = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)[np.arange(len(home)), home]
    enough = int(np.ceil(target * len(place)))
    return IvfIndex(index.centroids, index.blocks, index.id_type, int(np.sort(place)[enough - 1]) + 1)
