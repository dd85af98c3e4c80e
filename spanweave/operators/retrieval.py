"""Exact nearest-neighbour retrieval (inner product on L2-normalised vectors).

Plan: both sides are packed into blocks of bounded size (ids and a matrix a
row). The query set meets the corpus block against block, each pair of blocks
is one matrix product, and only the k best of each query leave a task (ties
broken by corpus id); a final ``row_number`` picks the global top-k. Exact: a
global top-k row is in the top-k of its block. No side passes the driver.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.text import let

QUERY_BLOCK = 256
CORPUS_BLOCK = 2048

Embedder = Callable[[DataFrame, str, str], DataFrame]  # (rows, text column, output column) -> rows with the vector


def l2_normalize(c) -> Column:
    """``x / ||x||`` in double precision (zero vectors stay zero)."""
    c = F.col(c) if isinstance(c, str) else c
    arr = F.transform(c, lambda x: x.cast("double"))
    return let(arr, lambda a: let(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(
        a, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))))


def hashing_embed(df: DataFrame, text: str, out: str = "embedding", dim: int = 384) -> DataFrame:
    """Default embedder: hashed lower-cased word counts, L2-normalised (JVM-side)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array
    tok = df.withColumn("_tok", F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim).transform(tok)
    nm = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0).transform(tf)
    return nm.withColumn(out, vector_to_array("_nv")).drop("_tok", "_tf", "_nv")


def _blocks(df: DataFrame, id_col: str, vec: str, rows: int, prefix: str) -> DataFrame:
    """Rows packed ``rows`` at a time: ``<prefix>_ids``, ``<prefix>_matrix`` (flat) and ``<prefix>_dim``."""
    id_type = dict(df.dtypes)[id_col]

    def pack(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            for lo in range(0, len(pdf), rows):
                part = pdf.iloc[lo:lo + rows]
                flat = np.concatenate([np.asarray(v, np.float64) for v in part[vec]])
                yield pd.DataFrame({f"{prefix}_ids": [part[id_col].tolist()], f"{prefix}_matrix": [flat], f"{prefix}_dim": [len(flat) // len(part)]})

    return df.select(id_col, vec).where(F.col(vec).isNotNull()).mapInPandas(
        pack, f"{prefix}_ids array<{id_type}>, {prefix}_matrix array<double>, {prefix}_dim int")


def best_of_blocks(pairs: DataFrame, k: int, cid: str, q_type: str, c_type: str) -> DataFrame:
    """``(query_id, cid, score)``: the ``k`` best rows of each corpus block for each query of the block it meets.

    Scores are rounded to 12 decimals, so equal vectors tie in any block."""

    def best(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.array(row.c_ids)
                scores = np.asarray(row.q_matrix).reshape(-1, row.q_dim) @ np.asarray(row.c_matrix).reshape(-1, row.c_dim).T
                scores = np.round(scores, 12)  # a product's last digits depend on the shape of the block
                n = min(k, len(ids))
                edge = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
                out = []
                for q, s, e in zip(row.q_ids, scores, edge):
                    some = np.flatnonzero(s >= e)
                    some = some[np.lexsort((ids[some], -s[some]))[:n]]
                    out += zip([q] * n, ids[some].tolist(), s[some].tolist())
                yield pd.DataFrame(out, columns=["query_id", cid, "score"])

    return pairs.mapInPandas(best, f"query_id {q_type}, {cid} {c_type}, score double")


def top_ranks(found: DataFrame, k: int, cid: str) -> DataFrame:
    """The ``k`` best rows of each query with ``rank`` 1..k, ties by ``cid``."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(cid))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_topk(queries: DataFrame, corpus: DataFrame, k: int = 3, *, qid: str = "query_id", cid: str = "vec_id",
             vec: str = "embedding", normalize: bool = True) -> DataFrame:
    """Top-``k`` corpus rows per query by inner product (``rank`` 1..k, ties by ``cid``); an empty side gives no rows."""
    if normalize:
        queries = queries.withColumn(vec, l2_normalize(vec))
        corpus = corpus.withColumn(vec, l2_normalize(vec))
    q_type, c_type = dict(queries.dtypes)[qid], dict(corpus.dtypes)[cid]
    # a stated query set against all rows: the rows of both sides are blocks
    pairs = _blocks(corpus, cid, vec, CORPUS_BLOCK, "c").crossJoin(_blocks(queries, qid, vec, QUERY_BLOCK, "q"))

    found = best_of_blocks(pairs, k, cid, q_type, c_type)
    return top_ranks(found, k, cid).withColumnRenamed("query_id", qid)
