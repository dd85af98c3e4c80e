"""Best-two-fit packing of token sequences into as few bins as it can.

How documents are packed depends only on how many pieces of each length there
are, a table of at most ``capacity`` rows. The driver packs this histogram:
it fills a bin greedily with the longest pieces that fit, then takes out the
smallest and puts in the two lengths that fill its expanded gap best, and
repeats the bin for as long as its lengths last. Each length's pieces are then
numbered by tasks (hot lengths are dealt into buckets whose counts give each
its offset) and piece number r of a length takes the r-th place that the plan
has for it. So one global packing is found, and no data passes the driver.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm._store import release, stored
from spanweave.llm._tokens import encoded_rows


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
                 capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids and ``end_id``, cut where longer than ``capacity``.

    Only the first piece of a longer document may be shorter. Null text is empty.
    """
    def cut(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, own in encoded_rows(batch.column(1), tokenizer_path, end_id):
                n = len(own)
                edges = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
                for p, (a, b) in enumerate(zip(edges, edges[1:])):
                    raw = own[a:b].astype("<u4").tobytes()
                    rows.append((ids[i], p, a, b - a, zlib.crc32(raw), raw if with_ids else None))
            cols = list(zip(*rows)) or [[]] * 6
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[5], pa.binary())] * with_ids,
                                             ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        release()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(cut, schema)


@dataclass
class Plan:
    """Places for each length, in order: from rank ``first`` on, bins ``bin``, ``bin + 1``, ... at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            lo, hi = np.searchsorted(self.length, [x, x + 1])
            own = length == x
            at = lo + np.searchsorted(self.first[lo:hi], rank[own], "right") - 1
            bins[own] = self.bin[at] + rank[own] - self.first[at]
            offsets[own] = self.offset[at]
        return bins, offsets


def plan_bins(counts: dict[int, int], capacity: int) -> Plan:
    """Best-two-fit over a histogram of lengths (each 1 to ``capacity``)."""
    left = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        left[x] = n
    used = np.zeros(capacity + 1, np.int64)
    places, bins = [], 0
    sizes = np.arange(capacity + 1)
    while True:
        free = left.copy()
        best = np.maximum.accumulate(np.where(free > 0, sizes, 0))
        if not best[-1]:
            break
        chosen, gap = [], capacity
        while gap and best[gap]:
            x = int(best[gap])
            times = min(int(free[x]), gap // x)
            chosen += [x] * times
            free[x] -= times
            gap -= x * times
            if not free[x]:
                best = np.maximum.accumulate(np.where(free > 0, sizes, 0))
        if gap and len(chosen) > 1:
            small, room = chosen[-1], gap + chosen[-1]
            a = np.flatnonzero(free[:room] > 0)
            a = a[a > 0]
            if len(a):
                b = best[room - a]
                b = np.where((b == a) & (free[a] < 2), np.concatenate([[0], best])[a], b)
                i = int(np.argmax(np.where(b > 0, a + b, 0)))
                if b[i] > 0 and a[i] + b[i] > small:
                    chosen = chosen[:-1] + sorted((int(a[i]), int(b[i])), reverse=True)
        need: dict[int, int] = {}
        for x in chosen:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in need.items())
        offset = 0
        for x in chosen:
            places.append((x, int(used[x]), bins, offset))
            used[x] += times
            left[x] -= times
            offset += x
        bins += times
    places.sort()
    cols = np.array(places, np.int64).reshape(-1, 4).T
    return Plan(*cols, bins)


def pack(pieces: DataFrame, capacity: int = 2048, bucket_rows: int = 50_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no sequence longer than ``capacity``, offsets without gaps.

    ``pieces`` needs ``doc_id``, ``piece``, ``start``, ``length`` (1 to
    ``capacity``) and ``ids_crc32`` and is best stored. Pieces of one length
    are numbered by these columns; equal rows are interchangeable, null ids
    sort first. An empty table gives an empty table. Pieces of one length are
    numbered in buckets of about ``bucket_rows`` rows, so no task holds a
    hot length.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_bins(histogram, capacity))
    buckets = max(64, sum(histogram.values()) // bucket_rows)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
               .select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (dealt.withColumn("_row", F.row_number().over(own))
              .join(offsets, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
              .withColumn("_rank", F.col("_before") + F.col("_row") - 1))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        bins, offset = plan.value.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": bins, "offset": offset})

    return ranked.withColumn("_at", place("length", "_rank")).select(
        *pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
                   capacity: int = 2048) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row a piece (see :func:`token_pieces` and :func:`pack`).

    Null or empty text is one piece that holds ``end_id`` alone. Repeated
    rows are packed each for itself. Other columns are not read.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, id_col, text_col, end_id, capacity), "pieces")
    return pack(pieces, capacity)
