"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by the power of two of their size. Every item of a
partition gets a bottom-k MinHash sketch: the k smallest hashes of its
shingles, with k set by the partition's largest size ``u`` to ``u - ceil(t *
u) + 1``. A document that holds a share ``t`` of an item's shingles cannot
miss so many of them, so it holds one hash of the sketch at least: recall is
1, for documents of any length, where banded signatures of whole documents
would lose short items. Documents probe the sketches with all their shingles,
and candidates are verified by exact containment of the shingle sets.

Items are taken in blocks of a bounded number of shingles; a block is
broadcast (its size is that bound) and all documents are read against it.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm._arrays import row_ranges, shingle_sets
from spanweave.llm._store import stored

_U = np.uint64
FILTER_BITS = 22


@dataclass
class Sketches:
    """A block of items: their shingle sets, and their sketches as sorted hashes with the item of each."""

    ids: list
    sets: list[np.ndarray]
    hashes: np.ndarray
    items: np.ndarray
    bitmap: np.ndarray
    num: int
    den: int

    @classmethod
    def build(cls, ids: list, sets: list[np.ndarray], num: int, den: int) -> Sketches:
        parts: dict[int, int] = {}
        for s in sets:
            parts[len(s).bit_length()] = max(parts.get(len(s).bit_length(), 0), len(s))
        hashes, items = [], []
        for i, s in enumerate(sets):
            u = parts[len(s).bit_length()]
            sketch = s[:u - -(-num * u // den) + 1]  # sets are sorted by hash
            hashes.append(sketch)
            items.append(np.full(len(sketch), i))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        items = np.concatenate(items) if items else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        bitmap = np.zeros(1 << FILTER_BITS, bool)
        bitmap[hashes >> _U(64 - FILTER_BITS)] = True
        return cls(ids, sets, hashes[order], items[order], bitmap, num, den)

    def hits(self, shingles: np.ndarray) -> list[tuple[int, int]]:
        """Items contained in a document's sorted distinct shingles: (item index, shared shingles)."""
        probe = shingles[self.bitmap[shingles >> _U(64 - FILTER_BITS)]]
        if not len(probe):
            return []
        lo, hi = np.searchsorted(self.hashes, probe, "left"), np.searchsorted(self.hashes, probe, "right")
        found = {int(x) for a, b in zip(lo, hi) for x in self.items[a:b]}
        out = []
        for i in sorted(found):
            own = self.sets[i]
            at = np.searchsorted(shingles, own)
            at[at == len(shingles)] = 0
            shared = int((shingles[at] == own).sum())
            if self.den * shared >= self.num * len(own):
                out.append((i, shared))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, block_shingles: int):
    """Sketches of all items that have ``k`` words, in blocks of about ``block_shingles`` shingles."""
    def sets(batches):
        for batch in batches:
            for lo, hi in row_ranges(batch.column(1)):
                own = shingle_sets(batch.column(1).slice(lo, hi - lo), k, whole=False)
                keep = [i for i, s in enumerate(own) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(keep, pa.int64())),
                     pa.array([own[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], ["item", "shingles"])

    found = stored(items.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col)).mapInArrow(
        sets, "item bigint, shingles array<bigint>"), "items")
    total = found.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(1, -(-total // block_shingles))
    for b in range(blocks if total else 0):
        rows = (found if blocks == 1 else found.where(F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == b)).collect()
        yield Sketches.build([r["item"] for r in rows], [np.array(r["shingles"], np.int64).view(_U) for r in rows], num, den)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, block_shingles: int = 1 << 22) -> DataFrame:
    """``(id, item_id, n_item, n_shared, containment)``: every pair of a document and an item it contains.

    Words are runs outside 0x20 and 0x09-0x0D, A-Z lower-cased; an item is
    contained if the document holds ``num / den`` of its distinct ``k``-word
    shingles at least. Items of fewer than ``k`` words (or null) identify
    nothing and match nothing; so do documents without ``k`` words. Repeated
    rows of either table give a pair each; null ids come back as null. Other
    columns are not read. Empty tables give an empty table.
    """
    schema = "id bigint, item_id bigint, n_item bigint, n_shared bigint, containment double"
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items, item_id_col, item_text_col, k, num, den, block_shingles):
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            sketches = shared.value
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for lo, hi in row_ranges(batch.column(1)):
                    for i, s in zip(range(lo, hi), shingle_sets(batch.column(1).slice(lo, hi - lo), k, whole=False)):
                        rows += [(ids[i], sketches.ids[x], len(sketches.sets[x]), n) for x, n in sketches.hits(s)]
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols), pa.array([n / m for m, n in zip(cols[2], cols[3])], pa.float64())],
                    ["id", "item_id", "n_item", "n_shared", "containment"])

        out = out.unionByName(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col)).mapInArrow(search, schema))
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                         item_text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, block_shingles: int = 1 << 22) -> DataFrame:
    """``docs`` without the rows that contain an item (see :func:`contaminated`); no shuffle, columns unchanged."""
    for block in item_blocks(items, item_id_col, item_text_col, k, num, den, block_shingles):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(block), k)(F.col(text_col)))
    return docs


def _clean(shared, k: int):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        column, out = pa.array(texts, pa.string(), from_pandas=True), []
        for lo, hi in row_ranges(column):
            out += [not shared.value.hits(s) for s in shingle_sets(column.slice(lo, hi - lo), k, whole=False)]
        return pd.Series(out, dtype=bool)

    return clean
