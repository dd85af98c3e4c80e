"""Token ids in files of patched frame-of-reference blocks, written and read back by Spark tasks.

A shard file holds the ids of consecutive documents (ascending id):

    8 bytes   magic ``SWPFOR1\\0``
    5 x u64   documents, ids, values a block, blocks, largest percentile
    i64[docs] document ids; u8[docs] 1 where the id is null; u64[docs] ids of each document
    u64[blocks + 1]  start of each block, from the first block on (the index)
    blocks    u32 minimum, u8 width, u16 exceptions, packed values (minimum taken
              off, ``width`` low bits each, little-endian bit order),
              u16[exceptions] positions, u32[exceptions] whole values less the minimum

The width of a block is that of its value at a percentile (of a few, the one
that makes the block smallest), so outliers do not widen it: they stand whole
in the exception list. Any block can be decoded alone by the index.
"""
from __future__ import annotations

import struct
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm._store import release, stored
from spanweave.llm._tokens import encoded_rows
from spanweave.session import unique_dir

MAGIC = b"SWPFOR1\0"
PERCENTILES = (90, 95, 98, 100)
HEADER = struct.Struct("<8s5Q")
BLOCK = struct.Struct("<IBH")


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width``-bit values to rows of bytes."""
    bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack_bits(rows: np.ndarray, width: int, size: int) -> np.ndarray:
    bits = np.unpackbits(rows, axis=1, count=size * width, bitorder="little").reshape(-1, width)
    if width <= 24:
        return (bits.astype(np.float32) @ (2.0 ** np.arange(width)).astype(np.float32)).astype(np.uint32).reshape(len(rows), size)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1).astype(np.uint32).reshape(len(rows), size)


def _widths(rest: np.ndarray, percentiles: tuple[int, ...]) -> np.ndarray:
    """For each block the width of its value at that one of ``percentiles`` which makes the block smallest."""
    ranked = np.sort(rest, axis=1)
    size = rest.shape[1]
    widths, cost = [], []
    for p in percentiles:
        top = ranked[:, max(0, -(-size * p // 100) - 1)]
        w = np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.int64)
        odd = (rest > ((np.uint64(1) << w.astype(np.uint64)) - np.uint64(1))[:, None]).sum(axis=1)
        widths.append(w)
        cost.append(-(-size * w // 8) + 6 * odd)
    return np.choose(np.argmin(cost, axis=0), widths)


def encode_shard(doc_ids: list[int | None], docs: list[bytes], block: int = 512, percentiles: tuple[int, ...] = PERCENTILES) -> bytes:
    """One shard file of the little-endian 32-bit ids of ``docs``."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    blocks = -(-len(ids) // block)
    full = np.concatenate([ids, np.full(blocks * block - len(ids), ids[-1] if len(ids) else 0, np.uint32)]).reshape(blocks, block)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    widths = _widths(rest, percentiles) if blocks else np.zeros(0, np.int64)
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(widths).tolist():
        for at in np.array_split(np.flatnonzero(widths == w), max(1, -(-int((widths == w).sum()) // 512))):
            part = rest[at]
            body = _pack_bits(part & np.uint32((1 << w) - 1), w) if w else np.zeros((len(at), 0), np.uint8)
            odd = part >> np.uint32(w) != 0 if w < 32 else np.zeros(part.shape, bool)
            for i, own, out in zip(at.tolist(), odd, body):
                where = np.flatnonzero(own)
                bodies[i] = (BLOCK.pack(int(low[i]), w, len(where)) + out.tobytes()
                             + where.astype("<u2").tobytes() + rest[i][where].astype("<u4").tobytes())
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype("<u8")
    head = HEADER.pack(MAGIC, len(docs), len(ids), block, blocks, max(percentiles))
    table = (np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes()
             + np.array([len(d) // 4 for d in docs], "<u8").tobytes())
    return b"".join([head, table, starts.tobytes(), *bodies])


class Shard:
    """Reader of one shard's bytes."""

    def __init__(self, data: bytes):
        magic, self.docs, self.ids, self.block, self.blocks, _ = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size
        raw = np.frombuffer(data, "<i8", self.docs, at)
        null = np.frombuffer(data, "u1", self.docs, at + 8 * self.docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(raw, null)]
        self.sizes = np.frombuffer(data, "<u8", self.docs, at + 9 * self.docs).astype(np.int64)
        at += 17 * self.docs
        self.starts = np.frombuffer(data, "<u8", self.blocks + 1, at).astype(np.int64)
        self.body = np.frombuffer(data, np.uint8, offset=at + 8 * (self.blocks + 1))

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from ``first`` up to ``last`` (not included)."""
        out = np.zeros((last - first, self.block), np.uint32)
        heads = [BLOCK.unpack_from(self.body, int(s)) for s in self.starts[first:last]]
        by_width: dict[int, list[int]] = {}
        for i, (_, w, _) in enumerate(heads):
            by_width.setdefault(w, []).append(i)
        for w, own in by_width.items():
            size = -(-self.block * w // 8)
            for lo in range(0, len(own), 512):
                part = own[lo:lo + 512]
                rows = np.stack([self.body[s:s + size] for s in (self.starts[first + i] + BLOCK.size for i in part)])
                if w:
                    out[part] = _unpack_bits(rows, w, self.block)
        for i, (low, w, n) in enumerate(heads):
            at = int(self.starts[first + i]) + BLOCK.size + -(-self.block * w // 8)
            where = np.frombuffer(self.body, "<u2", n, at)
            out[i, where] = np.frombuffer(self.body, "<u4", n, at + 2 * n)
            out[i] += np.uint32(low)
        return out.ravel()[:max(0, self.ids - first * self.block)]

    def documents(self):
        """``(doc id, start in the shard, ids)`` of each document, decoding a bounded run of blocks at a time."""
        step = max(1, (1 << 20) // self.block)
        held, begin, at = np.zeros(0, np.uint32), 0, 0
        next_block = 0
        for i, n in zip(self.doc_ids, self.sizes.tolist()):
            while begin + len(held) < at + n:
                held = np.concatenate([held[at - begin:], self.read(next_block, min(self.blocks, next_block + step))])
                begin, next_block = at, min(self.blocks, next_block + step)
            yield i, at, held[at - begin:at - begin + n]
            at += n


def _filesystem(uri: str):
    """Shared storage from inside a task, by any scheme pyarrow knows (a plain path is a file)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def write_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
              path: str | None = None, shard_ids: int = 1 << 20, block: int = 512, percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """Encode all texts into shard files in ascending id order; returns the manifest ``(part, seq, path, n_docs, n_ids)``.

    Null text is empty; each document ends with ``end_id``. Null ids come
    first; rows of one id stand by text. A file is written under a name of its own
    and then renamed, and a task that runs again writes the same bytes, so
    lost executors do no harm. ``path`` is shared storage (by default a fresh
    folder under ``spark.checkpoint.dir``).
    """
    spark = docs.sparkSession
    path = path or unique_dir(spark, "llm-ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")

    def write(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        store, root = _filesystem(path)
        ids, held, size, seq = [], [], 0, 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for i, tokens in encoded_rows(batch.column(1), tokenizer_path, end_id):
                ids.append(own[i])
                held.append(tokens.astype("<u4").tobytes())
                size += len(tokens)
                if size >= shard_ids:
                    yield _shard_row(store, root, part, seq, ids, held, block, percentiles)
                    ids, held, size, seq = [], [], 0, seq + 1
        if ids:
            yield _shard_row(store, root, part, seq, ids, held, block, percentiles)
        ids, held = [], []
        release()

    return stored(rows.mapInArrow(write, "part int, seq int, name string, n_docs bigint, n_ids bigint").withColumn(
        "folder", F.lit(path)), "manifest")


def _shard_row(store, root: str, part: int, seq: int, ids: list, docs: list[bytes], block: int, percentiles: tuple[int, ...]) -> pa.RecordBatch:
    import uuid
    name = f"{part:06d}-{seq:06d}.pfor"
    store.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as f:
        f.write(encode_shard(ids, docs, block, percentiles))
    store.move(temporary, f"{root}/{name}")
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "name": [name],
                                       "n_docs": [len(docs)], "n_ids": [sum(map(len, docs)) // 4]})


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, decoded from the files of ``manifest``.

    ``start`` counts the ids of all documents before it. The driver sums only
    one number for each partition that wrote files; shards within one are
    summed by a window.
    """
    spark = manifest.sparkSession
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases = list(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0)))
    bases = spark.createDataFrame(bases, "p int, first bigint")  # a row for each writing partition, at most
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = (manifest.withColumn("inner", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
              .join(F.broadcast(bases), F.col("part") == F.col("p"))
              .select("folder", "name", (F.col("first") + F.col("inner")).alias("base")))
    shards = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def read(batches):
        for batch in batches:
            for folder, name, base in zip(*(batch.column(c).to_pylist() for c in range(3))):
                store, root = _filesystem(folder)
                with store.open_input_file(f"{root}/{name}") as f:
                    shard = Shard(f.read())
                rows = [(i, base + at, len(x), zlib.crc32(x.tobytes()), x.tobytes() if with_ids else None) for i, at, x in shard.documents()]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.binary())] * with_ids,
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
        release()

    return shards.mapInArrow(read, schema)
