"""Cutting lineage through Parquet in the shared checkpoint folder, and block-wise merged sketches."""
from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.session import unique_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: survives lost executors, is never computed twice."""
    spark = df.sparkSession
    path = unique_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table written by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def merged_blocks(parts: DataFrame, blocks: int, dtype: str, width: int,
                  fold: Callable[[np.ndarray, np.ndarray], None]) -> dict[int, np.ndarray]:
    """Merge task-level sketch blocks ``(block int, payload binary)`` into one array per block.

    Blocks go to their own partitions and are folded as they stream in, so a
    task holds one array per block it owns however many tasks sent one. What
    the driver receives is at most ``blocks * width`` values: a fixed size.
    """
    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b not in held:
                    held[b] = np.zeros(width, dtype)
                fold(held[b], np.frombuffer(zlib.decompress(payload.as_py()), dtype))
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()),
                 pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], ["block", "payload"])
            held.clear()
            release()

    rows = (parts.repartition(min(blocks, 64), F.col("block")).mapInArrow(merge, "block int, payload binary").collect())
    return {r["block"]: np.frombuffer(zlib.decompress(bytes(r["payload"])), dtype) for r in rows}


def release() -> None:
    """Give memory that a task has freed back to the system, before its worker idles (glibc; elsewhere nothing)."""
    import ctypes
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def packed(array: np.ndarray) -> bytes:
    return zlib.compress(array.tobytes(), 1)
