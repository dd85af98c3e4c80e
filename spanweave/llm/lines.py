"""Line dedup: two Bloom filters find lines seen twice; only those shuffle for the exact count.

Pass 1 builds, in every task, a filter of hashes seen once and one of hashes
seen twice; the blocks of all tasks merge with ``twice |= other.twice | (once
& other.once)``, which can add false alarms but never miss a line held by two
documents. The merged twice filter has a fixed size (``bloom_bits / 8``
bytes), whatever the input, and is broadcast. Pass 2 sends only the suspected
lines, with their whole key, to a grouped exact count; the largest document id
that holds a repeated line keeps it. If the filter fills up at a larger
input, more lines shuffle and the result is the same.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm._bloom import held, twice_filter
from spanweave.llm._store import stored

BLANK = b" \t\n\x0b\x0c\r"
_TAIL = bytes(range(0x80, 0xC0))


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """Keys of all lines with at least ``min_chars`` code points: blanks stripped, A-Z lower-cased."""
    out = []
    for line in text.lower().split(b"\n"):
        if len(line) >= min_chars:
            key = line.strip(BLANK)
            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.translate(None, _TAIL)) >= min_chars):
                out.append(key)
    return out


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def _texts(column: pa.Array):
    for t in column.cast(pa.large_binary()):
        yield t.as_py() or b""


def suspected_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, bloom_bits: int) -> DataFrame:
    """``(id, key, h)``: the lines whose hash the twice filter holds, once a row."""
    spark = docs.sparkSession

    def hashes(batch):
        yield _hashes(k for t in _texts(batch.column(0)) for k in set(line_keys(t, min_chars)))

    bits = spark.sparkContext.broadcast(twice_filter(docs.select(F.col(text_col)), hashes, bloom_bits))

    def pick(batches):
        for batch in batches:
            ids, keys, hs = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                own = list(set(line_keys(t, min_chars)))
                if not own:
                    continue
                h = _hashes(own)
                for j in np.flatnonzero(held(bits.value, h)).tolist():
                    ids.append(i)
                    keys.append(own[j])
                    hs.append(int(h[j].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(hs, pa.int64())], ["id", "key", "h"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(pick, "id bigint, key binary, h bigint")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, bloom_bits: int = 1 << 26) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without blanks (0x20, 0x09-0x0D) at both ends,
    A-Z lower-cased. A key of at least ``min_chars`` code points found in at
    least ``min_docs`` documents loses all its lines except those of the
    largest id that holds it; the rest stay, joined by line feeds.

    Null or empty text has one (empty) line and stays as it is. Rows with the
    same id are one document. Rows with a null id count as no document and
    keep no repeated line. Ties cannot occur: the largest id is one document.
    Other columns pass through; input columns named ``n_lines`` or
    ``n_dropped`` are replaced. An empty table gives an empty table.
    """
    lines = stored(suspected_lines(docs, id_col, text_col, min_chars, bloom_bits), "lines")
    repeated = (lines.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
                .where(F.col("n") >= min_docs).select(F.col("key").alias("k"), "keeper"))
    # two stored tables: their join is a broadcast, or two plain shuffles of which a hot line's partition can be split
    drops = (lines.join(stored(repeated, "repeated-lines"), F.col("key") == F.col("k"))
             .where(~F.col("id").eqNullSafe(F.col("keeper")))
             .groupBy(F.col("id").alias("drop_id")).agg(F.collect_set("h").alias("drop_keys")))

    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def keep(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = []
        for text, drop in zip(texts, keys):
            if text is None:
                rows.append((None, 1, 0))
                continue
            if drop is None or not len(drop):
                rows.append((text, text.count("\n") + 1, 0))
                continue
            gone = set(drop.tolist())
            raw = text.encode()
            own = [x for x in raw.split(b"\n")]
            left = []
            for line, low in zip(own, raw.lower().split(b"\n")):
                key = low.strip(BLANK)
                short = len(key) < min_chars or len(key.translate(None, _TAIL)) < min_chars
                if short or int(np.uint64(xxhash.xxh3_64_intdigest(key)).view(np.int64)) not in gone:
                    left.append(line)
            rows.append((b"\n".join(left).decode(), len(own), len(own) - len(left)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    wide = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("own_id"))
    cut = (wide.join(drops, F.col("own_id").eqNullSafe(F.col("drop_id")), "left")
           .select("row", keep(F.col("row").getField(text_col), "drop_keys").alias("cut")))
    kept = [F.col("cut").getField("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
            for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return cut.select(*kept, F.col("cut.n_lines").alias("n_lines"), F.col("cut.n_dropped").alias("n_dropped"))
