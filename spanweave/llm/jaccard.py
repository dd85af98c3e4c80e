"""N-gram Jaccard join: a grouped prefix join that returns similarity components.

Shingles are ordered rarest first, by a fixed-size count sketch of the corpus
and then by hash; any such order is exact, the sketch only keeps shared
passages out of the prefixes. Two sets that are similar enough share a
shingle of their prefixes, and are at most a tenth apart in size.

* Documents with equal sets are one class; classes with the same prefix and
  size are one group, which stands for all its members in the join.
* Every prefix shingle that two groups hold names a hub: of its groups the
  one with the fewest shingles of its own, mostly the text that the others
  were copied from. One order names all hubs, so a family has few of them.
  Each group is sent once to each of its hubs: whoever shares a shingle meets.
* At a hub the groups expand to classes. Pairs that a parity bitmap of their
  sets rules out are dropped; the others are verified exactly, by counting
  common shingles block against block. A hub with many members
  is split into blocks of bounded size, and each pair of blocks is a task of
  its own. Only the links of a spanning forest leave a task, never all pairs.
"""
from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm._arrays import mix64, row_ranges, shingle_sets
from spanweave.llm._bloom import held, twice_filter
from spanweave.llm._graph import components
from spanweave.llm._store import merged_blocks, packed, release, stored

_U = np.uint64
SKETCH_BLOCK = 1 << 16
VOCABULARY_CHUNK = 1 << 12
PARITY_BITS = 1024


def shingle_sketch(docs: DataFrame, text_col: str, k: int, bits: int) -> np.ndarray:
    """How many documents hold the shingles of each of ``2**bits`` hash slots (uint16, 65535 stands for more; a fixed size)."""
    block = min(SKETCH_BLOCK, 1 << bits)

    def count(batches):
        sums = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for lo, hi in row_ranges(batch.column(0)):
                sets = shingle_sets(batch.column(0).slice(lo, hi - lo), k)
                at = (np.concatenate(sets) >> _U(64 - bits)).astype(np.int64)
                slots, n = np.unique(at, return_counts=True)
                sums[slots] = np.minimum(sums[slots].astype(np.int64) + n, 65535)
        for b in np.flatnonzero(sums.reshape(-1, block).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([packed(sums[b * block:(b + 1) * block])], pa.binary())], ["block", "payload"])
        del sums
        release()

    def fold(total, more):
        total[:] = np.minimum(total.astype(np.uint32) + more, 65535)

    parts = docs.select(F.col(text_col)).mapInArrow(count, "block int, payload binary")
    out = np.zeros(1 << bits, np.uint16)
    for b, x in merged_blocks(parts, (1 << bits) // block, "uint16", block, fold).items():
        out[b * block:(b + 1) * block] = x
    return out


def _print(values: np.ndarray) -> bytes:
    """128-bit fingerprint of a set of hashes (independent of their order)."""
    return struct.pack(">QQ", int(mix64(values ^ _U(0xA5A5A5A5DEADBEEF)).sum(dtype=_U)), int(mix64(values * _U(0xD6E8FEB86659FD93)).sum(dtype=_U)))


def prefix_sets(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """``(id, n, fp, gid, prefix, bits)``: set size, fingerprints of the set and of its prefix with the size, the prefix, a parity bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    shift = _U(64 - (len(sketch).bit_length() - 1))

    def make(batches):
        weight = shared.value
        for batch in batches:
            for lo, hi in row_ranges(batch.column(1)):
                n, fp, gid, prefix, bits = [], [], [], [], []
                for s in shingle_sets(batch.column(1).slice(lo, hi - lo), k):
                    n.append(len(s))
                    fp.append(_print(s))
                    length = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    head = s[np.lexsort((s, weight[(s >> shift).astype(np.int64)]))[:length]]
                    gid.append(_print(np.append(head, _U(len(s)))))
                    prefix.append(head.view(np.int64))
                    bits.append(np.packbits(np.bincount((s & _U(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes())
                off = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(gid, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(prefix) if prefix else [], pa.int64())),
                     pa.array(bits, pa.binary())], ["id", "n", "fp", "gid", "prefix", "bits"])
        release()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col)).mapInArrow(
        make, "id bigint, n bigint, fp binary, gid binary, prefix array<bigint>, bits binary")


def hub_visits(sets: DataFrame, num: int, den: int, bloom_bits: int) -> DataFrame:
    """``(hub, gid)``: the hubs that each group is sent to, the hub too; a group of several classes visits itself.

    A shingle only counts where two groups of a linkable size hold it in their
    prefixes. Sizes are cut into bands as wide as a link can span, so a pair
    lies in one band or in two neighbours: each entry stands in its own band
    and the next. Entries whose shingle a twice filter does not hold are left
    out before anything shuffles.
    """
    groups = stored(sets.where("n > 0").select("gid", "n", "prefix").dropDuplicates(["gid"]), "groups")

    def tokens(batch):
        yield batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(_U)

    bits = sets.sparkSession.sparkContext.broadcast(twice_filter(groups.select("prefix"), tokens, bloom_bits))
    width = math.log(den / num) if num < den else 1.0

    def spread(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            token = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), sizes)
            known = held(bits.value, token.view(_U))
            own = (sizes - np.bincount(owner, known, len(lists))).astype(np.int32)
            keep = np.flatnonzero(known)
            band = np.floor(np.log(batch.column(1).to_numpy()[owner[keep]].astype(np.float64)) / width).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner[keep])), pa.array(token[keep]), pa.array(own[owner[keep]]), pa.array(band)],
                ["gid", "token", "alone", "band"])

    entries = groups.select("gid", "n", "prefix").mapInArrow(spread, "gid binary, token bigint, alone int, band bigint")
    entries = stored(entries, "entries").select("gid", "token", "alone", F.explode(F.array(
        F.struct("band", F.lit(1).alias("own")), F.struct((F.col("band") + 1).alias("band"), F.lit(0).alias("own")))).alias("b")).select(
        "gid", "token", "alone", "b.band", "b.own")
    hubs = (entries.groupBy("token", "band").agg(F.count("*").alias("several"), F.sum("own").alias("some"), F.min(F.struct("alone", "gid")).alias("first"))
            .where("several > 1 and some > 0").select(F.col("token").alias("t"), F.col("band").alias("b"), F.col("first.gid").alias("hub")))
    several = (sets.where("n > 0").select("gid", "fp").distinct().groupBy("gid").agg(F.count("*").alias("classes"))
               .where("classes > 1").select(F.col("gid").alias("hub"), "gid"))
    return (entries.join(hubs, (F.col("token") == F.col("t")) & (F.col("band") == F.col("b"))).select("hub", "gid")
            .unionByName(several).distinct())


def _links(sets: list[np.ndarray], names: list[str], num: int, den: int) -> list[tuple[str, str]]:
    """A spanning forest of the links between sets, whose sizes of intersection come from a chunked matrix product."""
    m = len(sets)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    common = counts[inverse] > 1
    ids = np.cumsum(counts > 1) - 1
    token, owner = ids[inverse[common]], owner[common]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    inter = np.zeros((m, m), np.float32)
    total = int((counts > 1).sum())
    for lo in range(0, total, VOCABULARY_CHUNK):
        a, b = np.searchsorted(token, [lo, lo + VOCABULARY_CHUNK])
        member = np.zeros((m, min(VOCABULARY_CHUNK, total - lo)), np.float32)
        member[owner[a:b], token[a:b] - lo] = 1
        inter += member @ member.T
    inter = np.rint(inter).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    near = den * inter >= num * union
    i, j = np.nonzero(np.triu(near, 1))
    root = list(range(m))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((names[a], names[b]))
    return out


def block_pairs(at_hub: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """``at_hub (hub, fp, n, ...)`` with each hub's rows dealt to pairs of blocks ``(x, y)``.

    Blocks go by fingerprint, with about ``block_rows`` rows and
    ``block_shingles`` shingles each; every pair of blocks of a hub meets
    once. Hubs with one row are left out.
    """
    split = at_hub.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1").select(
        F.col("hub").alias("h"), F.ceil(F.greatest(F.col("m") / F.lit(block_rows), F.col("s") / F.lit(block_shingles))).cast("int").alias("blocks"))
    rest = [c for c in at_hub.columns if c != "hub"]
    return (at_hub.join(split, F.col("hub") == F.col("h"))
            .withColumn("x", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
            .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("hub", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), *rest))


def possible_partners(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """``(at, who)``: the rows of ``pairs (hub, x, y, fp, n, bits)`` that may link with another of their block pair.

    Two sets differ in at least as many shingles as their parity bitmaps
    differ in bits, which bounds the intersection from above; so no link is
    lost, and nearly all chance meetings go without their texts being sent.
    """
    sent = pairs.select("hub", "x", "y", "fp", "n", "bits").repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y", "fp")

    def keep(rows):
        if len(rows) < 2:
            return []
        n = np.array([r[1] for r in rows], np.int64)
        bits = np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
        ones = bits.sum(axis=1)
        apart = np.rint(ones[:, None] + ones[None, :] - 2 * (bits @ bits.T)).astype(np.int64)
        total = n[:, None] + n[None, :]
        common = np.minimum((total - apart) // 2, np.minimum(n[:, None], n[None, :]))
        near = den * common >= num * (total - common)
        np.fill_diagonal(near, False)
        return [rows[i][0] for i in np.flatnonzero(near.any(axis=1)).tolist()]

    def check(batches):
        at, rows, out = None, [], []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["at", "who"])

        for batch in batches:
            for hub, x, y, fp, n, bits in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if (hub, x, y) != at:
                    out += [(at[0], f) for f in keep(rows)] if rows else []
                    at, rows = (hub, x, y), []
                rows.append((fp, n, bits))
            yield emit()
            out = []
        out = [(at[0], f) for f in keep(rows)] if rows else []
        yield emit()

    return sent.mapInArrow(check, "at binary, who binary").distinct()


def verified_links(pairs: DataFrame, k: int, num: int, den: int, check_print: bool) -> DataFrame:
    """``(a, b)``: a spanning forest of the links among the texts of each block pair of ``pairs (hub, x, y, fp, text)``.

    With ``check_print`` only texts whose set has the fingerprint count.
    """
    sent = pairs.select("hub", "x", "y", "fp", "text").repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y", "fp")

    def verify(batches):
        at, names, sets, out = None, [], [], []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

        for batch in batches:
            hubs, xs, ys, fps = (batch.column(c).to_pylist() for c in range(4))
            for lo, hi in row_ranges(batch.column(4)):
                for i, s in zip(range(lo, hi), shingle_sets(batch.column(4).slice(lo, hi - lo), k)):
                    key = (hubs[i], xs[i], ys[i])
                    if key != at:
                        out += _links(sets, names, num, den)
                        at, names, sets = key, [], []
                    if (not names or names[-1] != fps[i]) and (not check_print or _print(s) == fps[i]):
                        names.append(fps[i])
                        sets.append(s)
            yield emit()
            out = []
        out = _links(sets, names, num, den)
        yield emit()
        sets = []
        release()

    return sent.mapInArrow(verify, "a binary, b binary")


def _named(ids: DataFrame, bits: int):
    """A filter for rows whose id is among ``ids``, by a Bloom filter of fixed size; lets a few others through."""
    hashed = ids.select(F.xxhash64(F.col(ids.columns[0])))
    known = ids.sparkSession.sparkContext.broadcast(
        twice_filter(hashed, lambda batch: [batch.column(0).to_numpy().view(_U)], bits, once_only=True))

    @F.pandas_udf("boolean")
    def named(hashes: pd.Series) -> pd.Series:
        return pd.Series(held(known.value, hashes.to_numpy().view(_U)))

    return lambda id_: named(F.xxhash64(id_))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100,
                       sketch_bits: int = 24, bloom_bits: int = 1 << 27, block_rows: int = 512,
                       block_shingles: int = 1 << 20) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``.

    Words are runs outside 0x20 and 0x09-0x0D with A-Z lower-cased. A set is
    the distinct ``k``-word shingles; a text with fewer words gives its whole
    sequence, one without words (or null) the empty set, linked with nothing.
    Sets link when ``den * intersection >= num * union``; ``component_id`` is
    the smallest id reachable, its own id for a row linked with nothing.

    Repeated rows and equal texts share a component. Null ids count as no id:
    a component's id is the smallest non-null one, null if it has none. Only
    the id and text columns are read, whatever other columns are called. An
    empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sets = stored(prefix_sets(docs, "id", "text", k, num, den, shingle_sketch(docs, "text", k, sketch_bits)), "sets")
    classes = stored(sets.where("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.first("gid").alias("gid"), F.first("n").alias("n"),
                                                           F.first("bits").alias("bits")), "classes")
    visits = hub_visits(sets, num, den, bloom_bits)
    at_hub = stored(visits.join(classes, "gid").select("hub", "fp", "n", "rep", "bits"), "visits")
    partners = possible_partners(block_pairs(at_hub, block_rows, block_shingles), num, den)
    at_hub = stored(at_hub.join(partners, (F.col("hub") == F.col("at")) & (F.col("fp") == F.col("who"))).select("hub", "fp", "n", "rep"), "partners")
    texts = docs.where(F.col("id").isNull() | _named(at_hub.select("rep"), bloom_bits >> 2)(F.col("id")))
    pairs = block_pairs(at_hub, block_rows, block_shingles).join(texts, F.col("rep").eqNullSafe(F.col("id")))
    links = stored(verified_links(pairs, k, num, den, check_print=True), "links")  # rows of one id may differ in text
    roots = components(links)
    grouped = classes.select("fp", "rep").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    low = grouped.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "r")
    named = grouped.join(low, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return (sets.select("id", "n", "fp").join(named, (F.col("fp") == F.col("f")) & (F.col("n") > 0), "left")
            .select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows with the same id are one document, of which one row stays. Rows with
    a null id cannot be named as a copy and all stay. Columns are unchanged.
    """
    found = similar_components(docs, id_col, text_col, **how)
    keep = found.where("id = component_id").select(F.col("id").alias("keep_id")).distinct()
    wide = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("own_id"))
    named = wide.where("own_id is not null").join(keep, F.col("own_id") == F.col("keep_id"), "left_semi").dropDuplicates(["own_id"])
    return named.unionByName(wide.where("own_id is null")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
