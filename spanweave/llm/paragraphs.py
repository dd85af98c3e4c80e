"""Substring dedup by paragraph MinHash banding.

A text's units are paragraphs with content-defined borders: a word ends one if
its rank (sentence and line ends first, then a hash of the last two words) is
the least among its neighbours, so a passage is cut alike wherever it stands,
also when it begins and ends inside a sentence, and every word of a text is in
a unit that is long enough to be compared. Equal units form a class, named by
a 128-bit print of its shingles. MinHash signatures of 5-word shingles are cut
into bands that :func:`tune` chooses for high recall with few keys; band keys
shuffle as pairs of numbers (each pair of key and class once a batch), and classes that share a key meet at
the smallest of them; a class that comes twice is seen there too. A second
pass over the texts writes the units of the classes that repeat or meet
another, with the text of the latter: these
are verified by exact Jaccard in blocks, and components of the links are
clusters. The first unit of a cluster stays, the others go.

What tasks get as a filter is sized from a count and at most ``filter_bits``
large; a full filter lets more rows shuffle and changes no result.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm._arrays import mix64, row_ranges, utf8, word_hashes, words
from spanweave.llm._bloom import held, twice_filter
from spanweave.llm._graph import components
from spanweave.llm._store import release, stored
from spanweave.llm.jaccard import block_pairs, verified_links

_U = np.uint64
_SEEDS = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def tune(similarity: float, recall: float, rows: int = 2, most: int = 96) -> tuple[int, int]:
    """``(bands, rows)``: the fewest bands whose recall at ``similarity`` is ``recall`` or more, with ``rows`` hashes each (one, if ``most`` is not enough).

    Every band is a key that shuffles for every unit, while a chance meeting
    costs one comparison, so few keys go before selective ones.
    """
    for rows in range(rows, 0, -1):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - similarity ** rows) ** bands >= recall:
                return bands, rows
    return most, 1


@dataclass(frozen=True)
class Paragraphs:
    """Cuts texts into paragraphs: together they hold all its words, each ``least`` to ``most`` words (a shorter text is one).

    A word ends a paragraph if its rank is the smallest among ``least - 1``
    words on either side (the first of equal ones). The ends of the text rank
    first, ends of sentences and lines second, then the hash of the word and
    the one before in its sentence. Where that leaves more than ``most`` words, cuts follow the
    last border at fixed steps.
    """

    least: int = 6
    most: int = 32

    def borders(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The last word of each paragraph, for texts given by their bytes, words (as from ``words``) and word hashes."""
        n, near = len(starts), self.least - 1
        if not n:
            return np.zeros(0, np.int64)
        last = np.zeros(n, bool)
        last[first[1:][np.diff(first) > 0] - 1] = True
        stop = _STOP[data[ends - 1]]
        after = np.searchsorted(starts, np.flatnonzero(data == 10))  # the word after each line end
        stop[after[(after > 0) & (after < n)] - 1] = True
        before = np.concatenate([[_U(0)], np.where((stop | last)[:-1], _U(0), hashes[:-1])])
        rank = (mix64(hashes + before * _U(0x9E3779B97F4A7C15)) >> _U(2)) | np.where(stop, _U(1 << 62), _U(2 << 62))
        rank[last] = 0
        around = np.concatenate([np.zeros(near, _U), rank, np.zeros(near, _U)])
        low = np.arange(n)
        for j in range(1, near + 1):
            own = rank[low]
            low = low[(own < around[low + (near - j)]) & (own <= around[low + (near + j)])]
        border = last
        border[low] = True
        step = 3 * self.most // 4
        at = np.concatenate([[-1], np.flatnonzero(border)])
        for i in np.flatnonzero(np.diff(at) > self.most).tolist():
            a, b = int(at[i]), int(at[i + 1])
            while b - a > self.most:
                a += step
                border[a] = True
        return np.flatnonzero(border)

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """Spans of each text's paragraphs, in characters."""
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        starts, ends, first = words(data, offsets)
        to = self.borders(data, starts, ends, first, word_hashes(data, starts, ends))
        if not len(to):
            return [[] for _ in texts]
        head = np.concatenate([[0], to[:-1] + 1])
        own = np.searchsorted(first, to, "right") - 1
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = chars[offsets[own]]
        spans = list(zip((chars[starts[head]] - base).tolist(), (chars[ends[to]] - base).tolist()))
        cuts = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
        return [spans[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


paragraphs = Paragraphs()


def _rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on, as far as there are ``k``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, _U)
    for j in range(k):
        out += hashes[j:n + j] * (_SEEDS[96 + j] | _U(1))
    return mix64(out)


class _Units:
    """Units of ``k`` words and ``min_words`` or more in a string column: row and number in it, shingle counts ``n`` and hashes."""

    def __init__(self, column: pa.Array, split: Paragraphs, k: int, min_words: int):
        self.data, offsets = utf8(column)
        starts, ends, first = words(self.data, offsets)
        hashes = word_hashes(self.data, starts, ends)
        to = split.borders(self.data, starts, ends, first, hashes)
        head = np.concatenate([[0], to + 1])[:-1]
        row = np.searchsorted(first, to, "right") - 1
        kept = np.flatnonzero(to - head + 1 >= max(min_words, k))
        head, to = head[kept], to[kept]
        self.row, self.number = row[kept], (kept - np.searchsorted(row, row[kept])).astype(np.int32)
        self.begin, self.end = starts[head], ends[to]
        self.n = to - head + 2 - k
        self.at = np.cumsum(self.n) - self.n
        self.flat = _rolling(hashes, k)[np.repeat(head - self.at, self.n) + np.arange(self.n.sum())]

    def text(self, i: int) -> bytes:
        return self.data[self.begin[i]:self.end[i]].tobytes()

    def prints(self) -> np.ndarray:
        """Two 64-bit numbers a unit, equal for equal sequences of shingles."""
        if not len(self.n):
            return np.zeros((0, 2), _U)
        place = (2 * (np.arange(len(self.flat)) - np.repeat(self.at, self.n)) + 1).astype(_U)
        return np.stack([np.add.reduceat(mix64(self.flat ^ s) * place, self.at) for s in _SEEDS[-2:]], axis=1)

    def keys(self, bands: int, rows: int) -> np.ndarray:
        """Band keys (units x bands)."""
        out = np.empty((len(self.n), bands), _U)
        for b in range(bands if len(self.n) else 0):
            key = np.full(len(self.n), _U(b + 1))
            for r in range(rows):
                key = mix64(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix64(self.flat ^ _SEEDS[b * rows + r]), self.at))
            out[:, b] = key
        return out


def _names(prints: np.ndarray) -> pa.Array:
    """Prints as binary values of 16 bytes."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(prints), [None, pa.py_buffer(prints.astype(">u8").tobytes())]).cast(pa.binary())


def _unit_groups(column: pa.Array, split: Paragraphs, k: int, min_words: int, size: int = 1 << 19):
    """First row and units of groups of texts of bounded length."""
    for lo, hi in row_ranges(column, size):
        units = _Units(column.slice(lo, hi - lo), split, k, min_words)
        if len(units.n):
            yield lo, units


def _filter(values: DataFrame, filter_bits: int):
    """Broadcast filter of the 64-bit numbers of ``values``: 16 bits for each of them, at most ``filter_bits`` in all."""
    bits = min(filter_bits, max(1 << 16, 1 << (16 * values.count()).bit_length()))
    return values.sparkSession.sparkContext.broadcast(
        twice_filter(values, lambda batch: [batch.column(0).to_numpy().astype(np.int64).view(_U)], bits, once_only=True))


def meetings(docs: DataFrame, text_col: str, k: int, min_words: int, bands: int, rows: int, split: Paragraphs) -> DataFrame:
    """``(hub, p)``: classes (by the first half of their print) that share a band key, with the smallest of each key; a class that repeats, with itself."""
    def emit(batches):
        for batch in batches:
            for _, units in _unit_groups(batch.column(0), split, k, min_words):
                prints, key = units.prints(), units.keys(bands, rows)
                order = np.lexsort((prints[:, 1], prints[:, 0]))
                same = np.zeros(len(order) + 1, bool)
                same[1:-1] = (prints[order[1:]] == prints[order[:-1]]).all(axis=1)
                one, two = order[~same[:-1]], order[~same[:-1] & same[1:]]  # a class that comes again in the group sends its first key twice
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[one].ravel(), key[two, 0]]).view(np.int64)),
                                                  pa.array(np.concatenate([np.repeat(prints[one, 0], bands), prints[two, 0]]).view(np.int64))], ["key", "p"])
        release()

    def meet(batches):
        held = None  # key, hub and class of the row before
        for batch in batches:
            key, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            begin = np.ones(len(key), bool)
            begin[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), bool)
            again[1:] = ~begin[1:] & (p[1:] == p[:-1])
            hub = p[np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))]
            if held is not None and held[0] == key[0]:
                hub[:len(key) if begin[1:].sum() == 0 else 1 + int(np.argmax(begin[1:]))] = held[1]
                again[0] = held[2] == p[0]
            held = key[-1], hub[-1], p[-1]
            other = (hub != p) & ~again
            again[1:] &= ~again[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([hub[other], p[again]])), pa.array(np.concatenate([p[other], p[again]]))], ["hub", "p"])

    keyed = docs.select(F.col(text_col)).mapInArrow(emit, "key bigint, p bigint")
    return stored(keyed.repartition("key").sortWithinPartitions("key", "p").mapInArrow(meet, "hub bigint, p bigint").distinct(), "meetings")


def unit_places(docs: DataFrame, id_col: str, text_col: str, k: int, min_words: int, met: DataFrame, visits: DataFrame, filter_bits: int,
                split: Paragraphs) -> DataFrame:
    """``(id, unit, p, fp, n, text)``: units of the classes of ``met``; the text stands once a group, for classes of ``visits``."""
    wanted = _filter(met.select("p").unionByName(met.select(F.col("hub").alias("p"))).distinct(), filter_bits)
    compared = _filter(visits.select("p").distinct(), filter_bits)

    def emit(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, units in _unit_groups(batch.column(1), split, k, min_words):
                prints = units.prints()
                some = np.flatnonzero(held(wanted.value, prints[:, 0]))
                prints = prints[some]
                order = np.lexsort((prints[:, 1], prints[:, 0]))
                first = np.ones(len(order), bool)
                first[1:] = (prints[order[1:]] != prints[order[:-1]]).any(axis=1)
                sent = np.zeros(len(order), bool)
                sent[order[first]] = True
                sent &= held(compared.value, prints[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(units.row[some] + lo)), pa.array(units.number[some]), pa.array(prints[:, 0].view(np.int64)), _names(prints),
                     pa.array(units.n[some]), pa.array([units.text(i) if s else None for i, s in zip(some.tolist(), sent.tolist())], pa.string())],
                    ["id", "unit", "p", "fp", "n", "text"])
        release()

    return stored(docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(
        emit, "id bigint, unit int, p bigint, fp binary, n bigint, text string"), "unit-places")


def linked_classes(places: DataFrame, visits: DataFrame, k: int, num: int, den: int, block_rows: int, block_shingles: int) -> DataFrame:
    """``(node, root)``: classes that are linked with another by Jaccard ``num / den``, and the smallest of their cluster."""
    classes = places.where("text is not null").groupBy("p", "fp", "n").agg(F.first("text").alias("text"))
    at_hub = stored(visits.join(classes, "p").select("hub", "fp", "n", "text"), "unit-visits")
    return components(stored(verified_links(block_pairs(at_hub, block_rows, block_shingles), k, num, den, check_print=False), "unit-links"))


def repeated_units(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, min_words: int, recall: float, filter_bits: int,
                   block_rows: int, block_shingles: int, split: Paragraphs) -> DataFrame:
    """``(id, unit, first_id)``: units that repeat an earlier one of their cluster, and the document where that stands.

    Places are counted by class first, so a class or cluster of any size is a
    row a task before it shuffles; only units of classes that repeat or meet another are written.
    """
    met = meetings(docs, text_col, k, min_words, *tune(num / den, recall), split)
    visits = met.where("hub <> p")
    visits = visits.unionByName(visits.select("hub", F.col("hub").alias("p")).distinct())
    places = unit_places(docs, id_col, text_col, k, min_words, met, visits, filter_bits, split)
    roots = linked_classes(places, visits, k, num, den, block_rows, block_shingles)
    last = F.lit(2**63 - 1)
    place = F.struct(F.coalesce("id", last).alias("id"), "unit")
    classes = places.groupBy("fp").agg(F.min(place).alias("first"), F.count("*").alias("c"))
    classes = (classes.join(roots, F.col("fp") == F.col("node"), "left").where("c > 1 or root is not null")
               .select("fp", F.coalesce("root", "fp").alias("cluster"), "first", "c"))
    classes = stored(classes, "unit-classes")
    clusters = (classes.groupBy("cluster").agg(F.min("first").alias("first"), F.sum("c").alias("c")).where("c > 1")
                .select(F.col("cluster").alias("of"), F.col("first").alias("stays")))
    named = stored(classes.join(clusters, F.col("cluster") == F.col("of")).select(F.col("fp").alias("name"), "stays"), "unit-clusters")
    return (places.join(named, F.col("fp") == F.col("name"))
            .where(~(F.coalesce("id", last).eqNullSafe(F.col("stays.id")) & (F.col("unit") == F.col("stays.unit"))))
            .select("id", "unit", F.when(F.col("stays.id") < last, F.col("stays.id")).alias("first_id")))


def cut_units(text: str, gone: set[int], min_run_words: int, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """A text with units at ``spans`` without its repeated units, and the spans taken out.

    A run of repeated units counts from ``min_run_words`` words on; shorter
    ones stay. Nothing goes but units that repeat.
    """
    runs, run = [], []
    for j in range(len(spans)):
        if j in gone:
            run.append(j)
        elif run:
            runs.append(run)
            run = []
    runs.append(run)
    out = [(spans[r[0]][0], spans[r[-1]][1]) for r in runs if r and sum(len(text[a:b].split()) for a, b in spans[r[0]:r[-1] + 1]) >= min_run_words]
    kept, at = [], 0
    for a, b in out:
        kept.append(text[at:a])
        while b < len(text) and text[b] in " \t":
            b += 1
        line_start = a == 0 or text[a - 1] == "\n"
        if line_start and b < len(text) and text[b] == "\n":
            b += 1
        at = b
    kept.append(text[at:])
    return "".join(kept), out


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5, min_words: int = 6,
                   min_run_words: int = 20, recall: float = 0.98, filter_bits: int = 1 << 28, block_rows: int = 512,
                   block_shingles: int = 1 << 20) -> DataFrame:
    """``docs`` without repeated passages in ``text_col``, plus ``removed`` and ``kept_in``.

    Units are :class:`Paragraphs` of ``min_words`` words at least (only a text
    with fewer words has a shorter one, which stays). They are compared by their ``k``-word shingles (A-Z lower-cased) and cluster
    when the Jaccard similarity is ``num / den`` or more. Of a cluster the
    unit with the smallest (id, position) stays. Of the others, a run goes if
    it has ``min_run_words`` words, and only units that repeat go; ``removed`` holds the spans (characters
    of the input text) and ``kept_in`` the ids of the documents where the
    units still stand. Collisions are found with probability ``recall`` at
    the threshold, and always for equal units. Documents that lose nothing
    do not shuffle.

    Null or empty texts stay; null ids sort last. Rows with one id are one
    document: equal rows are cut alike. Other columns pass through; input
    columns named ``removed`` or ``kept_in`` are replaced. No rows give none.
    """
    split = Paragraphs(min_words)
    found = repeated_units(docs, id_col, text_col, k, num, den, min_words, recall, filter_bits, block_rows, block_shingles, split)
    found = stored(found, "repeated-units")
    drops = found.groupBy(F.col("id").alias("drop_id")).agg(F.collect_set("unit").alias("gone"), F.collect_set(F.struct("unit", "first_id")).alias("stands"))

    @F.pandas_udf("text string, removed array<struct<start:int,end:int>>, units array<int>")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows, texts, gone = [], texts.tolist(), gone.tolist()
        for lo, hi in row_ranges(pa.array(texts, pa.large_string())):
            for text, drop, at in zip(texts[lo:hi], gone[lo:hi], split(texts[lo:hi])):
                if text is None or drop is None:
                    rows.append((text, [], []))
                    continue
                left, spans = cut_units(text, set(drop.tolist()), min_run_words, at)
                inside = [j for j in drop.tolist() if any(x <= at[j][0] and at[j][1] <= y for x, y in spans)]
                rows.append((left, [{"start": a, "end": b} for a, b in spans], inside))
        return pd.DataFrame(rows, columns=["text", "removed", "units"])

    some = _filter(found.select(F.xxhash64("id")).distinct(), filter_bits)

    @F.pandas_udf("boolean")
    def touched(hashes: pd.Series) -> pd.Series:
        return pd.Series(held(some.value, hashes.to_numpy().view(_U)))

    wide = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("own_id")).withColumn("touched", touched(F.xxhash64("own_id")))
    none, ids = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<bigint>")
    names = [c for c in docs.columns if c not in ("removed", "kept_in")]

    def columns(text, removed, kept_in):
        return [*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names), removed.alias("removed"), kept_in.alias("kept_in")]

    out = (wide.where("touched").join(drops, F.col("own_id").eqNullSafe(F.col("drop_id")), "left")
           .select("row", "stands", cut(F.col("row").getField(text_col), "gone").alias("cut")))
    stands = F.filter("stands", lambda s: F.array_contains(F.col("cut.units"), s.getField("unit")) & s.getField("first_id").isNotNull())
    kept_in = F.coalesce(F.array_sort(F.array_distinct(F.transform(stands, lambda s: s.getField("first_id")))), ids)
    return (out.select(*columns(F.col("cut.text"), F.col("cut.removed"), kept_in))
            .unionByName(wide.where("not touched").select(*columns(F.col("row").getField(text_col), none, ids))))
