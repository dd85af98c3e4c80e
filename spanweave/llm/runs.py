"""Periodic runs of words, found through a Re-Pair grammar of each text.

A run is a maximal stretch with smallest period ``q`` and at least
``max(least, 2 * q)`` words. Every run lies whole in some node of a text's
derivation tree and crosses that node's border between left and right child.
So each distinct nonterminal is searched once, at its border, and what is
found is translated to all places where the nonterminal stands; of intervals
with one period only the maximal ones are runs.

Words that no run can hold are set aside first: a run of ``least = 12`` words
repeats each of its 6-word windows but one, so only stretches covered by
windows that come twice go to the grammar. The search at the borders asks for
longest common extensions; they are answered for all borders of a batch at
once by names of blocks of 2, 4, 8 ... words (equal names: equal words).
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import let
from spanweave.llm._arrays import mix64, row_ranges, utf8, words
from spanweave.llm._store import release

_U = np.uint64
_COEF = np.random.default_rng(1207).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BLOCK = 1 << 19


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal bytes and only for those."""
    if not len(starts):
        return np.zeros(0, np.int64)
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    body = data[np.cumsum(inside[:-1]).astype(bool)]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def stretches(ids: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal stretches ``[a, b)`` of words that a run may hold; ``first`` has the borders of the texts.

    Windows of ``least // 2`` words are compared by hash within a text, and
    again within what is left, until nothing more can be set aside.
    """
    w = least // 2
    lo, hi = first[:-1].astype(np.int64), first[1:].astype(np.int64)
    while True:
        long = hi - lo >= least
        lo, hi = lo[long], hi[long]
        if not len(lo):
            return []
        size = hi - lo - w + 1
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = np.zeros(len(at), _U)
        for j in range(w):
            key += mix64(ids[at + j].astype(_U) + _COEF[32 + j]) * _COEF[j]
        part = np.repeat(np.arange(len(lo)), size)
        key = mix64(key) ^ mix64(part.astype(_U) + _COEF[31])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        # cover of the repeated windows, cut at the borders of the parts
        total = int(hi.max()) + 1
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + w, -1)
        held = np.cumsum(cover[:-1]) > 0
        begin = held.copy()
        begin[1:] &= ~held[:-1]
        begin[lo] |= held[lo]
        end = held.copy()
        end[:-1] &= ~held[1:]
        end[hi - 1] |= held[hi - 1]
        new_lo, new_hi = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if len(new_lo) == len(lo) and (new_lo == lo).all() and (new_hi == hi).all():
            return list(zip(lo.tolist(), hi.tolist()))
        lo, hi = new_lo, new_hi


def re_pair(sequence: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Re-Pair: ``(rules, rest)``; symbol ``-1 - r`` stands for ``rules[r]``, terminals are 0 or more.

    The most frequent pair of neighbours (the one seen first among equals) gets
    a symbol, until no pair comes twice.
    """
    symbols: list = list(sequence)
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], dict[int, None]] = {}
    for i in range(n - 1):
        places.setdefault((symbols[i], symbols[i + 1]), {})[i] = None
    serial = {p: k for k, p in enumerate(places)}
    queue = [(-len(at), serial[p], p) for p, at in places.items() if len(at) > 1]
    heapq.heapify(queue)
    rules: list[tuple[int, int]] = []

    def gone(pair, i):
        at = places.get(pair)
        if at is not None:
            at.pop(i, None)

    while queue:
        count, _, pair = heapq.heappop(queue)
        at = places.get(pair)
        if at is None or len(at) < 2:
            continue
        if len(at) != -count:
            heapq.heappush(queue, (-len(at), serial[pair], pair))
            continue
        left, right = pair
        taken, last = [], -1  # copies that do not overlap
        for i in sorted(at) if left == right else at:
            if left != right or i != last:
                taken.append(i)
                last = after[i]
        del places[pair]
        if len(taken) < 2:
            continue
        rules.append(pair)
        new = -len(rules)
        touched = {}
        for i in taken:
            j = after[i]
            k, h = after[j], before[i]
            if h >= 0:
                gone((symbols[h], left), h)
                p = (symbols[h], new)
                places.setdefault(p, {})[h] = None
                touched[p] = None
            if k < n:
                gone((right, symbols[k]), j)
                before[k] = i
                p = (new, symbols[k])
                places.setdefault(p, {})[i] = None
                touched[p] = None
            symbols[i], symbols[j] = new, None
            after[i] = k
        for p in touched:
            serial.setdefault(p, len(serial))
            if len(places.get(p, ())) > 1:
                heapq.heappush(queue, (-len(places[p]), serial[p], p))
    return rules, [s for s in symbols if s is not None]


def borders(sequence: list[int], base: int, least: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """The nonterminals of ``least`` words or more: ``(start, border, end)`` of one derivation, and the starts of all.

    What Re-Pair leaves over is joined pair by pair, level by level, so the
    tree above the rules is balanced. Places count from ``base``.
    """
    rules, rest = re_pair(sequence)
    nodes = list(rules)
    level = rest
    while len(level) > 1:
        above = []
        for i in range(0, len(level) - 1, 2):
            nodes.append((level[i], level[i + 1]))
            above.append(-len(nodes))
        level = above + level[len(level) - len(level) % 2:]
    size = []
    for left, right in nodes:
        size.append((size[-1 - left] if left < 0 else 1) + (size[-1 - right] if right < 0 else 1))
    starts: list[list[int]] = [[] for _ in nodes]
    if nodes and level[0] < 0:
        starts[-1 - level[0]].append(base)
    found, at = [], []
    for x in range(len(nodes) - 1, -1, -1):  # a node's parents come after it
        if size[x] < least or not starts[x]:
            continue
        left, right = nodes[x]
        width = size[-1 - left] if left < 0 else 1
        if left < 0 and size[-1 - left] >= least:
            starts[-1 - left] += starts[x]
        if right < 0 and size[-1 - right] >= least:
            starts[-1 - right] += [s + width for s in starts[x]]
        first = starts[x][0]
        found.append((first, first + width, first + size[x]))
        at.append(starts[x])
    return found, at


class Extensions:
    """Longest common extensions inside one array of numbers, by names of blocks of 2**k entries."""

    def __init__(self, values: np.ndarray, longest: int):
        self.n = len(values)
        self.names = [np.unique(values, return_inverse=True)[1].astype(np.int32)]
        step = 1
        while 2 * step <= min(longest, self.n):
            low = self.names[-1].astype(np.int64)
            both = (low[:-step] << 32) | low[step:] if step < self.n else low[:0]
            self.names.append(np.unique(both[:self.n - 2 * step + 1], return_inverse=True)[1].astype(np.int32))
            step *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many entries from ``i`` and from ``j`` (``i < j``) on agree."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            for _ in range(2 if k == len(self.names) - 1 else 1):
                fits = j + out < len(names)
                a, b = np.where(fits, i + out, 0), np.where(fits, j + out, 0)
                out += np.where(fits & (names[a] == names[b]), 1 << k, 0)
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many entries before ``i`` and before ``j`` (``i < j``) agree."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            for _ in range(2 if k == len(self.names) - 1 else 1):
                a = i - out - step
                fits = a >= 0
                a, b = np.where(fits, a, 0), np.where(fits, j - out - step, 0)
                out += np.where(fits & (names[a] == names[b]), step, 0)
        return out


def crossing(lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, ext: Extensions, least: int) -> np.ndarray:
    """``(node, start, end, period)``: per node its maximal stretches with ``max(least, 2 * period)`` words at its border.

    A stretch with period ``q`` has ``q`` words on one side of the border, so
    it shows as an extension of the ``q`` words right of it, or left of it.
    """
    found = []
    for side in (0, 1):
        room = np.minimum((hi - mid) if side == 0 else (mid - lo), (hi - lo) // 2)
        ends = np.cumsum(room)
        a = 0
        while a < len(room):  # whole nodes, so many that a block's candidates stay bounded
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + _BLOCK, "right")))
            node = np.repeat(np.arange(a, b), room[a:b])
            for c in range(0, len(node), _BLOCK):
                x = node[c:c + _BLOCK]
                q = np.arange(c, c + len(x)) - (ends[x] - room[x] - done) + 1
                i = mid[x] if side == 0 else mid[x] - q
                j = i + q
                forward = np.minimum(ext.ahead(i, j), hi[x] - j)
                backward = np.minimum(ext.behind(i, j), i - lo[x])
                start, end = i - backward, j + forward
                good = (end - start >= np.maximum(2 * q, least)) & (forward + backward >= q)
                found.append(np.stack([x[good], start[good], end[good], q[good]], axis=1))
            a = b
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # multiples of a period give the same stretch
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[first]


def runs_of(ids: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """``(start, end, period)`` of all runs of the texts whose words are ``ids``, in order; places count through all texts."""
    parts = stretches(ids, first, least)
    if not parts:
        return np.zeros((0, 3), np.int64)
    pieces, spans, places, at = [], [], [], 0
    shift = []
    for k, (a, b) in enumerate(parts):
        pieces += [ids[a:b], [-1 - k]]  # an entry of its own closes each stretch
        more, where = borders(ids[a:b].tolist(), at, least)
        spans += more
        places += where
        shift.append((at, a - at))
        at += b - a + 1
    if not spans:
        return np.zeros((0, 3), np.int64)
    lo, mid, hi = np.array(spans, np.int64).T
    ext = Extensions(np.concatenate(pieces), int((hi - lo).max()))
    rows = crossing(lo, mid, hi, ext, least)
    if not len(rows):
        return np.zeros((0, 3), np.int64)
    node = rows[:, 0]
    count = np.array([len(places[x]) for x in node.tolist()])
    moved = np.concatenate([np.array(places[x], np.int64) - lo[x] for x in node.tolist()])
    start, end, period = np.repeat(rows[:, 1], count) + moved, np.repeat(rows[:, 2], count) + moved, np.repeat(rows[:, 3], count)
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    # of the intervals of a period those inside an earlier one go
    reach = np.maximum.accumulate(end + period * (at + 1))
    whole = np.ones(len(end), bool)
    whole[1:] = end[1:] + period[1:] * (at + 1) > reach[:-1]
    start, end, period = start[whole], end[whole], period[whole]
    begins, move = np.array(shift, np.int64).T
    move = move[np.searchsorted(begins, start, "right") - 1]
    out = np.stack([start + move, end + move, period], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)``: the runs of every text, by start and then period, and the text without repeats.

    Words are maximal stretches outside 0x20 and 0x09-0x0D and are compared
    as bytes. ``collapsed`` holds the words that no run contains after its
    first period, joined by one space. ``least`` is even. Null or empty texts
    have no words, no runs and an empty text; null ids stay null, repeated
    rows are answered each, other columns are not read. One text is searched
    in one task, in memory in proportion to its length; a batch of texts is
    cut into pieces of bounded size.
    """
    if least % 2 or least < 4:
        raise ValueError("least must be even and 4 or more")

    def search(batches):
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            for lo, hi in row_ranges(column, 1 << 21):
                data, offsets = utf8(column.slice(lo, hi - lo))
                starts, ends, first = words(data, offsets)
                found = runs_of(word_ids(data, starts, ends), first, least)
                keep = np.ones(len(starts), bool)
                for a, b, q in found.tolist():
                    keep[a + q:b] = False
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()),
                                                  _run_lists(found, first), _joined(data, starts[keep], ends[keep], np.searchsorted(np.flatnonzero(keep), first))],
                                                 ["id", "n_words", "runs", "collapsed"])
        release()

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(search, f"id {base.schema['id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)


def _run_lists(found: np.ndarray, first: np.ndarray) -> pa.Array:
    at = np.searchsorted(found[:, 0], first)
    base = np.repeat(first[:-1], np.diff(at))
    items = pa.StructArray.from_arrays([pa.array(found[:, 0] - base), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2].copy())],
                                       ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """The words of each row joined by one space; ``first`` has the number of each row's first word."""
    sizes = ends - starts + 1  # a space behind each word, left out at the end of a row
    last = np.zeros(len(starts), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    sizes[last] -= 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
    body = data[np.minimum(take, max(len(data) - 1, 0))] if len(data) else data
    body[at[1:][~last] - 1] = 0x20
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(at[first].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))).cast(pa.string())


def longest(runs: Column) -> dict[str, Column]:
    """Columns ``start``, ``length``, ``period``, ``exponent_milli`` of the longest run (then the first, then the smallest period); null without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.get(F.array_sort(ranked), F.lit(0))
    length = -best["less"]
    return {"start": best["start"], "length": length, "period": best["period"],
            "exponent_milli": F.floor(1000 * length / best["period"]).cast("bigint")}


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with known repeats: where ``crc32(id) % 10`` is 0 the words from one place on repeat a period (see the query's contract).

    Other texts, and all null ids and texts without words, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeat(w):
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        said = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(said, " ")).otherwise(F.col(text_col))

    found = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return docs.withColumn(text_col, F.when((h % 10 == 0) & F.col(text_col).isNotNull(), let(found, repeat)).otherwise(F.col(text_col)))
