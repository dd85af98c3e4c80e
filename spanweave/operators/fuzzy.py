"""Fuzzy span location (the last resort after exact and case-insensitive search).

Similarity is the normalised Indel ratio ``100 * 2 * LCS(a, b) / (|a| + |b|)``
(not Levenshtein).  Two alignment rules are supported:

* ``partial``: best window of the note for the span -- prefixes shorter than
  the span, every full-length window, then suffixes; strict ``>`` keeps the
  first best; inclusive cutoff.  Window set and tie order follow the public
  description of the partial-ratio alignment.
* ``window``: window sizes ``int(0.8 L) .. min(len(note), int(1.2 L))``
  ascending; within a size the first best window scoring at least the cutoff;
  a later size must be strictly better.

Both run in an Arrow UDF over the unresolved rows only.  A note is never
walked window by window: a count filter names the windows that can reach the
cutoff, from running counts of the span's characters (a window with ``c``
characters of the span, with multiplicity, has ``LCS <= c``, so by the Indel
bound ``200 c / (m + w)`` is the most it can score; single characters are the
only grams whose pigeonhole bound says anything at these cutoffs).  The LCS of
the windows that are left comes from the bit-parallel recurrence of Hyyro
(2004), for all of them at once in 64-bit arrays; spans of more than 64
characters use it on Python integers, one window after the other.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                       T.StructField("score", T.DoubleType())])


class _Pattern:
    """Match masks of a fixed pattern for repeated LCS against many texts."""

    def __init__(self, a: str):
        self.a, self.m = a, len(a)
        masks: dict[str, int] = {}
        for i, ch in enumerate(a):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        self.masks = masks
        self.full = (1 << self.m) - 1

    def lcs(self, b: str, lo: int = 0, hi: int | None = None) -> int:
        v = self.full
        get = self.masks.get
        for ch in (b if lo == 0 and hi is None else b[lo:hi]):
            u = v & get(ch, 0)
            v = ((v + u) | (v - u)) & self.full
        return self.m - bin(v).count("1")

    def ratio(self, b: str, lo: int = 0, hi: int | None = None) -> float:
        n = (len(b) if hi is None else hi) - lo
        tot = self.m + n
        return 100.0 if tot == 0 else 100.0 * 2 * self.lcs(b, lo, hi) / tot


def ratio(a: str, b: str) -> float:
    return _Pattern(a).ratio(b)


def _bound(common: int, m: int, n: int) -> float:
    tot = m + n
    return 100.0 if tot == 0 else 100.0 * 2 * common / tot


class _Overlap:
    """Characters (with multiplicity) that a pattern shares with a window of a text, kept while the window's ends move."""

    def __init__(self, pattern: str, text: str):
        self.need, self.text = Counter(pattern), text
        self.have: Counter = Counter()
        self.lo = self.hi = self.shared = 0

    def move(self, lo: int, hi: int) -> int:
        while self.hi < hi:
            ch = self.text[self.hi]
            self.have[ch] += 1
            self.shared += self.have[ch] <= self.need[ch]
            self.hi += 1
        while self.lo < lo:
            ch = self.text[self.lo]
            self.shared -= self.have[ch] <= self.need[ch]
            self.have[ch] -= 1
            self.lo += 1
        return self.shared


def _partial_windows(size: int, n: int):
    """``(from, to, edge)`` of the windows of the partial rule, in order; ``edge`` is the end that moved last.

    Prefixes shorter than the span, windows of its length, then suffixes; both
    ends only ever move forward.
    """
    for i in range(1, size):
        yield 0, i, i - 1
    for i in range(n - size):
        yield i, i + size, i + size - 1
    for i in range(max(n - size, 0), n):
        yield i, n, i


def _partial_impl(short: str, text: str, cutoff: float):
    """First best window of ``text`` for ``short``: ``(score, from, to)``, score 0 below the cutoff.

    Only windows whose moving end is a character of the span count.
    """
    pattern, overlap = _Pattern(short), _Overlap(short, text)
    best, at = 0.0, (0, len(short))
    for lo, hi, edge in _partial_windows(len(short), len(text)):
        most = _bound(overlap.move(lo, hi), len(short), hi - lo)
        if text[edge] not in pattern.masks or most < cutoff or most <= best:
            continue
        score = pattern.ratio(text, lo, hi)
        if score >= cutoff and score > best:
            best, at = score, (lo, hi)
            if best == 100.0:
                break
    return best, *at


class _Windows:
    """Scores of many windows of a text for one span of at most 64 characters."""

    def __init__(self, span: str, text: str):
        self.m, self.n = len(span), len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.masks = np.zeros(self.n, np.uint64)  # places of each character of the text in the span
        self.counts = []  # (how often the span has a character, its running count in the text)
        for ch, need in Counter(span).items():
            here = codes == ord(ch)
            if here.any():
                self.masks[here] = sum(1 << i for i, c in enumerate(span) if c == ch)
                self.counts.append((need, np.concatenate([[0], np.cumsum(here, dtype=np.int32)])))

    def most(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The most that each window can score, from the characters it shares with the span."""
        shared = np.zeros(len(lo), np.int64)
        for need, run in self.counts:
            shared += np.minimum(run[hi] - run[lo], need)
        return 200.0 * shared / (self.m + hi - lo)

    def scores(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        full = np.uint64((1 << self.m) - 1)
        v = np.full(len(lo), full)
        width = hi - lo
        for j in range(int(width.max(initial=0))):
            mask = self.masks[np.minimum(lo + j, self.n - 1)]
            mask[j >= width] = 0
            u = v & mask
            v = ((v + u) | (v - u)) & full
        return 200.0 * (self.m - np.bitwise_count(v).astype(np.int64)) / (self.m + width)

    def best(self, lo: np.ndarray, hi: np.ndarray, cutoff: float, first: int = 64) -> tuple[float, int]:
        """Score and number of the first best window that reaches the cutoff (0 and -1 if none does)."""
        most = self.most(lo, hi)
        some = np.flatnonzero((most >= cutoff) & (most > 0))
        if not len(some):
            return 0.0, -1
        if len(some) > first:  # the most promising ones first: windows that cannot reach their best need no LCS
            top = some[np.argpartition(most[some], len(some) - first)[-first:]]
            some = some[most[some] >= self.scores(lo[top], hi[top]).max()]
        score = self.scores(lo[some], hi[some])
        at = int(np.argmax(score))
        return (float(score[at]), int(some[at])) if score[at] >= cutoff and score[at] > 0 else (0.0, -1)


    def best_of_sizes(self, sizes: range, cutoff: float, first: int = 64, block: int = 1 << 20) -> tuple[int, int, float] | None:
        """``(from, to, score)`` of the first best window of any of the ``sizes`` (the smallest first) that reaches the cutoff.

        The characters that windows share with the span are counted for some
        sizes at once. A window is shorter than 256 characters, so differences
        of running counts are right in a byte.
        """
        best, at, step = 0.0, None, max(1, block // (self.n + 1))
        runs = [(np.uint8(need), run.astype(np.uint8)) for need, run in self.counts]
        for some in (sizes[i:i + step] for i in range(0, len(sizes), step)):
            shared = np.zeros((len(some), self.n + 1), np.uint8)
            for need, run in runs:
                later = np.lib.stride_tricks.sliding_window_view(np.concatenate([run, np.zeros(some[-1], np.uint8)]), self.n + 1)
                shared += np.minimum(later[some[0]:some[-1] + 1] - run, need)
            most = 200.0 * np.arange(self.m + 1) / (self.m + np.array(some))[:, None]  # by the number of shared characters
            enough = (most < max(cutoff, best)).sum(axis=1)  # the fewest that can reach the cutoff
            row, lo = np.nonzero(shared >= np.maximum(enough, 1)[:, None])
            size = row + some[0]
            inside = lo + size <= self.n
            row, lo, size = row[inside], lo[inside], size[inside]
            if not len(lo):
                continue
            reach = most[row, np.minimum(shared[row, lo], self.m)]
            if len(lo) > first:  # the most promising ones first: windows that cannot reach their best need no LCS
                top = np.argpartition(reach, len(lo) - first)[-first:]
                kept = reach >= self.scores(lo[top], lo[top] + size[top]).max()
                lo, size = lo[kept], size[kept]
            score = self.scores(lo, lo + size)
            i = int(np.argmax(score))
            if score[i] >= cutoff and score[i] > best:
                best, at = float(score[i]), (int(lo[i]), int(lo[i] + size[i]))
        return None if at is None else (*at, best)


def _partial(short: str, text: str, cutoff: float):
    """:func:`_partial_impl` with all windows at once (spans of at most 64 characters)."""
    if len(short) > 64:
        return _partial_impl(short, text, cutoff)
    m, n = len(short), len(text)
    from_, to, tail = np.arange(1, m), np.arange(n - m), np.arange(max(n - m, 0), n)
    lo = np.concatenate([np.zeros(m - 1, np.int64), to, tail])
    hi = np.concatenate([from_, to + m, np.full(len(tail), n)])
    edge = np.concatenate([from_ - 1, to + m - 1, tail])
    windows = _Windows(short, text)
    kept = np.flatnonzero(windows.masks[edge] != 0)
    score, at = windows.best(lo[kept], hi[kept], cutoff)
    return (0.0, 0, m) if at < 0 else (score, int(lo[kept[at]]), int(hi[kept[at]]))


def partial_alignment(span: str, note: str, cutoff: float):
    """(start, end, score) of the best partial alignment in ``note``, or None."""
    if not span or not note:
        return None
    len1, len2 = len(span), len(note)
    if len1 <= len2:
        score, ds, de = _partial(span, note, cutoff)
        if score != 100.0 and len1 == len2:
            s2, ss, se = _partial(note, span, max(cutoff, score))
            if s2 > score:
                score, ds, de = s2, 0, len1  # source side of the swapped call is the whole note
        start, end = ds, de
    else:
        score, _, _ = _partial(note, span, cutoff)
        start, end = 0, len2
    if score < cutoff or score == 0.0:
        return None
    return start, end, score


def window_alignment(span: str, note: str, cutoff: float):
    """(start, end, score) by ascending window sizes around the span length, or None."""
    if not span or not note:
        return None
    n = len(note)
    sizes = range(max(1, int(len(span) * 0.80)), min(n, int(len(span) * 1.20)) + 1)
    if len(span) <= 64:
        return _Windows(span, note).best_of_sizes(sizes, cutoff)
    best, at = 0.0, None
    for size in sizes:
        score, i = _first_best(span, note, size, cutoff, best)
        if i >= 0 and score > best:
            best, at = score, (i, i + size)
    return None if at is None else (*at, best)


def _first_best(span: str, note: str, size: int, cutoff: float, here: float) -> tuple[float, int]:
    """Score and start of the first best window of ``size`` that beats ``here``, one after the other."""
    pattern, overlap, at = _Pattern(span), _Overlap(span, note), -1
    for lo in range(len(note) - size + 1):
        most = _bound(overlap.move(lo, lo + size), len(span), size)
        if most < cutoff or most <= here:
            continue
        score = pattern.ratio(note, lo, lo + size)
        if score >= cutoff and score > here:
            here, at = score, lo
            if score == 100.0:
                break
    return here, at


def _udf(mode: str, cutoff: float):
    import pandas as pd
    fn = partial_alignment if mode == "partial" else window_alignment

    def align(span, note):
        out = []
        for s, n in zip(span, note):
            r = fn(s, n, cutoff) if isinstance(s, str) and isinstance(n, str) else None
            out.append({"start": r[0], "end": r[1], "score": r[2]} if r else None)
        return pd.DataFrame({"start": [o["start"] if o else None for o in out],
                             "end": [o["end"] if o else None for o in out],
                             "score": [o["score"] if o else None for o in out]})
    align.__annotations__ = {"span": pd.Series, "note": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(RESULT)(align).asNondeterministic()  # else a filter on the result would align each row once more


def fuzzy_locate(miss: DataFrame, *, span_col: str = "span", note_col: str = "pn_history", cutoff: float = 70.0,
                 mode: str = "partial") -> DataFrame:
    """Locate the unresolved spans fuzzily; rows that stay unresolved are dropped."""
    r = miss.withColumn("_fz", _udf(mode, float(cutoff))(F.col(span_col), F.col(note_col)))
    r = r.filter(F.col("_fz").isNotNull() & F.col("_fz.start").isNotNull())
    return (r.withColumn("start", F.col("_fz.start")).withColumn("end", F.col("_fz.end"))
             .withColumn("method", F.lit("fuzzy")).drop("_fz"))
