"""Whole-text token ids with the tokenizers library and a bounded table of text pieces."""
from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from spanweave.llm._arrays import row_ranges, utf8, word_hashes, words

TABLE_BITS = 20
SLICE_BYTES = 1 << 20
MARKS = ".,;:!?$*#%&|<>()[]{}/\\\"-_=+@^~`"
_OPEN: dict[str, PieceEncoder] = {}


def _other_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space and joiners outside 0x20 and 0x09-0x0D, and of a few characters near them."""
    n = len(data)
    one = (data >= 0x1C) & (data <= 0x1F)
    lead = np.flatnonzero(((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3) | (data == 0xEF)))
    lead = lead[lead < n - 1]
    a, b = data[lead], data[lead + 1]
    c = data[np.minimum(lead + 2, n - 1)]
    odd = (((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0)))
           | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((a == 0xE2) & (b == 0x81) & (c >= 0x9F))
           | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB)))
    return np.concatenate([np.flatnonzero(one), lead[odd]])


class PieceEncoder:
    """Encodes text columns to unsigned 32-bit ids.

    The byte-level pattern never lets a token run from a non-space character
    into white space, so a text's ids are the ids of its pieces (white space
    and the run after it) one after another. Pieces recur, so each is encoded
    once and found again by the 64-bit hash of its bytes, in a table of
    ``2**TABLE_BITS`` slots that is emptied when half full. Texts with white
    space outside ASCII, and all texts of a tokenizer without that pattern,
    are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and not spec.get("normalizer")
                         and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"]
                                     for x in spec.get("added_tokens", [])))
        added = [re.escape(x["content"]) for x in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(added)) if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # in the byte-level alphabet a character is a byte
            self.bytes_of[i] = len(token)
        self._empty()

    def _empty(self) -> None:
        self.key = np.zeros(1 << TABLE_BITS, np.uint64)
        self.at = np.zeros(1 << TABLE_BITS, np.uint32)
        self.size = np.zeros(1 << TABLE_BITS, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = self.entries = 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 if the table lacks it."""
        mask = (1 << TABLE_BITS) - 1
        out = np.full(len(h), -1, np.int64)
        left, pos = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(left):
            there = self.key[pos]
            same = there == h[left]
            out[left[same]] = pos[same]
            go = ~same & (there != 0)
            left, pos = left[go], (pos[go] + 1) & mask
        return out

    def _insert(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Add distinct hashes that the table lacks, with their ids one after another."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.entries += len(h)
        mask = (1 << TABLE_BITS) - 1
        left, pos = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.key[pos] == 0)
            slots, first = np.unique(pos[free], return_index=True)
            own = left[free[first]]
            self.key[slots], self.at[slots], self.size[slots] = h[own], at[own], size[own]
            stay = np.ones(len(left), bool)
            stay[free[first]] = False
            left, pos = left[stay], (pos[stay] + 1) & mask

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units one after another, in any order of units, with the start and size of each unit's."""
        joined = np.fromiter((p[0] in " \n\t" and not p[-1].isspace() for p in units), bool, len(units))
        start, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        flat, total, alone = [], 0, [np.flatnonzero(~joined)]
        own = np.flatnonzero(joined)
        for lo in range(0, len(own), 20_000):  # units that begin with a space can stand one after another
            at = own[lo:lo + 20_000]
            part = [units[i] for i in at.tolist()]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(
                ["".join(part[i:i + 50]) for i in range(0, len(part), 50)], add_special_tokens=False)])
            done = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum(np.fromiter((len(p.encode()) for p in part), np.int64, len(part)))
            stop = np.searchsorted(done, ends) + 1
            if stop[-1] != len(ids) or (done[stop - 1] != ends).any():
                alone.append(at)
                continue
            size[at] = np.diff(stop, prepend=0)
            start[at] = total + stop - size[at]
            flat.append(ids)
            total += len(ids)
        at = np.concatenate(alone)
        for lo in range(0, len(at), 20_000):
            for i, e in zip(at[lo:lo + 20_000].tolist(), self._whole([units[i] for i in at[lo:lo + 20_000].tolist()])):
                start[i], size[i] = total, len(e)
                flat.append(np.array(e, np.uint32))
                total += len(e)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), start, size

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and how many each has.

        A run of ASCII marks after a letter begins a token, so word and marks are encoded apart.
        """
        number: dict[str, int] = {}
        heads, tails = [], []
        for p in pieces:
            b = p.rstrip(MARKS)
            if len(b) < len(p) and len(b) > 1 and b[-1].isalpha() and not (self.added and self.added.search(p)):
                heads.append(number.setdefault(b, len(number)))
                tails.append(number.setdefault(p[len(b):], len(number)))
            else:
                heads.append(number.setdefault(p, len(number)))
                tails.append(-1)
        flat, start, size = self._encode_units(list(number))
        parts = np.stack([heads, tails], axis=1).ravel()
        parts = parts[parts >= 0]
        n = size[parts]
        done = np.cumsum(n)
        ids = flat[np.repeat(start[parts] - (done - n), n) + np.arange(int(n.sum()))]
        heads, tails = np.array(heads), np.array(tails)
        return ids, size[heads] + np.where(tails >= 0, size[tails], 0)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a text column (null: none), and row offsets into them."""
        data, offsets = utf8(column)
        rows = len(offsets) - 1
        if not self.by_piece or len(data) > 1 << (TABLE_BITS + 1):  # a row so long may not fit the table
            return self._rows_whole(data, offsets, np.arange(rows))
        odd = np.unique(np.searchsorted(offsets, _other_space(data), "right") - 1)
        starts, ends, first = words(data, offsets)
        begins = np.concatenate([[0], ends[:-1]])
        heads = first[:-1][np.diff(first) > 0]
        row_of = np.repeat(np.arange(rows), np.diff(first))
        begins[heads] = offsets[row_of[heads]]
        last = np.where(np.diff(first) > 0, ends[np.maximum(first[1:], 1) - 1] if len(ends) else 0, offsets[:-1])
        tail = np.flatnonzero(last < offsets[1:])  # white space at a row's end
        begins, stops = np.concatenate([begins, last[tail]]), np.concatenate([ends, offsets[1:][tail]])
        order = np.argsort(begins, kind="stable")
        begins, stops = begins[order], stops[order]
        h = np.maximum(word_hashes(data, begins, stops, lower=False), np.uint64(1))
        if self.entries > 1 << (TABLE_BITS - 1):
            self._empty()
        slot = self._find(h)
        fresh, where = np.unique(h[slot < 0], return_index=True)
        if len(fresh):
            where = np.flatnonzero(slot < 0)[where]
            raw = data.tobytes()
            self._insert(fresh, *self._encode_pieces([raw[a:b].decode() for a, b in zip(begins[where].tolist(), stops[where].tolist())]))
            slot[slot < 0] = self._find(h[slot < 0])
        size = self.size[slot].astype(np.int64)
        done = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[slot].astype(np.int64) - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)]
        bounds = np.concatenate([[0], done])[np.searchsorted(begins, offsets)]
        if not len(odd):
            return ids, bounds
        other, other_at = self._rows_whole(data, offsets, odd)
        parts = np.split(ids, bounds[1:-1])
        for i, r in enumerate(odd.tolist()):
            parts[r] = other[other_at[i]:other_at[i + 1]]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _rows_whole(self, data, offsets, rows) -> tuple[np.ndarray, np.ndarray]:
        ids = self._whole([data[offsets[r]:offsets[r + 1]].tobytes().decode() for r in rows.tolist()])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum())), np.concatenate([[0], np.cumsum(size)])


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _OPEN:
        _OPEN[path] = PieceEncoder(path)
    return _OPEN[path]


def encoded_rows(column: pa.Array, path: str, end_id: int):
    """``(row, ids)`` of every row of a text column, with ``end_id`` after its ids; works on slices of bounded size."""
    enc = encoder(path)
    for lo, hi in row_ranges(column, SLICE_BYTES):
        ids, bounds = enc.encode(column.slice(lo, hi - lo))
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), lo):
            out = np.empty(b - a + 1, np.uint32)
            out[:-1] = ids[a:b]
            out[-1] = end_id
            yield i, out
