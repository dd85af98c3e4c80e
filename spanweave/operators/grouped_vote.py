"""The character vote as a grouped Arrow function, a twin of the interval sweep in ``spans.majority_vote``."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.operators.spans import far_edge, far_parts


GROUPS = 16_384  # pairs are dealt over so many groups; one call of the function votes all pairs of a group


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value (null is a value too) and the values."""
    found = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _blanks(place: np.ndarray, blanks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The blank counts noted for places, at the places ``at`` (0 where none is noted)."""
    order = np.argsort(place, kind="stable")
    place, blanks = place[order], blanks[order]
    i = np.searchsorted(place, at, side="right") - 1
    return np.where((i >= 0) & (place[i] == at), blanks[i], 0)


def _runs(pair: np.ndarray, voter: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    """``(pair, start, end)`` of the runs with ``limit`` votes, all pairs at once: places are numbered through the pairs."""
    wide = int(end.max()) + 1
    _, own = np.unique(np.stack([pair, voter, weight]), axis=1, return_inverse=True)  # spans of one voter and weight
    own = own.reshape(-1)
    order = np.lexsort((start, own))
    own, p, w, s, e = own[order], pair[order], weight[order], start[order], end[order]
    reach = np.maximum.accumulate(own * wide + e)
    first = np.concatenate([[True], own[1:] * wide + s[1:] > reach[:-1]])  # of an island
    last = np.concatenate([first[1:], [True]])
    place = np.concatenate([p[first] * wide + s[first], p[first] * wide + reach[last] - own[first] * wide])
    change = np.concatenate([w[first], -w[first]])
    if limit <= 0:  # places without votes count from the start of the note
        place, change = np.concatenate([place, np.unique(pair) * wide]), np.concatenate([change, np.zeros(len(np.unique(pair)), np.int64)])
    place, which = np.unique(place, return_inverse=True)
    votes = np.zeros(len(place), np.int64)
    np.add.at(votes, which.reshape(-1), change)
    votes = np.cumsum(votes)
    on = (votes[:-1] >= limit) & (place[:-1] // wide == place[1:] // wide)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    begin, stop = place[np.flatnonzero(edge == 1)], place[np.flatnonzero(edge == -1)]
    return begin // wide, begin % wide, stop % wide


def vote_grouped(located: DataFrame, threshold: int, *, pair_key: str = "id", voter: str = "model", weight: str | None = "weight",
                 n_voters: int | None = None) -> DataFrame:
    """``(pair_key, start, end)`` by the contract of ``majority_vote``, many pairs a group.

    Pairs are dealt over ``GROUPS`` groups by the hash of their key, so a call
    votes hundreds of pairs of a large table with a few array operations. Of a
    voter's spans with one start only the furthest end is sent, taken in part
    before the shuffle, so a pair has at most one row a character of its note,
    voter and weight, whatever number of spans it received.
    """
    limit = threshold if n_voters is None else min(threshold, n_voters)
    wcol = F.col(weight) if weight else F.lit(1)
    far = (located.groupBy(F.col(pair_key).alias("_pair"), F.col(voter).alias("_voter"), F.coalesce(wcol.cast("bigint"), F.lit(0)).alias("_w"), "start")
           .agg(F.max(far_edge()).alias("_far"), F.max("lead").alias("lead")))
    far = far.select("_pair", "_voter", "_w", "start", "lead", *far_parts("_far"))
    key = dict(located.dtypes)[pair_key]

    def vote(table: pa.Table) -> pa.Table:
        start, end, lead, trail, w = (pc.fill_null(table.column(c), 0).to_numpy().astype(np.int64) for c in ("start", "end", "lead", "trail", "_w"))
        (pair, names), (voters, _) = _codes(table.column("_pair")), _codes(table.column("_voter"))
        p, s, e = _runs(pair, voters, w, start, end, limit)
        wide = int(end.max()) + 1
        s, e = s + _blanks(pair * wide + start, lead, p * wide + s), e - _blanks(pair * wide + end, trail, p * wide + e)
        keep = s < e
        return pa.table({pair_key: names.take(pa.array(p[keep])), "start": pa.array(s[keep].astype(np.int32)), "end": pa.array(e[keep].astype(np.int32))})

    return far.groupBy(F.pmod(F.hash("_pair"), F.lit(GROUPS)).alias("_group")).applyInArrow(vote, f"{pair_key} {key}, start int, end int")
