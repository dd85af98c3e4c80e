"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words without ASCII punctuation, hashed to
``2**hash_bits`` slots. The classifier is fitted on a bounded sample of
labelled rows (``sample_rows``, picked by a hash of the id). Its features are
the slots whose share among toxic rows differs most from that among others,
and both slots of every pair whose joint presence says more than the two say
apart (see :func:`strong_pairs`), also where neither says anything alone. A
second-order factorization machine learns a weight for each feature and a
vector whose products are the weights of pairs. So a pair such as an insult
with a group mention can weigh more than both alone, which additive weights
cannot say. What the driver fits on is at most ``sample_rows * (features +
pair_terms)`` slot numbers. All rows are scored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm._arrays import SPACE, row_ranges, utf8, word_hashes, words

_U = np.uint64
SEPARATORS = SPACE.copy()
for _c in range(128):
    if not chr(_c).isalnum():
        SEPARATORS[_c] = True


def term_slots(column: pa.Array, hash_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all terms of a text column, and for each row the index of its first term."""
    data, offsets = utf8(column)
    starts, ends, first = words(data, offsets, SEPARATORS)
    return (word_hashes(data, starts, ends) >> _U(64 - hash_bits)).astype(np.int64), first


def _distinct(slots: np.ndarray, first: np.ndarray, hash_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, slot)`` of the distinct slots of each row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    both = np.unique((row << hash_bits) | slots)
    return both >> hash_bits, both & ((1 << hash_bits) - 1)


@dataclass
class Machine:
    """Feature of each slot (-1: none), bias, weights and vectors."""

    feature: np.ndarray
    hash_bits: int
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def logits(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """Scores before the sigmoid of rows given as sorted (row, feature) pairs."""
        out = np.full(rows, self.bias)
        if len(row):
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            v = self.vector[feature]
            sums = np.add.reduceat(v, at)
            pairs = 0.5 * (sums ** 2 - np.add.reduceat(v ** 2, at)).sum(axis=1)
            out[row[at]] += np.add.reduceat(self.weight[feature], at) + pairs
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for lo, hi in row_ranges(column):
            slots, first = term_slots(column.slice(lo, hi - lo), self.hash_bits)
            feature = self.feature[slots]
            known = np.flatnonzero(feature >= 0)
            first = np.searchsorted(known, first)
            row, slot = _distinct(slots[known], first, self.hash_bits)
            out.append(self.logits(row, self.feature[slot], hi - lo))
        x = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], labels: np.ndarray, features: int, factors: int = 8, epochs: int = 40, batch: int = 512,
        rate: float = 0.02, decay: float = 2e-4, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by mini-batches of Adam on the logistic loss; deterministic for a seed."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    theta = [np.array([np.log(share / (1 - share))]), np.zeros(features), rng.normal(0, 0.05, (features, factors))]
    moment = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            own = order[lo:lo + batch]
            size = np.array([len(rows[i]) for i in own])
            x = np.concatenate([rows[i] for i in own])
            r = np.repeat(np.arange(len(own)), size)
            sums = np.zeros((len(own), factors))
            v = theta[2][x]
            some = np.flatnonzero(size)
            logit = np.full(len(own), theta[0][0])
            if len(x):
                at = (np.cumsum(size) - size)[some]
                sums[some] = np.add.reduceat(v, at)
                logit[some] += np.add.reduceat(theta[1][x], at) + 0.5 * (sums[some] ** 2 - np.add.reduceat(v ** 2, at)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[own]) / len(own)
            grads = [np.array([error.sum()]), np.bincount(x, error[r], features) + decay * theta[1], decay * theta[2]]
            push = error[r][:, None] * (sums[r] - v)
            grads[2] = grads[2] + np.stack([np.bincount(x, push[:, f], features) for f in range(factors)], axis=1)
            step += 1
            for t, g, m in zip(theta, grads, moment):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                t -= rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)
    return float(theta[0][0]), theta[1], theta[2]


def strong_pairs(rows: list[np.ndarray], labels: np.ndarray, terms: int, min_z: float, least: int = 10, most: int = 128, step: int = 2048) -> np.ndarray:
    """Terms of the pairs whose toxic share departs from what the two terms add, by ``min_z`` standard errors or more.

    For two terms the rows fall in four cells: both, one, the other, none. The
    contrast of a pair is ``p11 - p10 - p01 + p00``; it is 0 where the terms
    only add. Pairs with fewer than ``least`` rows in a cell are left out, and of the
    rest the ``most`` strongest count.
    """
    both, toxic = np.zeros((terms, terms)), np.zeros((terms, terms))
    for lo in range(0, len(rows), step):
        own = rows[lo:lo + step]
        x = np.zeros((len(own), terms), np.float32)
        x[np.repeat(np.arange(len(own)), [len(r) for r in own]), np.concatenate(own) if own else []] = 1
        both += x.T @ x
        toxic += (x * labels[lo:lo + step, None].astype(np.float32)).T @ x
    n, t = np.diag(both).copy(), np.diag(toxic).copy()
    cells = [both, n[:, None] - both, n[None, :] - both, len(rows) - n[:, None] - n[None, :] + both]
    bad = [toxic, t[:, None] - toxic, t[None, :] - toxic, labels.sum() - t[:, None] - t[None, :] + toxic]
    enough = np.logical_and.reduce([c >= least for c in cells])
    share = [b / np.maximum(c, 1) for b, c in zip(bad, cells)]
    p = labels.mean() if len(labels) else 0.0
    spread = np.sqrt(max(p * (1 - p), 1e-9) * sum(1 / np.maximum(c, 1) for c in cells))
    z = np.where(enough, np.abs(share[0] - share[1] - share[2] + share[3]) / spread, 0)
    i, j = np.nonzero(np.triu(z, 1) >= min_z)
    strongest = np.lexsort((j, i, -z[i, j]))[:most]
    return np.unique(np.concatenate([i[strongest], j[strongest]]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          hash_bits: int = 18, sample_rows: int = 16_384, features: int = 2048,
          min_z: float = 4.0, pair_terms: int = 1024, min_pair_z: float = 6.0) -> Machine:
    """Fit on the labelled rows for which ``usable`` (a condition on ``labels``) holds, ``sample_rows`` of them at most.

    Slots whose shares differ by fewer than ``min_z`` standard errors are
    features only if they belong to one of the :func:`strong_pairs` among the
    ``pair_terms`` slots that most rows hold. Null labels teach nothing. Without any label the score is one half. Rows
    of a repeated id each count.
    """
    spark = docs.sparkSession
    sample = (labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("sample_id"), F.col(label_col).cast("int").alias("label")).distinct()
              .orderBy(F.xxhash64("sample_id"), "sample_id", "label").limit(sample_rows))
    taken = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), F.col("own_id") == F.col("sample_id")).select("own_id", "label", "text")  # sample_rows rows: a bound

    def count(batches):
        sums = np.zeros((2, 1 << hash_bits), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for lo, hi in row_ranges(batch.column(2)):
                row, slot = _distinct(*term_slots(batch.column(2).slice(lo, hi - lo), hash_bits), hash_bits)
                for y in (0, 1):
                    sums[y] += np.bincount(slot[label[lo:hi][row] == y], minlength=1 << hash_bits)
                    rows[y] += int((label[lo:hi] == y).sum())
        some = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), *(pa.array(np.append(sums[y][some], rows[y])) for y in (0, 1))], ["slot", "n0", "n1"])

    stats = taken.mapInArrow(count, "slot bigint, n0 bigint, n1 bigint").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = stats.toArrow()  # 2**hash_bits + 1 rows at most
    slot, n0, n1 = (table.column(c).to_numpy().astype(np.int64) for c in ("slot", "n0", "n1"))
    feature = np.full(1 << hash_bits, -1, np.int64)
    whole = slot < 0
    rows0, rows1 = int(n0[whole].sum()), int(n1[whole].sum())
    if not rows0 or not rows1:
        return Machine(feature, hash_bits, 0.0, np.zeros(1), np.zeros((1, 1)))
    share, p0, p1 = (n0 + n1) / (rows0 + rows1), n0 / rows0, n1 / rows1
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / rows0 + 1 / rows1))
    z[whole | (n0 + n1 < 5)] = 0
    best = np.lexsort((slot, -z))[:features]
    best = best[z[best] >= min_z]
    common = np.lexsort((slot, -np.where(whole, 0, n0 + n1)))[:pair_terms]
    common = common[(n0 + n1)[common] * ~whole[common] >= 20]
    wanted = np.concatenate([best, common[~np.isin(common, best)]])
    feature[slot[wanted]] = np.arange(len(wanted))
    shared = spark.sparkContext.broadcast(feature)

    def pick(batches):
        for batch in batches:
            for lo, hi in row_ranges(batch.column(2)):
                slots, first = term_slots(batch.column(2).slice(lo, hi - lo), hash_bits)
                known = np.flatnonzero(shared.value[slots] >= 0)
                row, own = _distinct(slots[known], np.searchsorted(known, first), hash_bits)
                off = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(shared.value[own].astype(np.int32)))], ["id", "label", "x"])

    learnt = taken.mapInArrow(pick, "id bigint, label int, x array<int>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    x = [np.asarray(v, np.int64) for v in learnt.column("x").to_pylist()]
    y = learnt.column("label").to_numpy().astype(float)
    place = np.full(len(wanted), -1)
    place[feature[slot[common]]] = np.arange(len(common))
    paired = strong_pairs([place[r][place[r] >= 0] for r in x], y, len(common), min_pair_z)
    kept = np.unique(np.concatenate([np.arange(len(best)), feature[slot[common[paired]]]])).astype(np.int64)
    number = np.full(len(wanted) + 1, -1)
    number[kept] = np.arange(len(kept))
    x = [number[r][number[r] >= 0] for r in x]
    bias, weight, vector = fit(x, y, max(1, len(kept)))
    return Machine(number[feature], hash_bits, bias, weight, vector)  # number[-1] is -1: no feature


def score(docs: DataFrame, machine: Machine, text_col: str = "text", limit: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where the score is ``limit`` or more).

    Only the text is read; null or empty text gets the score of a text
    without known terms. Input columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(pa.array(texts, pa.string(), from_pandas=True)))

    out = docs.select(F.struct("*").alias("row"), toxic(F.col(text_col)).alias("score"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("score", "predicted")),
                      "score", (F.col("score") >= limit).cast("int").alias("predicted"))
