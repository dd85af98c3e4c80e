"""Language ID with interpolated Kneser-Ney character models held in sorted hash arrays.

Training counts every 4-character sequence of all labelled texts, in one
pass; Spark groups them and derives the lower orders from continuation counts
(how many different characters stand before a sequence). The finished model
has, for every order, one sorted array of sequence hashes, each with the
languages that know the sequence and their log probabilities, next to the same
for back-off weights. The hash is a bijection of the packed 64-bit sequence, so
no two sequences share an entry. A model grows with the distinct sequences of
the corpus: its entries are counted before anything is gathered. Up to
``max_model_bytes`` it is broadcast; a larger one stays a table, and the
sequences of the texts are joined with it. Both give the same predictions.

A text's language is the one with the lowest cross-entropy a character. It is
accepted if that is not above what the model expects of its own language: the
mean and spread of a character's cross-entropy come from the same counts, so
the limit is calibrated for each language and widens for short texts.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm._arrays import mix64
from spanweave.llm._store import release, stored

ORDER = 4
DISCOUNT = 0.75
FLOOR_CHARS = 65536
MODEL_BYTES = 256 << 20  # largest model that is broadcast
ENTRY_BYTES = 24  # at most: a key, its first entry, one language and value
_U = np.uint64
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(65536)), bool, 65536))
    return _LETTER[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit symbols of all texts (lower-cased letters, each other run as one space) and row offsets.

    A row is its words, each with one space after it; a row without letters is empty.
    Code points beyond 16 bits keep their low bits, and count as letters if they are.
    """
    joined, sizes = [], []
    for t in texts:
        t = (t or "").lower()
        joined.append(t)
        sizes.append(len(t) + 1)
    raw = np.frombuffer("\n".join([*joined, ""]).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[raw & 0xFFFF] & (raw < 65536)
    for i in np.flatnonzero(raw >= 65536):
        letter[i] = chr(raw[i]).isalpha()
    code = np.where(letter, raw & 0xFFFF, 32).astype(np.uint64)
    ends = np.cumsum(np.array(sizes, np.int64))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    firsts = ends - sizes
    count = np.concatenate([[0], np.cumsum(keep)])
    used = count[ends] - count[firsts]
    return code[keep], np.concatenate([[0], np.cumsum(used)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-symbol sequences ending at every symbol (padded with spaces on the left) and row offsets."""
    code, off = symbols(texts)
    packed = code.copy()
    at = np.arange(len(code)) - np.repeat(off[:-1], np.diff(off))
    for j in range(1, ORDER):
        before = np.full(len(code), 32, np.uint64)
        before[j:] = code[:-j]
        before[at < j] = 32
        packed |= before << _U(16 * j)
    return packed, off


def _slices(texts: list[str | None], chars: int = 1 << 20):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and size + n > chars:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def gram_counts(docs: DataFrame, text_col: str, lang: Column) -> DataFrame:
    """``(lang, g, c)``: how often each packed sequence occurs in each language, over all rows given."""
    def count(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: dict[str, list[int]] = {}
            for i, x in enumerate(langs):
                rows.setdefault(x, []).append(i)
            for name, own in rows.items():
                held_g, held_c = np.zeros(0, _U), np.zeros(0, np.int64)
                for a, b in _slices([texts[i] for i in own]):
                    g, c = np.unique(grams([texts[i] for i in own[a:b]])[0], return_counts=True)
                    both = np.concatenate([held_g, g])
                    order = np.argsort(both, kind="stable")
                    sums = np.concatenate([held_c, c])[order]
                    both = both[order]
                    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else []
                    held_g, held_c = both[new], np.add.reduceat(sums, new) if len(both) else sums
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(held_g), pa.string()), pa.array(held_g.view(np.int64)), pa.array(held_c, pa.int64())],
                    ["lang", "g", "c"])
        release()

    found = docs.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, g bigint, c bigint")
    return found.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _order_tables(counts: DataFrame) -> list[DataFrame]:
    """For orders 1 to 4: ``(lang, g, c)`` with raw counts on top and continuation counts below."""
    tables = [counts]
    for k in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (16 * k)) - 1).cast("bigint")
        tables.insert(0, tables[0].select("lang", F.col("g").bitwiseAND(mask).alias("g"), "c")
                      .groupBy("lang", "g").agg(F.count("*").alias("c")))
    return tables


def _low(k: int) -> int:
    return (1 << (16 * k)) - 1


@dataclass
class Entries:
    """Sorted hashes of sequences; those of ``keys[i]`` are the languages and values from ``first[i]`` to ``first[i + 1]``."""

    keys: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def gather(cls, table: DataFrame, langs: list[str]) -> "Entries":
        """From rows ``(lang, g, v)``, whose number was held against the model's bound before."""
        number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
        got = table.select(number.cast("int").alias("lang"), "g", F.col("v").cast("float").alias("v")).toArrow()
        h = mix64(got.column("g").to_numpy().view(_U))
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return cls(h[first], np.append(first, len(h)), got.column("lang").to_numpy()[order], got.column("v").to_numpy()[order])

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index in ``g``, language, value) of everything known of the packed sequences ``g``."""
        if not len(self.keys):
            return np.zeros(0, np.int64), self.lang[:0], self.value[:0]
        h = mix64(g)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == h)
        at = at[hit]
        size = self.first[at + 1] - self.first[at]
        own = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(hit, size), self.lang[own], self.value[own]


@dataclass
class Arrays:
    """What a task needs: the sorted arrays of each order (``None`` in a model that stays a table) and the calibration."""

    langs: list[str]
    probs: list[Entries] | None
    backs: list[Entries] | None
    mean: np.ndarray
    sd: np.ndarray

    def char_logp(self, g: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of packed sequences, in every language."""
        out = np.full((len(g), len(self.langs)), -np.log(FLOOR_CHARS), np.float32)
        for k in range(1, ORDER + 1):
            own = g & _U(_low(k))
            row, lang, value = self.backs[k - 1].find(own >> _U(16))
            out[row, lang] += value
            row, lang, value = self.probs[k - 1].find(own)
            out[row, lang] = value
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character in every language, and the number of characters, of each text."""
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b in _slices(texts):
            g, off = grams(texts[a:b])
            used = np.diff(off)
            size[a:b] = used
            if not len(g):
                continue
            distinct, where = np.unique(g, return_inverse=True)
            values = self.char_logp(distinct)
            rows = np.flatnonzero(used)
            for i in range(len(self.langs)):
                total[a + rows, i] = np.add.reduceat(values[:, i].astype(np.float64)[where], off[:-1][rows])
        return -total / np.maximum(size, 1)[:, None], size

    def limit(self, size: np.ndarray, margin: float, spreads: float) -> np.ndarray:
        """The largest cross-entropy accepted for a text of ``size`` characters, in every language."""
        return self.mean + margin + spreads * self.sd / np.sqrt(np.maximum(size, 1))[:, None]

    def verdict(self, h: np.ndarray, size: np.ndarray, margin: float, spreads: float) -> pd.DataFrame:
        """``lang_pred, score, entropy, accepted`` of texts with cross-entropies ``h`` and ``size`` characters."""
        n = len(size)
        if not self.langs:
            return pd.DataFrame({"lang_pred": ["und"] * n, "score": [0.0] * n, "entropy": [0.0] * n, "accepted": [False] * n})
        best = h.argmin(axis=1)
        rows = np.arange(n)
        low = h[rows, best]
        share = 1 / np.exp((low[:, None] - h) / 0.1).sum(axis=1)
        some = size > 0
        names = np.array([*self.langs, "und"], object)[np.where(some, best, len(self.langs))]
        return pd.DataFrame({"lang_pred": names, "score": np.where(some, share, 0.0), "entropy": np.where(some, low, 0.0),
                             "accepted": some & (low <= self.limit(size, margin, spreads)[rows, best])})


@dataclass
class Model:
    """A fitted model: stored tables ``(lang, g, v)`` of each order, and their arrays where they are within the bound."""

    arrays: Arrays
    probs: list[DataFrame]
    backs: list[DataFrame]
    n_bytes: int

    @property
    def langs(self) -> list[str]:
        return self.arrays.langs

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.arrays.score(texts)


def train(docs: DataFrame, text_col: str, lang: Column, max_model_bytes: int = MODEL_BYTES) -> Model:
    """Fit one model for each distinct non-null value of ``lang`` on all rows of ``docs``.

    Rows with null ``lang`` or null text teach nothing. Without any row left
    the model knows no language. Arrays are gathered only if all entries of
    all languages together, counted first, fit ``max_model_bytes``.
    """
    counts = stored(gram_counts(docs.where(lang.isNotNull() & F.col(text_col).isNotNull()), text_col, lang), "grams")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    mean, sd = np.zeros(len(langs)), np.zeros(len(langs))
    if not langs:
        return Model(Arrays([], [], [], mean, sd), [], [], 0)
    probs, backs, lower = [], [], None
    for k, table in enumerate(_order_tables(counts), 1):
        context = F.shiftrightunsigned("g", 16) if k > 1 else F.lit(0).cast("bigint")
        table = table.withColumn("h", context)
        sums = stored(table.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")), f"contexts{k}")
        own = (F.col("c") - DISCOUNT) / F.col("total")
        rest = F.lit(DISCOUNT) * F.col("kinds") / F.col("total")
        joined = table.join(sums, ["lang", "h"])
        if k == 1:
            p = joined.select("lang", "g", "c", (own + rest / FLOOR_CHARS).alias("p"))
        else:
            joined = joined.withColumn("tail", F.col("g").bitwiseAND(F.lit(_low(k - 1)).cast("bigint")))
            p = joined.join(lower, ["lang", "tail"]).select("lang", "g", "c", (own + rest * F.col("low")).alias("p"))
        p = stored(p, f"order{k}")
        lower = p.select("lang", F.col("g").alias("tail"), F.col("p").alias("low"))
        backs.append(sums.select("lang", F.col("h").alias("g"), F.log(rest).alias("v")))
        probs.append(p.select("lang", "g", F.log("p").alias("v")))
    surprise = -F.log("p")
    for r in p.groupBy("lang").agg((F.sum(F.col("c") * surprise) / F.sum("c")).alias("m"),
                                   (F.sum(F.col("c") * surprise * surprise) / F.sum("c")).alias("q")).collect():
        i = langs.index(r["lang"])
        mean[i], sd[i] = r["m"], np.sqrt(max(r["q"] - r["m"] ** 2, 0))
    n_bytes = sum(t.count() for t in probs + backs) * ENTRY_BYTES
    arrays = Arrays(langs, None, None, mean, sd)
    if n_bytes <= max_model_bytes:
        arrays.probs, arrays.backs = ([Entries.gather(t, langs) for t in tables] for tables in (probs, backs))
    return Model(arrays, probs, backs, n_bytes)


def _joined_entropies(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``(row, h array<double>, size)`` of the numbered rows that have letters, by a join of their sequences with the model."""
    def count(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                g, off = grams(texts[a:b])
                row = np.repeat(np.arange(b - a), np.diff(off))
                order = np.lexsort((g, row))
                g, row = g[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])])) if len(g) else np.zeros(0, np.int64)
                c = np.diff(np.append(new, len(g)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][row[new]]), pa.array(g[new].view(np.int64)), pa.array(c, pa.int64())], ["row", "g", "c"])

    found = stored(docs.select("row", F.col(text_col).alias("text")).mapInArrow(count, "row bigint, g bigint, c bigint"), "text-grams")
    value = found.select("g").distinct().withColumn("lang", F.explode(F.array(*map(F.lit, model.langs))))
    value = value.withColumn("logp", F.lit(-float(np.log(FLOOR_CHARS))))
    for k in range(1, ORDER + 1):
        tail = F.col("g").bitwiseAND(F.lit(_low(k)).cast("bigint")) if k < ORDER else F.col("g")
        back = model.backs[k - 1].select("lang", F.col("g").alias("h"), F.col("v").alias("less"))
        prob = model.probs[k - 1].select("lang", F.col("g").alias("tail"), F.col("v").alias("own"))
        value = value.withColumn("tail", tail).withColumn("h", F.shiftrightunsigned("tail", 16))
        value = value.join(back, ["lang", "h"], "left").join(prob, ["lang", "tail"], "left")
        value = value.select("lang", "g", F.coalesce("own", F.col("logp") + F.coalesce("less", F.lit(0.0))).alias("logp"))
    # one row a sequence: a text's sequences then meet one value row each
    value = stored(value.groupBy("g").agg(*(F.max(F.when(F.col("lang") == x, F.col("logp"))).alias(f"l{i}") for i, x in enumerate(model.langs))), "sequence-values")
    sums = found.join(value, "g").groupBy("row").agg(F.sum("c").alias("size"), *(F.sum(F.col("c") * F.col(f"l{i}")).alias(f"l{i}") for i in range(len(model.langs))))
    return sums.select("row", F.array(*(-F.col(f"l{i}") / F.col("size") for i in range(len(model.langs)))).alias("h"), "size")


def identify(docs: DataFrame, model: Model, text_col: str = "text", margin: float = 0.8, spreads: float = 8.0) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``entropy`` and ``accepted`` beside the input columns.

    ``lang_pred`` is the language of lowest cross-entropy a character (ties:
    the first by name); ``und`` if the text is null or has no letter or the
    model knows no language, with score 0 and not accepted. ``score`` is the
    softmax of the negated cross-entropies in tenths of a nat. ``accepted``
    is false where the cross-entropy lies above the language's own mean by
    more than ``margin`` nats plus ``spreads`` standard errors. Only the text
    is read. Input columns of these four names are replaced; repeated rows
    stay as they are. What is broadcast is the model if it is within its
    bound; else its tables are joined with the distinct sequences of texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays)
    returns = "lang_pred string, score double, entropy double, accepted boolean"

    @F.pandas_udf(returns)
    def predict(texts: pd.Series) -> pd.DataFrame:
        m, texts = shared.value, texts.tolist()
        h, size = m.score(texts) if m.langs else (None, np.zeros(len(texts)))
        return m.verdict(h, size, margin, spreads)

    @F.pandas_udf(returns)
    def judge(h: pd.Series, size: pd.Series) -> pd.DataFrame:
        m = shared.value
        known = [x if x is not None else np.zeros(len(m.langs)) for x in h]
        return m.verdict(np.stack(known), size.fillna(0).to_numpy(), margin, spreads)

    if model.arrays.probs is not None:
        out = docs.select(F.struct("*").alias("row"), predict(F.col(text_col)).alias("is"))
    else:
        # numbers are given once, in a stored table: a recomputed task cannot give others
        rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "numbered")
        found = _joined_entropies(rows.select("row", F.col("doc").getField(text_col).alias("text")), model, "text")
        out = rows.join(found, "row", "left").select(F.col("doc").alias("row"), judge("h", "size").alias("is"))
    new = ("lang_pred", "score", "entropy", "accepted")
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new),
                      *(F.col(f"is.{c}").alias(c) for c in new))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of training: crc32 of the id as text leaves 2 when divided by 4; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))
