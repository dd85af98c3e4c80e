"""Quality rules: distribution divergence from language references, with DataFrame functions alone.

A first pass counts the words of every language. A second measures every text:
its words, symbols, repeated lines and windows, its characters by class and
the commonest words of its language. These measures are stored, and the
references of each language (the share of each character class, and of its
commonest words) are sums over all rows. A last, narrow pass compares each
text's two histograms to its language's reference (references are broadcast up
to ``BROADCAST_LANGUAGES`` rows, joined by shuffle beyond) by Jensen-Shannon distance (0: equal, 1: disjoint). Texts too short for a
histogram to mean anything are not judged by it. The limit of the words is
calibrated from each reference, see :func:`word_limit`.

Common words are the most frequent of all words. They are counted in part
before the shuffle: a task sends each distinct word of a language once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm._store import stored

GAP = r"[\x20\x09-\x0D]+"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "wide", "rest")
BROADCAST_LANGUAGES = 10_000
TOO_FAR = 0.45
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _only(text: Column, keep: str) -> Column:
    """How many characters of ``text`` are of the class ``keep``."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("bigint")


def repeated_windows(hashes: Column) -> Column:
    """Words inside the 3-word windows (by their 64-bit hashes, in order) that occur twice or more (each word once)."""
    def covered(h):
        numbered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def same(s, x, j):
            return x["x"].eqNullSafe(F.get(s, j)["x"])

        twice = _let(numbered, lambda s: F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)))
        at = F.transform(twice, lambda x: x["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2))))).cast("bigint")

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in ``words`` (each word once).

    Windows are compared by the 64-bit hash of their words. Only texts in
    which a hash recurs go further: there pairs of hash and position are
    sorted, and equal neighbours are repeats.
    """
    size = F.size(words)
    hashes = F.transform(F.slice(words, F.lit(1), size - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(size < 4, F.lit(0).cast("bigint")).otherwise(repeated_windows(hashes))


def common_counts(words: Column, common: Column) -> Column:
    """How often each of the ``common`` words (distinct) stands among ``words``."""
    # a search for one place walks the array without a call of a lambda for each of its items
    return _let(F.array_remove(F.transform(words, lambda w: F.array_position(common, w)), 0), lambda r: F.transform(
        common, lambda w, i: (F.size(r) - F.size(F.array_remove(r, (i + 1).cast("bigint")))).cast("bigint")))


def measures(text: Column, common: Column) -> list[Column]:
    """Columns of the base measures, the character classes (without ``rest``) and the counts of the ``common`` words of a text (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    length = F.length(t).cast("bigint")
    symbols = _only(t, r"#*$%&|<>")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w):
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                        repeated_words(w).alias("n_repeat_words"), common_counts(w, common).alias("n_common"))

    return [_let(F.filter(F.split(t, GAP), lambda x: x != ""), of_words).alias("w"), length.alias("n_all"), symbols.alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _only(t, "a-z").alias("lower"), _only(t, "A-Z").alias("upper"), _only(t, "0-9").alias("digit"),
            _only(t, ".,;:!?").alias("stop"), (F.octet_length(t).cast("bigint") - length).alias("wide")]


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    def part(a, b):
        return F.when(a > 0, a * F.log(2 * a / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda x, y: x + y)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / (2 * F.log(F.lit(2.0))))


def _shares(counts: list[Column]) -> Column:
    """Counts of classes as shares of their sum; all zero for an empty text."""
    total = sum(counts[1:], counts[0])
    return F.array(*(F.when(total > 0, c / total).otherwise(0.0) for c in counts))


def _class_counts(prefix: str = "") -> list[Column]:
    known = [F.col(prefix + c) for c in CLASSES[:-2]]
    rest = F.greatest(F.col(prefix + "n_all") - sum(known[1:], known[0]), F.lit(0).cast("bigint"))
    return [*known, F.col(prefix + "wide"), rest]


def word_limit(none: Column, classes: Column, n_words: Column, share: float) -> Column:
    """The largest natural word distance of a text of ``n_words`` words.

    ``none`` is the distance of a text without any of the ``classes`` common
    words. The limit is ``share`` of it, widened by the squared distance that
    drawing so few words gives. Where that comes close to ``none``, the text is
    too short to tell, and only distances above ``TOO_FAR`` are odd.
    """
    chance = classes / (8 * F.log(F.lit(2.0)) * n_words)
    limit = F.sqrt(share * share * none * none + chance)
    return F.when(limit < 0.95 * none, limit).otherwise(F.greatest(limit, F.lit(TOO_FAR)))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", columns: list[str] | None = None, common: int = 24,
          max_chars: int | None = 5, min_chars_judged: int = 200, min_words_judged: int = 100, max_char_distance: float = 0.32,
          max_word_distance: float | None = None, word_share: float = 0.7) -> DataFrame:
    """``columns`` of ``docs`` (default: all) with base measures, both distances and ``natural``.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (all long), ``char_distance``, ``word_distance``
    (double) and ``natural``: false if either distance is above its limit and
    the text is long enough to be judged by it (``min_chars_judged``
    characters, ``min_words_judged`` words). The limit of the words is
    ``max_word_distance`` if given, else :func:`word_limit`. Null text counts as empty: no
    words, natural. Rows with a null language share a reference of their own.
    Common words have at most ``max_chars`` characters; with None a word of any length can be one.
    Repeated rows are measured each. Ties among common words go to the first
    by name. Input columns of the added names are replaced. Without rows
    nothing is returned.
    """
    added = (*MEASURES, "char_distance", "word_distance", "natural")
    names = [c for c in (docs.columns if columns is None else columns) if c not in added]
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    # an outer generator: before an inner one the optimizer would split each text twice more
    counts = docs.select("lang", F.explode_outer(F.split("text", GAP)).alias("word")).where(F.col("word") != "")
    if max_chars is not None:
        counts = counts.where(F.length("word") <= max_chars)
    counts = counts.groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = (counts.withColumn("rank", rank).where(F.col("rank") <= common).groupBy(F.col("lang").alias("l"))
           .agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top")))
    top = stored(top.select("l", F.col("top.word").alias("ref_words"), F.col("top.n").alias("ref_n")), "common-words")  # a row of 'common' words for each language
    few = top.count() <= BROADCAST_LANGUAGES
    base = docs.join(F.broadcast(top) if few else top, F.col("lang").eqNullSafe(F.col("l")), "left")
    base = stored(base.select("row", "lang", *measures(F.col("text"), F.coalesce("ref_words", F.array().cast("array<string>")))), "measures")
    flat = base.select("*", "w.*").withColumn("space", F.col("n_all") - F.col("word_chars")).withColumn("symbol", F.col("n_symbols"))
    sums = flat.groupBy("lang").agg(F.sum("n_words").alias("n_words"), F.sum("n_all").alias("n_all"),
                                    *(F.sum(c).alias(c) for c in CLASSES[:-1]))
    refs = (sums.join(top, F.col("lang").eqNullSafe(F.col("l")), "left")
            .select(F.col("lang").alias("ref_lang"), _shares(_class_counts()).alias("ref_chars"),
                    F.transform(F.coalesce("ref_n", F.array().cast("array<bigint>")), lambda n: n / F.col("n_words")).alias("ref_shares")))
    refs = refs.withColumn("ref_none", _distance(F.concat(F.transform("ref_shares", lambda x: F.lit(0.0)), F.array(F.lit(1.0))), F.concat(
        "ref_shares", F.array(1 - F.aggregate("ref_shares", F.lit(0.0), lambda x, y: x + y)))))
    refs = stored(refs, "references")
    few = refs.count() <= BROADCAST_LANGUAGES
    found = flat.join(F.broadcast(refs) if few else refs, F.col("lang").eqNullSafe(F.col("ref_lang")))
    shares = F.transform("n_common", lambda n: n / F.col("n_words"))
    other = 1 - F.aggregate("n_common", F.lit(0).cast("bigint"), lambda x, y: x + y) / F.col("n_words")
    word_distance = _distance(F.concat(shares, F.array(other)), F.concat("ref_shares", F.array(1 - F.aggregate("ref_shares", F.lit(0.0), lambda x, y: x + y))))

    some = F.col("n_words") > 0
    limit = word_limit(F.col("ref_none"), F.size("ref_shares"), F.col("n_words"), word_share) if max_word_distance is None else F.lit(max_word_distance)
    found = found.select("row", *MEASURES, "n_all", F.when(some, limit).otherwise(1.0).alias("word_limit"), F.when(some, _distance(_shares(_class_counts()), F.col("ref_chars"))).otherwise(0.0).alias("char_distance"),
                         F.when(some, word_distance).otherwise(0.0).alias("word_distance"))
    odd = (((F.col("n_all") >= min_chars_judged) & (F.col("char_distance") > max_char_distance))
           | ((F.col("n_words") >= min_words_judged) & (F.col("word_distance") > F.col("word_limit"))))
    return found.select(*(F.col("row").getField(c).alias(c) for c in names), *MEASURES, "char_distance", "word_distance", (~odd).alias("natural"))
