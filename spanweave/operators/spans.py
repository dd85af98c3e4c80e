"""Span operators: locate, merge, vote, format, score.

Offsets are 0-based, end-exclusive, counted in code points (Spark's
``locate``/``substring``/``length`` are 1-based code-point functions).
Nothing here materialises a per-character array: voting is an interval
sweep whose cost is proportional to the number of span boundaries, and the
sweep input is pre-aggregated: of a voter's spans with one start only the
furthest end is sent, so a hot pair has at most ``note_length`` rows a voter
in its task, and ``2 * note_length`` positions, however many spans it receives.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.text import VOTE_BLANKS, let, locate, strip_u
from spanweave.session import unique_dir


def _lead_blanks(note: Column, pos: Column) -> Column:
    """Number of vote blanks (space, tab, newline, CR) starting at 0-based ``pos``."""
    def count():
        rest = F.substring(note, pos + 1, 2147483647)
        return F.length(rest) - F.length(F.ltrim(rest, F.lit(VOTE_BLANKS)))
    return F.when(~F.substring(note, pos + 1, F.lit(1)).isin(*VOTE_BLANKS), 0).otherwise(count())


def _trail_blanks(note: Column, end: Column) -> Column:
    """Number of vote blanks ending just before 0-based exclusive ``end``."""
    def count():
        head = F.substring(note, F.lit(1), end)
        return F.length(head) - F.length(F.rtrim(head, F.lit(VOTE_BLANKS)))
    return F.when(~F.substring(note, end, F.lit(1)).isin(*VOTE_BLANKS), 0).otherwise(count())


def locate_spans(spans: DataFrame, notes: DataFrame, *, key: str = "pn_num", span_col: str = "span",
                 note_col: str = "pn_history", fuzzy_cutoff: float | None = None,
                 fuzzy_mode: str = "partial") -> DataFrame:
    """First occurrence of each span in its note: exact, then case-insensitive, then fuzzy.

    ``spans`` has ``key`` and ``span_col`` (plus any pass-through columns);
    ``notes`` has ``key`` and ``note_col`` (deduplicated by the caller).
    Returns the located rows with ``start``, ``end``, ``method`` and the
    note length ``note_len``; unresolved spans are dropped.  Exact and
    case-insensitive steps are JVM expressions; the fuzzy step (optional) is an
    Arrow UDF that runs only on the distinct unresolved (span, note) pairs.
    The span text is stripped first; an empty span or note never matches.
    """
    s = spans.withColumn(span_col, strip_u(F.col(span_col)))
    s = s.filter(F.col(span_col) != "")
    rest = [c for c in s.columns if c != key]
    # a span is searched in each text of its key and leaves with each of them: one row for a key that comes once
    texts = notes.select(key, note_col, F.length(note_col).alias("note_len"))  # measured once a note, not once a span
    held = texts.filter(F.col("note_len") > 0).select(key, F.col(note_col).alias("_in"))
    if fuzzy_cutoff is None:
        held = held.join(texts, key)
    more = [c for c in held.columns if c not in (key, "_in")]
    span, text = F.col(span_col), F.col("_in")

    def hit(at, method):
        return F.struct((at - 1).alias("start"), F.lit(method).alias("method"))

    found = let(locate(span, text), lambda e: F.when(e > 0, hit(e, "exact")).otherwise(
        let(locate(F.lower(span), F.lower(text)), lambda c: F.when(c > 0, hit(c, "ci")))))
    # the outer generator keeps filters behind it: one in front would parse and search once more
    j = s.join(held, key).select(key, *rest, *more, F.explode_outer(F.array(found)).alias("_at"))
    held_len = [c for c in more if c == "note_len"]
    j = j.select(key, *rest, *(c for c in more if c not in held_len), "_at.start", "_at.method", (F.col("_at.start") + F.length(span)).alias("end"), *held_len)
    if fuzzy_cutoff is None:
        return j.filter(F.col("start").isNotNull())
    from spanweave.operators.fuzzy import fuzzy_locate
    path = unique_dir(j.sparkSession, "located")  # both branches read what the first two steps found
    j.write.parquet(path)
    seen = j.sparkSession.read.parquet(path)
    lost = seen.filter(F.col("start").isNull()).drop("start", "end", "method")
    # a fixed number of parts: few bytes are many alignments, and would be put into few tasks
    parts = int(j.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    miss = lost.select(key, span_col).distinct().join(texts.drop("note_len"), key).repartition(parts, key, span_col)
    found = fuzzy_locate(miss, span_col=span_col, note_col=note_col, cutoff=fuzzy_cutoff, mode=fuzzy_mode).drop(note_col)
    j = seen.filter(F.col("start").isNotNull()).unionByName(lost.join(found, [key, span_col]))
    return j.join(texts, key).select(key, *rest, note_col, "start", "method", "end", "note_len")


def with_blank_edges(located: DataFrame, note_col: str = "pn_history") -> DataFrame:
    """Clamp to ``[0, note_len]``, drop empty spans, and record the vote-blank run
    after each start (``lead``) and before each end (``trail``).

    The two counts let the vote trim its runs without looking at the note
    again, so the note text never travels past the locate stage.
    """
    note = F.col(note_col)
    c = (located.withColumn("start", F.greatest(F.col("start"), F.lit(0)))
                .withColumn("end", F.least(F.col("end"), F.col("note_len")))
                .filter(F.col("start") < F.col("end")))
    return (c.withColumn("lead", _lead_blanks(note, F.col("start")))
             .withColumn("trail", _trail_blanks(note, F.col("end"))))


def far_edge(end: str = "end", trail: str = "trail") -> Column:
    """``end`` and ``trail`` (ints, ``trail`` may be null) as one long of the order of their struct.

    A maximum of longs is aggregated by hash; one of structs sorts all rows before the shuffle.
    """
    return F.shiftleft(F.col(end).cast("bigint"), 32) + F.coalesce(F.col(trail).cast("bigint") + 1, F.lit(0).cast("bigint"))


def far_parts(far: str, end: str = "end", trail: str = "trail") -> tuple[Column, Column]:
    """``end`` and ``trail`` of :func:`far_edge`."""
    low = F.col(far).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(F.col(far), 32).cast("int").alias(end), F.when(low > 0, (low - 1).cast("int")).alias(trail)


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end",
                    touching: bool = True, carry: bool = False, together: list[str] | None = None) -> DataFrame:
    """Islands merge: overlapping (and, by default, touching) intervals per ``keys``.

    Returns one row per merged interval with ``start``/``end``; with
    ``carry`` the blank counts of the first start and the last end travel along.
    Of intervals with one start only the furthest end counts, so those are
    taken first, in part before the shuffle: a window then holds at most one
    row for each position, however often an interval is repeated. ``together``
    names the keys that later steps group by.
    """
    furthest = [F.max(end).alias(end)] if not carry else [F.max(far_edge(end)).alias("_far"), F.max("lead").alias("lead")]
    df = df.groupBy(*keys, start).agg(*furthest)
    if carry:
        df = df.select(*keys, start, *far_parts("_far", end), "lead")
    if together:
        df = df.repartition(*together)
    w = Window.partitionBy(*keys).orderBy(F.col(start), F.col(end))
    prev = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    brk = (F.col(start) > prev) if touching else (F.col(start) >= prev)
    g = df.withColumn("_new", F.when(prev.isNull() | brk, 1).otherwise(0))
    g = g.withColumn("_grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = [F.min(start).alias(start), F.max(end).alias(end)]
    if carry:
        aggs += [F.min_by("lead", F.col(start)).alias("lead"), F.max_by("trail", F.col(end)).alias("trail")]
    return g.groupBy(*keys, "_grp").agg(*aggs).drop("_grp")


def majority_vote(located: DataFrame, threshold: int, *, pair_key: str = "id", voter: str = "model",
                  weight: str | None = "weight", n_voters: int | None = None) -> DataFrame:
    """Character-level majority vote as a weighted interval sweep.

    ``located`` rows: ``pair_key, voter, [weight], start, end, lead, trail``
    (from :func:`with_blank_edges`).  Within one voter spans are unioned, so
    overlap never adds votes; each voter adds its weight over its union.
    Characters with votes >= ``min(threshold, n_voters)`` form runs; each run
    loses its leading and trailing vote blanks, and all-blank runs vanish.
    Output: ``pair_key, start, end`` (final, non-empty, disjoint).
    """
    t = threshold if n_voters is None else min(threshold, n_voters)
    wcol = F.col(weight) if weight else F.lit(1)
    base = located.select(pair_key, voter, wcol.alias("_w"), "start", "end", "lead", "trail")
    # furthest ends by start, then one shuffle by pair: every window below reuses that partitioning
    merged = merge_intervals(base, [pair_key, voter, "_w"], carry=True, together=[pair_key])
    # both ends of an interval from one row, so the upstream plan runs once
    none = F.lit(None).cast("int")
    ends = F.array(F.struct(F.col("start").alias("pos"), F.col("_w").alias("d"), F.col("lead").alias("lead"), none.alias("trail")),
                   F.struct(F.col("end").alias("pos"), (-F.col("_w")).alias("d"), none.alias("lead"), F.col("trail").alias("trail")))
    ev = merged.select(pair_key, F.explode(ends).alias("e")).select(pair_key, "e.*")
    ev = ev.groupBy(pair_key, "pos").agg(F.sum("d").alias("d"), F.max("lead").alias("lead"),
                                         F.max("trail").alias("trail"))
    w = Window.partitionBy(pair_key).orderBy("pos")
    seg = (ev.withColumn("v", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("nxt", F.lead("pos").over(w))
             .withColumn("nxt_trail", F.lead("trail").over(w))
             .filter(F.col("v") >= t))
    seg = seg.withColumn("_new", F.when(F.lag("nxt").over(w) == F.col("pos"), 0).otherwise(1))
    seg = seg.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = seg.groupBy(pair_key, "_run").agg(
        (F.min("pos") + F.min_by("lead", F.col("pos"))).alias("start"),
        (F.max("nxt") - F.max_by("nxt_trail", F.col("nxt"))).alias("end"))
    return runs.filter(F.col("start") < F.col("end")).drop("_run")


def format_location(spans: DataFrame, pair_key: str = "id", start: str = "start", end: str = "end") -> DataFrame:
    """``"s e;s e"`` per pair, sorted by start (input spans are already disjoint)."""
    return spans.groupBy(pair_key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))),
                                 lambda x: F.concat_ws(" ", x["s"].cast("string"), x["e"].cast("string"))),
                     ";").alias("location"))


def trim_and_merge(spans: DataFrame, notes: DataFrame, *, pair_key: str = "id", key: str = "pn_num",
                   note_col: str = "pn_history") -> DataFrame:
    """The submission formatter on arbitrary spans: trim vote blanks from each
    span, drop empties, merge overlapping or touching spans, then format."""
    j = spans.join(notes.select(key, note_col), key).withColumn("note_len", F.length(note_col))
    j = with_blank_edges(j, note_col)
    j = (j.withColumn("start", F.col("start") + F.col("lead"))
          .withColumn("end", F.col("end") - F.col("trail"))
          .filter(F.col("start") < F.col("end")))
    m = merge_intervals(j, [pair_key], touching=True)
    return format_location(m, pair_key)


def parse_location(c) -> Column:
    """``"s e;s e"`` to ``array<struct<start:int,end:int>>`` (null or empty gives ``[]``)."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.struct(
        F.split(F.trim(p), " +").getItem(0).cast("int").alias("start"),
        F.split(F.trim(p), " +").getItem(1).cast("int").alias("end")))


# ------------------------------------------------------------------ scoring
def occurrences(note, span) -> Column:
    """All (overlapping) occurrences of ``span`` in ``note`` as ``array<struct<s,e>>``.

    A span that is found once, as most are, takes two searches. Of others a
    zero-width lookahead counts the occurrences in the JVM regex engine; the
    fold then walks ``locate`` from hit to hit, so the cost follows the number
    of hits rather than the note length.
    """
    note = F.col(note) if isinstance(note, str) else note
    L = F.length(span)
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(span, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    cnt = F.size(F.regexp_extract_all(note, quoted, F.lit(0)))
    starts = F.aggregate(
        F.sequence(F.lit(1), cnt), F.array().cast("array<int>"),
        lambda acc, _: F.concat(acc, F.array(
            locate(span, note, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + 2) - 1)))
    def found(first):
        once = F.array(F.struct((first - 1).alias("s"), (first - 1 + L).alias("e")))
        many = F.transform(starts, lambda i: F.struct(i.alias("s"), (i + L).alias("e")))
        return F.when((L > 0) & (first > 0), F.when(locate(span, note, first + 1) > 0, many).otherwise(once)) \
                .otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    return let(locate(span, note), found)


def all_occurrences(note, spans) -> Column:
    """Occurrences of every span of an array (null: none), as one array of intervals."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    return F.flatten(F.transform(F.coalesce(spans, F.array().cast("array<string>")), lambda s: occurrences(note, s)))


def covered_chars(intervals) -> Column:
    """Size of the union of ``array<struct<s,e>>`` intervals (linear after the sort)."""
    init = F.struct(F.lit(-1).alias("m"), F.lit(0).cast("long").alias("t"))
    return F.aggregate(
        F.array_sort(intervals), init,
        lambda acc, x: F.struct(F.greatest(acc["m"], x["e"]).alias("m"),
                                (acc["t"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["m"]))).alias("t")),
        lambda acc: acc["t"])


def interval_counts(pred, truth) -> Column:
    """``struct<tp,fp,fn>`` in characters of two arrays of intervals."""
    pred, truth = (F.col(c) if isinstance(c, str) else c for c in (pred, truth))

    def counts(o):
        return let(F.struct(covered_chars(o["p"]).alias("np"), covered_chars(o["t"]).alias("nt"),
                            covered_chars(F.concat(o["p"], o["t"])).alias("nu")),
                   lambda c: F.struct((c["np"] + c["nt"] - c["nu"]).alias("tp"), (c["nu"] - c["nt"]).alias("fp"),
                                      (c["nu"] - c["np"]).alias("fn")))
    return let(F.struct(pred.alias("p"), truth.alias("t")), counts)


def char_counts(note, pred, truth) -> Column:
    """Per-row ``struct<tp,fp,fn>`` over the character sets of all occurrences."""
    return interval_counts(all_occurrences(note, pred), all_occurrences(note, truth))


def micro_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """``2tp / (2tp + fp + fn)``; 1.0 when the denominator is zero."""
    den = 2 * tp + fp + fn
    return F.when(den == 0, F.lit(1.0)).otherwise(2.0 * tp / den)
