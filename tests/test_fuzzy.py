"""Fuzzy alignment against brute force (DP LCS over every candidate window)."""
import random

import pytest

from spanweave.operators.fuzzy import partial_alignment, ratio, window_alignment


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def r_dp(a, b):
    return 100.0 if not a and not b else 100.0 * 2 * lcs_dp(a, b) / (len(a) + len(b))


def brute_partial(span, note, cutoff):
    if not span or not note:
        return None
    if len(span) > len(note):
        s = r_dp(note, span)  # best over windows of the span; location is the whole note
        best = max([r_dp(note, span[i:i + len(note)]) for i in range(len(span) - len(note) + 1)]
                   + [r_dp(note, span[:i]) for i in range(1, len(note))] + [r_dp(note, span[i:]) for i in range(len(span))])
        return (0, len(note), best) if best >= cutoff and best > 0 else None
    m, n = len(span), len(note)
    cands = [(0, i) for i in range(1, m)] + [(i, i + m) for i in range(0, n - m)] + [(i, n) for i in range(n - m, n)]
    chars = set(span)
    best, pos = 0.0, None
    for lo, hi in cands:
        probe = note[hi - 1] if (lo == 0 and hi < m) or (hi == lo + m and lo < n - m) else note[lo]
        if probe not in chars:
            continue
        sc = r_dp(span, note[lo:hi])
        if sc >= cutoff and sc > best:
            best, pos = sc, (lo, hi)
            if sc == 100.0:
                break
    if best != 100.0 and m == n:
        alt = brute_partial_swap(note, span, max(cutoff, best))
        if alt is not None and alt > best:
            return (0, m, alt)
    if pos is None:
        return None
    return (pos[0], pos[1], best)


def brute_partial_swap(s1, s2, cutoff):
    m, n = len(s1), len(s2)
    cands = [(0, i) for i in range(1, m)] + [(i, i + m) for i in range(0, n - m)] + [(i, n) for i in range(n - m, n)]
    vals = [r_dp(s1, s2[lo:hi]) for lo, hi in cands]
    vals = [v for v in vals if v >= cutoff]
    return max(vals) if vals else None


def brute_window(span, note, cutoff):
    L, n = len(span), len(note)
    best, bs, be = 0, -1, -1
    for win in range(max(1, int(L * 0.80)), min(n, int(L * 1.20)) + 1):
        sb, sp = None, -1
        for s in range(0, n - win + 1):
            sc = r_dp(span, note[s:s + win])
            if sc >= cutoff and (sb is None or sc > sb):
                sb, sp = sc, s
        if sb is not None and sb > best:
            best, bs, be = sb, sp, sp + win
    return (bs, be, best) if best >= cutoff and bs != -1 else None


def test_ratio_is_indel_not_levenshtein():
    assert ratio("abcd", "abcd") == 100.0
    assert abs(ratio("ab", "ba") - 50.0) < 1e-9


@pytest.mark.parametrize("seed", range(8))
def test_partial_matches_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        note = "".join(rnd.choice("abcd \n") for _ in range(rnd.randint(1, 30)))
        span = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 8)))
        cutoff = rnd.choice([0.0, 50.0, 70.0])
        assert partial_alignment(span, note, cutoff) == brute_partial(span, note, cutoff), (span, note, cutoff)


@pytest.mark.parametrize("seed", range(8))
def test_window_matches_brute_force(seed):
    rnd = random.Random(100 + seed)
    for _ in range(40):
        note = "".join(rnd.choice("abcd \n") for _ in range(rnd.randint(1, 30)))
        span = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 10)))
        cutoff = rnd.choice([50.0, 72.0])
        assert window_alignment(span, note, cutoff) == brute_window(span, note, cutoff), (span, note, cutoff)


def test_newline_crossing_span_found_fuzzily():
    note = "pain in the\nchest since monday"
    r = partial_alignment("the chest", note, 70.0)
    assert r is not None and note[r[0]:r[1]].replace("\n", " ") == "the chest"


@pytest.mark.parametrize("seed", range(4))
def test_long_spans_and_many_windows_match_brute_force(seed):
    """Spans on either side of 64 characters, wide characters, and more windows than are scored first."""
    rnd = random.Random(500 + seed)
    for size in (1, 20, 63, 64, 65, 90):
        for _ in range(3):
            note = "".join(rnd.choice("ab é日\n😀") for _ in range(rnd.randint(size, 220)))
            at = rnd.randrange(len(note))
            span = "".join(c for c in note[at:at + size] if rnd.random() > 0.1) or "b"
            assert partial_alignment(span, note, 70.0) == brute_partial(span, note, 70.0), (span, note)
            assert window_alignment(span, note, 72.0) == brute_window(span, note, 72.0), (span, note)


def test_both_scorers_agree():
    from spanweave.operators.fuzzy import _partial, _partial_impl
    rnd = random.Random(9)
    for _ in range(60):
        note = "".join(rnd.choice("abcdefgh  \n") for _ in range(rnd.randint(40, 900)))
        at = rnd.randrange(len(note))
        span = "".join(c for c in note[at:at + rnd.randint(1, 40)] if rnd.random() > 0.2) or "a"
        for cutoff in (0.0, 60.0, 70.0, 90.0):
            assert _partial(span, note, cutoff) == _partial_impl(span, note, cutoff)


def test_a_lost_span_is_aligned_once(spark):
    from spanweave.operators.fuzzy import fuzzy_locate
    miss = spark.createDataFrame([(1, "chst pain", "some chest pain"), (2, "zzz", "note")], "k int, span string, pn_history string").repartition(3, "k")
    out = fuzzy_locate(miss, cutoff=72.0, mode="window")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["k"], r["start"], r["end"]) for r in out.collect()] == [(1, 5, 15)]


def test_all_window_sizes_at_once_in_small_blocks():
    from spanweave.operators.fuzzy import _Windows, window_alignment
    rng = random.Random(11)
    for _ in range(300):
        note = "".join(rng.choice("abcd é") for _ in range(rng.randrange(1, 400)))
        span = "".join(rng.choice("abcd éx") for _ in range(rng.randrange(1, 65)))
        sizes = range(max(1, int(len(span) * 0.8)), min(len(note), int(len(span) * 1.2)) + 1)
        for cutoff in (40.0, 72.0):
            assert window_alignment(span, note, cutoff) == _Windows(span, note).best_of_sizes(sizes, cutoff, first=2, block=500)
