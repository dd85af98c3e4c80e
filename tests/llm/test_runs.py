"""Periodic runs against a search of every period, and the digests of the registered query."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from spanweave.llm import runs as R
from spanweave.llm.catalog import op12_periodic_runs

GAP = re.compile(r"[\x20\x09-\x0D]+")


def brute(w, least=12):
    """Every period from 1 on; a stretch counts with the smallest period that gives it."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def words_of(text):
    return [x for x in GAP.split(text or "") if x]


def sequences(rng):
    s = [rng.randrange(rng.choice([1, 2, 3, 5, 40])) for _ in range(rng.randrange(120))]
    for _ in range(rng.randrange(3)):
        if s:
            a, p = rng.randrange(len(s)), rng.randrange(1, 20)
            s[a:a] = s[a:a + p] * rng.randrange(1, 8)
    return s


def test_runs_equal_a_search_of_all_periods():
    rng = random.Random(8)
    for _ in range(250):
        texts = [sequences(rng) for _ in range(rng.randrange(1, 8))]
        least = rng.choice([4, 6, 12, 12])
        first = np.cumsum([0] + [len(t) for t in texts])
        got = R.runs_of(np.array([x for t in texts for x in t], np.int64), first, least)
        want = [[a + o, b + o, q] for t, o in zip(texts, first.tolist()) for a, b, q in brute(t, least)]
        assert got.tolist() == sorted(want, key=lambda r: (r[0], r[2]))


def test_small_blocks_of_candidates_change_nothing(monkeypatch):
    rng = random.Random(3)
    s = [rng.randrange(2) for _ in range(700)]
    first = np.array([0, 700])
    want = R.runs_of(np.array(s), first, 12).tolist()
    monkeypatch.setattr(R, "_BLOCK", 97)
    assert R.runs_of(np.array(s), first, 12).tolist() == want == [list(r) for r in brute(s)]


def test_grammar_gives_the_text_back_and_no_pair_twice():
    rng = random.Random(2)
    for _ in range(100):
        s = sequences(rng)
        rules, rest = R.re_pair(s)

        def expand(x):
            return [x] if x >= 0 else expand(rules[-1 - x][0]) + expand(rules[-1 - x][1])

        assert [y for x in rest for y in expand(x)] == s
        pairs = [p for p in zip(rest, rest[1:]) if p[0] != p[1]]
        assert len(pairs) == len(set(pairs))


def plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def digest(doc_id, text):
    w = plant(doc_id, words_of(text)) if doc_id is not None else words_of(text)
    found = brute(w)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    best = min(((-(b - a), a, q) for a, b, q in found), default=None)
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc_id, len(found), *((best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_query_equals_brute_force_on_documents(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["a", "B", "b", "é", "日本", "x.", " y", "word", "zz"]
    rows = [(i, "".join(rng.choice(vocabulary[:rng.choice([2, 4, 9])]) + rng.choice([" ", "\n", "\t ", "\x0b", " \r\n"])
                        for _ in range(rng.randrange(90)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "q " * 30), (203, "w " * 13), (203, "w " * 13), (204, "one"),
             (205, " ".join(f"u{i % 4999}" for i in range(30000)))]
    spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id bigint, text string, runs string, start int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r)[:8] for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    long = [r for r in got if r[0] == 205]
    assert sorted((r for r in got if r[0] != 205), key=key) == sorted((digest(i, t) for i, t in rows if i != 205), key=key)
    assert len(long) == 1 and long[0][1] == 1


def test_empty_table_and_odd_least(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert R.periodic_runs(empty).collect() == []
    with pytest.raises(ValueError):
        R.periodic_runs(empty, least=11)
