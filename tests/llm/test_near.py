"""Similarity join, line dedup and decontamination against brute force on small tables."""
import hashlib
import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text, k, whole=True):
    w = WORD.findall(lower(text or ""))
    if len(w) >= k:
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w and whole else set()


def brute_components(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {(d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(30)]
    base, out = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 and base:
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.5 and base:
            w = list(base[0])
            w[rng.randrange(len(w))] = f"x{i}"
        else:
            w = [rng.choice(vocab) for _ in range(rng.randrange(1, 140))]
            if rng.random() < 0.4:
                w += passage
        base.append(w)
        text = rng.choice([" ", "  ", " \n"]).join(w)
        out.append((i * 3 % (3 * n) + 1, text.upper() if rng.random() < 0.1 else text))
    return out + [(9001, ""), (9002, None), (9003, " \t\n"), (9004, "one two"), (9005, "ONE two"), (9006, "ünder Über a b")]


@pytest.mark.parametrize("block_rows", [512, 3])
def test_components_match_brute_force(spark, block_rows):
    from spanweave.llm.jaccard import similar_components
    rows = corpus()
    df = spark.createDataFrame([(d, t, "hub", 1) for d, t in rows], "doc_id bigint, text string, hub string, n int")
    for k, num in ((3, 90), (5, 80)):
        got = {tuple(r) for r in similar_components(df, k=k, num=num, den=100, block_rows=block_rows, sketch_bits=12).collect()}
        assert got == brute_components(rows, k, num, 100)


def test_components_of_repeated_rows_null_ids_and_no_rows(spark):
    from spanweave.llm.jaccard import keep_one, similar_components
    text = " ".join(f"a{i}" for i in range(20))
    df = spark.createDataFrame([(5, text), (5, text), (3, text), (None, text), (None, "alone here now"), (None, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, similar_components(df).collect()), key=str)
    assert got == sorted([(5, 18, 3), (5, 18, 3), (3, 18, 3), (None, 18, 3), (None, 1, None), (None, 0, None)], key=str)
    assert similar_components(df.limit(0)).count() == 0
    kept = keep_one(df.withColumn("keep_id", df.doc_id), k=5, num=80)
    assert kept.columns == ["doc_id", "text", "keep_id"]
    assert sorted((r[0] for r in kept.collect()), key=str) == [3, None, None, None]


def test_hub_of_many_near_copies_is_one_component(spark):
    from spanweave.llm.jaccard import similar_components
    words = [f"v{i}" for i in range(120)]
    rows = [(0, " ".join(words))]
    for i in range(1, 400):
        w = list(words)
        w[(i * 7) % 118 + 1] = f"z{i}"
        rows.append((i, " ".join(w)))
    got = similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"), block_rows=64).collect()
    assert {r["component_id"] for r in got} == {0}


def brute_lines(rows, min_chars=40, min_docs=5):
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(BLANK))
            if len(key) >= min_chars and d is not None:
                held.setdefault(key, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(lower(x.strip(BLANK)), ())) >= min_docs and max(held[lower(x.strip(BLANK))]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 20, 1 << 3])
def test_lines_match_brute_force(spark, bits):
    from spanweave.llm.lines import dedup_lines
    rng = random.Random(4)
    common = ["The same long line that stands in very many documents " + str(i) for i in range(4)]
    edge = ["é" * 40, "é" * 39, "x" * 40, "x" * 39, " " + "y" * 39]
    rows = []
    for i in range(60):
        lines = [f"own line {i} {j} {'pad ' * rng.randrange(20)}" for j in range(rng.randrange(4))]
        for line in rng.sample(common + edge, rng.randrange(7)):
            lines += [rng.choice(["", " ", "\t"]) + rng.choice([line, line.upper() if line.isascii() else line]) + rng.choice(["", "\r", "  "])] * rng.randrange(1, 3)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n\n"), (59, rows[59][1]), (None, common[0] + "\nrest")]
    df = spark.createDataFrame([(d, t, 7, "k") for d, t in rows], "doc_id bigint, text string, n_dropped int, key string")
    out = dedup_lines(df, bloom_bits=bits)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()), key=str)
    assert got == brute_lines(rows)
    assert dedup_lines(df.limit(0)).count() == 0


def test_contained_items_match_brute_force(spark):
    from spanweave.llm.decontam import contaminated, without_contaminated
    rng = random.Random(8)
    vocab = [f"q{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 9, 20, 40, 41])))) for i in range(30)]
    items += [(30, None), (31, ""), (1, items[1][1]), (None, " ".join(vocab[:12]))]
    docs = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(3)):
            x = (rng.choice(items)[1] or "").split()
            if x and rng.random() < 0.5:
                x[rng.randrange(len(x))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((i, " ".join(w).upper()))
    docs += [(200, None), (201, ""), (202, "a b c"), (5, docs[5][1]), (None, docs[6][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for i, t in docs:
        own = shingles(t, 5, whole=False)
        for j, x in items:
            s = shingles(x, 5, whole=False)
            if s and 5 * len(s & own) >= 4 * len(s):
                want.append((i, j, len(s), len(s & own), len(s & own) / len(s)))
    for block in (1 << 22, 60):
        assert sorted(map(tuple, contaminated(d, b, block_shingles=block).collect()), key=str) == sorted(want, key=str)
        left = sorted((r["doc_id"] for r in without_contaminated(d, b, block_shingles=block).collect()), key=str)
        bad = {i for i, *_ in want}
        assert left == sorted((i for i, _ in docs if i not in bad), key=str) and want
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0
    assert without_contaminated(d, b.limit(0)).count() == len(docs)
