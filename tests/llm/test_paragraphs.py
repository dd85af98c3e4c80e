"""Passage dedup: exact and near copies against brute force, edges, and the text that stays."""
import random
import re
import uuid

import pytest

from spanweave.llm.paragraphs import Paragraphs, cut_units, dedup_passages, paragraphs, repeated_units, tune

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=5):
    w = WORD.findall(text.lower())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows, min_words=6):
    """(id, unit, first id) of units that repeat an earlier one of their cluster."""
    found = [(i, j, shingle_set(t[a:b])) for i, t in rows if t for j, (a, b) in enumerate(paragraphs([t])[0]) if len(WORD.findall(t[a:b])) >= min_words]
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(found)):
        for y in range(x):
            a, b = found[x][2], found[y][2]
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(x)] = find(y)
    groups = {}
    for x, (i, j, _) in enumerate(found):
        groups.setdefault(find(x), []).append((i, j))
    return {(i, j, min(g)[0]) for g in groups.values() for i, j in g if (i, j) != min(g)}


def sentences_of(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[^ .][^.]*\.", text)]


def sentence(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(200)) for _ in range(n)).capitalize() + "."


def corpus(seed=3):
    rng = random.Random(seed)
    shared = [" ".join(sentence(rng, rng.randrange(9, 30)) for _ in range(4)) for _ in range(5)]
    rows = []
    for i in range(70):
        parts = [sentence(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.6:
            text = rng.choice(shared).split(" ")
            if rng.random() < 0.4:
                text[rng.randrange(len(text))] = "changed"
            parts.insert(rng.randrange(len(parts) + 1), " ".join(text))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows


def found_units(spark, rows, recall, filter_bits=1 << 20, block_rows=512):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return {tuple(r) for r in repeated_units(df, "doc_id", "text", 5, 4, 5, 6, recall, filter_bits, block_rows, 1 << 20, paragraphs).collect()}


@pytest.mark.parametrize("block_rows", [512, 4])
def test_repeated_units_match_brute_force(spark, block_rows):
    rows = corpus()
    got = found_units(spark, rows, 0.9999, block_rows=block_rows)
    assert got == brute(rows) and len(got) > 40


def test_registered_recall_and_a_full_filter(spark):
    rows = [(i, t) for c in range(3) for i, t in ((1000 * c + i, t) for i, t in corpus(30 + c))]
    want = brute(rows)
    got = found_units(spark, rows, 0.98, filter_bits=1 << 16)
    assert got <= want and len(got) >= 0.98 * len(want) > 100
    assert found_units(spark, rows, 0.98, filter_bits=64) == got  # every row passes the filter


def test_a_hot_unit_and_long_texts(spark):
    rng = random.Random(40)
    hot = " ".join(sentence(rng, 15) for _ in range(3))
    rows = [(i, f"{sentence(rng, 12)}\n{hot}" if i % 3 == 0 else sentence(rng, 12)) for i in range(300)]
    rows.append((999, "\n".join(sentence(rng, rng.randrange(5, 40)) for _ in range(12000)) + "\n" + hot))  # more than one group of units
    assert len(rows[-1][1]) > 1 << 20
    out = dedup_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), filter_bits=1 << 20)
    cut = {r["doc_id"]: r for r in out.where("size(removed) > 0").collect()}
    assert set(cut) == {i for i in range(3, 300, 3)} | {999} and {tuple(r["kept_in"]) for r in cut.values()} == {(0,)}
    assert all(cut[i]["text"].strip() == t.split("\n")[0] for i, t in rows[:-1] if i in cut)
    assert cut[999]["text"].strip() == rows[-1][1][:-len(hot)].strip()


def test_passages_go_and_the_rest_stays(spark):
    rng = random.Random(1)
    passage = " ".join(sentence(rng, 14) for _ in range(4))
    own = [sentence(rng, 12) for _ in range(8)]
    rows = [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{own[2]} {passage} {own[3]}"), (3, f"{own[4]}\n{passage}\n{own[5]}"), (4, own[6]), (5, None), (6, ""),
            (7, f"{own[7]}\n{passage[:passage.index('.') + 1]}"), (None, passage), (4, own[6])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, units string")
    out = dedup_passages(df, filter_bits=1 << 20)
    assert out.columns == ["doc_id", "text", "units", "removed", "kept_in"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["text"], [(s["start"], s["end"]) for s in r["removed"]], r["kept_in"]))
    assert got[1] == [(rows[0][1], [], [])] and got[4] == [(own[6], [], [])] * 2 and got[5] == [(None, [], [])] and got[6] == [("", [], [])]
    assert got[2][0][0] == f"{own[2]} {own[3]}" and got[2][0][2] == [1]
    assert got[3][0][0] == f"{own[4]}\n{own[5]}" and got[None][0][0] == ""
    at = got[2][0][1][0]
    assert rows[1][1][at[0]:at[1]] == passage
    assert got[7][0][1] == []  # one sentence of 14 words is no run of 20
    assert dedup_passages(df.limit(0), filter_bits=1 << 20).count() == 0


def test_cuts():
    def units(t):
        return [(m.start(), m.end()) for m in re.finditer(r"[^.]+\.", t)]

    text = "Keep me." + " ".join(["word"] * 30) + ".tiny." + " ".join(["more"] * 9) + ".End."
    assert cut_units(text, {1, 2, 3}, 25, units(text))[0] == "Keep me.End."
    assert cut_units(text, {1, 3}, 25, units(text))[0] == text.replace(" ".join(["word"] * 30) + ".", "")  # the tiny one stays, and what is left is short
    assert cut_units(text, {3}, 25, units(text)) == (text, [])
    assert cut_units("", set(), 25, []) == ("", [])


def test_banding_reaches_its_recall():
    for similarity, recall in ((0.8, 0.98), (0.9, 0.999), (0.5, 0.9)):
        bands, rows = tune(similarity, recall)
        assert bands * rows <= 96 and 1 - (1 - similarity ** rows) ** bands >= recall


def test_paragraphs_hold_every_word_and_ignore_what_is_around():
    rng = random.Random(9)
    texts = [None, "", " \n ", "Too short.", "same " * 200, "Ünd ß. " * 30, "\n".join(sentence(rng, rng.randrange(1, 60)) for _ in range(40))]
    for t, spans in zip(texts, paragraphs(texts)):
        parts = [(t or "")[a:b].split() for a, b in spans]
        assert sum(parts, []) == (t or "").split() and paragraphs([t]) == [spans]
        assert all(6 <= len(x) <= 32 for x in parts) or len(sum(parts, [])) < 6
    a, b, passage = ([x for _ in range(40) for x in sentence(rng, 17).split()] for _ in range(3))
    one, other = " ".join(a[:300] + passage + a[300:]), " ".join(b[:205] + passage + b[205:])
    shared = {one[x:y] for x, y in paragraphs([one])[0]} & {other[x:y] for x, y in paragraphs([other])[0]}
    assert len(" ".join(shared).split()) > len(passage) - 60


def test_passages_of_short_sentences_and_inside_sentences_go(spark):
    rng = random.Random(12)
    short = " ".join(sentence(rng, rng.randrange(2, 6)) for _ in range(20))  # no sentence of six words
    inner = " ".join(x for _ in range(3) for x in sentence(rng, 22).split())[8:-8].strip()  # begins and ends inside a sentence
    own = [sentence(rng, 20)[:-1] for _ in range(8)]
    rows = [(2 * i + j, f"{own[4 * i + 2 * j]} {p} {own[4 * i + 2 * j + 1]}") for i, p in enumerate((short, inner)) for j in (0, 1)]
    got = {r["doc_id"]: r for r in dedup_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), filter_bits=1 << 20).collect()}
    for first, passage in ((0, short), (2, inner)):
        assert got[first]["removed"] == [] and got[first + 1]["kept_in"] == [first]
        assert len(got[first + 1]["text"].split()) <= 40 + 2 * 16
        assert all(w in got[first + 1]["text"].split() for w in rows[first + 1][1].split() if w not in passage.split())


def test_the_only_copy_of_a_short_sentence_stays(spark):
    rng = random.Random(21)
    parts = [" ".join(sentence(rng, 14) for _ in range(3)) for _ in range(3)]
    rows = []
    for i, n in enumerate((8, 8, 9, 7)):  # near copies: a short sentence of its own in each, one of them changed in one word
        short = [sentence(rng, n), sentence(rng, n)]
        if i == 1:
            short[0] = rows[0][2][0].replace(rows[0][2][0].split()[4], "changed")
        rows.append((i, f"{parts[0]} {short[0]} {parts[1]} {short[1]} {parts[2]}", short))
    out = dedup_passages(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), filter_bits=1 << 20)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] == rows[0][1]
    for i, _, short in rows[1:]:
        assert got[i].split() == " ".join(short).split()
    text = " ".join(x[1] for x in rows[:1])
    cut, spans = cut_units(text, {0, 1, 2, 4, 5, 6}, 20, sentences_of(text))  # unit 3 may be the first of its cluster
    assert rows[0][2][0] in cut and len(spans) == 2


def test_texts_are_cut_into_units_twice_whatever_the_batches(spark, tmp_path):
    class Counted(Paragraphs):
        def borders(self, data, starts, ends, first, hashes):
            (tmp_path / uuid.uuid4().hex).write_text(str(len(first) - 1))
            return super().borders(data, starts, ends, first, hashes)

    rng = random.Random(50)
    hot = sentence(rng, 15)
    rows = corpus() + [(100 + i, f"{hot} {hot}" if i % 2 else hot) for i in range(40)] + [(200, None), (201, ""), (None, hot), (100, hot)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).localCheckpoint()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # keys and classes go on over many batches
    try:
        got = repeated_units(df, "doc_id", "text", 5, 4, 5, 6, 0.9999, 1 << 20, 512, 1 << 20, Counted()).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = brute([r for r in rows if r[0] is not None])
    assert {tuple(r) for r in got if r["id"] is not None} == want
    assert [r["first_id"] for r in got if r["id"] is None] == [100] * len(paragraphs([hot])[0])
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 2 * len(rows)  # four times before
