"""The pipeline, stage by stage, against brute-force versions on a small table."""
import random
import zlib

import numpy as np
import pytest

from tests.llm.test_near import brute_components, brute_lines, shingles
from tests.llm.test_tokens import check_packing

LONG = "this very long line stands in many of the documents of the corpus"


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    rng = random.Random(9)
    en = "the of and to in that was with for this from ing tion ther".split()
    de = "der die und das nicht mit von ist einer auf ung keit lich sch".split()

    def prose(words, n):
        return " ".join(rng.choice(words) + (rng.choice(words) if rng.random() < 0.6 else "") for _ in range(n))
    items = [(i, prose(en, 30)) for i in range(4)]
    rows = []
    for i in range(140):
        lang = rng.choice(["en", "de"])
        words = en if lang == "en" else de
        kind = rng.random()
        text = prose(words, rng.randrange(20, 120))
        if kind < 0.2 and rows:
            text, lang = rng.choice(rows)[1:3]
            if rng.random() < 0.5 and text:
                text = text.replace(" ", "  ", 1) + " end"
        elif kind < 0.3:
            text += " " + rng.choice(items)[1] + " " + prose(words, 5)
        elif kind < 0.5:
            text += "\n" + LONG
        rows.append((i, text, lang, f"s{i % 3}", len(text or "")))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "12345 6789", "en", "s", 10), (903, "ωορλδ και " * 20, None, "s", 200)]
    path = tmp_path_factory.mktemp("small")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_every_stage_against_brute_force(spark, inputs):
    import corpus_pipeline as P
    path, rows, items = inputs
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = rows
    for name, stage in P.STAGES[:-1]:
        from spanweave.llm._store import stored
        docs = stored(stage(spark, docs, path), name)
        assert docs.columns == columns
        got = sorted(map(tuple, docs.collect()))
        if name == "language_id":
            want = [r for r in kept if r[0] < 900]
        elif name == "line_dedup":
            lines = {d: h for d, _, _, h in brute_lines([(r[0], r[1]) for r in kept])}
            import hashlib
            assert {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in got} == lines
            want = [(r[0], t, *r[2:4], len(t)) for r, t in ((r, next(g[1] for g in got if g[0] == r[0])) for r in kept)]
            assert sum(LONG in r[1] for r in got) < sum(LONG in r[1] for r in kept)
        elif name == "ngram_jaccard_join":
            own = {d for d, _, c in brute_components([(r[0], r[1]) for r in kept], 5, 80, 100) if d == c}
            want = [r for r in kept if r[0] in own]
            assert len(want) < len(kept)
        else:
            bad = {r[0] for r in kept for _, t in items if 5 * len(shingles(t, 5, False) & shingles(r[1], 5, False)) >= 4 * len(shingles(t, 5, False))}
            want = [r for r in kept if r[0] not in bad]
            assert bad
        assert got == sorted(want), name
        kept = want
    packed = P.STAGES[-1][1](spark, docs, path).collect()
    check_packing(packed, [(r[0], r[1]) for r in kept], 2048, 0)
    whole = P.run(spark, path).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_stages_of_an_empty_table(spark, inputs):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{inputs[0]}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, inputs[0])
    assert P.STAGES[-1][1](spark, docs, inputs[0]).count() == 0


def test_null_ids_repeated_rows_and_clashing_columns_pass_the_stages(spark, inputs):
    import corpus_pipeline as P
    path, rows, _ = inputs
    clean = [r for r in rows if r[0] < 900 and LONG not in r[1]][:20]
    odd = [(None, clean[0][1] + " " + clean[1][1], "en", "s", 0)] + clean + clean[:1]
    docs = spark.createDataFrame([(*r, 1.5, "x", 7) for r in odd],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string, row int")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        if name == "line_dedup":  # neither stage drops a row here
            assert docs.count() == len(odd)
    got = docs.collect()
    assert {(r["score"], r["lang_pred"], r["row"]) for r in got} == {(1.5, "x", 7)}
    assert {r["doc_id"] for r in got} <= {r[0] for r in odd}
    packed = P.STAGES[-1][1](spark, docs, path).collect()
    assert len(packed) >= len(got)


def test_registered_and_optional():
    import __spark_entry__ as E
    names = list(E.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == 2583214201
