"""What is made once a note, a feature, a bucket or an Arrow batch, so that time grows with the input and no faster."""
import inspect

import pytest
from pyspark.sql import functions as F

from spanweave.functions import prompts as P
from spanweave.functions.text import parse_json_strict, parse_spans
from spanweave.functions.tokenizers import BLANKS


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_training_text_in_parts_has_the_ids_of_the_whole(spark):
    rows = [(" a note with  blanks\n", "chest-pain", '{"spans": ["a b"]}'), ("x", "", ""), (None, None, None), ('"', 'f "g"', "t"), ("\x1c", " ", " ")]
    df = spark.createDataFrame(rows, "n string, f string, t string")
    head, body, rest, asked = P.training_parts("n", "f", "t")
    full, prompt = P.render_chatml(P.chat_messages("n", "f", "t")), P.render_chatml(P.chat_messages("n", "f"), True)
    joined = lambda end: F.concat(BLANKS.ids(head), BLANKS.ids(body), BLANKS.ids(end))
    for r in df.select(F.concat(head, body, rest).alias("a"), full.alias("b"), joined(rest).alias("c"), BLANKS.ids(full).alias("d"),
                       joined(asked).alias("e"), BLANKS.ids(prompt).alias("g")).collect():
        assert r.a == r.b and r.c == r.d and r.e == r.g


def test_blank_texts_leave_before_the_joins(spark):
    from spanweave.plans.training import training_rows
    train = spark.createDataFrame([(f"{n}_{f}", n, 0, f, "['a']") for n in (1, 2, 3, 4) for f in (1, 2, 9)], "id string, pn_num long, case_num int, feature_num long, annotation string")
    notes = spark.createDataFrame([(1, "text"), (1, "again"), (2, "  "), (3, None)], "pn_num long, pn_history string")
    features = spark.createDataFrame([(0, 1, "f"), (0, 2, "\n")], "case_num int, feature_num long, feature_text string")
    out = training_rows(train, None, notes, features, of_note={"n": F.length("pn_history")})
    assert sorted((r.id, r.pn_history, r.n) for r in out.collect()) == [("1_1", "again", 5), ("1_1", "text", 4)]
    narrow = plan(out.select("id"))
    assert "LeftOuter" not in narrow and "coalesce(pn_history" not in narrow


@pytest.mark.parametrize("mode", ["greedy", "first_object", "outer_braces"])
def test_plain_outputs_read_as_parsed_ones(spark, mode):
    # a second key makes an output that only the JSON parser reads
    lists = ['', '"a"', '" a " , "b"', '" ", "é"', '"}"', '"]"', ", ".join(f'"i{i}"' for i in range(17))]
    df = spark.createDataFrame([(i, f'{{"spans": [{x}]}}', f'{{"spans": [{x}], "n": 1}}') for i, x in enumerate(lists)], "i int, p string, q string")
    for r in df.select(parse_spans("p", mode).alias("p"), parse_spans("q", mode).alias("q")).collect():
        assert r.p == r.q
    odd = {'[{"spans": ["a"]}]': {"greedy": ["a"], "first_object": ["a"], "outer_braces": []}, '{"spans": ["a"]} {"spans": ["b"]}': {"greedy": [], "first_object": ["a"], "outer_braces": []}}
    for raw, want in odd.items():
        assert spark.createDataFrame([(raw,)], "r string").select(parse_spans("r", mode)).first()[0] == want[mode]


def test_texts_that_are_no_json_are_told_by_their_ends(spark):
    texts = ['{"a": 1}', ' {"a": 1}\n', '{"a": 1', '{"a": 1} x', "[1]", '"s"', "1", "-1", "true", "false", "null", "Answer: {}", "```json", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    said = parse_json_strict(F.col("t"))
    got = [r.ok for r in df.select(said.isNotNull().alias("ok")).collect()]
    assert got == [True, True, False, False, True, True, True, True, True, True, True, False, False, False, False]
    assert "`A-HJ" in plan(df.select(said))


def test_notes_are_measured_once(spark):
    from spanweave.operators.spans import locate_spans
    notes = spark.createDataFrame([(1, "one two")], "pn_num int, pn_history string")
    spans = spark.createDataFrame([(1, "two"), (1, "one")], "pn_num int, span string")
    found = locate_spans(spans, notes)
    assert [r.note_len for r in found.collect()] == [7, 7]
    assert "length(pn_history" not in plan(found).split("Join")[0]


def test_votes_and_states_are_by_group_of_pairs(spark):
    from spanweave.operators.grouped_vote import vote_grouped
    from spanweave.streaming import jobs, state_vote
    df = spark.range(4000).selectExpr("concat('p', id div 2) id", "concat('m', id % 2) model", "1 weight", "0 start", "4 end", "0 lead", "0 trail")
    out = vote_grouped(df, 2)
    assert "pmod(hash(" in plan(out) and out.count() == 2000
    assert sorted(spark.range(50000).select(jobs.bucket_of("id").alias("b")).distinct().agg(F.count("b"), F.max("b")).first()) <= [jobs.BUCKETS, jobs.BUCKETS]
    assert 'groupBy("bucket")' in inspect.getsource(jobs._vote_stream) and 'groupBy("bucket")' in inspect.getsource(state_vote.run_vote)


def test_fallback_writes_texts_of_failed_rows_only(spark):
    from spanweave.operators.labelers import PhraseLabeler, label_with_fallback, phrase_labeler_factory
    df = spark.createDataFrame([(i, "a cough " * (1 + 9 * (i == 3)), "cough") for i in range(6)], "id int, pn_history string, feature_text string").coalesce(1)
    run = lambda **k: label_with_fallback(df, lambda: PhraseLabeler(max_note_chars=20), phrase_labeler_factory, batch=2, **k)
    whole, narrow = run(), run(keep=["id"])
    assert narrow.columns == ["id", "raw", "error"] and whole.columns == [*df.columns, "raw", "error"]
    assert sorted(map(tuple, narrow.collect())) == sorted((r.id, r.raw, r.error) for r in whole.collect())
    assert narrow.where("error is not null").count() == 0 and narrow.count() == 6


def test_fewshot_parts_give_the_whole_prompt(spark):
    ex = "array(named_struct('pn_history', 'x\\ny', 'feature_text', 'f', 'annotation', 'a | b'))"
    df = spark.range(1).selectExpr("' no\\nte ' n", "'feat' f", f"{ex} e")
    whole = P.fewshot_messages("n", "f", "e")[1]["content"]
    parts = P.fewshot_turns(P.one_line("n"), "f", P.fewshot_block("e"))[1]["content"]
    r = df.select(whole.alias("a"), parts.alias("b")).first()
    assert r.a == r.b and 'Note: "no te"' in r.a and 'Note (excerpt): "x y"' in r.a
    assert "translate(" not in plan(df.select(whole))


def test_padded_rows_reads_sizes_without_arrays(spark, tmp_path):
    from spanweave.operators.batching import padded_rows
    spark.createDataFrame([("a", 3, [1, 2, 3], [1, 2, 3]), ("b", 1, [4], [4])], "id string, n_tok int, input_ids array<int>, labels array<int>").write.parquet(f"{tmp_path}/e")
    out = padded_rows(spark.read.parquet(f"{tmp_path}/e"), 0)
    assert "size(input_ids" not in plan(out) and {r.id: r.input_ids for r in out.collect()} == {"a": [1, 2, 3, 0, 0, 0, 0, 0], "b": [4] + [0] * 7}


def test_features_get_their_examples_before_they_meet_notes(spark):
    from spanweave.plans.pseudo_label import with_blocks
    features = spark.createDataFrame([(1, 0, "f"), (2, 0, "g"), (2, 1, "h")], "feature_num long, case_num int, feature_text string")
    one = [("note", "f", "a | b")]
    examples = spark.createDataFrame([(2, one), (2, one)], "feature_num long, examples array<struct<pn_history:string,feature_text:string,annotation:string>>")
    rows = with_blocks(features, examples)
    got = sorted((r.feature_num, r.case_num, r.block is None) for r in rows.collect())
    assert got == [(1, 0, True), (2, 0, False), (2, 0, False), (2, 1, False), (2, 1, False)]
    assert "strategy=broadcast" in plan(spark.range(3).selectExpr("cast(id as int) case_num").join(rows, "case_num"))


@pytest.mark.parametrize("query", ["fewshot_prompt", "pseudo_label"])
def test_no_text_of_a_pair_is_shuffled(spark, query, monkeypatch):
    from spanweave.operators import labelers as LB
    from spanweave.plans import catalog
    seen = []
    monkeypatch.setattr("spanweave.plans.pseudo_label.label", lambda df, *a, **k: seen.append(df) or LB.label(df, *a, **k))
    out = catalog.QUERIES[query](spark, "/root/testdata/sf0.001")
    text = (seen or [out])[0]._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line]
    assert joins and not any("feature_num" in line and "LeftOuter" in line for line in joins)
