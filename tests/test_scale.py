"""Plans that decide how time and memory grow: what is computed once, aggregated by hash, dealt over tasks."""
from pyspark.sql import functions as F

from spanweave.functions.text import is_blank, strip_u
from spanweave.operators.spans import far_edge, far_parts, locate_spans, majority_vote, with_blank_edges
from spanweave.plans.ensemble import explode_spans

BLANKS = " \t\x0b\x1c\x1f\x85\xa0   　\n"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_outputs_are_parsed_once(spark):
    p = spark.createDataFrame([(1, "m", 1, '{"spans": ["a", " b "]}'), (2, "m", 1, None), (3, "m", 1, '{"spans": []}')],
                              "id int, model string, weight int, raw string").withColumn("pn_num", F.col("id"))
    s = explode_spans(p)
    assert plan(s).count("(?s)<think>") == 1
    assert sorted((r.id, r.span_idx, r.span) for r in s.collect()) == [(1, 0, "a"), (1, 1, "b")]


def test_strip_searches_no_inner_position(spark):
    texts = [BLANKS + "a" + BLANKS + "b" + BLANKS, BLANKS, "", None, "é" + BLANKS, BLANKS + "ñ", "​ x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", strip_u("t").alias("s"), is_blank("t").alias("b"))
    assert "regexp_replace" not in plan(out)
    assert all(r.s == (r.t.strip() if r.t is not None else None) and r.b == (not (r.t or "").strip()) for r in out.collect())


def test_spans_of_repeated_notes_meet_every_copy_once_each(spark):
    notes = spark.createDataFrame([(1, "one Two"), (1, "Two one"), (2, None), (2, "x two"), (3, ""), (None, "two")], "pn_num int, pn_history string")
    spans = spark.createDataFrame([(1, "two"), (2, " two "), (3, "two"), (None, "two"), (4, "two")], "pn_num int, span string")
    found = locate_spans(spans, notes)
    assert plan(found).count("Scan ExistingRDD") == 3  # spans once, notes to search and to leave with
    assert sorted((r.pn_num, r.pn_history or "", r.start, r.end, r.method) for r in found.collect()) == sorted(
        [(1, t, at, at + 3, "ci") for t in ("one Two", "Two one") for at in (4, 0)] + [(2, t, 2, 5, "exact") for t in ("", "x two")])


def test_far_ends_are_aggregated_by_hash(spark):
    rows = spark.createDataFrame([(5, 0), (5, 2), (4, 9), (5, None)], "end int, trail int")
    top = rows.agg(F.max(far_edge()).alias("f")).select(*far_parts("f")).first()
    assert (top.end, top.trail) == (5, 2)
    none = rows.where(F.col("trail").isNull()).agg(F.max(far_edge()).alias("f")).select(*far_parts("f")).first()
    assert (none.end, none.trail) == (5, None)
    note = spark.createDataFrame([(1, "ab  \n cd ")], "pn_num int, pn_history string")
    s = spark.createDataFrame([("p", 1, m, 1, a, b) for m, a, b in (("x", 0, 6), ("y", 1, 9), ("z", 5, 99))],
                              "id string, pn_num int, model string, weight int, start int, end int")
    edged = with_blank_edges(s.join(note, "pn_num").withColumn("note_len", F.length("pn_history")))
    assert sorted((r.model, r.lead, r.trail) for r in edged.collect()) == [("x", 0, 4), ("y", 0, 1), ("z", 1, 1)]
    vote = majority_vote(edged, 2)
    assert "SortAggregate" not in plan(vote)
    assert [(r.start, r.end) for r in vote.collect()] == [(1, 8)]


def test_pairs_with_texts_are_dealt_over_tasks(spark, tmp_path):
    from spanweave.sources import tables as T
    spark.range(40).selectExpr("id as doc_id", "concat('src', id) as source", "repeat('word ', 50) as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(10).selectExpr("id as item_id", "'word' as text").write.parquet(f"{tmp_path}/benchmark.parquet")
    p = T.pairs(spark, str(tmp_path), with_text=True)
    assert "hashpartitioning(pn_num" in plan(p) and p.count() == 40


def test_size_classes_with_zero_rest_have_infinite_gap(spark):
    """Best losses of 0 in a class, or a class alone, gave a division by zero."""
    import math
    from spanweave.plans.catalog import ieee_ratio, size_class_stats
    cols = "run string, best_eval_loss double, final_train_loss double, grad_mean double"
    both = spark.createDataFrame([("run0", 0.5, 1.0, 1.0), ("run4", 0.0, 1.0, 1.0), ("run5", 0.0, 2.0, 1.0)], cols)
    gap = {r.size_class: (r.eval_rest_mean, r.rel_gap) for r in size_class_stats(spark, both).collect()}
    assert gap == {"small": (0.0, math.inf), "large": (0.5, -1.0)}
    one = size_class_stats(spark, both.where("run = 'run0'")).collect()
    assert len(one) == 1 and math.isnan(one[0].eval_rest_mean) and math.isnan(one[0].rel_gap)
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    got = [r.q for r in d.select(ieee_ratio(F.col("a"), F.col("b")).alias("q")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [None, None, 1.5]


def test_labels_leave_texts_behind(spark):
    from spanweave.operators.labelers import label, phrase_labeler_factory
    df = spark.createDataFrame([(i, "a fever", "fever") for i in range(70)], "id int, pn_history string, feature_text string")
    out = label(df, phrase_labeler_factory, keep=["id"])
    assert out.columns == ["id", "raw", "error"] and label(df, phrase_labeler_factory).columns == [*df.columns, "raw", "error"]
    assert sorted((r.id, r.raw, r.error) for r in out.collect()) == [(i, '{"spans": ["fever"]}', None) for i in range(70)]
