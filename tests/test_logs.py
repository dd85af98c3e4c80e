"""Event documents, session streams, the append-only log and the vote on transformWithState."""
import json
import os
import shutil

from pyspark.sql import functions as F

from spanweave.session import unique_dir
from spanweave.sources.event_json import event_rows, read_event_documents
from spanweave.streaming import state_vote as SV
from spanweave.streaming import telemetry as ST
from tests.test_streams import batch_result, tables

ROWS = "run string, ts timestamp, tag string, value double"


def test_event_documents_by_the_rules(spark):
    docs = [
        {"run": "a", "events": [
            {"wall_time": 1.5, "step": 1, "summary": [{"tag": "train/loss", "value": 2.5}, {"tag": "odd/tag", "tensor": {"dtype": "DT_FLOAT", "floatVal": [1.0]}}]},
            {"wall_time": 2.0, "step": 2},
            {"wall_time": 3.0, "step": 3, "summary": [{"tag": "x", "value": None, "tensor": 4}, {"value": 5}, {"tag": "none"}]},
            {"wall_time": 4.0, "step": 4, "summary": [{"tag": "t", "value": 1}, {"tag": "u", "value": 9}, {"tag": "t", "tensor": "s"}]},
            {"step": 5, "summary": []}, {"wall_time": "late", "step": None, "summary": [{"tag": "v", "value": True}]}]},
        {"run": None, "events": []}, {"events": None}]
    path = unique_dir(spark, "docs")
    spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").write.text(path)
    got = [tuple(r) for r in event_rows(read_event_documents(spark, path)).orderBy("event_no", "tag").collect()]
    got = [(r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in got]
    assert got == [
        (0, 1.5, 1, "odd/tag", "tensor", None, '{"dtype":"DT_FLOAT","floatVal":[1]}'), (0, 1.5, 1, "train/loss", "value", 2.5, "2.5"),
        (2, 3.0, 3, "", "value", 5.0, "5"), (2, 3.0, 3, "x", "value", None, "null"),
        (3, 4.0, 4, "t", "tensor", None, '"s"'), (3, 4.0, 4, "u", "value", 9.0, "9"),
        (4, None, 5, None, None, None, None), (5, None, None, "v", "value", 1.0, "true")]


def events(spark, minutes, run="r"):
    return spark.createDataFrame([(run, m, "loss", float(m)) for m in minutes], "run string, m int, tag string, value double").select(
        "run", F.timestamp_seconds(F.col("m") * 60).alias("ts"), "tag", "value")


def spans(out):
    return sorted((r["run"], (r["session_start"] - r0(r)).total_seconds() / 60, r["n_events"]) for r in out.collect())


def r0(r):
    import datetime
    return datetime.datetime(1970, 1, 1)


def test_sessions_go_on_over_a_restart_and_late_rows_are_dropped(spark):
    src, out, ck = (unique_dir(spark, x) for x in ("s-in", "s-out", "s-ck"))
    run = lambda: ST.stream_sessions(spark, src, out, ck, gap="30 minutes", delay="1 hour")
    events(spark, [0, 10, 60]).coalesce(1).write.parquet(src)
    assert run().count() == 0  # the watermark is at 0
    events(spark, [20, 120, 200]).coalesce(1).write.mode("append").parquet(src)  # 20 is late, but not behind the watermark
    assert spans(run()) == [("r", 0.0, 3), ("r", 60.0, 1)]  # a restart between two triggers: the open session went on
    events(spark, [5, 130, 300]).coalesce(1).write.mode("append").parquet(src)  # the watermark is at 140: 5 is dropped, 120 goes on with 130
    run()
    ST.end_of_feed(events(spark, [300])).coalesce(1).write.mode("append").parquet(src)
    got = spans(run())
    assert got == [("r", 0.0, 3), ("r", 60.0, 1), ("r", 120.0, 2), ("r", 200.0, 1), ("r", 300.0, 1)]
    assert spans(run()) == got  # nothing new: nothing is written


def test_sessions_of_an_ordered_feed_are_those_of_the_table(spark):
    rows = events(spark, [0, 7, 29, 90, 91, 400, 431], "a").unionByName(events(spark, [3, 60, 89, 119, 500], "b"))
    src = ST.timed_feed(rows, "ts", 5, (ST.end_of_feed(rows),))
    got = ST.stream_sessions(spark, src, unique_dir(spark, "o"), unique_dir(spark, "c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ST.session_rows(rows, "30 minutes").collect()))


def test_a_batch_that_comes_again_adds_nothing_to_the_log(spark):
    rows = spark.range(40).select(F.format_string("run,\"%d\"\n", F.col("id") % 3).alias("run"), F.col("id").cast("int").alias("step"),
                                  F.when(F.col("id") % 2 == 0, F.col("id") / 3).alias("loss"))
    src, out, ck = ST.timed_feed(rows, "step", 4), unique_dir(spark, "log"), unique_dir(spark, "log-ck")
    run = lambda: ST.append_log(spark, src, rows.schema, out, ck)
    want = sorted(map(str, rows.collect()))
    assert sorted(map(str, run().collect())) == want
    local = lambda p: p.removeprefix("file://")
    commits = f"{local(ck)}/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            shutil.move(f"{commits}/{name}", unique_dir(spark, "moved").removeprefix("file://"))
    assert sorted(map(str, run().collect())) == want
    rows.limit(3).withColumn("step", F.col("step") + 100).coalesce(1).write.mode("append").parquet(src)
    assert run().count() == 43


def stage(spark, rows, src, models):
    for m in models:
        rows.where(F.col("model") == m).coalesce(1).write.mode("append").parquet(src)


def test_state_vote_equals_batch_over_a_restart(spark):
    located, reports = tables(spark)
    rows = SV.report_rows(located, reports)
    src, out, ck = (unique_dir(spark, x) for x in ("v-in", "v-out", "v-ck"))
    stage(spark, rows, src, ["m1", "m2"])
    assert SV.run_vote(spark, src, out, ck, 2, 3, files_per_trigger=1).count() == 0  # two of three models: nothing yet
    stage(spark, rows, src, ["m3"])
    got = SV.run_vote(spark, src, out, ck, 2, 3, files_per_trigger=1)
    assert sorted((r["id"], r["location"]) for r in got.collect()) == batch_result(spark)
    stage(spark, rows.withColumn("model", F.lit("m9")), src, ["m9"])  # late: the pair's mark drops it
    assert SV.run_vote(spark, src, out, ck, 2, 3).count() == len(batch_result(spark))


def test_state_vote_timer_fires_for_missing_models(spark):
    located, reports = tables(spark)
    at = lambda s: F.timestamp_seconds(F.lit(1_000_000 + s))
    two = SV.report_rows(located, reports.where("model in ('m1', 'm2')").withColumn("reported_at", at(0)))
    later = SV.report_rows(located.limit(0), spark.createDataFrame([("z", "m1")], "id string, model string").withColumn("reported_at", at(9000)))
    src, out, ck = (unique_dir(spark, x) for x in ("t-in", "t-out", "t-ck"))
    two.coalesce(1).write.parquet(src)
    run = lambda: SV.run_vote(spark, src, out, ck, 2, 3, timeout_ms=600_000, delay="10 seconds", files_per_trigger=1)
    assert run().count() == 0
    for s in (0, 1):  # time passes with another pair; the batch after uses the new watermark
        later.withColumn("reported_at", at(9000 + s)).coalesce(1).write.mode("append").parquet(src)
    got = {r["id"]: (r["location"], r["n_models"]) for r in run().collect()}
    assert got == {"p1": ("3 5", 2), "p2": ("2 4;6 8", 2), "p3": (None, 2), "p4": (None, 2)}


def test_a_report_holds_one_span_a_start(spark):
    located = spark.range(5000).select(F.lit("p").alias("id"), F.lit("m").alias("model"), F.lit(1).alias("weight"), (F.col("id") % 5).cast("int").alias("start"),
                                       (6 + F.col("id") % 7).cast("int").alias("end"), F.lit(0).alias("lead"), (F.col("id") % 7 % 2).cast("int").alias("trail"))
    row = SV.report_rows(located, spark.createDataFrame([("p", "m"), ("q", "m")], "id string, model string")).orderBy("id").collect()
    assert list(row[0]["edges"]) == [x for s in range(5) for x in (s, 12, 0, 0)] and list(row[1]["edges"]) == []
