"""Registered queries over event documents and training-log streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators import telemetry as TM
from spanweave.plans.catalog import _located, _log, _r6, register
from spanweave.session import unique_dir
from spanweave.operators.spans import with_blank_edges
from spanweave.sources import tables as T
from spanweave.sources.event_json import event_rows, read_event_documents
from spanweave.streaming import state_vote as SV
from spanweave.streaming import telemetry as ST

EVENTS_A_DOCUMENT = 4096


def event_documents(spark: SparkSession, sf: str) -> str:
    """The events as JSON documents of at most ``EVENTS_A_DOCUMENT`` events of a run, as a logger writes them; the folder's path.

    Some events have no summary, some a tensor instead of a value, a null
    value beside a tensor, two items of one tag, an item without payload, or
    a tag that no list names.
    """
    ev = T.read_table(spark, sf, "events")
    i, v = F.col("event_id"), F.coalesce(F.col("value").cast("string"), F.lit("null"))
    tag = F.concat(F.lit('{"tag":"train/'), TM.tag_expr(F.col("event_type")), F.lit('"'))
    tensor = F.concat(F.lit(',"tensor":{"dtype":"DT_FLOAT","floatVal":['), v, F.lit("]}"))
    item = (F.when(i % 17 == 0, F.concat(tag, F.lit(',"value":null'), tensor, F.lit("}")))
            .when(i % 5 == 0, F.concat(tag, tensor, F.lit("}")))
            .when(i % 13 == 0, F.concat(tag, F.lit(',"value":0},'), tag, F.lit(',"value":'), v, F.lit("}")))
            .when(i % 19 == 0, F.concat(tag, F.lit("}")))
            .otherwise(F.concat(tag, F.lit(',"value":'), v, F.lit("}"))))
    other = F.when(i % 11 == 0, F.concat(F.lit(',{"tag":"props/k","value":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit("}"))).otherwise("")
    summary = F.when(i % 7 == 0, "").otherwise(F.concat(F.lit(',"summary":['), item, other, F.lit("]")))
    event = F.concat(F.lit('{"wall_time":'), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"), F.lit(',"step":'), i.cast("string"), summary, F.lit("}"))
    run = F.concat(F.lit("run"), F.pmod("user_id", F.lit(8)).cast("string"))
    docs = ev.groupBy(run.alias("run"), F.floor(i / EVENTS_A_DOCUMENT).alias("block")).agg(F.array_sort(F.collect_list(F.struct("event_id", event.alias("e")))).alias("l"))
    line = F.concat(F.lit('{"run":"'), F.col("run"), F.lit('","events":['), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]}"))
    path = unique_dir(spark, "event-json")
    docs.select(line.alias("value")).write.text(path)
    return path


def _event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(read_event_documents(spark, event_documents(spark, sf)))


@register("event_json")
def q_event_json(spark, sf):
    """Every tag that an event document sets, with its value or else its tensor."""
    return _event_rows(spark, sf).select("run", "step", "wall_time", "tag", "source", "number",
                                         F.get_json_object("payload", "$.floatVal[0]").cast("double").alias("tensor_number"))


@register("event_json_pivot")
def q_event_json_pivot(spark, sf):
    """Known tags of the event documents as columns: the mean of each an hour of a run."""
    rows = _event_rows(spark, sf).where(F.col("source") == "value").withColumn("hstep", F.floor((F.col("wall_time") - 1704067200) / 3600).cast("int"))
    return _r6(TM.event_pivot(rows, ["run", "hstep"], value="number"), TM.TAGS)


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    ev = T.read_table(spark, sf, "events")
    return ev.select(F.concat(F.lit("run"), F.pmod("user_id", F.lit(8)).cast("string")).alias("run"), F.col("ts").cast("timestamp").alias("ts"),
                     TM.tag_expr(F.col("event_type")).alias("tag"), "value")


@register("telemetry_sessions")
def q_telemetry_sessions(spark, sf):
    """Sessions of each run (30 minutes without an event end one), streamed file by file in the order of time."""
    events = _feed(spark, sf)
    src = ST.timed_feed(events, "ts", then=(ST.end_of_feed(events),))
    out = ST.stream_sessions(spark, src, unique_dir(spark, "sessions"), unique_dir(spark, "sessions-ck"))
    shown = out.select("run", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("session_start", "session_end")), "n_events", "loss", "eval_loss")
    return _r6(shown, ["loss", "eval_loss"])


@register("telemetry_append")
def q_telemetry_append(spark, sf):
    """The metric rows of every run, appended to a CSV log by a stream and read back."""
    rows = _log(spark, sf).select("run", "step", "loss", "eval_loss", "learning_rate", "grad_norm")
    src = ST.timed_feed(rows, "step")
    return ST.append_log(spark, src, rows.schema, unique_dir(spark, "metrics-log"), unique_dir(spark, "metrics-ck"))


@register("stream_vote_state")
def q_stream_vote_state(spark, sf):
    """The online vote with one state entry a report."""
    located = with_blank_edges(_located(spark, sf))
    n_voters = sum(w for _, w in T.REGISTRY)
    reports = T.predictions(spark, sf).select("id", "model")
    return SV.online_vote_state(spark, located, reports, n_voters, 2, n_models=len(T.REGISTRY)).select("id", "location")
