"""Event documents of a training run: nested JSON with a summary of tagged values an event.

A document is one line of JSON Lines, ``{"run": ..., "events": [...]}``, with
a bounded block of a run's events; a file holds any number of documents and
is split like text. An event is an object with ``wall_time``, ``step`` and
``summary``, a list of objects with ``tag`` and ``value`` or ``tensor``.
Documents are read as VARIANT, so a key that is missing differs from one that
is null, and tags or payloads that nobody listed are kept.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_event_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc variant``: one row a line."""
    return spark.read.option("singleVariantColumn", "doc").json(path)


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _items(event: Column) -> Column:
    """The summary's items that set a tag, as ``(tag, source, payload)``; of items of one tag the last sets it."""
    def item(x):
        value, tensor = _get(x, "$.value", "variant"), _get(x, "$.tensor", "variant")
        source = F.when(value.isNotNull(), "value").when(tensor.isNotNull(), "tensor")  # a null literal is there, too
        return F.struct(F.coalesce(_get(x, "$.tag", "string"), F.lit("")).alias("tag"), source.alias("source"), F.coalesce(value, tensor).alias("payload"))

    listed = F.coalesce(_get(event, "$.summary", "array<variant>"), F.array().cast("array<variant>"))
    kept = F.filter(F.transform(listed, item), lambda x: x["source"].isNotNull())

    def last(items):
        tags = F.transform(items, lambda x: x["tag"])
        return F.filter(items, lambda x, i: ~F.array_contains(F.slice(tags, i + 2, F.greatest(F.size(tags), F.lit(1))), x["tag"]))

    return F.element_at(F.transform(F.array(kept), last), 1)


def event_rows(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """``(run, event_no, wall_time, step, tag, source, number, payload)``: one row for each tag an event sets.

    ``source`` says whether ``value`` or, where there is no such key,
    ``tensor`` gave the payload. ``payload`` is its JSON (numbers in their shortest form) and ``number`` its
    value as a double, null if it is no number. Events without ``summary`` are
    left out; one whose summary sets nothing gives a row with a null tag. An
    item without a tag has the empty one.
    """
    events = docs.select(_get(F.col(doc), "$.run", "string").alias("run"),
                         F.posexplode(_get(F.col(doc), "$.events", "array<variant>")).alias("event_no", "event"))
    event = F.col("event")
    said = events.where(_get(event, "$.summary", "variant").isNotNull()).select(
        "run", "event_no", _get(event, "$.wall_time", "double").alias("wall_time"), _get(event, "$.step", "bigint").alias("step"),
        F.explode_outer(_items(event)).alias("x"))
    payload = F.col("x.payload")
    return said.select("run", "event_no", "wall_time", "step", "x.tag", "x.source", _get(payload, "$", "double").alias("number"),
                       F.to_json(payload).alias("payload"))
