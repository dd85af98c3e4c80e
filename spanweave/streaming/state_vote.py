"""Online vote on ``transformWithState``: open reports and marks by bucket of pairs, event-time timers, RocksDB state store.

Pairs are dealt over buckets. The pairs of a bucket are one value, read and
written in one go, so a batch asks the state store a few times a bucket and
not for each report. State with a time to live needs
processing time, which would make results depend on the clock; here a timer in
event time clears the pairs of a bucket that are due.
"""
from __future__ import annotations

import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanweave.operators.spans import far_edge, far_parts
from spanweave.session import unique_dir
from spanweave.streaming.jobs import VOTE_STATE, _stage, _vote_pdf, absorb, packed, voted_rows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BucketVote(StatefulProcessor):
    """Pairs of one bucket: each voted when ``need`` models have reported, or ``timeout_ms`` of event time after its last report."""

    def __init__(self, threshold: int, need: int, timeout_ms: int):
        self.threshold, self.need, self.timeout_ms = threshold, need, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getValueState("pairs", VOTE_STATE)
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def _read(self) -> dict:
        held = self.pairs.get()
        return {} if held is None else pickle.loads(held[0])

    def _write(self, pairs: dict, now: int) -> None:
        was = self.timer.get()
        if was is not None:
            self.handle.deleteTimer(was[0])
        if pairs:
            self.pairs.update((pickle.dumps(pairs, pickle.HIGHEST_PROTOCOL),))
            at = max(min(entry[1] for entry in pairs.values()), now + 1)
            self.handle.registerTimer(at)
            self.timer.update((at,))
        else:
            self.pairs.clear()
            self.timer.clear()

    def handleInputRows(self, key, rows, timerValues):
        pairs, now = self._read(), timerValues.getCurrentWatermarkInMs()
        _, done = absorb(pairs, rows, self.threshold, self.need, self.timeout_ms, now)
        self._write(pairs, now)
        if done:
            yield voted_rows(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        pairs, now = self._read(), timerValues.getCurrentWatermarkInMs()
        done = []
        for pair in [pair for pair, entry in pairs.items() if entry[1] <= now]:
            held = pairs.pop(pair)[2]
            if held is not None:
                done.append((pair, _vote_pdf(held, self.threshold), len(held)))
        self._write(pairs, now)
        if done:
            yield voted_rows(done)

    def close(self) -> None:
        pass


def report_rows(located: DataFrame, reports: DataFrame) -> DataFrame:
    """``(id, model, weight, edges, reported_at)``: one row a report of ``reports (id, model[, reported_at])`` with its spans.

    ``edges`` has start, end, lead and trail of each span in a row. Of spans
    with one start the furthest counts, so a report has at most one for each
    character of its note; a report without spans has none.
    """
    far = located.groupBy("id", "model", "start").agg(F.first("weight").alias("weight"), F.max("lead").alias("lead"), F.max(far_edge()).alias("far"))
    end, trail = far_parts("far")
    edges = F.array(F.col("start").cast("int"), end, F.col("lead").cast("int"), trail)
    own = far.groupBy("id", "model").agg(F.first("weight").alias("weight"), F.flatten(F.array_sort(F.collect_list(edges))).alias("edges"))
    rows = reports.join(own, ["id", "model"], "left")
    rows = rows.withColumn("edges", F.coalesce("edges", F.array().cast("array<int>"))).withColumn("weight", F.coalesce("weight", F.lit(0)).cast("int"))
    if "reported_at" not in rows.columns:
        rows = rows.withColumn("reported_at", F.current_timestamp())
    return rows.select("id", "model", "weight", "edges", "reported_at")


def run_vote(spark: SparkSession, src: str, out: str, checkpoint: str, threshold: int, need: int, *, timeout_ms: int = 10 * 60 * 1000,
             delay: str = "10 minutes", files_per_trigger: int = 2) -> DataFrame:
    """Vote over the report files of ``src`` into ``out``, resuming from ``checkpoint``; returns ``id, location, n_models`` so far.

    After its vote a pair's mark stays until the timer: reports that come late
    in that time are dropped, not voted as a pair of their own.
    """
    reports = (spark.readStream.schema("id string, model string, weight int, edges array<int>, reported_at timestamp")
               .option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "false").parquet(src).withWatermark("reported_at", delay))
    voted = packed(reports, F.col("edges")).groupBy("bucket").transformWithStateInPandas(
        BucketVote(threshold, need, timeout_ms), "id string, location string, n_models int", "Append", "EventTime")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # read when the stream starts
    try:
        query = (voted.writeStream.outputMode("append").format("parquet").option("path", out)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema("id string, location string, n_models int").parquet(out)


def online_vote_state(spark: SparkSession, located: DataFrame, reports: DataFrame, n_voters: int, threshold: int, *, n_models: int) -> DataFrame:
    """``id, location, n_models`` of every pair that all ``n_models`` models reported, as :func:`run_vote` finds them."""
    src, _ = _stage(spark, report_rows(located, reports), "reports")
    return run_vote(spark, src, unique_dir(spark, "vote-out"), unique_dir(spark, "vote-ck"), min(threshold, n_voters), n_models)
