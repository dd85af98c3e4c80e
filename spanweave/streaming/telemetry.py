"""Training-log streams: sessions of activity, and an append-only log.

Both read a folder of arriving files in the order of arrival, a few files a
trigger, and resume from their checkpoint. What a trigger has committed is
never written again, so a replayed batch adds no row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.session import unique_dir
from spanweave.sources.files import CSV_OPTS

SESSION_SCHEMA = "run string, session_start timestamp, session_end timestamp, n_events bigint, loss double, eval_loss double"


def timed_feed(df: DataFrame, order: str, files: int = 8, then: tuple[DataFrame, ...] = ()) -> str:
    """Write ``df`` as ``files`` files that arrive in the order of ``order``, and each of ``then`` as one after them (stand-in for a feed); the folder's path."""
    spark = df.sparkSession
    path = unique_dir(spark, "feed")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    known: list[str] = []
    for rows in (df.repartitionByRange(files, order).sortWithinPartitions(order), *(x.coalesce(1) for x in then)):
        rows.write.mode("append").parquet(path)
        parts = sorted(p.getPath().getName() for p in fs.listStatus(folder) if p.getPath().getName().startswith("part-"))
        known += [p for p in parts if p not in known]
    for i, part in enumerate(known):  # a file source reads files by their time
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(folder, part), 1_700_000_000_000 + 1000 * i, -1)
    return path


def _files(spark: SparkSession, src: str, schema: T.StructType | str, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "false").parquet(src)


def session_rows(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each run: events closer than ``gap`` belong together; works on tables and streams of ``run, ts, tag, value``.

    Rows without a run are in no session. They are left out by their count,
    after the grouping: a filter on the key would go before the watermark.
    """
    return (events.groupBy(F.session_window("ts", gap).alias("w"), "run")
            .agg(F.count("run").alias("n_events"), F.avg(F.when(F.col("tag") == "loss", F.col("value"))).alias("loss"),
                 F.avg(F.when(F.col("tag") == "eval_loss", F.col("value"))).alias("eval_loss"))
            .where("n_events > 0")
            .select("run", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "loss", "eval_loss"))


def stream_sessions(spark: SparkSession, src: str, out: str, checkpoint: str, *, gap: str = "30 minutes", delay: str = "1 hour",
                    files_per_trigger: int = 1) -> DataFrame:
    """Append the sessions that the watermark has closed to ``out`` and return all of them.

    ``src`` holds files of ``run, ts, tag, value``. A session is written once,
    when the watermark (the latest time seen, less ``delay``) has passed its
    end; until then later triggers or restarts extend it. Rows behind the
    watermark are dropped. A row without a run tells the time and nothing
    else: a feed that ends sends one (:func:`end_of_feed`) to close what is open.
    """
    events = _files(spark, src, "run string, ts timestamp, tag string, value double", files_per_trigger)
    closed = session_rows(events.withWatermark("ts", delay), gap)
    query = (closed.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(SESSION_SCHEMA).parquet(out)


def end_of_feed(events: DataFrame, after: str = "1 day") -> DataFrame:
    """One row without a run, ``after`` the latest time of ``events`` (none for an empty table)."""
    late = events.agg(F.max("ts").alias("ts")).where("ts is not null")
    return late.select(F.lit(None).cast("string").alias("run"), (F.col("ts") + F.expr(f"interval {after}")).alias("ts"),
                       F.lit(None).cast("string").alias("tag"), F.lit(None).cast("double").alias("value"))


def append_log(spark: SparkSession, src: str, schema: T.StructType | str, out: str, checkpoint: str, *, files_per_trigger: int = 2) -> DataFrame:
    """Append the rows of arriving files to the log ``out`` (CSV files with a header) and read the whole log.

    The sink commits a batch's files in its own log of batches: a batch that
    was written but not committed to ``checkpoint`` comes again after a
    restart and adds nothing. Readers see committed files only.
    """
    rows = _files(spark, src, schema, files_per_trigger)
    query = (rows.writeStream.outputMode("append").format("csv").options(**CSV_OPTS).option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(rows.schema).options(**CSV_OPTS).csv(out)
