"""The corpus pipeline: five stages, each one operator over all that the stage before kept.

Every stage but the last returns the columns of documents; the last returns
the packed pieces (doc_id, piece, start, length, ids_crc32, sequence_id,
offset). ``run`` writes each stage's result to the shared checkpoint folder
as Parquet and reads it back as the next stage's documents.

Nulls: a null text has no letter, so language ID rejects it. Null ids pass
line dedup, the join and decontamination as those operators state. Columns
that documents have beside the known ones are kept as they are.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm._store import stored
from spanweave.llm.catalog import byte_bpe
from spanweave.llm.decontam import without_contaminated
from spanweave.llm.jaccard import keep_one
from spanweave.llm.langid import held_out, identify, train
from spanweave.llm.lines import dedup_lines
from spanweave.llm.packing import pack_documents
from spanweave.sources.tables import read_table


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model learnt from ``docs`` accepts."""
    model = train(docs.where(~held_out("doc_id")), "text", F.col("lang"))
    judged = identify(docs.select(F.struct("*").alias("document"), "text"), model)
    return judged.where("accepted").select(*(F.col("document").getField(c).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without their repeated lines; ``n_chars`` follows the text."""
    out = _same_columns(dedup_lines(docs), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more): the smallest id."""
    return keep_one(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    return pack_documents(docs, byte_bpe())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard_join", jaccard_join),
          ("benchmark_decontamination", decontaminate), ("best_fit_packing", packing)]

#: Language ID and packing cannot be said in SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
