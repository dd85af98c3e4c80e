"""Pseudo-labelling of unannotated notes (sample -> pairs -> retrieve -> prompt
-> label -> parse -> locate -> repr-list rows), as one Spark plan around the
labeler's Arrow boundary."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions import prompts as P
from spanweave.functions.text import pair_id, parse_spans, py_repr_list
from spanweave.operators import relational as R
from spanweave.operators import retrieval as RT
from spanweave.operators import sampling as S
from spanweave.operators.labelers import label
from spanweave.operators.spans import locate_spans
from spanweave.session import unique_dir
from spanweave.sources import files as FS


BROADCAST_FEATURES = 10_000


def examples_per_feature(features: DataFrame, corpus: DataFrame, k: int = 3, embed: RT.Embedder = RT.hashing_embed) -> DataFrame:
    """``feature_num, examples``: the top-k corpus rows of each feature (ties by ``id``), nearest first.

    Only distinct texts of both sides are embedded and compared. Equal corpus
    texts have equal scores, so of each the ``k`` smallest ids can be among
    the top k; a text stands for them under the smallest. A corpus row is
    taken up again by its id alone.
    """
    first = Window.partitionBy("embed_text").orderBy("id")
    kept = corpus.select("embed_text", "id").withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    kept = FS.materialize_once(kept, unique_dir(corpus.sparkSession, "retrieval-texts"))
    texts = kept.where(F.col("place") == 1).select(F.col("id").alias("cid"), "embed_text")
    asked = features.select("feature_num", F.concat(F.lit("Feature: "), "feature_text", F.lit("  Annotation:")).alias("query_id"))
    queries = embed(asked.where(F.col("query_id").isNotNull()).select("query_id").distinct(), "query_id").select("query_id", "embedding")
    near = RT.knn_topk(queries, embed(texts, "embed_text").select("cid", "embedding"), k, cid="cid", normalize=False).drop("rank")
    near = near.join(texts, "cid").join(kept.select("embed_text", "id"), "embed_text").select("query_id", "id", "score")
    top = FS.materialize_once(RT.top_ranks(near, k, "id"), unique_dir(corpus.sparkSession, "retrieved"))
    few = top.count() <= k * BROADCAST_FEATURES  # then no row of the corpus is shuffled with its text
    rows = (F.broadcast(top) if few else top).join(corpus.select("id", "pn_history", "feature_text", F.col("annotation_str").alias("annotation")), "id")
    examples = rows.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "pn_history", "feature_text", "annotation"))),  # k rows
        lambda x: F.struct(x["pn_history"].alias("pn_history"), x["feature_text"].alias("feature_text"),
                           x["annotation"].alias("annotation"))).alias("examples"))
    return asked.join(examples, "query_id").select("feature_num", "examples")


def with_blocks(features: DataFrame, examples: DataFrame) -> DataFrame:
    """``features`` with the ``block`` of their examples (null: none), written once.

    Notes meet features that have their blocks, so no text of a pair is shuffled
    to find them; up to ``BROADCAST_FEATURES`` features no text of a note either.
    """
    blocks = examples.select("feature_num", P.fewshot_block("examples").alias("block"))
    rows = FS.materialize_once(features.join(blocks, "feature_num", "left"), unique_dir(features.sparkSession, "feature-blocks"))
    return F.broadcast(rows) if rows.count() <= BROADCAST_FEATURES else rows


def pseudo_label(notes: DataFrame, annotated: DataFrame, features: DataFrame, corpus: DataFrame, labeler_factory,
                 *, n_sample: int | None = None, seed: int = 42, k: int = 3, cutoff: float = 72.0,
                 done: DataFrame | None = None, batch: int = 32, embed: RT.Embedder = RT.hashing_embed) -> DataFrame:
    """Rows ``id, pn_num, feature_num, case_num, annotation, location, error``
    (repr-string lists; ``annotation`` keeps every parsed span, ``location``
    only the located ones, in span order). All unannotated notes are labelled,
    or ``n_sample`` of them. The labels are written once to the shared store."""
    # dealt over tasks before the narrow table of annotated notes meets them: texts are shuffled once and never sorted
    sample = R.unannotated(notes.repartition("pn_num"), annotated.hint("shuffle_hash"))
    if n_sample is not None:
        sample = S.sample_n(sample, n_sample, seed, "pn_num")
    asked = with_blocks(features.filter(F.col("feature_text") != ""), examples_per_feature(features, corpus, k, embed))
    target = P.one_line(F.coalesce("pn_history", F.lit("")))  # once a note
    pairs = R.case_fanout(sample.withColumn("target", target), asked).withColumn("id", pair_id("pn_num", "feature_num"))
    if done is not None:
        pairs = R.resume(pairs, done, "id")
    pairs = pairs.withColumn("messages", P.fewshot_turns("target", "feature_text", "block"))
    path = unique_dir(notes.sparkSession, "pseudo-labels")
    label(pairs.drop("target", "block"), labeler_factory, batch=batch, keep=["id", "pn_num", "feature_num", "case_num"]).write.parquet(path)
    out = notes.sparkSession.read.parquet(path)
    out = out.withColumn("spans", parse_spans("raw", "first_object"))
    ex_spans = out.select("id", "pn_num", F.posexplode("spans").alias("pos", "span"))
    loc = locate_spans(ex_spans, notes.select("pn_num", "pn_history"), fuzzy_cutoff=cutoff, fuzzy_mode="window")
    loc = loc.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "start", "end"))),
                                            lambda x: F.concat_ws(" ", x["start"].cast("string"), x["end"].cast("string")))
                                .alias("locs"))
    res = out.join(loc, "id", "left")
    return res.select("id", "pn_num", "feature_num", "case_num",
                      py_repr_list("spans").alias("annotation"),
                      py_repr_list(F.coalesce("locs", F.array().cast("array<string>"))).alias("location"), "error")
