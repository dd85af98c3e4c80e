"""Typed readers for the input tables and the annotation-domain view of them.

The annotation domain (notes, features, annotated pairs, model outputs) is
mapped onto the driver's parquet tables:

* notes      = ``documents``: ``pn_num = doc_id``, ``case_num = int(source[3:]) % 10``,
  ``pn_history = text``
* features   = ``benchmark``: ``feature_num = item_id``, ``case_num = item_id % 10``,
  ``feature_text = text``
* annotated notes = ``labels.doc_id``; the rest are unannotated
* pairs      = each note with every feature of its case
* true spans = a note substring around a per-pair anchor (two pairs in three),
  plus the benchmark passage when the note contains it
* model outputs = per registry model, a substring near the same anchor,
  rendered in one of several raw-output shapes (plain JSON, think block,
  fenced, trailing marker, upper-cased, empty, two spans, broken JSON,
  newline-flattened, prose prefix with mixed item types)

Every choice is a deterministic function of the row (md5 of the pair id), so
DuckDB can rebuild the same tables for the correctness oracle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.text import locate, pair_id, py_repr_list
from spanweave.session import path_exists, unique_dir

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Fixed model registry used by the ensemble examples: (model, weight).
REGISTRY = [("m1", 1), ("m2", 1), ("m3", 1)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def h32(*parts) -> Column:
    """Deterministic 32-bit hash of the ``|``-joined parts (md5 prefix)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pn_num"),
                    F.pmod(F.expr("try_cast(substring(source, 4) as int)"), F.lit(10)).alias("case_num"),
                    F.col("text").alias("pn_history"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("feature_num"), F.pmod("item_id", F.lit(10)).cast("int").alias("case_num"),
                    F.col("text").alias("feature_text"))


_WRITTEN: dict[tuple, str] = {}


def _on_disk(spark: SparkSession, sf_dir: str, name: str, build, *key) -> DataFrame:
    """A table that a run would find on disk (model outputs, label files): written to the shared store once a session."""
    at = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name, *key)
    if at not in _WRITTEN or not path_exists(spark, _WRITTEN[at]):
        path = unique_dir(spark, name)
        build().write.parquet(path)
        _WRITTEN[at] = path
    return spark.read.parquet(_WRITTEN[at])


def annotated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pn_num"))


def pairs(spark: SparkSession, sf_dir: str, with_text: bool = False, annotated: bool = False) -> DataFrame:
    """Every note (or only the annotated ones) with every feature of its case (equi-join on ``case_num``).

    With texts, notes are dealt over all tasks first: a table of one row group
    is read by one task, which would also make all of its pairs. Notes are
    chosen before their pairs are made, so no text of a pair is shuffled.
    """
    n = notes(spark, sf_dir)
    n = n.repartition("pn_num") if with_text else n.drop("pn_history")
    if annotated:  # the texts are where the join needs them, and are not sorted
        ids = annotated_ids(spark, sf_dir)
        n = n.join(ids.hint("shuffle_hash") if with_text else ids, "pn_num", "left_semi")
    f = features(spark, sf_dir)
    if not with_text:
        f = f.drop("feature_text")
    p = n.join(f, "case_num")
    return p.withColumn("id", pair_id("pn_num", "feature_num"))


def _anchor(note: Column, pid: Column) -> Column:
    return F.pmod(h32(pid, "a"), F.greatest(F.length(note), F.lit(1)))


def with_truth(p: DataFrame) -> DataFrame:
    """Add ``annotation array<string>`` (true spans) to pairs carrying note and feature text."""
    note, pid = F.col("pn_history"), F.col("id")
    a = _anchor(note, pid)
    span0 = F.substring(note, (a + 1).cast("int"), (5 + F.pmod(h32(pid, "L0"), F.lit(30))).cast("int"))
    pos = F.pmod(h32(pid, "pos"), F.lit(3)) != 0
    passage = F.when(locate(F.col("feature_text"), note) > 0, F.col("feature_text"))
    ann = F.filter(F.array(F.when(pos, span0), passage), lambda x: x.isNotNull())
    return p.withColumn("annotation", ann)


def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated pairs as they sit on disk: python-repr ``annotation``/``location`` strings."""
    return _on_disk(spark, sf_dir, "train-pairs", lambda: _train_pairs(spark, sf_dir))


def _train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_truth(pairs(spark, sf_dir, with_text=True, annotated=True))
    loc = F.transform(F.transform(p["annotation"], lambda s: F.struct((locate(s, F.col("pn_history")) - 1).alias("at"), F.length(s).alias("n"))),
                      lambda x: F.concat_ws(" ", x["at"].cast("string"), (x["at"] + x["n"]).cast("string")))
    return p.select("id", "pn_num", "case_num", "feature_num",
                    py_repr_list("annotation").alias("annotation"), py_repr_list(loc).alias("location"))


def _with_raw(df: DataFrame, note: str = "pn_history", pid: str = "id", model: str = "model") -> DataFrame:
    """Add the rendered model output ``raw``; intermediate columns keep the plan
    in whole-stage codegen (each costly piece is computed once)."""
    n, i, m = F.col(note), F.col(pid), F.col(model)
    a = _anchor(n, i)
    s = F.greatest(a + F.pmod(h32(i, m, "s"), F.lit(11)) - 5, F.lit(0))
    df = (df.withColumn("_span", F.substring(n, (s + 1).cast("int"), (5 + F.pmod(h32(i, m, "l"), F.lit(36))).cast("int")))
            .withColumn("_span2", F.substring(n, (F.pmod(h32(i, m, "t"), F.greatest(F.length(n), F.lit(1))) + 1).cast("int"),
                                              (5 + F.pmod(h32(i, m, "u"), F.lit(20))).cast("int")))
            .withColumn("_v", F.pmod(h32(i, m, "v"), F.lit(12)))
            .withColumn("_js", F.to_json(F.array("_span"))))
    span, js, v = F.col("_span"), F.col("_js"), F.col("_v")
    inner = F.substring(js, F.lit(2), F.length(js) - 2)
    up = F.translate(span, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    raw = (F.when(v <= 2, F.concat(F.lit('{"spans": '), js, F.lit("}")))
            .when(v == 3, F.concat(F.lit('<think>\nchecking the note\n</think>\n\n{"spans": '), js, F.lit("}")))
            .when(v == 4, F.concat(F.lit('```json\n{"spans": '), js, F.lit("}\n```")))
            .when(v == 5, F.concat(F.lit('{"spans": '), js, F.lit("} <|im_end|>")))
            .when(v == 6, F.concat(F.lit('{"spans": '), F.to_json(F.array(up)), F.lit("}")))
            .when(v == 7, F.lit('{"spans": []}'))
            .when(v == 8, F.concat(F.lit('{"spans": '), F.to_json(F.array(span, F.col("_span2"))), F.lit("}")))
            .when(v == 9, F.concat(F.lit('{"spans": ["'), span))
            .when(v == 10, F.concat(F.lit('{"spans": '), F.to_json(F.array(F.translate(span, "\n", " "))),
                                    F.lit(', "note": 1}')))
            .otherwise(F.concat(F.lit('Answer: {"spans": ['), inner, F.lit(', 1, null]}'))))
    return df.withColumn("raw", raw).drop("_span", "_span2", "_v", "_js")


def predictions(spark: SparkSession, sf_dir: str, registry=None) -> DataFrame:
    """Long model-output table ``id, pn_num, case_num, feature_num, model, weight, raw``."""
    return _on_disk(spark, sf_dir, "model-outputs", lambda: _model_outputs(spark, sf_dir, registry), tuple(registry or REGISTRY))


def _model_outputs(spark: SparkSession, sf_dir: str, registry=None) -> DataFrame:
    p = pairs(spark, sf_dir, with_text=True).drop("feature_text")
    reg = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(int(w)).alias("weight"))
                    for m, w in (registry or REGISTRY)])
    out = p.withColumn("_m", F.explode(reg)).select("*", "_m.model", "_m.weight")
    return _with_raw(out).select("id", "pn_num", "case_num", "feature_num", "model", "weight", "raw")


def predictions_with_truth(spark: SparkSession, sf_dir: str, registry=None) -> DataFrame:
    """Model outputs next to the note, feature and true spans, in one scan (no join back)."""
    p = with_truth(pairs(spark, sf_dir, with_text=True))
    reg = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(int(w)).alias("weight"))
                    for m, w in (registry or REGISTRY)])
    out = p.withColumn("_m", F.explode(reg)).select("*", "_m.model", "_m.weight").drop("_m")
    return _with_raw(out)


def augmented_pairs(spark: SparkSession, sf_dir: str, model: str = "m1") -> DataFrame:
    """Pseudo-labelled pairs as written by the labelling job: repr-string annotation
    of the first-object parse of one model's output, for unannotated notes."""
    return _on_disk(spark, sf_dir, "augmented-pairs", lambda: _augmented_pairs(spark, sf_dir, model), model)


def _augmented_pairs(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    from spanweave.functions.text import is_blank, parse_spans
    n = notes(spark, sf_dir).join(annotated_ids(spark, sf_dir), "pn_num", "left_anti")
    n = n.filter(~is_blank(F.col("pn_history"))).repartition("pn_num")
    p = n.join(features(spark, sf_dir).drop("feature_text"), "case_num").withColumn("id", pair_id("pn_num", "feature_num"))
    p = _with_raw(p.withColumn("model", F.lit(model)))
    return p.select("id", "pn_num", "feature_num", "case_num",
                    py_repr_list(parse_spans("raw", "first_object")).alias("annotation"))
