"""Registered queries: one per operator key, each reading the whole input tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.plans.ensemble import ensemble_locations
from spanweave.sources import tables as T

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("ensemble_vote")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Three registry models, threshold 2, exact and case-insensitive location."""
    n_voters = sum(w for _, w in T.REGISTRY)
    return ensemble_locations(T.pairs(spark, sf), T.notes(spark, sf).select("pn_num", "pn_history"),
                              T.predictions(spark, sf), threshold=2, n_voters=n_voters)


# ----------------------------------------------------------------- batch 2
from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from spanweave.functions import prompts as P  # noqa: E402
from spanweave.functions.text import (parse_pylist, parse_spans, strip_think, is_blank,  # noqa: E402
                                      assistant_target)
from spanweave.functions.tokenizers import BLANKS  # noqa: E402
from spanweave.operators import relational as R  # noqa: E402
from spanweave.operators.batching import padded_rows  # noqa: E402
from spanweave.operators import sampling as S  # noqa: E402
from spanweave.operators import scoring as SC  # noqa: E402
from spanweave.operators.spans import (locate_spans, merge_intervals, parse_location,  # noqa: E402
                                       with_blank_edges, format_location)
from spanweave.plans.ensemble import explode_spans  # noqa: E402
from spanweave.plans.pseudo_label import examples_per_feature, with_blocks  # noqa: E402
from spanweave.plans.training import training_rows  # noqa: E402

SEP = "␟"  # list separator in flattened outputs


def _parsed(spark, sf, mode):
    p = T.predictions(spark, sf)
    s = parse_spans("raw", mode)
    return p.select("id", "model", F.size(s).alias("n_spans"), F.array_join(s, SEP).alias("spans"))


register("parse_spans")(lambda spark, sf: _parsed(spark, sf, "greedy"))
register("parse_spans_first_object")(lambda spark, sf: _parsed(spark, sf, "first_object"))
register("parse_spans_outer_braces")(lambda spark, sf: _parsed(spark, sf, "outer_braces"))


@register("strip_think")
def q_strip_think(spark, sf):
    return T.predictions(spark, sf).select("id", "model", strip_think("raw").alias("text"))


@register("json_valid_pct")
def q_json_valid_pct(spark, sf):
    return SC.json_valid_pct(T.predictions(spark, sf), "raw", ["model"])


def _located(spark, sf):
    notes = T.notes(spark, sf).select("pn_num", "pn_history")
    return locate_spans(explode_spans(T.predictions(spark, sf)), notes)


@register("locate_spans")
def q_locate_spans(spark, sf):
    return _located(spark, sf).select("id", "model", "span_idx", "start", "end", "method")


@register("merge_spans")
def q_merge_spans(spark, sf):
    c = _located(spark, sf).withColumn("end", F.least("end", "note_len"))
    return merge_intervals(c, ["id", "model"])


@register("format_location")
def q_format_location(spark, sf):
    """All models' spans per pair: trim blanks, drop empties, merge touching, format."""
    j = with_blank_edges(_located(spark, sf))
    j = (j.withColumn("start", F.col("start") + F.col("lead")).withColumn("end", F.col("end") - F.col("trail"))
          .filter(F.col("start") < F.col("end")))
    return format_location(merge_intervals(j, ["id"]))


@register("parse_location")
def q_parse_location(spark, sf):
    sub = flagship(spark, sf)
    return sub.select("id", F.explode(parse_location("location")).alias("x")).select("id", "x.start", "x.end")


def _judged(spark, sf):
    """Stored model outputs, the truth of each pair, and the notes."""
    preds = T.predictions(spark, sf).select("id", "pn_num", "model", "raw")
    return preds, T.with_truth(T.pairs(spark, sf, with_text=True)), T.notes(spark, sf).select("pn_num", "pn_history")


@register("char_f1")
def q_char_f1(spark, sf):
    preds, truth, notes = _judged(spark, sf)
    preds = preds.withColumn("pred", parse_spans("raw", "outer_braces")).drop("raw")
    return SC.char_scores_of_tables(preds, truth, notes, by=["model"])


@register("output_rates")
def q_output_rates(spark, sf):
    return SC.output_rates_of_tables(*_judged(spark, sf), by=["model"], prefix="val_")


@register("fill_rate")
def q_fill_rate(spark, sf):
    p = T.predictions(spark, sf).withColumn("spans", parse_spans("raw", "first_object"))
    return SC.fill_rate(p, "spans", ["model"])


def _unannotated(spark, sf):
    return R.unannotated(T.notes(spark, sf), T.annotated_ids(spark, sf))


@register("unannotated_notes")
def q_unannotated(spark, sf):
    return _unannotated(spark, sf).select("pn_num", "case_num")


@register("nonblank_notes")
def q_nonblank(spark, sf):
    return R.nonblank(T.notes(spark, sf), "pn_history").groupBy("case_num").agg(F.count(F.lit(1)).alias("n_notes"))


@register("sample_n")
def q_sample_n(spark, sf):
    return S.sample_n(_unannotated(spark, sf), 50, 42, "pn_num").select("pn_num", "case_num")


@register("sample_fraction")
def q_sample_fraction(spark, sf):
    return S.sample_fraction(T.augmented_pairs(spark, sf), 0.5, 42, "id").select("id")


@register("case_fanout")
def q_case_fanout(spark, sf):
    f = T.features(spark, sf).drop("feature_text")
    return R.case_fanout(_unannotated(spark, sf).drop("pn_history"), f).select("pn_num", "case_num", "feature_num")


@register("pair_ids")
def q_pair_ids(spark, sf):
    return T.pairs(spark, sf).select("id", "pn_num", "feature_num")


@register("pair_totals")
def q_pair_totals(spark, sf):
    s = _unannotated(spark, sf).drop("pn_history")
    return R.case_fanout(s, T.features(spark, sf).drop("feature_text")).agg(F.count(F.lit(1)).alias("total_pairs"))


@register("features_per_case")
def q_features_per_case(spark, sf):
    return T.features(spark, sf).groupBy("case_num").agg(
        F.array_join(F.array_sort(F.collect_list("feature_num")), ",").alias("feature_nums"))


@register("lookup_note")
def q_lookup_note(spark, sf):
    """Note text by the last of its revisions: every seventh note has an older, empty one."""
    now = T.notes(spark, sf).select("pn_num", "pn_history", F.lit(2).alias("revision"))
    old = now.where(F.col("pn_num") % 7 == 0).select("pn_num", F.lit("").alias("pn_history"), F.lit(1).alias("revision"))
    notes = R.dedupe_last(old.unionByName(now), ["pn_num"], "revision", ["pn_history"])
    t = R.lookup(T.pairs(spark, sf), notes, ["pn_num"], "pn_history")
    return t.select("id", F.length("pn_history").alias("note_len"), F.md5("pn_history").alias("note_md5"))


@register("lookup_feature")
def q_lookup_feature(spark, sf):
    t = R.lookup(T.pairs(spark, sf), T.features(spark, sf), ["case_num", "feature_num"], "feature_text")
    return t.select("id", "feature_text")


@register("resume_pairs")
def q_resume_pairs(spark, sf):
    """Pairs of unannotated notes still to label, given a results table of valid outputs."""
    from spanweave.functions.text import json_valid
    todo = R.case_fanout(_unannotated(spark, sf).drop("pn_history"), T.features(spark, sf).drop("feature_text"))
    todo = todo.withColumn("id", F.format_string("%05d_%03d", "pn_num", "feature_num"))
    done = T.predictions(spark, sf).filter((F.col("model") == "m1") & json_valid("raw"))
    return R.resume(todo, done, "id").select("id")


@register("head_n")
def q_head_n(spark, sf):
    return R.head_n(T.pairs(spark, sf), 20, ["id"]).select("id", "pn_num")


def _training(spark, sf, of_note=None):
    return training_rows(T.train_pairs(spark, sf), T.augmented_pairs(spark, sf),
                         T.notes(spark, sf), T.features(spark, sf), ratio=0.5, seed=42, of_note=of_note)


@register("training_rows")
def q_training_rows(spark, sf):
    t = _training(spark, sf)
    return t.select("id", "pn_num", "case_num", "feature_num", F.length("pn_history").alias("note_len"),
                    "feature_text", F.size("annotation").alias("n_spans"), "assistant_target")


@register("span_histogram")
def q_span_histogram(spark, sf):
    t = _training(spark, sf)
    return t.groupBy(F.size("annotation").alias("n_spans")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("assistant_target")
def q_assistant_target(spark, sf):
    t = T.with_truth(T.pairs(spark, sf, with_text=True))
    return t.select("id", assistant_target("annotation").alias("assistant_target"))


@register("parse_pylist")
def q_parse_pylist(spark, sf):
    t = T.train_pairs(spark, sf)
    a, l_ = parse_pylist("annotation"), parse_pylist("location")
    return t.select("id", F.size(a).alias("n_spans"), F.array_join(a, SEP).alias("spans"),
                    F.array_join(l_, SEP).alias("locations"))


@register("group_kfold")
def q_group_kfold(spark, sf):
    f = S.group_kfold(_training(spark, sf), "case_num", 5)
    return f.groupBy("case_num", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


@register("fold_summary")
def q_fold_summary(spark, sf):
    rows = FS.materialize_once(_training(spark, sf).select("case_num"), unique_dir(spark, "fold-rows"))  # read for sizes, folds and sides
    f = S.split_fold(S.group_kfold(rows, "case_num", 5), 4, 5)
    per_case = f.groupBy("case_num").agg(F.countDistinct("side").alias("k"))
    j = f.join(per_case, "case_num")
    return j.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.array_join(F.array_sort(F.collect_set("case_num")), ",").alias("cases"),
                                 F.countDistinct(F.when(F.col("k") > 1, F.col("case_num"))).alias("leaky"))


@register("length_percentiles")
def q_length_percentiles(spark, sf, tokenizer=BLANKS):
    if tokenizer.splits_at_blanks:  # a note is counted once, not in each of its pairs
        head, body, rest, _ = P.training_parts("pn_history", "feature_text", "assistant_target")
        t = _training(spark, sf, {"note_tokens": tokenizer.count(body)})
        t = t.select((tokenizer.count(head) + F.col("note_tokens") + tokenizer.count(rest)).alias("n_tokens"))
    else:
        text = P.render_chatml(P.chat_messages("pn_history", "feature_text", "assistant_target"))
        t = _training(spark, sf).select(tokenizer.count(text).alias("n_tokens"))
    return SC.length_report(t, "n_tokens", 512)


@register("model_filter")
def q_model_filter(spark, sf):
    wanted = [m.strip() for m in "m1,m3".split(",") if m.strip()]
    return T.predictions(spark, sf).filter(F.col("model").isin(wanted)).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- telemetry
from spanweave.operators import telemetry as TM  # noqa: E402

EPOCH0 = 1704067200  # 2024-01-01T00:00:00Z, origin of the hourly step buckets


def _log(spark, sf):
    return TM.training_log(T.read_table(spark, sf, "events"))


def _hourly(spark, sf):
    return _log(spark, sf).withColumn("hstep", F.floor((F.col("wall_time") - EPOCH0) / 3600).cast("int"))


def _r6(df, cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@register("telemetry_clean")
def q_telemetry_clean(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return _log(spark, sf).select("run", "step", k.alias("k")).filter(F.col("k").isNotNull())


@register("event_pivot")
def q_event_pivot(spark, sf):
    h = _hourly(spark, sf).withColumn("tag", F.concat(F.lit("train/"), "tag"))
    return _r6(TM.event_pivot(h, ["run", "hstep"]), TM.TAGS)


@register("grad_stats")
def q_grad_stats(spark, sf):
    return _r6(TM.series_stats(_log(spark, sf), ["run"], "grad_norm"), ["mean", "std", "min", "max"])


@register("best_checkpoint")
def q_best_checkpoint(spark, sf):
    return TM.best_step(_log(spark, sf), ["run"], "eval_loss")


@register("last_row")
def q_last_row(spark, sf):
    return TM.last_row_value(_log(spark, sf), ["run"], "loss")


@register("last_nonnull")
def q_last_nonnull(spark, sf):
    return TM.last_nonnull_value(_log(spark, sf), ["run"], "loss")


@register("relative_time")
def q_relative_time(spark, sf):
    r = TM.minutes_since_start(_log(spark, sf), ["run"], "wall_time", F.col("loss").isNotNull())
    return _r6(r.select("run", "step", "minutes"), ["minutes"])


@register("tail_n")
def q_tail_n(spark, sf):
    return TM.tail(_log(spark, sf), ["run"], "step", 500).select("run", "step")


@register("train_eval_curve")
def q_train_eval_curve(spark, sf):
    h = _hourly(spark, sf)
    tr = h.filter(F.col("loss").isNotNull()).groupBy("run", "hstep").agg(F.avg("loss").alias("loss"))
    ev = h.filter(F.col("eval_loss").isNotNull()).groupBy("run", "hstep").agg(F.avg("eval_loss").alias("eval_loss"))
    return _r6(tr.join(ev, ["run", "hstep"], "full_outer"), ["loss", "eval_loss"])


@register("schedule_check")
def q_schedule_check(spark, sf):
    lr = _log(spark, sf).filter(F.col("learning_rate").isNotNull())
    return lr.groupBy("run").agg(F.min("learning_rate").alias("lr_min"), F.max("learning_rate").alias("lr_max"),
                                 F.min_by("learning_rate", "step").alias("lr_first"),
                                 F.max_by("learning_rate", "step").alias("lr_last"))


@register("event_counts")
def q_event_counts(spark, sf):
    return _log(spark, sf).rollup("run").agg(F.count(F.lit(1)).alias("n_events"))


@register("early_stop_point")
def q_early_stop(spark, sf):
    return TM.early_stop(_log(spark, sf), ["run"], "eval_loss", patience=3)


def _run_metrics(spark, sf):
    log = _log(spark, sf)
    return log.groupBy("run").agg(
        F.max("step").alias("final_step"), F.count("eval_loss").alias("total_eval_steps"),
        F.min("eval_loss").alias("best_eval_loss"),
        F.max_by("loss", F.when(F.col("loss").isNotNull(), F.col("step"))).alias("final_train_loss"),
        F.max_by("eval_loss", F.when(F.col("eval_loss").isNotNull(), F.col("step"))).alias("final_eval_loss"),
        F.avg("grad_norm").alias("grad_mean"), F.count(F.lit(1)).alias("n_events"))


@register("run_summary")
def q_run_summary(spark, sf):
    m = _run_metrics(spark, sf).withColumn("train_eval_gap", F.col("final_eval_loss") - F.col("final_train_loss"))
    return _r6(m.drop("grad_mean", "n_events"), ["train_eval_gap"])


@register("minmax_matrix")
def q_minmax(spark, sf):
    m = _run_metrics(spark, sf).select("run", "final_train_loss", "best_eval_loss", "grad_mean",
                                       F.col("n_events").cast("double").alias("n_events"))
    s = TM.minmax_scores(m, "run", {"final_train_loss": True, "best_eval_loss": True, "grad_mean": True,
                                    "n_events": False})
    return _r6(s, ["score"])


# Fixed size-class dimension of the runs (name -> class).
SIZE_CLASS = [(f"run{i}", "small" if i < 4 else "large") for i in range(8)]


def ieee_ratio(num, den):
    """``num / den`` of doubles by IEEE rules, as the SQL has it: a zero divisor gives an infinity or NaN, never an error."""
    quotient = num / F.nullif(den, F.lit(0.0))
    at_zero = F.when(F.isnan(num) | (num == 0), float("nan")).when(num > 0, float("inf")).otherwise(float("-inf"))
    return F.when(num.isNull() | den.isNull() | (den != 0), quotient).otherwise(at_zero)


@register("size_class_stats")
def q_size_class(spark, sf):
    return size_class_stats(spark, _run_metrics(spark, sf))


def size_class_stats(spark, metrics):
    """Statistics of the runs of each size class, and the gap of its mean to that of all other runs."""
    dim = spark.createDataFrame(SIZE_CLASS, "run string, size_class string")
    m = metrics.join(F.broadcast(dim), "run")
    per = m.groupBy("size_class").agg(F.avg("best_eval_loss").alias("eval_mean"),
                                      F.stddev_samp("best_eval_loss").alias("eval_std"),
                                      F.avg("final_train_loss").alias("train_mean"),
                                      F.stddev_samp("final_train_loss").alias("train_std"),
                                      F.avg("grad_mean").alias("grad_mean"), F.stddev_samp("grad_mean").alias("grad_std"),
                                      F.sum("best_eval_loss").alias("_s"), F.count(F.lit(1)).alias("_n"))
    tot = m.agg(F.sum("best_eval_loss").alias("_ts"), F.count(F.lit(1)).alias("_tn"))
    j = per.withColumn("_k", F.lit(1)).join(tot.withColumn("_k", F.lit(1)), "_k")
    j = j.withColumn("eval_rest_mean", ieee_ratio(F.col("_ts") - F.col("_s"), (F.col("_tn") - F.col("_n")).cast("double")))
    j = j.withColumn("rel_gap", ieee_ratio(F.col("eval_mean") - F.col("eval_rest_mean"), F.col("eval_rest_mean")))
    return _r6(j.drop("_k", "_s", "_n", "_ts", "_tn"),
               ["eval_mean", "eval_std", "train_mean", "train_std", "grad_mean", "grad_std", "eval_rest_mean", "rel_gap"])


def _bench(spark, sf):
    """Benchmark rows, one per label (event type): throughput analytics inputs."""
    ev = T.read_table(spark, sf, "events")
    b = ev.groupBy(F.col("event_type").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value")).cast("long").alias("output_toks"),
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6 / 10000.0)
        .alias("wall_time_s"),
        F.avg(F.length("props")).alias("avg_chars"),
        F.min("props").alias("_err"))
    ok = F.col("label") != "error"
    b = b.withColumn("status", F.when(ok, "OK").otherwise("ERROR")) \
         .withColumn("error", F.when(~ok, F.concat(F.lit("failed: "), F.col("_err")))).drop("_err")
    return TM_bench(b, ok)


def TM_bench(b, ok):
    tok_ps = F.round(F.col("output_toks") / F.col("wall_time_s"), 1)
    b = b.withColumn("output_toks_ps", F.when(ok, tok_ps))
    est_in = F.floor(F.col("avg_chars") / 4) * F.col("n")
    b = b.withColumn("input_toks_ps", F.when(ok, F.round(est_in / F.col("wall_time_s"), 1)))
    total_out = 14300 * 40 * 3  # fixed workload of the ETA estimate (rows x tokens x passes)
    b = b.withColumn("eta_14k_hours", F.round(total_out / F.col("output_toks_ps") / 3600, 2))
    return b.withColumn("eta_worst_hours", F.round(total_out / (F.col("output_toks_ps") * 0.8) / 3600, 2))


def _quality(spark, sf):
    ev = T.read_table(spark, sf, "events")
    return ev.groupBy(F.col("event_type").alias("label")).agg(
        F.round(100 * F.avg((F.col("value") < 300).cast("int")), 1).alias("valid_pct"))


@register("throughput")
def q_throughput(spark, sf):
    return _bench(spark, sf).select("label", "n", "output_toks", "output_toks_ps", "input_toks_ps",
                                    "eta_14k_hours", "eta_worst_hours")


@register("bench_status")
def q_bench_status(spark, sf):
    return _bench(spark, sf).select("label", "status", F.substring(F.coalesce("error", F.lit("")), 1, 80).alias("error"))


def _budget(col):
    return F.when(F.col(col) < 9, "yes").when(F.col(col).isNotNull(), "no").otherwise("ERR")


@register("bench_rank")
def q_bench_rank(spark, sf):
    b = _bench(spark, sf).withColumn("fits_budget", _budget("eta_worst_hours"))
    w = Window.orderBy(F.col("output_toks_ps").desc_nulls_last(), F.col("label"))
    return b.select("label", "status", "output_toks_ps", "fits_budget", F.row_number().over(w).alias("rank"))


@register("bench_quality_join")
def q_bench_quality(spark, sf):
    return _bench(spark, sf).join(_quality(spark, sf), "label", "left").select("label", "output_toks_ps", "valid_pct")


@register("bench_pick")
def q_bench_pick(spark, sf):
    b = _bench(spark, sf).join(_quality(spark, sf), "label", "left")
    fits = F.coalesce(F.when(F.col("eta_worst_hours") != 0, F.col("eta_worst_hours")), F.lit(99.0)) < 9
    return b.filter(fits & (F.col("valid_pct") >= 90)).orderBy(F.col("output_toks_ps").desc(), "label") \
            .limit(3).select("label", "output_toks_ps", "valid_pct")


@register("timing_summary")
def q_timing(spark, sf):
    """Rows and seconds of each model, and the seconds it would need for the rows of all (a row a model meets there)."""
    ev = T.read_table(spark, sf, "events")
    t = ev.groupBy(F.col("event_type").alias("model")).agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("rows"))
    secs = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1e6
    t = t.withColumn("elapsed_s", F.floor(secs).cast("long"))
    return t.select("model", "rows", "elapsed_s", TM.hms(F.col("elapsed_s")).alias("elapsed"),
                    F.round(F.col("rows") / F.nullif(F.col("elapsed_s"), F.lit(0)), 6).alias("rows_per_s"),
                    F.round(F.sum("rows").over(Window.partitionBy()) * F.nullif(F.col("elapsed_s"), F.lit(0)) / F.col("rows"), 3).alias("est_full_s"))


@register("ablation_delta")
def q_ablation(spark, sf):
    m = _run_metrics(spark, sf).select("run", F.col("best_eval_loss").alias("score"))
    w = Window.orderBy("run")
    out = m.withColumn("delta", F.round(F.col("score") - F.first("score").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6)) \
           .withColumn("is_best", F.col("score") == F.min("score").over(Window.partitionBy()))
    return out


@register("model_coverage")
def q_model_coverage(spark, sf):
    """Non-empty outputs of each model and, as the row ``submission``, voted pairs with a location."""
    p = T.predictions(spark, sf)
    models = p.groupBy("model").agg(F.count_if(F.size(parse_spans("raw")) > 0).alias("non_empty"), F.count(F.lit(1)).alias("n"))
    voted = flagship(spark, sf).agg(F.count("location").alias("non_empty"), F.count(F.lit(1)).alias("n"))
    return models.unionByName(voted.withColumn("model", F.lit("submission")))


# ----------------------------------------------------- retrieval and prompts
from spanweave.functions.text import constraint_regex, feature_variants, obeys, strip_u as _strip  # noqa: E402
from spanweave.operators import ivf as IVF  # noqa: E402
from spanweave.operators import retrieval as RT  # noqa: E402


EXCERPT = 500


def _train_parsed(spark, sf):
    t = T.train_pairs(spark, sf).withColumn("annotation", parse_pylist("annotation"))
    excerpt = F.substring("pn_history", 1, EXCERPT).alias("pn_history")  # cut before the join: no more is used of a note
    t = R.lookup(t, T.notes(spark, sf).select("pn_num", excerpt), ["pn_num"], "pn_history")
    return R.lookup(t, T.features(spark, sf), ["case_num", "feature_num"], "feature_text")


def retrieval_corpus(train):
    """Retrieval examples: ``Feature: X  Annotation: a | b`` (two blanks), note excerpt of 500."""
    ann = F.array_join(F.filter("annotation", lambda a: _strip(a) != ""), " | ")
    c = train.withColumn("annotation_str", ann).filter((F.col("feature_text") != "") & (F.col("annotation_str") != ""))
    return c.select("id", "feature_text", "annotation_str",
                    F.concat(F.lit("Feature: "), "feature_text", F.lit("  Annotation: "), "annotation_str").alias("embed_text"),
                    F.substring("pn_history", 1, EXCERPT).alias("pn_history"), "location")


@register("retrieval_corpus")
def q_retrieval_corpus(spark, sf):
    c = retrieval_corpus(_train_parsed(spark, sf))
    return c.select("id", "embed_text", F.md5("pn_history").alias("excerpt_md5"), "location")


def _emb_split(spark, sf):
    """Query set: every vector whose id is divisible by 20, against all others."""
    e = T.read_table(spark, sf, "embeddings")
    q = F.col("vec_id") % 20 == 0
    return e.where(q).select(F.col("vec_id").alias("query_id"), "embedding"), e.where(~q).select("vec_id", "embedding")


@register("knn_topk")
def q_knn_topk(spark, sf):
    queries, corpus = _emb_split(spark, sf)
    r = RT.knn_topk(queries, corpus, 3)
    return r.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _by_index(spark, sf):
    queries, corpus = _emb_split(spark, sf)
    return IVF.search(IVF.tune_probes(IVF.build_index(corpus), corpus, 3), queries, 3)


@register("knn_topk_index")
def q_knn_topk_index(spark, sf):
    """Top-3 by an inverted file over all other vectors, probes tuned for a recall of 0.95 on sampled rows."""
    return _by_index(spark, sf).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("knn_index_recall")
def q_knn_index_recall(spark, sf):
    """Neighbours of the exact search, and whether the index finds nine in ten of them."""
    exact = q_knn_topk(spark, sf).select("query_id", "vec_id")
    found = exact.join(_by_index(spark, sf).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return found.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_neighbours"),
                     (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count(F.lit(1))).alias("recall_ok"))


@register("fewshot_prompt")
def q_fewshot_prompt(spark, sf):
    """Pseudo-labelling prompts for all unannotated notes: top-3 retrieved examples
    per distinct feature (hoisted), joined back to every (note, feature) pair."""
    features = T.features(spark, sf)
    asked = with_blocks(features, examples_per_feature(features, retrieval_corpus(_train_parsed(spark, sf)), 3))  # once a feature
    notes = R.unannotated(T.notes(spark, sf).repartition("pn_num"), T.annotated_ids(spark, sf).hint("shuffle_hash"))
    pairs = R.case_fanout(notes.select("pn_num", "case_num", P.one_line("pn_history").alias("target")), asked)  # once a note
    msgs = P.fewshot_turns("target", "feature_text", "block")
    return pairs.select(F.format_string("%05d_%03d", "pn_num", "feature_num").alias("id"),
                        F.size(msgs).alias("n_messages"), F.md5(msgs[1]["content"]).alias("user_md5"))


@register("chat_messages")
def q_chat_messages(spark, sf):
    t = _training(spark, sf)
    text = P.render_chatml(P.chat_messages("pn_history", "feature_text", "assistant_target"))
    return t.select("id", F.length(text).alias("text_len"), F.md5(text).alias("text_md5"))


def _conversation_messages(spark, sf):
    c = T.read_table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                                                lambda x: F.struct(x["role"].alias("role"),
                                                                   x["text"].alias("content"))).alias("messages"))


@register("chatml_render")
def q_chatml(spark, sf):
    m = _conversation_messages(spark, sf)
    text = P.render_chatml("messages", add_generation_prompt=True)
    return m.select("conv_id", F.size("messages").alias("n_turns"), F.length(text).alias("text_len"),
                    F.md5(text).alias("text_md5"))


@register("fewshot_chat")
def q_fewshot_chat(spark, sf):
    """Fixed-example chat: the 3 first annotated rows (by id) as alternating user /
    assistant turns, then the query turn, for every pair."""
    tr = _training(spark, sf)
    ex = tr.orderBy("id").limit(3).select("id", P.user_content("pn_history", "feature_text").alias("u"),
                                           "assistant_target")
    turns = ex.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "u", "assistant_target"))),
                                         lambda x: F.array(P.msg("user", x["u"]), P.msg("assistant", x["assistant_target"]))))
                   .alias("turns"))
    # one-row example table (3 examples, bounded): broadcast on a constant key
    p = T.pairs(spark, sf, with_text=True).withColumn("_k", F.lit(1)).join(
        F.broadcast(turns.withColumn("_k", F.lit(1))), "_k")
    msgs = F.concat(F.array(P.msg("system", F.lit(P.SYSTEM_PROMPT))), F.col("turns"),
                    F.array(P.msg("user", P.user_content("pn_history", "feature_text"))))
    text = P.render_chatml(msgs, add_generation_prompt=True)
    return p.select("id", F.size(msgs).alias("n_messages"), F.md5(text).alias("text_md5"))


@register("label_mask")
def q_label_mask(spark, sf, max_len: int | None = None, tokenizer=BLANKS):
    """Labels of each conversation; ``max_len`` cuts the token arrays (reported in ``n_truncated``)."""
    m = _conversation_messages(spark, sf)
    full = tokenizer.ids(P.render_chatml("messages"))
    prompt = tokenizer.ids(P.render_chatml(F.slice("messages", 1, F.size("messages") - 1), True))
    out = m.select("conv_id", prompt.alias("p"), full.alias("f"))
    out = out.select("conv_id", P.mask_labels("p", "f", max_len).alias("labels"), F.size("f").alias("n_full"))
    return out.select("conv_id", F.size("labels").alias("n_tokens"), (F.col("n_full") - F.size("labels")).alias("n_truncated"),
                      F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked"),
                      F.forall("labels", lambda x: x == -100).alias("all_masked"))


def encoded_training(spark, sf, tokenizer=BLANKS):
    """``id, n_tok, input_ids, labels`` of every training row (labels count in the answer alone), written once."""
    if tokenizer.splits_at_blanks:  # a note is encoded once, not twice in each of its pairs
        head, body, rest, asked = P.training_parts("pn_history", "feature_text", "assistant_target")
        t = _training(spark, sf, {"note_ids": tokenizer.ids(body)})
        whole = lambda end: F.concat(tokenizer.ids(head), F.col("note_ids"), tokenizer.ids(end))
        t = t.select("id", whole(rest).alias("input_ids"), whole(asked).alias("p"))
    else:
        full = P.render_chatml(P.chat_messages("pn_history", "feature_text", "assistant_target"))
        prompt = P.render_chatml(P.chat_messages("pn_history", "feature_text"), True)
        t = _training(spark, sf).select("id", tokenizer.ids(full).alias("input_ids"), tokenizer.ids(prompt).alias("p"))
    t = t.select("id", F.size("input_ids").alias("n_tok"), "input_ids", P.mask_labels("p", "input_ids").alias("labels"))
    return FS.materialize_once(t, unique_dir(spark, "encoded"))


@register("pad_batches")
def q_pad_batches(spark, sf, tokenizer=BLANKS):
    """Batches of eight rows of like length, with digests of their padded ids and labels (row by row)."""
    rows = padded_rows(encoded_training(spark, sf, tokenizer), tokenizer.pad_id)
    said = lambda c: F.md5(F.array_join(c, ",").cast("binary"))
    rows = rows.select("bucket", "batch", "n_tok", "padded_len", F.struct("place", said("input_ids").alias("ids"), said("labels").alias("labels")).alias("r"))
    b = rows.groupBy("bucket", "batch").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_tok").alias("max_len"), F.sum("n_tok").alias("tokens"),
                                            F.max("padded_len").cast("bigint").alias("padded_len"), F.array_sort(F.collect_list("r")).alias("l"))
    digest = lambda f: F.md5(F.array_join(F.transform("l", lambda x: x[f]), "").cast("binary"))
    return b.select("bucket", "batch", "n_rows", "max_len", "tokens", "padded_len", digest("ids").alias("ids_md5"), digest("labels").alias("labels_md5"))


@register("constraint_regex")
def q_constraint_regex(spark, sf):
    pat = constraint_regex("pn_history", 10)
    return T.notes(spark, sf).select("pn_num", F.length(pat).alias("pattern_len"), F.md5(pat).alias("pattern_md5"))


@register("constraint_check")
def q_constraint_check(spark, sf):
    patterns = T.notes(spark, sf).select("pn_num", constraint_regex("pn_history", 10).alias("pattern"))  # once a note
    p = T.predictions(spark, sf).join(patterns, "pn_num")
    return p.groupBy("model").agg(F.count_if(obeys("raw", F.col("pattern"))).alias("n_obey"), F.count(F.lit(1)).alias("n"))


@register("feature_variants")
def q_feature_variants(spark, sf):
    f = T.features(spark, sf)
    return f.select("feature_num", F.posexplode(feature_variants("feature_text")).alias("variant_idx", "variant"))


# ------------------------------------------------ fuzzy location and labelers
# (no SQL oracle: alignment by LCS ratio is not expressible in SQL on whole
# tables; tests/test_fuzzy.py checks it against brute force)
from spanweave.operators import labelers as LB  # noqa: E402
from spanweave.plans.pseudo_label import pseudo_label  # noqa: E402


def _located_fuzzy(spark, sf, mode, cutoff):
    notes = T.notes(spark, sf).select("pn_num", "pn_history")
    return locate_spans(explode_spans(T.predictions(spark, sf)), notes, fuzzy_cutoff=cutoff, fuzzy_mode=mode)


@register("locate_spans_fuzzy")
def q_locate_fuzzy(spark, sf):
    return _located_fuzzy(spark, sf, "partial", 70.0).select("id", "model", "span_idx", "start", "end", "method")


@register("locate_spans_window")
def q_locate_window(spark, sf):
    return _located_fuzzy(spark, sf, "window", 72.0).select("id", "model", "span_idx", "start", "end", "method")


@register("ensemble_vote_fuzzy")
def q_ensemble_fuzzy(spark, sf):
    n_voters = sum(w for _, w in T.REGISTRY)
    return ensemble_locations(T.pairs(spark, sf), T.notes(spark, sf).select("pn_num", "pn_history"),
                              T.predictions(spark, sf), threshold=2, n_voters=n_voters, fuzzy_cutoff=70.0)


@register("pseudo_label")
def q_pseudo_label(spark, sf):
    corpus = retrieval_corpus(_train_parsed(spark, sf))
    return pseudo_label(T.notes(spark, sf), T.annotated_ids(spark, sf), T.features(spark, sf), corpus,
                        LB.phrase_labeler_factory)


@register("labeler_fallback")
def q_labeler_fallback(spark, sf):
    """A primary backend whose context holds 2,000 characters; batches with a longer note go to one without a limit."""
    pairs = T.pairs(spark, sf, with_text=True)
    out = LB.label_with_fallback(pairs, lambda: LB.PhraseLabeler(max_note_chars=2000), LB.phrase_labeler_factory, batch=32, keep=["id"])
    return out.select("id", F.size(parse_spans("raw")).alias("n_spans"), F.col("error").isNull().alias("ok"))


# ----------------------------------------------------------------- streaming
from spanweave.streaming import jobs as SJ  # noqa: E402


@register("telemetry_stream")
def q_telemetry_stream(spark, sf):
    r = SJ.telemetry_windows(spark, T.read_table(spark, sf, "events"))
    return _r6(r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "run",
                        "n_events", "loss", "eval_loss"), ["loss", "eval_loss"])


@register("stream_label")
def q_stream_label(spark, sf):
    out = SJ.incremental_labels(spark, T.notes(spark, sf), T.features(spark, sf), LB.phrase_labeler_factory)
    return out.select("id", F.size(parse_spans("raw")).alias("n_spans"))


@register("stream_vote")
def q_stream_vote(spark, sf):
    notes = T.notes(spark, sf).select("pn_num", "pn_history")
    preds = T.predictions(spark, sf)
    located = with_blank_edges(locate_spans(explode_spans(preds), notes))
    n_voters = sum(w for _, w in T.REGISTRY)
    r = SJ.online_vote(spark, located, preds.select("id", "model"), n_voters, 2, n_models=len(T.REGISTRY))
    return r.select("id", "location")


# ------------------------------------------------------------ sources, sinks
from spanweave.session import unique_dir  # noqa: E402
from spanweave.sources import files as FS  # noqa: E402

NOTES_SCHEMA = "pn_num long, case_num int, pn_history string"
SUBMISSION_SCHEMA = "id string, location string"
TRAIN_SCHEMA = "id string, pn_num long, case_num int, feature_num long, annotation string, location string"


@register("scan_csv_typed")
def q_scan_csv(spark, sf):
    path = unique_dir(spark, "notes-csv")
    FS.write_csv(T.notes(spark, sf), path)
    n = FS.read_csv_typed(spark, path, NOTES_SCHEMA)
    return n.select("pn_num", "case_num", F.length(F.coalesce("pn_history", F.lit(""))).alias("note_len"),
                    F.md5(F.coalesce("pn_history", F.lit(""))).alias("note_md5"))


@register("scan_optional")
def q_scan_optional(spark, sf):
    train_path = unique_dir(spark, "train-csv")
    FS.write_csv(T.train_pairs(spark, sf), train_path)
    train = FS.read_csv_typed(spark, train_path, TRAIN_SCHEMA).withColumn("src", F.lit("train"))
    aug = FS.read_optional(spark, unique_dir(spark, "augmented-missing"), TRAIN_SCHEMA).withColumn("src", F.lit("aug"))
    u = train.unionByName(aug, allowMissingColumns=True)
    return u.agg(F.count_if(F.col("src") == "train").alias("n_train"), F.count_if(F.col("src") == "aug").alias("n_augmented"))


@register("input_contract")
def q_input_contract(spark, sf):
    """Tables that a run needs, one column name and one type that are not there, and one table that is missing."""
    need = {"documents": "doc_id bigint not null, text string not null, source string", "benchmark": "item_id bigint not null, text string",
            "labels": "doc_id string not null, toxic int", "pages": "page_id bigint, no_such_column string", "no_such_table": "id bigint"}
    return FS.input_contract(spark, {t: (f"{sf.rstrip('/')}/{t}.parquet", ddl) for t, ddl in need.items()})


@register("materialize_once")
def q_materialize_once(spark, sf):
    path = unique_dir(spark, "retrieval-meta")
    corpus = retrieval_corpus(_train_parsed(spark, sf)).select("id", "embed_text")
    FS.materialize_once(corpus, path)
    return FS.materialize_once(corpus, path)  # second call reuses the table


@register("sink_submission_roundtrip")
def q_sink_submission(spark, sf):
    path = unique_dir(spark, "submission")
    FS.write_csv(flagship(spark, sf), path)
    return FS.read_csv_typed(spark, path, SUBMISSION_SCHEMA)


RUN_DOC_SCHEMA = ("model_name string, global_step long, "
                  "log_history_snapshot array<struct<step:long,loss:double,eval_loss:double>>, "
                  "trainer_state struct<log_history:array<struct<step:long,loss:double,eval_loss:double>>>")


RUN_BLOCK_STEPS = 10_000


def run_documents(log, block_steps: int = RUN_BLOCK_STEPS):
    """One document for each run and block of steps, so that none holds more than ``block_steps`` steps of a run."""
    hist = F.array_sort(F.collect_list(F.struct(F.col("step").cast("long").alias("step"), "loss", "eval_loss")))
    docs = log.groupBy("run", F.floor(F.col("step") / block_steps).alias("block")).agg(hist.alias("h"), F.max("step").cast("long").alias("global_step"))
    even = F.pmod(F.substring("run", 4, 8).cast("int"), F.lit(2)) == 0
    return docs.select("run", F.col("run").alias("model_name"), "global_step", F.col("h").alias("log_history_snapshot"),
                       F.struct(F.when(even, F.array().cast("array<struct<step:long,loss:double,eval_loss:double>>"))
                                .otherwise(F.col("h")).alias("log_history")).alias("trainer_state"))


@register("json_runs")
def q_json_runs(spark, sf):
    """Metric documents (one a run and block of steps) written as JSON, read back in one partitioned read;
    history from the trainer state when non-empty, else from the snapshot."""
    docs = run_documents(_log(spark, sf).filter(F.col("loss").isNotNull() | F.col("eval_loss").isNotNull()))
    path = unique_dir(spark, "runs-json")
    docs.write.mode("overwrite").partitionBy("run").json(path)
    back = spark.read.schema(RUN_DOC_SCHEMA + ", run string").option("basePath", path).json(path)
    src = F.when(F.size(F.coalesce("trainer_state.log_history", F.array())) > 0, F.col("trainer_state.log_history")) \
           .otherwise(F.coalesce("log_history_snapshot", F.array()))
    return back.select("run", F.explode(src).alias("e")).select("run", "e.step", "e.loss", "e.eval_loss")


CELLS_A_DOCUMENT = 1000
NB_SCHEMA = ("conv_id long, block long, cells array<struct<cell_type:string,source:array<string>,"
             "outputs:array<struct<output_type:string,text:string,data:struct<html:string,image:string>>>>>")


@register("nested_doc_explode")
def q_nested_doc(spark, sf):
    """Notebook-like documents (one per conversation and block of 1,000 cells) to one row an output: whole texts, html, decoded images.

    Cells without outputs keep one row with a null output index.
    """
    c = T.read_table(spark, sf, "conversations")
    output = "struct<output_type:string,text:string,data:struct<html:string,image:string>>"
    none = F.lit(None).cast("string")
    stream = F.struct(F.lit("stream").alias("output_type"), F.col("text").alias("text"),
                      F.lit(None).cast("struct<html:string,image:string>").alias("data"))
    shown = F.struct(F.lit("display_data").alias("output_type"), none.alias("text"),
                     F.struct(F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"),
                              F.base64(F.col("text").cast("binary")).alias("image")).alias("data"))
    cell = F.struct(F.when(F.col("role") == "user", "markdown").otherwise("code").alias("cell_type"),
                    F.split("text", "\n").alias("source"),
                    F.when(F.col("role") == "user", F.array().cast(f"array<{output}>")).otherwise(F.array(stream, shown)).alias("outputs"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    numbered = c.select("conv_id", at.alias("at"), cell.alias("c"))
    docs = numbered.groupBy("conv_id", F.floor(F.col("at") / CELLS_A_DOCUMENT).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("cells"))
    path = unique_dir(spark, "notebooks-json")
    docs.write.mode("overwrite").json(path)
    nb = FS.read_json_docs(spark, path, NB_SCHEMA, multi_line=False)
    cells = nb.select("conv_id", "block", F.posexplode("cells").alias("i", "cell"))
    cells = cells.select("conv_id", (F.col("block") * CELLS_A_DOCUMENT + F.col("i")).cast("int").alias("cell_idx"), "cell")
    outs = cells.select("conv_id", "cell_idx", "cell", F.posexplode_outer("cell.outputs").alias("output_idx", "o"))
    return outs.select("conv_id", "cell_idx", F.col("cell.cell_type").alias("cell_type"), F.size("cell.source").alias("n_lines"), "output_idx",
                       F.col("o.output_type").alias("output_type"), F.length("o.text").alias("output_len"), F.md5("o.text").alias("output_md5"),
                       F.length("o.data.html").alias("html_len"), F.octet_length(F.unbase64("o.data.image")).alias("image_bytes"))


# ------------------------------------------------------------ remaining keys
@register("vote_locations")
def q_vote_locations(spark, sf):
    """Final voted intervals per pair (the sweep output before formatting)."""
    from spanweave.operators.spans import majority_vote
    notes = T.notes(spark, sf).select("pn_num", "pn_history")
    edged = with_blank_edges(locate_spans(explode_spans(T.predictions(spark, sf)), notes))
    return majority_vote(edged, 2, n_voters=sum(w for _, w in T.REGISTRY)).select("id", "start", "end")


@register("vote_grouped")
def q_vote_grouped(spark, sf):
    """``vote_locations`` by a grouped Arrow function."""
    from spanweave.operators.grouped_vote import vote_grouped
    notes = T.notes(spark, sf).select("pn_num", "pn_history")
    edged = with_blank_edges(locate_spans(explode_spans(T.predictions(spark, sf)), notes))
    return vote_grouped(edged, 2, n_voters=sum(w for _, w in T.REGISTRY))


@register("prompt_cycle")
def q_prompt_cycle(spark, sf, n_prompts: int = 500):
    """Benchmark prompt set: note x feature pairs in id order, cycled to ``n_prompts``.

    Only the first ``min(n, P)`` pairs can be used, so they are taken with a
    per-partition top-n; the cycle is an equi-join of ``range(n)`` on ``i % m``.
    """
    top = T.pairs(spark, sf, with_text=True).orderBy("id").limit(n_prompts)
    w = Window.orderBy("id")  # at most n_prompts rows
    top = top.withColumn("slot", F.row_number().over(w) - 1)
    m = top.agg(F.count(F.lit(1)).alias("m"))
    idx = spark.range(n_prompts).withColumnRenamed("id", "i").withColumn("_k", F.lit(1)) \
               .join(F.broadcast(m.withColumn("_k", F.lit(1))), "_k").withColumn("slot", F.col("i") % F.col("m"))
    p = idx.join(top, "slot")
    prompt = P.benchmark_prompt("pn_history", "feature_text")
    return p.select("i", "id", F.length(prompt).alias("prompt_len"), F.floor(F.length(prompt) / 4).alias("est_tokens"))


@register("coverage_check")
def q_coverage_check(spark, sf):
    """Expected features with the number of training rows that target them; zero = missing."""
    t = _training(spark, sf).groupBy("feature_num").agg(F.count(F.lit(1)).alias("n_rows"))
    exp = T.features(spark, sf).select("feature_num")
    r = exp.join(t, "feature_num", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
    return r.withColumn("missing", F.col("n_rows") == 0)


# Weighted registry: (model, weight); a run of characters needs votes of weight 4 in 6.
WEIGHTED_REGISTRY = [("m1", 2), ("m2", 2), ("m3", 1), ("m4", 1)]


@register("ensemble_vote_weighted")
def q_ensemble_weighted(spark, sf):
    return ensemble_locations(T.pairs(spark, sf), T.notes(spark, sf).select("pn_num", "pn_history"),
                              T.predictions(spark, sf, WEIGHTED_REGISTRY), threshold=4, n_voters=sum(w for _, w in WEIGHTED_REGISTRY))


@register("telemetry_sliding")
def q_telemetry_sliding(spark, sf):
    """Two-hour windows every hour, as a stream."""
    r = SJ.telemetry_windows(spark, T.read_table(spark, sf, "events"), window="2 hours", slide="1 hour")
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "run", "n_events")


@register("minmax_pivot")
def q_minmax_pivot(spark, sf):
    """The comparison matrix with a column a run."""
    s = q_minmax(spark, sf)
    return s.groupBy("metric").pivot("run", [r for r, _ in SIZE_CLASS]).agg(F.first("score"))


@register("training_drops")
def q_training_drops(spark, sf):
    """How many training rows the blank filter drops, of how many."""
    from spanweave.plans.training import dropped_counts
    p = T.pairs(spark, sf, with_text=True).join(T.annotated_ids(spark, sf), "pn_num", "left_semi")
    return dropped_counts(p)


@register("summary_sink")
def q_summary_sink(spark, sf):
    """Run summaries joined with the static sizes of their class, written as JSON documents and read back."""
    dim = spark.createDataFrame([(r, c, 1.7 if c == "small" else 8.0) for r, c in SIZE_CLASS], "run string, size_class string, params_b double")
    path = unique_dir(spark, "run-summaries")
    q_run_summary(spark, sf).join(dim, "run").write.mode("overwrite").json(path)
    back = FS.read_json_docs(spark, path, "run string, final_step long, best_eval_loss double, size_class string, params_b double", multi_line=False)
    return back.select("run", "final_step", "best_eval_loss", "size_class", "params_b")


from spanweave.plans import catalog_logs  # noqa: E402, F401  (registers its queries)
