"""Oracle SQL per query key (DuckDB dialect, same parquet tables as views)."""
from __future__ import annotations

from oracles import duck as D

ORACLES: dict[str, str] = {}

ORACLES["ensemble_vote"] = D.vote_oracle(2)

# ------------------------------------------------------------------ batch 2
from spanweave.functions.prompts import SYSTEM_PROMPT  # noqa: E402
from spanweave.functions.text import PY_BLANK_CLASS  # noqa: E402

W = D.with_domain
S = D.strip


def _parsed(fn):
    return W(D.PREDS) + (f"SELECT id, model, len(s) AS n_spans, array_to_string(s, '{D.SEP}') AS spans "
                         f"FROM (SELECT id, model, {fn('raw')} AS s FROM preds)")


ORACLES["parse_spans"] = _parsed(D.parse_greedy)
ORACLES["parse_spans_first_object"] = _parsed(D.parse_first_object)
ORACLES["parse_spans_outer_braces"] = _parsed(D.parse_outer_braces)
ORACLES["strip_think"] = W(D.PREDS) + f"SELECT id, model, {D.strip_think('raw')} AS text FROM preds"
ORACLES["json_valid_pct"] = W(D.PREDS) + (
    f"SELECT model, round(100 * avg(CAST({D.json_valid('raw')} AS INTEGER)), 1) AS valid_pct, "
    "count(*) AS n FROM preds GROUP BY model")
ORACLES["locate_spans"] = W(D.PREDS, D.PARSED, D.EX, D.LOCATED) + \
    'SELECT id, model, span_idx, start, "end", method FROM located'
ORACLES["merge_spans"] = W(D.PREDS, D.PARSED, D.EX, D.LOCATED,
                           "ch AS (SELECT DISTINCT id, model, unnest(range(start, least(\"end\", note_len))) AS pos "
                           "FROM located)") + D.islands("ch", "id, model")
ORACLES["format_location"] = W(
    D.PREDS, D.PARSED, D.EX, D.LOCATED,
    "sp AS (SELECT id, start, least(\"end\", note_len) AS e, substr(note, start + 1, least(\"end\", note_len) - start) AS txt "
    "FROM located)",
    "tr AS (SELECT id, start + length(regexp_extract(txt, '^[ \\t\\n\\r]*', 0)) AS s, "
    "e - length(regexp_extract(txt, '[ \\t\\n\\r]*$', 0)) AS e FROM sp)",
    "ch AS (SELECT DISTINCT id, unnest(range(s, e)) AS pos FROM tr WHERE s < e)",
    f"isl AS ({D.islands('ch', 'id')})",
) + "SELECT id, string_agg(start || ' ' || \"end\", ';' ORDER BY start) AS location FROM isl GROUP BY id"
ORACLES["parse_location"] = (
    "SELECT id, CAST(split_part(x, ' ', 1) AS INTEGER) AS start, CAST(split_part(x, ' ', 2) AS INTEGER) AS \"end\" "
    f"FROM (SELECT id, unnest(string_split(location, ';')) AS x FROM ({D.vote_oracle(2)}) v "
    "WHERE location IS NOT NULL)")

_PRED_NOTE = ("pn AS (SELECT p.id, p.model, n.pn_history AS note, p.raw, "
              f"{D.parse_outer_braces('p.raw')} AS pred FROM preds p JOIN notes n USING (pn_num))")
ORACLES["char_f1"] = W(
    D.TRUTH, D.PREDS, _PRED_NOTE,
    "m3 AS (SELECT DISTINCT model FROM preds)",
    "pspan AS (SELECT DISTINCT id, model, note, unnest(pred) AS span FROM pn)",
    "tspan AS (SELECT DISTINCT id, pn_history AS note, unnest(annotation) AS span FROM truth)",
    "aspan AS (SELECT id, model, 'p' AS side, note, span FROM pspan UNION ALL SELECT id, model, 't', note, span FROM tspan, m3)",
    f"iv AS ({D.occurrence_intervals('aspan', 'id, model, side')})",
    "both_ AS (SELECT id, model, side, s, e FROM iv UNION ALL SELECT id, model, 'u', s, e FROM iv)",
    "far AS (SELECT *, max(e) OVER (PARTITION BY id, model, side ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM both_)",
    "len AS (SELECT model, side, sum(greatest(0, e - greatest(s, coalesce(m, 0))))::BIGINT AS n FROM far GROUP BY model, side)",
    "agg AS (SELECT m.model, m.n, coalesce(max(l.n) FILTER (side = 'p'), 0) AS np, coalesce(max(l.n) FILTER (side = 't'), 0) AS nt, "
    "coalesce(max(l.n) FILTER (side = 'u'), 0) AS nu FROM (SELECT model, count(*) AS n FROM preds GROUP BY model) m "
    "LEFT JOIN len l USING (model) GROUP BY m.model, m.n)",
) + ("SELECT model, np + nt - nu AS tp, nu - nt AS fp, nu - np AS fn, n, CASE WHEN np + nt = 0 THEN 1.0 "
     "ELSE 2.0 * (np + nt - nu) / (np + nt) END AS char_f1 FROM agg")
ORACLES["output_rates"] = W(D.TRUTH, D.PREDS, _PRED_NOTE) + (
    "SELECT pn.model, count(*) AS val_gen_n, "
    f"avg(CAST(starts_with({S('coalesce(pn.raw, chr(0))')}, '{{') OR len(pred) > 0 "
    "OR contains(coalesce(pn.raw, ''), '\"spans\"') AS INTEGER)) AS val_jsonish_rate, "
    "avg(CAST(len(list_filter(pred, lambda s: instr(pn.note, s) = 0)) = 0 AS INTEGER)) AS val_contained_rate, "
    "avg(CAST((len(t.annotation) = 0) = (len(pred) = 0) AS INTEGER)) AS val_empty_accuracy "
    "FROM pn JOIN truth t USING (id) GROUP BY pn.model")
ORACLES["fill_rate"] = W(D.PREDS) + (
    f"SELECT model, count_if(len({D.parse_first_object('raw')}) > 0) AS non_empty, count(*) AS n, "
    f"100.0 * count_if(len({D.parse_first_object('raw')}) > 0) / greatest(count(*), 1) AS fill_pct "
    "FROM preds GROUP BY model")
ORACLES["unannotated_notes"] = W(D.UNANNOTATED) + "SELECT pn_num, case_num FROM unann"
ORACLES["nonblank_notes"] = W() + (
    f"SELECT case_num, count(*) AS n_notes FROM notes WHERE pn_history IS NOT NULL AND {S('pn_history')} <> '' "
    "GROUP BY case_num")
ORACLES["sample_n"] = W(D.UNANNOTATED) + f"SELECT pn_num, case_num FROM ({D.sample_rows('unann', 50, 42, 'pn_num')})"
_AUG_IDS = ("aug AS (SELECT printf('%05d_%03d', u.pn_num, f.feature_num) AS id, u.pn_num, u.case_num, f.feature_num "
            "FROM unann u JOIN features f USING (case_num))")
ORACLES["sample_fraction"] = W(D.UNANNOTATED, _AUG_IDS) + (
    "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5('42|' || id), id) AS rn, count(*) OVER () AS c "
    "FROM aug) WHERE rn <= greatest(1, floor(c * 0.5))")
ORACLES["case_fanout"] = W(D.UNANNOTATED) + \
    "SELECT u.pn_num, u.case_num, f.feature_num FROM unann u JOIN features f USING (case_num)"
ORACLES["pair_ids"] = W() + "SELECT id, pn_num, feature_num FROM pairs"
ORACLES["pair_totals"] = W(D.UNANNOTATED) + "SELECT count(*) AS total_pairs FROM unann JOIN features f USING (case_num)"
ORACLES["features_per_case"] = W() + (
    "SELECT case_num, array_to_string(list_sort(list(feature_num)), ',') AS feature_nums FROM features GROUP BY case_num")
ORACLES["lookup_note"] = W() + (
    "SELECT id, length(coalesce(pn_history, '')) AS note_len, md5(coalesce(pn_history, '')) AS note_md5 FROM pairs")
ORACLES["lookup_feature"] = W() + "SELECT id, coalesce(feature_text, '') AS feature_text FROM pairs"
ORACLES["resume_pairs"] = W(D.UNANNOTATED, _AUG_IDS, D.PREDS) + (
    f"SELECT id FROM aug WHERE id NOT IN (SELECT id FROM preds WHERE model = 'm1' AND {D.json_valid('raw')})")
ORACLES["head_n"] = W() + "SELECT id, pn_num FROM pairs ORDER BY id LIMIT 20"


def _json_target(arr: str) -> str:
    items = f"list_filter(list_transform({arr}, lambda a: {S('a')}), lambda a: a <> '')"
    return f"('{{\"spans\": [' || coalesce(array_to_string(list_transform({items}, lambda a: to_json(a)), ', '), '') || ']}}')"


_TRAINING = [
    D.TRUTH, D.UNANNOTATED, _AUG_IDS, D.PREDS,
    "tr0 AS (SELECT id, pn_num, case_num, feature_num, annotation FROM truth WHERE pn_num IN (SELECT doc_id FROM labels))",
    f"aug1 AS (SELECT a.id, a.pn_num, a.case_num, a.feature_num, {D.parse_first_object('p.raw')} AS annotation "
    "FROM aug a JOIN preds p ON p.id = a.id AND p.model = 'm1')",
    "aug2 AS (SELECT id, pn_num, case_num, feature_num, annotation FROM (SELECT *, row_number() OVER "
    "(ORDER BY md5('42|' || id), id) AS rn, count(*) OVER () AS c FROM aug1) WHERE rn <= greatest(1, floor(c * 0.5)))",
    "u AS (SELECT * FROM tr0 UNION ALL SELECT * FROM aug2)",
    "trows AS (SELECT u.*, coalesce(n.pn_history, '') AS pn_history, coalesce(f.feature_text, '') AS feature_text "
    "FROM u LEFT JOIN notes n USING (pn_num) LEFT JOIN features f ON f.case_num = u.case_num AND "
    f"f.feature_num = u.feature_num WHERE {S('coalesce(n.pn_history, chr(32))')} <> '' AND "
    f"{S('coalesce(f.feature_text, chr(32))')} <> '')",
    f"trows2 AS (SELECT *, {_json_target('annotation')} AS assistant_target FROM trows)",
]
ORACLES["training_rows"] = W(*_TRAINING) + (
    "SELECT id, pn_num, case_num, feature_num, length(pn_history) AS note_len, feature_text, "
    "len(annotation) AS n_spans, assistant_target FROM trows2")
ORACLES["span_histogram"] = W(*_TRAINING) + \
    "SELECT len(annotation) AS n_spans, count(*) AS n_rows FROM trows2 GROUP BY 1"
ORACLES["assistant_target"] = W(D.TRUTH) + f"SELECT id, {_json_target('annotation')} AS assistant_target FROM truth"
ORACLES["parse_pylist"] = W(D.TRUTH) + (
    f"SELECT id, len(annotation) AS n_spans, array_to_string(annotation, '{D.SEP}') AS spans, "
    "array_to_string(list_transform(annotation, lambda s: (instr(pn_history, s) - 1) || ' ' || "
    f"(instr(pn_history, s) - 1 + length(s))), '{D.SEP}') AS locations FROM truth "
    "WHERE pn_num IN (SELECT doc_id FROM labels)")

_FOLDS = _TRAINING + [
    "g AS (SELECT case_num, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, case_num DESC) AS rn "
    "FROM trows2 GROUP BY case_num)",
    "rec AS (SELECT 0 AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::INTEGER AS case_num, NULL::INTEGER AS fold "
    "UNION ALL SELECT r.i + 1, list_transform(range(5), lambda k: r.loads[k + 1] + CASE WHEN "
    "k = list_position(r.loads, list_min(r.loads)) - 1 THEN g.n ELSE 0 END), g.case_num, "
    "CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INTEGER) FROM rec r JOIN g ON g.rn = r.i + 1)",
    "folds AS (SELECT case_num, fold FROM rec WHERE case_num IS NOT NULL)",
]
ORACLES["group_kfold"] = W(*_FOLDS).replace("WITH ", "WITH RECURSIVE ", 1) + (
    "SELECT t.case_num, f.fold, count(*) AS n_rows FROM trows2 t JOIN folds f USING (case_num) GROUP BY 1, 2")
ORACLES["fold_summary"] = W(*_FOLDS).replace("WITH ", "WITH RECURSIVE ", 1) + (
    "SELECT side, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT case_num)), ',') AS cases, "
    "0::BIGINT AS leaky FROM (SELECT t.case_num, CASE WHEN f.fold = 4 THEN 'val' ELSE 'train' END AS side "
    "FROM trows2 t JOIN folds f USING (case_num)) GROUP BY side")
_SYS = SYSTEM_PROMPT.replace("'", "''")
_CHAT = ("('<|im_start|>system' || chr(10) || '" + _SYS + "' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) "
         "|| 'Note: \"' || " + S("pn_history") + " || '\"' || chr(10) || 'Feature: ' || feature_text || '<|im_end|>' "
         "|| chr(10) || '<|im_start|>assistant' || chr(10) || assistant_target || '<|im_end|>' || chr(10))")
ORACLES["length_percentiles"] = W(*_TRAINING, (
    f"tok AS (SELECT len(list_filter(string_split_regex({_CHAT}, '{PY_BLANK_CLASS}+'), lambda t: t <> '')) AS n "
    "FROM trows2)")) + (
    "SELECT CAST(trunc(quantile_cont(n, 0.5)) AS INTEGER) AS p50, CAST(trunc(quantile_cont(n, 0.9)) AS INTEGER) AS p90, "
    "CAST(trunc(quantile_cont(n, 0.99)) AS INTEGER) AS p99, max(n) AS max_len, count_if(n > 512) AS n_over, "
    "count(*) AS n FROM tok")
ORACLES["model_filter"] = W(D.PREDS) + "SELECT model, count(*) AS n FROM preds WHERE model IN ('m1', 'm3') GROUP BY model"

# ----------------------------------------------------------------- telemetry
_TAGCASE = ("CASE event_type WHEN 'view' THEN 'loss' WHEN 'click' THEN 'eval_loss' WHEN 'purchase' THEN 'grad_norm' "
            "WHEN 'signup' THEN 'learning_rate' WHEN 'error' THEN 'eval_runtime' END")
LOG = ("log0 AS (SELECT 'run' || (user_id % 8) AS run, event_id, ts, epoch_us(ts) / 1e6 AS wall_time, "
       f"{_TAGCASE} AS tag, value, props FROM events), "
       "log AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS step, "
       "floor((wall_time - 1704067200) / 3600)::INTEGER AS hstep, "
       "CASE WHEN tag = 'loss' THEN value END AS loss, CASE WHEN tag = 'eval_loss' THEN value END AS eval_loss, "
       "CASE WHEN tag = 'grad_norm' THEN value END AS grad_norm, "
       "CASE WHEN tag = 'learning_rate' THEN value END AS learning_rate, "
       "CASE WHEN tag = 'eval_runtime' THEN value END AS eval_runtime FROM log0)")
L = f"WITH {LOG}\n"
ORACLES["telemetry_clean"] = L + (
    "SELECT run, step, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM log "
    "WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL")
ORACLES["event_pivot"] = L + (
    "SELECT run, hstep, " + ", ".join(f"round(avg(CASE WHEN tag = '{t}' THEN value END), 6) AS {t}"
                                      for t in ["loss", "eval_loss", "grad_norm", "learning_rate", "eval_runtime"])
    + " FROM log GROUP BY run, hstep")
ORACLES["grad_stats"] = L + (
    "SELECT run, round(avg(grad_norm), 6) AS mean, round(stddev_samp(grad_norm), 6) AS std, "
    "round(min(grad_norm), 6) AS min, round(max(grad_norm), 6) AS max, count(grad_norm) AS n "
    "FROM log WHERE grad_norm IS NOT NULL GROUP BY run")
ORACLES["best_checkpoint"] = L + (
    "SELECT run, min(eval_loss) AS best_eval_loss, min(step) FILTER (WHERE eval_loss = m) AS best_step FROM "
    "(SELECT *, min(eval_loss) OVER (PARTITION BY run) AS m FROM log WHERE eval_loss IS NOT NULL) GROUP BY run")
ORACLES["last_row"] = L + "SELECT run, arg_max(loss, step) AS last_loss FROM (SELECT run, step, loss FROM log) " \
                          "GROUP BY run"
ORACLES["last_row"] = L + ("SELECT l.run, l.loss AS last_loss FROM log l JOIN (SELECT run, max(step) AS s FROM log "
                           "GROUP BY run) m ON l.run = m.run AND l.step = m.s")
ORACLES["last_nonnull"] = L + ("SELECT l.run, l.loss AS last_loss FROM log l JOIN (SELECT run, max(step) AS s FROM log "
                               "WHERE loss IS NOT NULL GROUP BY run) m ON l.run = m.run AND l.step = m.s")
ORACLES["relative_time"] = L + (
    "SELECT run, step, round((wall_time - min(wall_time) OVER (PARTITION BY run)) / 60.0, 6) AS minutes "
    "FROM log WHERE loss IS NOT NULL")
ORACLES["tail_n"] = L + ("SELECT run, step FROM (SELECT run, step, count(*) OVER (PARTITION BY run) AS c FROM log) "
                         "WHERE step > c - 500")
ORACLES["train_eval_curve"] = L + (
    "SELECT coalesce(t.run, e.run) AS run, coalesce(t.hstep, e.hstep) AS hstep, round(t.loss, 6) AS loss, "
    "round(e.eval_loss, 6) AS eval_loss FROM "
    "(SELECT run, hstep, avg(loss) AS loss FROM log WHERE loss IS NOT NULL GROUP BY 1, 2) t FULL OUTER JOIN "
    "(SELECT run, hstep, avg(eval_loss) AS eval_loss FROM log WHERE eval_loss IS NOT NULL GROUP BY 1, 2) e "
    "ON t.run = e.run AND t.hstep = e.hstep")
ORACLES["schedule_check"] = L + (
    "SELECT run, min(learning_rate) AS lr_min, max(learning_rate) AS lr_max, arg_min(learning_rate, step) AS lr_first, "
    "arg_max(learning_rate, step) AS lr_last FROM log WHERE learning_rate IS NOT NULL GROUP BY run")
ORACLES["event_counts"] = L + "SELECT run, count(*) AS n_events FROM log GROUP BY ROLLUP (run)"
ORACLES["early_stop_point"] = L + (
    "SELECT run, min(step) AS stop_step FROM (SELECT run, step, row_number() OVER (PARTITION BY run, g ORDER BY step) - 1 "
    "AS streak FROM (SELECT run, step, sum(imp) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW) AS g FROM (SELECT run, step, CASE WHEN pb IS NULL OR eval_loss < pb THEN 1 ELSE 0 END AS imp FROM "
    "(SELECT run, step, eval_loss, min(eval_loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING) AS pb FROM log WHERE eval_loss IS NOT NULL)))) WHERE streak = 3 GROUP BY run")
RUNM = ("runm AS (SELECT run, max(step) AS final_step, count(eval_loss) AS total_eval_steps, "
        "min(eval_loss) AS best_eval_loss, arg_max(loss, step) FILTER (WHERE loss IS NOT NULL) AS final_train_loss, "
        "arg_max(eval_loss, step) FILTER (WHERE eval_loss IS NOT NULL) AS final_eval_loss, avg(grad_norm) AS grad_mean, "
        "count(*) AS n_events FROM log GROUP BY run)")
LR = f"WITH {LOG}, {RUNM}\n"
ORACLES["run_summary"] = LR + (
    "SELECT run, final_step, total_eval_steps, best_eval_loss, final_train_loss, final_eval_loss, "
    "round(final_eval_loss - final_train_loss, 6) AS train_eval_gap FROM runm")
ORACLES["minmax_matrix"] = LR + (
    "SELECT run, metric, round(CASE WHEN value IS NULL OR hi = lo OR hi IS NULL THEN 0.5 "
    "WHEN metric IN ('final_train_loss', 'best_eval_loss', 'grad_mean') THEN 1.0 - (value - lo) / (hi - lo) "
    "ELSE (value - lo) / (hi - lo) END, 6) AS score FROM (SELECT *, min(value) OVER (PARTITION BY metric) AS lo, "
    "max(value) OVER (PARTITION BY metric) AS hi FROM (UNPIVOT (SELECT run, final_train_loss, best_eval_loss, grad_mean, "
    "CAST(n_events AS DOUBLE) AS n_events FROM runm) ON final_train_loss, best_eval_loss, grad_mean, n_events "
    "INTO NAME metric VALUE value))")
ORACLES["size_class_stats"] = LR + (
    "SELECT size_class, round(avg(best_eval_loss), 6) AS eval_mean, round(stddev_samp(best_eval_loss), 6) AS eval_std, "
    "round(avg(final_train_loss), 6) AS train_mean, round(stddev_samp(final_train_loss), 6) AS train_std, "
    "round(avg(grad_mean), 6) AS grad_mean, round(stddev_samp(grad_mean), 6) AS grad_std, "
    "round(rest, 6) AS eval_rest_mean, "
    "round((avg(best_eval_loss) - rest) / rest, 6) AS rel_gap FROM (SELECT c.*, "
    "(sum(best_eval_loss) OVER () - sum(best_eval_loss) OVER (PARTITION BY size_class)) / "
    "(count(*) OVER () - count(*) OVER (PARTITION BY size_class)) AS rest FROM "
    "(SELECT runm.*, CASE WHEN CAST(substr(run, 4) AS INTEGER) < 4 THEN 'small' ELSE 'large' END AS size_class "
    "FROM runm) c) GROUP BY size_class, rest")
BENCH = (
    "b0 AS (SELECT event_type AS label, count(*) AS n, CAST(round(sum(value)) AS BIGINT) AS output_toks, "
    "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 10000.0 AS wall_time_s, avg(length(props)) AS avg_chars, "
    "min(props) AS err FROM events GROUP BY event_type), "
    "b1 AS (SELECT *, CASE WHEN label <> 'error' THEN 'OK' ELSE 'ERROR' END AS status, "
    "CASE WHEN label = 'error' THEN 'failed: ' || err END AS error, "
    "CASE WHEN label <> 'error' THEN round(output_toks / wall_time_s, 1) END AS output_toks_ps, "
    "CASE WHEN label <> 'error' THEN round(floor(avg_chars / 4) * n / wall_time_s, 1) END AS input_toks_ps FROM b0), "
    "bench AS (SELECT *, round(1716000 / output_toks_ps / 3600, 2) AS eta_14k_hours, "
    "round(1716000 / (output_toks_ps * 0.8) / 3600, 2) AS eta_worst_hours FROM b1), "
    "quality AS (SELECT event_type AS label, round(100 * avg(CAST(value < 300 AS INTEGER)), 1) AS valid_pct "
    "FROM events GROUP BY event_type)")
B = f"WITH {BENCH}\n"
ORACLES["throughput"] = B + ("SELECT label, n, output_toks, output_toks_ps, input_toks_ps, eta_14k_hours, "
                             "eta_worst_hours FROM bench")
ORACLES["bench_status"] = B + "SELECT label, status, substr(coalesce(error, ''), 1, 80) AS error FROM bench"
ORACLES["bench_rank"] = B + (
    "SELECT label, status, output_toks_ps, CASE WHEN eta_worst_hours < 9 THEN 'yes' WHEN eta_worst_hours IS NOT NULL "
    "THEN 'no' ELSE 'ERR' END AS fits_budget, row_number() OVER (ORDER BY output_toks_ps DESC NULLS LAST, label) AS rank "
    "FROM bench")
ORACLES["bench_quality_join"] = B + \
    "SELECT b.label, b.output_toks_ps, q.valid_pct FROM bench b LEFT JOIN quality q USING (label)"
ORACLES["bench_pick"] = B + (
    "SELECT b.label, b.output_toks_ps, q.valid_pct FROM bench b LEFT JOIN quality q USING (label) "
    "WHERE coalesce(CASE WHEN eta_worst_hours <> 0 THEN eta_worst_hours END, 99.0) < 9 AND valid_pct >= 90 "
    "ORDER BY output_toks_ps DESC, label LIMIT 3")
ORACLES["timing_summary"] = (
    "SELECT model, rows, elapsed_s, printf('%02d:%02d:%02d', elapsed_s // 3600, (elapsed_s % 3600) // 60, elapsed_s % 60) "
    "AS elapsed, round(rows / nullif(elapsed_s, 0), 6) AS rows_per_s, "
    "round(sum(rows) OVER () * nullif(elapsed_s, 0) / rows, 3) AS est_full_s FROM (SELECT event_type AS model, count(*) AS rows, "
    "CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS elapsed_s FROM events GROUP BY event_type)")
ORACLES["ablation_delta"] = LR + (
    "SELECT run, best_eval_loss AS score, round(best_eval_loss - first_value(best_eval_loss) OVER (ORDER BY run), 6) "
    "AS delta, best_eval_loss = min(best_eval_loss) OVER () AS is_best FROM runm")
ORACLES["model_coverage"] = W(D.PREDS) + (
    f"SELECT model, count_if(len({D.parse_greedy('raw')}) > 0) AS non_empty, count(*) AS n FROM preds GROUP BY model")
ORACLES["model_coverage"] = (ORACLES["model_coverage"] + f" UNION ALL SELECT 'submission', count(location), count(*) FROM ({D.vote_oracle(2)})")

# ------------------------------------------------------ retrieval and prompts
_TRAIN_T = "tt AS (SELECT * FROM truth WHERE pn_num IN (SELECT doc_id FROM labels))"
ORACLES["retrieval_corpus"] = W(D.TRUTH, _TRAIN_T) + (
    "SELECT id, 'Feature: ' || feature_text || '  Annotation: ' || ann AS embed_text, "
    "md5(substr(pn_history, 1, 500)) AS excerpt_md5, "
    "'[' || array_to_string(list_transform(annotation, lambda s: '''' || (instr(pn_history, s) - 1) || ' ' || "
    "(instr(pn_history, s) - 1 + length(s)) || ''''), ', ') || ']' AS location FROM ("
    f"SELECT *, array_to_string(list_filter(annotation, lambda a: {S('a')} <> ''), ' | ') AS ann FROM tt) "
    "WHERE coalesce(feature_text, '') <> '' AND ann <> ''")
_NORM = "list_transform({e}, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform({e}, lambda y: CAST(y AS DOUBLE) * y))))"
ORACLES["knn_topk"] = (
    f"WITH v AS (SELECT vec_id, {_NORM.format(e='embedding')} AS v FROM embeddings), "
    "s AS (SELECT q.vec_id AS qid, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c "
    "ON q.vec_id % 20 = 0 AND c.vec_id % 20 <> 0) "
    "SELECT qid AS query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3")
ORACLES["knn_index_recall"] = (
    "SELECT count(*) AS n_queries, sum(least(3, (SELECT count(*) FROM embeddings WHERE vec_id % 20 <> 0)))::BIGINT AS n_neighbours, "
    "true AS recall_ok FROM embeddings WHERE vec_id % 20 = 0")
ORACLES["chat_messages"] = W(*_TRAINING) + f"SELECT id, length({_CHAT}) AS text_len, md5({_CHAT}) AS text_md5 FROM trows2"
_TURN = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"
ORACLES["chatml_render"] = (
    f"SELECT conv_id, count(*) AS n_turns, length(coalesce(string_agg({_TURN}, '' ORDER BY turn), '') || "
    f"'<|im_start|>assistant' || chr(10)) AS text_len, md5(coalesce(string_agg({_TURN}, '' ORDER BY turn), '') || "
    "'<|im_start|>assistant' || chr(10)) AS text_md5 FROM conversations GROUP BY conv_id")
_UC = "('Note: \"' || " + S("coalesce(pn_history, '')") + " || '\"' || chr(10) || 'Feature: ' || coalesce(feature_text, ''))"
_SYS_TURN = "'<|im_start|>system' || chr(10) || '" + _SYS + "' || '<|im_end|>' || chr(10)"
ORACLES["fewshot_chat"] = W(*_TRAINING, (
    "ex AS (SELECT string_agg('<|im_start|>user' || chr(10) || " + _UC + " || '<|im_end|>' || chr(10) || "
    "'<|im_start|>assistant' || chr(10) || assistant_target || '<|im_end|>' || chr(10), '' ORDER BY id) AS turns "
    "FROM (SELECT * FROM trows2 ORDER BY id LIMIT 3))")) + (
    "SELECT p.id, 8 AS n_messages, md5(" + _SYS_TURN + " || ex.turns || '<|im_start|>user' || chr(10) || "
    + _UC.replace("pn_history", "p.pn_history").replace("feature_text", "p.feature_text") +
    " || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS text_md5 FROM pairs p, ex")
def _toks(x: str) -> str:
    return "len(list_filter(string_split_regex(" + x + ", '" + PY_BLANK_CLASS + "+'), lambda t: t <> ''))"

ORACLES["label_mask"] = (
    "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rdesc FROM conversations), "
    f"r AS (SELECT conv_id, coalesce(string_agg({_TURN}, '' ORDER BY turn), '') AS full_t, "
    f"coalesce(string_agg({_TURN}, '' ORDER BY turn) FILTER (WHERE rdesc > 1), '') || '<|im_start|>assistant' || chr(10) "
    "AS prompt_t FROM c GROUP BY conv_id), "
    f"n AS (SELECT conv_id, {_toks('full_t')} AS f, {_toks('prompt_t')} AS p FROM r) "
    "SELECT conv_id, f AS n_tokens, 0 AS n_truncated, least(p, f) AS n_masked, least(p, f) = f AS all_masked FROM n")
_WORDS = lambda x: "list_filter(string_split_regex(" + x + ", '" + PY_BLANK_CLASS + "+'), lambda t: t <> '')"
_PROMPT = _SYS_TURN + " || '<|im_start|>user' || chr(10) || " + _UC + " || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
ORACLES["pad_batches"] = W(*_TRAINING, (
    f"tok AS (SELECT id, list_transform({_WORDS(_CHAT)}, lambda t: 1 + ('0x' || substr(md5(t), 1, 7))::INTEGER) AS ids, {_toks(_PROMPT)} AS p FROM trows2)"), (
    "num AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY n_tok, md5(id), id) - 1) / 8) AS BIGINT) AS batch "
    "FROM (SELECT *, len(ids) AS n_tok, CAST(floor(len(ids) / 256) AS BIGINT) AS bucket FROM tok))"), (
    "pad AS (SELECT *, CAST(ceil(max(n_tok) OVER (PARTITION BY bucket, batch) / 8) * 8 AS BIGINT) AS padded_len FROM num)"), (
    "dig AS (SELECT *, md5(array_to_string(list_concat(ids, list_transform(range(padded_len - n_tok), lambda i: 0)), ',')) AS di, "
    "md5(array_to_string(list_transform(range(padded_len), lambda i: CASE WHEN i < least(p, n_tok) OR i >= n_tok THEN -100 ELSE ids[i + 1] END), ',')) AS dl FROM pad)")) + (
    "SELECT bucket, batch, count(*) AS n_rows, max(n_tok) AS max_len, sum(n_tok)::BIGINT AS tokens, max(padded_len) AS padded_len, "
    "md5(string_agg(di, '' ORDER BY n_tok, md5(id), id)) AS ids_md5, md5(string_agg(dl, '' ORDER BY n_tok, md5(id), id)) AS labels_md5 "
    "FROM dig GROUP BY bucket, batch")
_CLS = ("(CASE WHEN len(cs) = 0 THEN '[^\\n]' ELSE '[' || array_to_string(list_transform(cs, lambda ch: CASE WHEN "
        "ch IN (']', '^', '-', '\\', '[', '&') THEN '\\' || ch ELSE ch END), '') || ']' END)")
_PAT = ("('\\{\"spans\": \\[(?:\"' || cls || '*\"(?:, \"' || cls || '*\"){0,9})?\\]\\}')")
_CS = ("cls_t AS (SELECT pn_num, pn_history, " + _CLS + " AS cls FROM (SELECT pn_num, pn_history, list_sort(list_filter("
       "list_distinct(string_split(coalesce(pn_history, ''), '')), lambda ch: ch <> '' AND ch <> '\"' AND ch <> '\\' "
       "AND unicode(ch) >= 32 AND unicode(ch) <> 127)) AS cs FROM notes))")
ORACLES["constraint_regex"] = W(_CS) + f"SELECT pn_num, length({_PAT}) AS pattern_len, md5({_PAT}) AS pattern_md5 FROM cls_t"
ORACLES["constraint_check"] = W(_CS, D.PREDS) + (
    f"SELECT p.model, count_if(regexp_full_match(coalesce(p.raw, ''), {_PAT})) AS n_obey, count(*) AS n "
    "FROM preds p JOIN cls_t c USING (pn_num) GROUP BY p.model")
ORACLES["feature_variants"] = W() + (
    "SELECT feature_num, generate_subscripts(v, 1) - 1 AS variant_idx, unnest(v) AS variant FROM (SELECT feature_num, "
    f"list_filter(list_transform(string_split_regex(feature_text, '(?i)-or-'), "
    f"lambda p: {S(chr(116) + 'ranslate(p, ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')}), "
    "lambda p: p <> '') AS v FROM features)")

# ----------------------------------------------------------------- streaming
ORACLES["telemetry_stream"] = (
    "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start, 'run' || (user_id % 8) AS run, "
    "count(*) AS n_events, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS loss, "
    "round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS eval_loss FROM events GROUP BY 1, 2")
_VARS = (f"list_filter(list_transform(string_split_regex(feature_text, '(?i)-or-'), "
         f"lambda p: {S(chr(116) + 'ranslate(p, ' + chr(39) + '-' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')}), "
         "lambda p: p <> '')")
_HITS = (f"coalesce(list_sum(list_transform({_VARS}, lambda v: CAST((length(lower(coalesce(pn_history, ''))) - "
         "length(replace(lower(coalesce(pn_history, '')), lower(v), ''))) / length(v) AS INTEGER))), 0)::INTEGER")
ORACLES["stream_label"] = W() + f"SELECT id, {_HITS} AS n_spans FROM pairs"
ORACLES["labeler_fallback"] = W() + f"SELECT id, {_HITS} AS n_spans, true AS ok FROM pairs"
ORACLES["stream_vote"] = D.vote_oracle(2)

# ------------------------------------------------------------ sources, sinks
ORACLES["scan_csv_typed"] = W() + (
    "SELECT pn_num, case_num, length(coalesce(pn_history, '')) AS note_len, md5(coalesce(pn_history, '')) AS note_md5 "
    "FROM notes")
ORACLES["scan_optional"] = ("SELECT count(*) AS n_train, 0::BIGINT AS n_augmented FROM (" + W() +
                            "SELECT 1 FROM pairs WHERE pn_num IN (SELECT doc_id FROM labels))")
ORACLES["input_contract"] = (
    "SELECT 'documents' AS \"table\", true AS present, true AS columns_ok, true AS types_ok, count(*) AS n_rows, "
    "count_if(doc_id IS NULL OR text IS NULL) AS n_null FROM documents "
    "UNION ALL SELECT 'benchmark', true, true, true, count(*), count_if(item_id IS NULL) FROM benchmark "
    "UNION ALL SELECT 'labels', true, true, false, count(*), count_if(doc_id IS NULL) FROM labels "
    "UNION ALL SELECT 'pages', true, false, false, count(*), 0 FROM pages "
    "UNION ALL SELECT 'no_such_table', false, false, false, 0, 0")
ORACLES["materialize_once"] = W(D.TRUTH, _TRAIN_T) + (
    "SELECT id, 'Feature: ' || feature_text || '  Annotation: ' || ann AS embed_text FROM ("
    f"SELECT *, array_to_string(list_filter(annotation, lambda a: {S('a')} <> ''), ' | ') AS ann FROM tt) "
    "WHERE coalesce(feature_text, '') <> '' AND ann <> ''")
ORACLES["sink_submission_roundtrip"] = D.vote_oracle(2)
ORACLES["json_runs"] = L + "SELECT run, step, loss, eval_loss FROM log WHERE loss IS NOT NULL OR eval_loss IS NOT NULL"
ORACLES["nested_doc_explode"] = (
    "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cell_idx, "
    "len(string_split(text, chr(10))) AS n_lines FROM conversations) "
    "SELECT conv_id, cell_idx, 'markdown' AS cell_type, n_lines, NULL::INTEGER AS output_idx, NULL AS output_type, NULL::INTEGER AS output_len, "
    "NULL AS output_md5, NULL::INTEGER AS html_len, NULL::INTEGER AS image_bytes FROM c WHERE role = 'user' UNION ALL "
    "SELECT conv_id, cell_idx, 'code', n_lines, 0, 'stream', length(text), md5(text), NULL, NULL FROM c WHERE role <> 'user' UNION ALL "
    "SELECT conv_id, cell_idx, 'code', n_lines, 1, 'display_data', NULL, NULL, length(text) + 7, strlen(text) FROM c WHERE role <> 'user'")

# ------------------------------------------------------------ remaining keys
ORACLES["vote_locations"] = ORACLES["parse_location"]
ORACLES["vote_grouped"] = ORACLES["parse_location"]
ORACLES["prompt_cycle"] = W() + (
    "SELECT r.i, t.id, length(pr) AS prompt_len, floor(length(pr) / 4)::BIGINT AS est_tokens FROM "
    "(SELECT *, row_number() OVER (ORDER BY id) - 1 AS slot, '<|im_start|>system' || chr(10) || '" + _SYS +
    "' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || " + _UC +
    " || chr(10) || chr(10) || '/no_think<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS pr "
    "FROM (SELECT * FROM pairs ORDER BY id LIMIT 500)) t "
    "JOIN (SELECT range AS i FROM range(500)) r ON r.i % (SELECT least(count(*), 500) FROM pairs) = t.slot")
ORACLES["coverage_check"] = W(*_TRAINING) + (
    "SELECT f.feature_num, coalesce(c.n, 0)::BIGINT AS n_rows, coalesce(c.n, 0) = 0 AS missing FROM features f "
    "LEFT JOIN (SELECT feature_num, count(*) AS n FROM trows2 GROUP BY feature_num) c USING (feature_num)")
ORACLES["ensemble_vote_weighted"] = D.vote_oracle(4).replace(D.REGISTRY_VALUES, "(VALUES ('m1', 2), ('m2', 2), ('m3', 1), ('m4', 1)) r(model, weight)")
ORACLES["telemetry_sliding"] = (
    "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, run, count(*) AS n_events FROM (SELECT 'run' || (user_id % 8) AS run, "
    "unnest([time_bucket(INTERVAL 1 hour, ts), time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour]) AS w FROM events) GROUP BY 1, 2")
ORACLES["minmax_pivot"] = ("WITH mm AS (" + ORACLES["minmax_matrix"] + ") SELECT metric, " + ", ".join(
    f"max(score) FILTER (run = 'run{i}') AS run{i}" for i in range(8)) + " FROM mm GROUP BY metric")
ORACLES["training_drops"] = W() + (
    f"SELECT count_if({S("coalesce(pn_history, '')")} = '' OR {S("coalesce(feature_text, '')")} = '') AS dropped, count(*) AS n "
    "FROM pairs WHERE pn_num IN (SELECT doc_id FROM labels)")
ORACLES["summary_sink"] = ("WITH rs AS (" + ORACLES["run_summary"] + ") SELECT run, final_step, best_eval_loss, "
    "CASE WHEN CAST(substr(run, 4) AS INTEGER) < 4 THEN 'small' ELSE 'large' END AS size_class, "
    "CASE WHEN CAST(substr(run, 4) AS INTEGER) < 4 THEN 1.7::DOUBLE ELSE 8.0::DOUBLE END AS params_b FROM rs")


def _repr(x: str) -> str:
    """Python's ``repr`` of a text without control characters other than tab and line ends."""
    bs = "chr(92)"
    e = f"replace(replace(replace(replace({x}, {bs}, {bs} || {bs}), chr(10), {bs} || 'n'), chr(13), {bs} || 'r'), chr(9), {bs} || 't')"
    return (f"(CASE WHEN contains({x}, chr(39)) AND NOT contains({x}, chr(34)) THEN chr(34) || {e} || chr(34) "
            f"ELSE chr(39) || replace({e}, chr(39), {bs} || chr(39)) || chr(39) END)")


ORACLES["pseudo_label"] = W(
    D.UNANNOTATED,
    "pr AS (SELECT printf('%05d_%03d', u.pn_num, f.feature_num) AS id, u.pn_num, f.feature_num, u.case_num, u.pn_history AS note, f.feature_text "
    "FROM unann u JOIN features f USING (case_num) WHERE f.feature_text <> '')",
    f"vs AS (SELECT id, note, unnest(vars) AS v, generate_subscripts(vars, 1) AS vi FROM (SELECT *, {_VARS} AS vars FROM pr))",
    "st AS (SELECT *, list_transform(range(1, len(string_split(lower(note), lower(v)))), lambda j: CAST(list_sum(list_transform("
    "string_split(lower(note), lower(v))[1:j], lambda x: length(x))) + (j - 1) * length(v) AS BIGINT)) AS starts FROM vs "
    "WHERE contains(lower(note), lower(v)))",
    "hit AS (SELECT id, vi, generate_subscripts(starts, 1) AS j, note, length(v) AS n, unnest(starts) AS s FROM st)",
    "sp AS (SELECT id, vi, j, note, substr(note, s + 1, n) AS span FROM hit)",
    f"lo AS (SELECT id, vi, j, span, instr(note, {S('span')}) - 1 AS s, length({S('span')}) AS n FROM sp)",
    f"ag AS (SELECT id, string_agg({_repr('span')}, ', ' ORDER BY vi, j) AS a, "
    "string_agg(chr(39) || s || ' ' || (s + n) || chr(39), ', ' ORDER BY vi, j) AS l FROM lo GROUP BY id)",
) + ("SELECT pr.id, pn_num, feature_num, case_num, '[' || coalesce(a, '') || ']' AS annotation, '[' || coalesce(l, '') || ']' AS location, "
     "NULL::VARCHAR AS error FROM pr LEFT JOIN ag USING (id)")

# ------------------------------------------- event documents, training-log streams
_TAG = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (
    ("view", "loss"), ("click", "eval_loss"), ("purchase", "grad_norm"), ("signup", "learning_rate"), ("error", "eval_runtime"))) + " END"
_V = "coalesce(CAST(value AS VARCHAR), 'null')"
_T = "'{\"tag\":\"train/' || tag || '\"'"
_TENSOR = f"',\"tensor\":{{\"dtype\":\"DT_FLOAT\",\"floatVal\":[' || {_V} || ']}}}}'"
EVENT_JSON = f"""WITH e AS (SELECT event_id, 'run' || (user_id % 8) AS run, value, props, floor(epoch(ts))::BIGINT AS wall, {_TAG} AS tag FROM events),
j AS (SELECT run, CAST('{{"run":"' || run || '","wall_time":' || wall || ',"step":' || event_id || CASE WHEN event_id % 7 = 0 THEN '' ELSE ',"summary":[' ||
  CASE WHEN event_id % 17 = 0 THEN {_T} || ',"value":null' || {_TENSOR}
       WHEN event_id % 5 = 0 THEN {_T} || {_TENSOR}
       WHEN event_id % 13 = 0 THEN {_T} || ',"value":0}},' || {_T} || ',"value":' || {_V} || '}}'
       WHEN event_id % 19 = 0 THEN {_T} || '}}' ELSE {_T} || ',"value":' || {_V} || '}}' END ||
  CASE WHEN event_id % 11 = 0 THEN ',{{"tag":"props/k","value":' || coalesce(json_extract_string(props, '$.k'), 'null') || '}}' ELSE '' END || ']' END || '}}' AS JSON) AS doc FROM e),
s AS (SELECT run, CAST(doc->>'$.step' AS BIGINT) AS step, CAST(doc->>'$.wall_time' AS DOUBLE) AS wall_time, json_extract(doc, '$.summary[*]') AS items
      FROM j WHERE json_exists(doc, '$.summary')),
u AS (SELECT run, step, i, x->>'$.tag' AS tag, CASE WHEN json_exists(x, '$.value') THEN 'value' WHEN json_exists(x, '$.tensor') THEN 'tensor' END AS source,
             try_cast(x->>'$.value' AS DOUBLE) AS v, try_cast(x->>'$.tensor.floatVal[0]' AS DOUBLE) AS t
      FROM (SELECT run, step, unnest(items) AS x, generate_subscripts(items, 1) AS i FROM s)),
w AS (SELECT * FROM u WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY step, tag ORDER BY i DESC) = 1),
r AS (SELECT s.run, s.step, s.wall_time, w.tag, w.source, CASE WHEN w.source = 'value' THEN w.v END AS number,
             CASE WHEN w.source = 'tensor' THEN w.t END AS tensor_number FROM s LEFT JOIN w ON w.step = s.step)
"""
ORACLES["event_json"] = EVENT_JSON + "SELECT * FROM r"
ORACLES["event_json_pivot"] = EVENT_JSON + (
    "SELECT run, CAST(floor((wall_time - 1704067200) / 3600) AS INTEGER) AS hstep, " + ", ".join(
        f"round(avg(CASE WHEN tag = 'train/{t}' THEN number END), 6) AS {t}" for t in ["loss", "eval_loss", "grad_norm", "learning_rate", "eval_runtime"])
    + " FROM r WHERE source = 'value' GROUP BY 1, 2")
ORACLES["telemetry_sessions"] = (
    f"WITH e AS (SELECT 'run' || (user_id % 8) AS run, ts, {_TAG} AS tag, value FROM events), "
    "b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run ORDER BY ts) <= INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM e), "
    "g AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b) "
    "SELECT run, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts) + INTERVAL 30 minute, '%Y-%m-%d %H:%M:%S.%f') AS session_end, "
    "count(*) AS n_events, round(avg(CASE WHEN tag = 'loss' THEN value END), 6) AS loss, "
    "round(avg(CASE WHEN tag = 'eval_loss' THEN value END), 6) AS eval_loss FROM g GROUP BY run, s")
ORACLES["telemetry_append"] = L + "SELECT run, step, loss, eval_loss, learning_rate, grad_norm FROM log"
ORACLES["stream_vote_state"] = D.vote_oracle(2)
