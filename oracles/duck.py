"""DuckDB SQL building blocks for the correctness oracles.

The oracle queries rebuild the annotation domain from the same parquet
tables (see ``spanweave.sources.tables``) and compute every result with plain
SQL, usually by a different algorithm than the Spark plan (per-character
expansion instead of interval sweeps, list functions instead of windows).
"""
from __future__ import annotations

from spanweave.functions.text import PY_BLANK_CLASS

NL = "chr(10)"


def h(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_BLANK_CLASS}+|{PY_BLANK_CLASS}+$', '', 'g')"


def strip_think(x: str) -> str:
    return strip(f"regexp_replace({x}, '(?s)<think>.*?</think>', '', 'g')")


def _obj(x: str) -> str:
    return f"json_type(try_cast({x} AS JSON)) = 'OBJECT'"


def _items(j: str, strip_items: bool = True) -> str:
    item = strip("(x->>'$')") if strip_items else "(x->>'$')"
    return (f"(CASE WHEN json_type(json_extract({j}, '$.spans')) = 'ARRAY' THEN "
            f"list_filter(list_transform(json_extract({j}, '$.spans[*]'), "
            f"lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN {item} END), "
            f"lambda y: y IS NOT NULL AND {strip('y')} <> '') ELSE []::VARCHAR[] END)")


def parse_greedy(raw: str) -> str:
    t = strip_think(raw)
    m = f"regexp_extract({t}, '(?s)\\{{.*\\}}', 0)"
    j = (f"(CASE WHEN {_obj(t)} THEN try_cast({t} AS JSON) "
         f"WHEN {_obj(m)} THEN try_cast({m} AS JSON) END)")
    return f"coalesce({_items(j)}, []::VARCHAR[])"


def parse_first_object(raw: str) -> str:
    t = strip_think(strip(raw))
    m = f"regexp_extract({t}, '(?s)\\{{[^{{}}]*\"spans\"\\s*:\\s*\\[[^\\]]*\\][^{{}}]*\\}}', 0)"
    t2 = f"(CASE WHEN {m} <> '' THEN {m} ELSE {t} END)"
    j = f"(CASE WHEN {_obj(t2)} THEN try_cast({t2} AS JSON) END)"
    chars = (f"list_filter(string_split_regex(json_extract_string({j}, '$.spans'), ''), "
             f"lambda c: c <> '' AND {strip('c')} <> '')")
    arr = (f"(CASE WHEN json_type(json_extract({j}, '$.spans')) = 'VARCHAR' THEN {chars} "
           f"ELSE {_items(j, strip_items=False)} END)")
    return f"(CASE WHEN coalesce({raw}, '') = '' THEN []::VARCHAR[] ELSE coalesce({arr}, []::VARCHAR[]) END)"


def parse_outer_braces(raw: str) -> str:
    t = strip(raw)
    m = f"regexp_extract({raw}, '(?s)\\{{.*\\}}', 0)"
    j = (f"(CASE WHEN try_cast({t} AS JSON) IS NOT NULL THEN "
         f"(CASE WHEN {_obj(t)} THEN try_cast({t} AS JSON) END) "
         f"WHEN {_obj(m)} THEN try_cast({m} AS JSON) END)")
    chars = (f"list_transform(list_filter(string_split_regex(json_extract_string({j}, '$.spans'), ''), "
             f"lambda c: c <> '' AND {strip('c')} <> ''), lambda c: {strip('c')})")
    arr = (f"(CASE WHEN json_type(json_extract({j}, '$.spans')) = 'VARCHAR' THEN {chars} "
           f"ELSE {_items(j)} END)")
    return f"coalesce({arr}, []::VARCHAR[])"


def json_valid(raw: str) -> str:
    t = strip_think(raw)
    m = f"regexp_extract({t}, '(?s)\\{{.*\\}}', 0)"
    j = (f"(CASE WHEN {_obj(t)} THEN try_cast({t} AS JSON) "
         f"WHEN {_obj(m)} THEN try_cast({m} AS JSON) END)")
    return f"coalesce(json_type(json_extract({j}, '$.spans')) = 'ARRAY', false)"


NOTES = ("notes AS (SELECT doc_id AS pn_num, TRY_CAST(substr(source, 4) AS INTEGER) % 10 AS case_num, "
         "text AS pn_history FROM documents)")
FEATURES = ("features AS (SELECT item_id AS feature_num, CAST(item_id % 10 AS INTEGER) AS case_num, "
            "text AS feature_text FROM benchmark)")
PAIRS = ("pairs AS (SELECT n.pn_num, n.case_num, f.feature_num, printf('%05d_%03d', n.pn_num, f.feature_num) AS id, "
         "n.pn_history, f.feature_text FROM notes n JOIN features f USING (case_num))")


def _anchor(note: str, pid: str) -> str:
    return f"({h(pid, chr(39) + 'a' + chr(39))} % greatest(length({note}), 1))"


TRUTH = ("truth AS (SELECT p.*, list_filter([CASE WHEN " + h("p.id", "'pos'") + " % 3 <> 0 THEN "
         "substr(p.pn_history, " + _anchor("p.pn_history", "p.id") + " + 1, 5 + " + h("p.id", "'L0'") + " % 30) END, "
         "CASE WHEN instr(p.pn_history, p.feature_text) > 0 THEN p.feature_text END], lambda x: x IS NOT NULL) "
         "AS annotation FROM pairs p)")

_UP = "translate(span, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
REGISTRY_VALUES = "(VALUES ('m1', 1), ('m2', 1), ('m3', 1)) r(model, weight)"

PREDS = (
    "preds0 AS (SELECT p.id, p.pn_num, p.case_num, p.feature_num, r.model, r.weight, p.pn_history AS note, "
    f"substr(p.pn_history, greatest({_anchor('p.pn_history', 'p.id')} + {h('p.id', 'r.model', chr(39)+'s'+chr(39))} % 11 - 5, 0) + 1, "
    f"5 + {h('p.id', 'r.model', chr(39)+'l'+chr(39))} % 36) AS span, "
    f"substr(p.pn_history, {h('p.id', 'r.model', chr(39)+'t'+chr(39))} % greatest(length(p.pn_history), 1) + 1, "
    f"5 + {h('p.id', 'r.model', chr(39)+'u'+chr(39))} % 20) AS span2, "
    f"{h('p.id', 'r.model', chr(39)+'v'+chr(39))} % 12 AS v "
    f"FROM pairs p CROSS JOIN {REGISTRY_VALUES}), "
    "preds AS (SELECT id, pn_num, case_num, feature_num, model, weight, CASE "
    "WHEN v <= 2 THEN '{\"spans\": ' || to_json([span]) || '}' "
    f"WHEN v = 3 THEN '<think>' || {NL} || 'checking the note' || {NL} || '</think>' || {NL} || {NL} || "
    "'{\"spans\": ' || to_json([span]) || '}' "
    f"WHEN v = 4 THEN '```json' || {NL} || '{{\"spans\": ' || to_json([span]) || '}}' || {NL} || '```' "
    "WHEN v = 5 THEN '{\"spans\": ' || to_json([span]) || '} <|im_end|>' "
    f"WHEN v = 6 THEN '{{\"spans\": ' || to_json([{_UP}]) || '}}' "
    "WHEN v = 7 THEN '{\"spans\": []}' "
    "WHEN v = 8 THEN '{\"spans\": ' || to_json([span, span2]) || '}' "
    "WHEN v = 9 THEN '{\"spans\": [\"' || span "
    f"WHEN v = 10 THEN '{{\"spans\": ' || to_json([replace(span, {NL}, ' ')]) || ', \"note\": 1}}' "
    "ELSE 'Answer: {\"spans\": [' || substr(to_json([span]), 2, length(to_json([span])) - 2) || ', 1, null]}' "
    "END AS raw FROM preds0)"
)

DOMAIN = ",\n".join([NOTES, FEATURES, PAIRS])


def with_domain(*ctes: str) -> str:
    return "WITH " + ",\n".join([DOMAIN, *ctes]) + "\n"


# --- the location / vote oracle: per-character expansion -----------------
def vote_oracle(threshold: int) -> str:
    """Per-character vote over the located spans (exact and case-insensitive)."""
    return with_domain(
        PREDS,
        f"parsed AS (SELECT id, pn_num, model, weight, {parse_greedy('raw')} AS spans FROM preds)",
        "ex AS (SELECT id, pn_num, model, weight, unnest(spans) AS span FROM parsed)",
        "loc AS (SELECT e.id, e.model, e.weight, length(n.pn_history) AS n, "
        f"{strip('e.span')} AS sp, n.pn_history AS note FROM ex e JOIN notes n USING (pn_num))",
        "loc2 AS (SELECT *, CASE WHEN instr(note, sp) > 0 THEN instr(note, sp) - 1 "
        "WHEN instr(lower(note), lower(sp)) > 0 THEN instr(lower(note), lower(sp)) - 1 END AS s "
        "FROM loc WHERE sp <> '' AND n > 0)",
        "iv AS (SELECT id, model, weight, greatest(s, 0) AS s, least(n, s + length(sp)) AS e FROM loc2 WHERE s IS NOT NULL)",
        "chars AS (SELECT DISTINCT id, model, weight, unnest(range(s, e)) AS pos FROM iv WHERE s < e)",
        f"cons AS (SELECT id, pos FROM chars GROUP BY id, pos HAVING sum(weight) >= {threshold})",
        "isl AS (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM cons)",
        "runs AS (SELECT i.id, min(pos) AS s, max(pos) + 1 AS e FROM isl i GROUP BY i.id, g)",
        "seg AS (SELECT r.id, r.s, r.e, substr(n.pn_history, r.s + 1, r.e - r.s) AS txt FROM runs r "
        "JOIN pairs p ON p.id = r.id JOIN notes n ON n.pn_num = p.pn_num)",
        "trimmed AS (SELECT id, s + length(regexp_extract(txt, '^[ \\t\\n\\r]*', 0)) AS s, "
        "e - length(regexp_extract(txt, '[ \\t\\n\\r]*$', 0)) AS e FROM seg)",
        "locs AS (SELECT id, string_agg(s || ' ' || e, ';' ORDER BY s) AS location FROM trimmed WHERE s < e GROUP BY id)",
    ) + "SELECT p.id, l.location FROM pairs p LEFT JOIN locs l USING (id)"


SEP = "␟"
PARSED = f"parsed AS (SELECT *, {parse_greedy('raw')} AS spans FROM preds)"
EX = ("ex AS (SELECT id, pn_num, model, weight, unnest(spans) AS span, "
      "generate_subscripts(spans, 1) - 1 AS span_idx FROM parsed)")
LOCATED = ("located AS (SELECT id, model, span_idx, s AS start, s + length(sp) AS \"end\", "
           "CASE WHEN x > 0 THEN 'exact' ELSE 'ci' END AS method, n AS note_len, note FROM ("
           "SELECT *, CASE WHEN x > 0 THEN x - 1 WHEN c > 0 THEN c - 1 END AS s FROM ("
           "SELECT e.id, e.model, e.span_idx, sp, n.pn_history AS note, length(n.pn_history) AS n, "
           "instr(n.pn_history, sp) AS x, instr(lower(n.pn_history), lower(sp)) AS c FROM "
           f"(SELECT *, {strip('span')} AS sp FROM ex) e JOIN notes n USING (pn_num) "
           "WHERE sp <> '' AND length(n.pn_history) > 0)) WHERE s IS NOT NULL)")
UNANNOTATED = ("unann AS (SELECT * FROM notes WHERE pn_num NOT IN (SELECT doc_id FROM labels) "
               f"AND pn_history IS NOT NULL AND {strip('pn_history')} <> '')")


def islands(src: str, keys: str) -> str:
    """Character rows ``keys, pos`` to maximal runs ``keys, start, end``."""
    return (f"SELECT {keys}, min(pos) AS start, max(pos) + 1 AS \"end\" FROM ("
            f"SELECT {keys}, pos, pos - row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS g FROM {src}) "
            f"GROUP BY {keys}, g")


def occurrence_intervals(src: str, keys: str) -> str:
    """``keys, s, e`` of every (overlapping) occurrence of ``span`` in ``note``.

    A span none of whose ends is its own beginning cannot overlap itself, so
    splitting the note by it finds all; the few others are tried at every place.
    """
    border = "len(list_filter(range(1, length(span)), lambda k: substr(span, k + 1) = substr(span, 1, length(span) - k))) > 0"
    here = f"FROM {src} WHERE length(span) > 0 AND contains(note, span)"
    return (f"SELECT {keys}, s, s + n AS e FROM (SELECT {keys}, length(span) AS n, unnest(list_transform(range(1, len(string_split(note, span))), "
            "lambda j: CAST(list_sum(list_transform(string_split(note, span)[1:j], lambda x: length(x))) + (j - 1) * length(span) AS BIGINT))) AS s "
            f"{here} AND NOT ({border})) UNION ALL "
            f"SELECT {keys}, s, s + n AS e FROM (SELECT {keys}, length(span) AS n, unnest(list_filter(range(0, length(note) - length(span) + 1), "
            f"lambda i: note[i + 1:i + length(span)] = span)) AS s {here} AND ({border}))")


def sample_rows(src: str, n: int | str, seed: int, key: str) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR)), {key}) "
            f"AS _rn FROM {src}) WHERE _rn <= {n}")
