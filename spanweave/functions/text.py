"""Column functions for note text and model output (all JVM-side expressions).

Every function here takes and returns :class:`pyspark.sql.Column` objects and
compiles to built-in Spark SQL expressions, so they stay inside whole-stage
codegen.  Python only runs for :func:`parse_pylist` rows the regular
expression cannot prove (escaped literals), through an Arrow UDF.
"""
from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def locate(sub, s, pos=None) -> Column:
    """SQL ``locate(sub, s[, pos])`` with column-valued ``sub`` (1-based, 0 when absent)."""
    args = [_col(sub), _col(s)] + ([pos if isinstance(pos, Column) else F.lit(pos)] if pos is not None else [])
    return F.call_function("locate", *args)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (keeps plans and
    generated code small when a costly sub-expression is referenced repeatedly)."""
    return F.transform(F.array(value), body)[0]


def _ranges(codes: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def _class(codes: list[int]) -> str:
    parts = []
    for a, b in _ranges(codes):
        parts.append(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}")
    return "[" + "".join(parts) + "]"


# Python's str.strip()/str.isspace() blank set, derived from the interpreter by
# rule (Java's (?U)\s lacks U+001C..U+001F, so it is spelled out).  The class
# uses \x{...} escapes, valid for both Java regex and RE2.
PY_BLANK_CODES = [c for c in range(sys.maxunicode + 1) if chr(c).isspace()]
PY_BLANKS = "".join(map(chr, PY_BLANK_CODES))
PY_BLANK_CLASS = _class(PY_BLANK_CODES)
PY_NONBLANK_CLASS = "[^" + PY_BLANK_CLASS[1:]

# Fixed values that must equal the reference: the blank set of the vote trim
# and the location formatter is exactly space, tab, newline, carriage return.
VOTE_BLANKS = " \t\n\r"
VOTE_BLANK_CLASS = "[ \\t\\n\\r]"


def strip_u(c) -> Column:
    """Python ``str.strip()``: remove Unicode blanks on both sides (a regular expression would try every position between)."""
    return F.trim(_col(c), F.lit(PY_BLANKS))


def is_blank(c) -> Column:
    """True when null or only Unicode blanks (``not s.strip()``); the search ends at the first other character."""
    c = _col(c)
    return c.isNull() | ~c.rlike(PY_NONBLANK_CLASS)


def strip_think(c) -> Column:
    """Remove ``<think>...</think>`` blocks (non-greedy, dot matches newline), then strip."""
    return strip_u(F.regexp_replace(_col(c), r"(?s)<think>.*?</think>", ""))


# ---------------------------------------------------------------- JSON spans
_END = "\u241fend of value\u241f"


def parse_json_strict(t: Column) -> Column:
    """``json.loads`` semantics: exactly one JSON value, nothing after it.

    ``try_parse_json`` alone stops after the first value. The text is put
    into an array before an end mark: only if the mark is the second and last
    element did the text hold one value and no stray bracket or rest. Prose,
    fences and objects without their last brace are told by their ends: each
    failing parse would make exceptions.
    """
    may = F.when(t.rlike(r"(?s)\A\s*(?:\{.*\}\s*\z|[^{`A-HJ-MO-Za-eg-mo-su-z])"), t)
    return let(F.try_parse_json(F.concat(F.lit("["), may, F.lit(f',"{_END}"]'))),
               lambda w: F.when((F.try_variant_get(w, "$[1]", "string") == _END) & F.try_variant_get(w, "$[2]", "variant").isNull(),
                                F.try_variant_get(w, "$[0]", "variant")))


def _is_object(v: Column) -> Column:
    return v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")


def _spans_of(v: Column, strip_items: bool, string_iterates: bool) -> Column:
    """String items of ``v.spans``; non-string items dropped, blank items dropped."""
    arr = F.try_variant_get(v, "$.spans", "array<variant>")
    item = (lambda x: strip_u(x.cast("string"))) if strip_items else (lambda x: x.cast("string"))
    from_array = F.filter(
        F.transform(arr, lambda x: F.when(F.schema_of_variant(x) == "STRING", item(x))),
        lambda s: s.isNotNull() & ~is_blank(s),
    )
    if not string_iterates:
        return from_array
    # older parsers iterate a string value character by character and an
    # object value by key
    sv = F.try_variant_get(v, "$.spans", "variant")
    kind = F.schema_of_variant(sv)
    chars = F.filter(F.split(sv.cast("string"), "(?!^)|^(?=.)", -1), lambda s: (s != "") & ~is_blank(s))
    keys = F.filter(F.json_object_keys(F.to_json(sv)), lambda s: ~is_blank(s))
    if strip_items:
        chars = F.transform(chars, lambda s: strip_u(s))
        keys = F.transform(keys, lambda s: strip_u(s))
    return F.when(kind == "STRING", chars).when(kind.startswith("OBJECT"), keys).otherwise(from_array)


_WS = r"[ \t\r\n]*"
_PLAIN_ITEM = r'"[^"\\\x00-\x1f]*+"'
_PLAIN_ITEMS = 16
_PLAIN = (rf'\A\{{{_WS}"spans"{_WS}:{_WS}\[{_WS}(?:{_PLAIN_ITEM}(?:{_WS},{_WS}{_PLAIN_ITEM}){{0,{_PLAIN_ITEMS - 1}}})?{_WS}\]{_WS}\}}\z')


def _plain_or(t: Column, strip_items: bool, rest: Column) -> Column:
    """Items of an object that holds ``spans`` alone, a short list of strings without escapes; of any other text ``rest``.

    One regular expression proves the form, so most outputs are read without a JSON parser.
    """
    items = F.slice(F.regexp_extract_all(t, F.lit('"([^"]*)"'), F.lit(1)), 2, _PLAIN_ITEMS)
    if strip_items:
        items = F.transform(items, lambda s: strip_u(s))
    return F.when(t.rlike(_PLAIN), F.filter(items, lambda s: ~is_blank(s))).otherwise(rest)


def _empty() -> Column:
    return F.array().cast("array<string>")


def parse_spans(c, mode: str = "greedy") -> Column:
    """Parse model output into ``array<string>`` of span texts.

    ``greedy`` (default): strip think blocks, parse; when that is not a JSON
    object retry on the greedy ``{...}`` region; ``spans`` must be a list;
    items that are strings are stripped, blank ones dropped.
    ``first_object``: strip, strip think blocks, take the first
    ``{.."spans": [..]..}`` object if any, items kept unstripped, a string value
    iterates by character.
    ``outer_braces``: parse the stripped text, else the text from the first
    ``{`` to the last ``}``; items stripped; no think stripping.
    Null, invalid or unexpected input yields an empty array, never null.
    """
    raw = _col(c)
    if mode == "greedy":
        def read(t, region):
            v = let(parse_json_strict(t), lambda a: F.when(_is_object(a), a).otherwise(
                let(parse_json_strict(region), lambda b: F.when(_is_object(b), b))))
            return _plain_or(region, True, let(v, lambda x: _spans_of(x, strip_items=True, string_iterates=False)))
        res = let(strip_think(raw), lambda t: let(F.regexp_extract(t, r"(?s)\{.*\}", 0), lambda region: read(t, region)))
    elif mode == "first_object":
        def body(t):
            return let(F.regexp_extract(t, r'(?s)\{[^{}]*"spans"\s*:\s*\[[^\]]*\][^{}]*\}', 0), lambda m: let(
                F.when(m != "", m).otherwise(t), lambda one: _plain_or(one, False, let(
                    parse_json_strict(one), lambda v0: let(F.when(_is_object(v0), v0),
                                                           lambda v: _spans_of(v, strip_items=False, string_iterates=True))))))
        res = let(raw, lambda r: F.when(F.coalesce(r, F.lit("")) == "", _empty()).otherwise(let(strip_think(strip_u(r)), body)))
    elif mode == "outer_braces":
        def outer(t):
            v = let(parse_json_strict(t), lambda a: F.when(a.isNotNull(), F.when(_is_object(a), a)).otherwise(
                let(parse_json_strict(F.regexp_extract(t, r"(?s)\{.*\}", 0)), lambda b: F.when(_is_object(b), b))))
            return _plain_or(t, True, let(v, lambda x: _spans_of(x, strip_items=True, string_iterates=True)))
        res = let(strip_u(raw), outer)
    else:
        raise ValueError(f"unknown parse mode {mode!r}")
    return F.coalesce(res, _empty())


def json_valid(c) -> Column:
    """Output is valid: after think-strip (and greedy retry) ``spans`` is a JSON list."""
    def body(t):
        return let(F.struct(parse_json_strict(t).alias("a"),
                            parse_json_strict(F.regexp_extract(t, r"(?s)\{.*\}", 0)).alias("b")),
                   lambda vv: let(F.when(_is_object(vv["a"]), vv["a"]).when(_is_object(vv["b"]), vv["b"]),
                                  lambda v: F.schema_of_variant(F.try_variant_get(v, "$.spans", "variant"))
                                  .startswith("ARRAY")))
    return F.coalesce(let(strip_think(_col(c)), body), F.lit(False))


def jsonish(raw, spans) -> Column:
    """Starts with ``{`` (after strip), or parsed spans non-empty, or mentions ``"spans"``."""
    raw = F.coalesce(_col(raw), F.lit(""))
    return strip_u(raw).startswith("{") | (F.size(_col(spans)) > 0) | raw.contains('"spans"')


def all_contained(spans, note) -> Column:
    """Every predicted span is a substring of the note (true when there are none)."""
    return F.forall(_col(spans), lambda s: locate(s, F.coalesce(_col(note), F.lit(""))) > 0)


# ------------------------------------------------------------ JSON writers
def json_quote(c) -> Column:
    """A JSON string literal as ``json.dumps(..., ensure_ascii=False)`` writes it."""
    j = F.to_json(F.array(_col(c)))
    low = j
    for code in ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"):  # json.dumps writes them in lower case
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
    j = F.when(j.rlike(r"\\u00[01][A-F]"), low).otherwise(j)
    return F.substring(j, F.lit(2), F.length(j) - 2)


def spans_json(arr, strip_items: bool = True) -> Column:
    """``{"spans": [...]}`` with the blanks Python's json.dumps puts after ``:`` and ``,``."""
    a = _col(arr)
    if strip_items:
        a = F.filter(F.transform(a, lambda s: strip_u(s)), lambda s: s.isNotNull() & (s != ""))
    body = F.array_join(F.transform(a, lambda s: json_quote(s)), ", ")
    return F.concat(F.lit('{"spans": ['), F.coalesce(body, F.lit("")), F.lit("]}"))


def assistant_target(arr) -> Column:
    """Training target: stripped, non-blank string items as a spaced JSON object."""
    return spans_json(arr, strip_items=True)


def json_quote_ascii(c) -> Column:
    """JSON string literal with ``ensure_ascii=True`` (``\\uXXXX`` for non-ASCII)."""
    def esc(ch):
        cp = F.ascii(ch)
        hi = F.floor((cp - 0x10000) / 1024) + 0xD800
        lo = F.pmod(cp - 0x10000, 1024) + 0xDC00
        return (F.when(cp < 128, ch)
                .when(cp < 0x10000, F.format_string("\\u%04x", cp))
                .otherwise(F.concat(F.format_string("\\u%04x", hi), F.format_string("\\u%04x", lo))))
    inner = json_quote(c)
    chars = F.split(inner, "(?!^)|^(?=.)", -1)
    return F.when(inner.rlike(r"^[\x00-\x7F]*$"), inner).otherwise(
        F.array_join(F.transform(F.filter(chars, lambda s: s != ""), esc), ""))


def json_list_ascii(arr) -> Column:
    """``json.dumps(list_of_str)`` with the default ``ensure_ascii=True``."""
    return F.concat(F.lit("["), F.array_join(F.transform(_col(arr), json_quote_ascii), ", "), F.lit("]"))


# --------------------------------------------------------- python-repr lists
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_DQ = r'"(?:[^"\\\n]|\\.)*"'
_LIT = f"(?:{_SQ}|{_DQ})"
_ITEM = rf"(?:{_LIT}|[-+]?[0-9.][0-9_.eE+-]*|None|True|False)"
_LIST_OF_ITEMS = rf"^{_WS}\[{_WS}(?:{_ITEM}{_WS}(?:,{_WS}{_ITEM}{_WS})*,?{_WS})?\]{_WS}\z"


def py_repr_str(c) -> Column:
    """``repr(str)`` for the common case: quote choice, backslash/quote/control escapes."""
    s = _col(c)
    e = F.regexp_replace(s, r"\\", r"\\\\")
    e = F.regexp_replace(F.regexp_replace(F.regexp_replace(e, "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t")
    use_dq = s.contains("'") & ~s.contains('"')
    sq = F.concat(F.lit("'"), F.regexp_replace(e, "'", r"\\'"), F.lit("'"))
    dq = F.concat(F.lit('"'), e, F.lit('"'))
    return F.when(use_dq, dq).otherwise(sq)


def py_repr_list(arr) -> Column:
    """``str(list_of_str)``, the on-disk form of annotation and location lists."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(_col(arr), py_repr_str), ", "), F.lit("")),
                    F.lit("]"))


_ESCAPE = r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|(?s)\\.|[^\\]+"
_ONE_CHAR = {"\\n": "\n", "\\r": "\r", "\\t": "\t", "\\\\": "\\", "\\'": "'", '\\"': '"', "\\a": "\a", "\\b": "\b", "\\f": "\f", "\\v": "\v",
             "\\\n": ""}


def _unescape(body: Column) -> Column:
    """The text of a Python string literal's body; unknown escapes stay as they are."""
    def one(t):
        wide = lambda digits, charset: F.decode(F.unhex(digits), charset)
        out = F.when(t.startswith("\\x"), wide(F.concat(F.lit("00"), F.substring(t, 3, 2)), "UTF-16BE"))
        out = out.when(t.startswith("\\u"), wide(F.substring(t, 3, 4), "UTF-16BE")).when(t.startswith("\\U"), wide(F.substring(t, 3, 8), "UTF-32"))
        out = out.when(t.rlike(r"^\\[0-7]"), wide(F.lpad(F.conv(F.substring(t, 2, 3), 8, 16), 4, "0"), "UTF-16BE"))
        for k, v in _ONE_CHAR.items():
            out = out.when(t == F.lit(k), F.lit(v))
        return out.otherwise(t)

    parts = F.regexp_extract_all(body, F.lit(f"({_ESCAPE})"), F.lit(1))
    return F.when(body.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(body)


def parse_pylist(c) -> Column:
    """Python-repr list to its string items as ``array<string>``; null, bad or non-list gives ``[]``.

    Lists of string literals, numbers, ``None``, ``True`` and ``False`` are
    read in the JVM, escapes included; items that are not strings are
    dropped. Anything else (nested or prefixed literals) gives ``[]``.
    """
    s = _col(c)
    items = F.regexp_extract_all(s, F.lit(f"({_ITEM})"), F.lit(1))
    texts = F.filter(items, lambda x: F.substring(x, 1, 1).isin("'", '"'))
    return F.when(s.rlike(_LIST_OF_ITEMS), F.transform(texts, lambda x: _unescape(F.substring(x, F.lit(2), F.length(x) - 2)))).otherwise(_empty())


# ------------------------------------------------------------ ids & features
def pair_id(pn_num, feature_num) -> Column:
    """Row id ``f"{pn:05d}_{feat:03d}"``."""
    return F.format_string("%05d_%03d", _col(pn_num), _col(feature_num))


def feature_variants(c) -> Column:
    """Feature text alternatives: split on ``-OR-`` (any case), ``-`` read as a blank."""
    parts = F.split(_col(c), "(?i)-or-")
    return F.filter(F.transform(parts, lambda p: strip_u(F.translate(p, "-", " "))), lambda p: p != "")


# ------------------------------------------------------- output constraints
def note_char_class(note) -> Column:
    """Character class of the note's distinct characters (code-point order),
    without ``"``, backslash and control characters; ``] ^ - \\`` are escaped,
    and ``[`` and ``&`` too because Java classes treat them as syntax.
    An empty set gives ``[^\\n]``."""
    chars = F.array_distinct(F.split(F.coalesce(_col(note), F.lit("")), ""))
    chars = F.array_sort(F.filter(chars, lambda ch: (ch != "") & (ch != '"') & (ch != "\\")
                                  & (F.ascii(ch) >= 0x20) & (F.ascii(ch) != 0x7F)))
    esc = F.transform(chars, lambda ch: F.when(ch.isin("]", "^", "-", "\\", "[", "&"), F.concat(F.lit("\\"), ch))
                      .otherwise(ch))
    return F.when(F.size(chars) == 0, F.lit("[^\\n]")).otherwise(F.concat(F.lit("["), F.array_join(esc, ""), F.lit("]")))


def constraint_regex(note, max_spans: int = 10) -> Column:
    """Pattern a well-formed answer for this note must match:
    ``{"spans": []}`` or up to ``max_spans`` quoted items drawn from the note's characters."""
    item = F.concat(F.lit('"'), note_char_class(note), F.lit('*"'))
    rest = F.concat(F.lit("(?:, "), item, F.lit(f"){{0,{max_spans - 1}}}"))
    return F.concat(F.lit('\\{"spans": \\[(?:'), item, rest, F.lit(")?\\]\\}"))


def obeys(raw, pattern) -> Column:
    """The whole output matches the (per-row) pattern."""
    return F.call_function("rlike", F.coalesce(_col(raw), F.lit("")), F.concat(F.lit("^(?:"), _col(pattern), F.lit(")\\z")))
