"""Table-driven cases for the parsers and text functions."""
import pytest
from pyspark.sql import functions as F

from spanweave.functions.text import (assistant_target, json_valid, parse_pylist, parse_spans, py_repr_list,
                                      strip_think, strip_u)


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [
    ('<think>\n\n</think>\n\n{"spans": ["x"]}', ["x"]),
    ('```json\n{"spans": ["x"]}\n```', ["x"]),
    ('{"spans": ["x"]} <|im_end|>', ["x"]),
    ('{"spans":["a"]}\n{"spans":["b"]}', []),
    ("[]", []),
    ('{"spans":"ab"}', []),
    ('{"spans":["a",1,null," "]}', ["a"]),
    ('{"spans": [" pad "]}', ["pad"]),
    (None, []),
    ("not json", []),
])
def test_parse_greedy(spark, raw, expected):
    assert one(spark, parse_spans("x"), raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ('{"spans":["a"]}\n{"spans":["b"]}', ["a"]),
    ('{"spans": [" keep "]}', [" keep "]),
    ('{"spans": "ab"}', ["a", "b"]),
    ("", []),
    ('{"spans": "ab"}]', []),
    ('{"spans": "ab"}] more', []),
])
def test_parse_first_object(spark, raw, expected):
    assert one(spark, parse_spans("x", "first_object"), raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ('noise {"spans": ["a"]} tail', ["a"]),
    ('[{"spans": ["a"]}]', []),
    ('<think>x</think>{"spans": ["a"]}', ["a"]),
])
def test_parse_outer_braces(spark, raw, expected):
    assert one(spark, parse_spans("x", "outer_braces"), raw) == expected


def test_json_valid(spark):
    assert one(spark, json_valid("x"), '{"spans": []}') is True
    assert one(spark, json_valid("x"), '{"spans": "a"}') is False
    assert one(spark, json_valid("x"), 'junk {"spans": ["a"]} junk') is True


def test_strip_matches_python(spark):
    s = "　\x1c a b \xa0\n"
    assert one(spark, strip_u("x"), s) == s.strip()
    assert one(spark, strip_think("x"), "<think>a\nb</think>  ok ") == "ok"


@pytest.mark.parametrize("value,expected", [
    ("['it\\'s', \"a'b\"]", ["it's", "a'b"]),
    (None, []),
    ("{'a':1}", []),
    ("[", []),
    ("['x', 'y']", ["x", "y"]),
    ("['a\\nb']", ["a\nb"]),
])
def test_parse_pylist(spark, value, expected):
    assert one(spark, parse_pylist("x"), value) == expected


def test_repr_roundtrip(spark):
    import ast
    vals = ["plain", "it's", 'say "hi"', "both ' and \"", "back\\slash", "new\nline", "tab\tcr\r"]
    df = spark.createDataFrame([(vals,)], "x array<string>")
    r = df.select(py_repr_list("x").alias("r")).first()["r"]
    assert r == str(vals)
    assert ast.literal_eval(r) == vals
    assert df.select(parse_pylist(py_repr_list("x")).alias("p")).first()["p"] == vals


def test_assistant_target_matches_json_dumps(spark):
    import json
    vals = [" a ", "é\"q", "", "x\ny"]
    df = spark.createDataFrame([(vals,)], "x array<string>")
    got = df.select(assistant_target("x").alias("r")).first()["r"]
    clean = [s.strip() for s in vals if s.strip()]
    assert got == json.dumps({"spans": clean}, ensure_ascii=False)


def test_control_characters_as_json_dumps(spark):
    import json

    from spanweave.functions.text import json_quote
    for text in ["".join(map(chr, range(0x1A, 0x20))) + "\x0b\x0e\x0f\x7f", "\\u001F stays", "\\\x1f", "plain"]:
        assert one(spark, json_quote("x"), text) == json.dumps(text, ensure_ascii=False)


@pytest.mark.parametrize("items", [["a'b", 'c"d', "e\\f"], ["tab\t", "nl\n", "cr\r"], ["\x00\x1f\x7f\x85", "\u2028 \xa0", "é \U0001f600"], [], ["[", "],", "', '"],
                                   ["\ud800 lone"[1:]]])
def test_repr_lists_round_trip(spark, items):
    assert one(spark, parse_pylist("x"), repr(items)) == items


def test_pylist_plan_runs_no_python(spark):
    import contextlib
    import io
    df = spark.createDataFrame([("['a']",)], "x string").select(parse_pylist("x"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    assert "EvalPython" not in out.getvalue()


def test_feature_variants_split_on_or_only(spark):
    from spanweave.functions.text import feature_variants
    assert one(spark, feature_variants("x"), "a;b-OR-c-d-or- e") == ["a;b", "c d", "e"]
