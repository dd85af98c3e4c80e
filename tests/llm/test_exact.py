"""Exact dedup against grouping by definition, colliding hashes included."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from spanweave.llm.exact import exact_groups, hash128, without_copies

SCHEMA = "doc_id bigint, text string, kept string, print string, id string, bytes int"
TEXTS = [(1, "a b"), (2, "ab"), (3, " a\tb\x0b"), (4, None), (5, ""), (6, " \n"), (7, "Ab"), (8, "a b"), (9, "日 本"), (10, "日本"),
         (11, "日 本"), (None, "a b c d"), (12, "abcd"), (None, "lone"), (13, "x" * 300000), (14, "x" * 150000 + "\r\f" + "x" * 150000),
         (15, "same"), (15, "same"), (15, "same"), (16, "z z"), (16, "zz"), (17, "s ame")]


def brute(rows):
    groups = {}
    for i, t in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(body, []).append((-len(t or ""), i is None, i or 0))
    out = []
    for body, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        for j, (_, null, i) in enumerate(members):
            out.append((None if null else i, keep, len(members), j == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "p", "i", 1) for i, t in rows], SCHEMA).repartition(3)


def weak(value):
    return F.substring(hash128(value), 1, 0)  # every content has the same hash


def half_weak(value):
    return F.when(F.length(value) < 4, F.lit(b"s")).otherwise(hash128(value))


@pytest.mark.parametrize("print_of", [hash128, weak, half_weak])
@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_groups_by_definition(spark, print_of, bound):
    got = exact_groups(frame(spark, TEXTS), print_of=print_of, broadcast_hashes=bound).drop("chars").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(TEXTS)


def test_survivors_keep_their_columns(spark):
    got = without_copies(frame(spark, TEXTS))
    assert got.columns == ["doc_id", "text", "kept", "print", "id", "bytes"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(
        [(3, " a\tb\x0b"), (6, " \n"), (7, "Ab"), (8, "a b"), (9, "日 本"), (None, "a b c d"), (None, "lone"),
         (14, TEXTS[15][1]), (16, "z z"), (17, "s ame")], key=str)
    same = without_copies(frame(spark, [(1, "q"), (1, "q"), (2, None)])).collect()
    assert sorted(r["doc_id"] for r in same) == [1, 2]


def test_a_hot_group_and_an_empty_table(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy of one text").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_groups(hot).groupBy("group_size", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, True, 2000), (1000, False, 999), (1000, True, 1)]
    assert exact_groups(frame(spark, [])).collect() == []


def test_no_python_worker_in_the_plan(spark):
    plan = exact_groups(frame(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
