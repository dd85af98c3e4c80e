"""Exact dedup with DataFrame functions alone: 128-bit content hashes, bytes compared inside their groups.

A row's content is its text without blanks (0x20, 0x09-0x0D). One narrow pass
hashes every content; rows are grouped by hash through partial sums, so a
group that holds a third of all rows is one row a task before it shuffles.
Contents of groups of two or more are then grouped by hash *and* bytes: equal
copies collapse inside each task, and what is left of a hash is its distinct
contents. A hash with more than one is a collision; its rows are told apart
by their bytes.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm._store import stored

BLANKS = " \t\n\x0b\x0c\r"
#: Up to so many repeated hashes (16 bytes each) are broadcast to skip the other texts; beyond, all texts are grouped.
BROADCAST_HASHES = 1 << 20


def content(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def hash128(value: Column) -> Column:
    return F.unhex(F.md5(value.cast("binary")))


def _collisions(docs: DataFrame, prints: DataFrame, text_col: str, print_of: Callable[[Column], Column], broadcast_hashes: int) -> DataFrame | None:
    """``(print, bytes)``: the distinct contents of every hash that more than one content has; None if there is none."""
    repeated = stored(prints.groupBy("print").agg(F.count("*").alias("c")).where("c > 1").select("print"), "exact-repeated")
    texts = docs.select(content(F.col(text_col)).alias("bytes")).withColumn("print", print_of(F.col("bytes")))
    if repeated.count() <= broadcast_hashes:
        texts = texts.join(F.broadcast(repeated), "print", "left_semi")
    # grouping by the bytes compares them: copies meet in the task's own table first
    contents = texts.groupBy("print", "bytes").agg(F.count("*").alias("rows")).drop("rows")
    seen = contents.groupBy("print").agg(F.count("*").alias("contents")).where("contents > 1")
    seen = stored(seen.select(F.col("print").alias("of")), "exact-collisions")
    if seen.isEmpty():
        return None
    return texts.join(seen, F.col("print") == F.col("of"), "left_semi").select("print", "bytes").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", print_of: Callable[[Column], Column] = hash128,
                 broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256, chars)``: one row a row of ``docs``.

    Rows are equal when their texts are, blanks apart (null counts as empty).
    Of equal rows the one with the most code points in its original text
    stays, then the one with the smallest id; null ids come last. Repeated
    rows of one id count each, and of those that tie for staying one is
    kept. No rows give none. Only ``id_col`` and ``text_col`` are read, so other
    columns may have any name.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    body = content(F.col("text"))
    prints = stored(base.select("id", print_of(body).alias("print"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("sha"),
                                F.coalesce(F.length("text"), F.lit(0)).alias("chars")), "exact-prints")
    several = _collisions(base, prints, "text", print_of, broadcast_hashes)
    if several is None:
        rows = prints.withColumn("variant", F.lit(0))
    else:  # tell the contents of a collided hash apart by their bytes
        numbered = stored(several.withColumn("variant", F.row_number().over(Window.partitionBy("print").orderBy("bytes"))), "exact-variants")
        doubtful = numbered.select(F.col("print").alias("of")).distinct()
        clear = prints.join(doubtful, F.col("print") == F.col("of"), "left_anti").withColumn("variant", F.lit(0))
        told = (base.withColumn("bytes", content(F.col("text"))).withColumn("print", print_of(F.col("bytes")))
                .join(numbered, ["print", "bytes"])
                .select("id", "print", F.unhex(F.sha2(F.col("bytes").cast("binary"), 256)).alias("sha"),
                        F.coalesce(F.length("text"), F.lit(0)).alias("chars"), "variant"))
        rows = clear.unionByName(told)
    # repeated rows of one id travel as one row with a count
    same = rows.groupBy("print", "variant", "id", "chars", "sha").agg(F.count("*").alias("times"))
    best = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("last"), F.col("id"))
    groups = (same.groupBy("print", "variant").agg(F.min(best).alias("best"), F.sum("times").alias("group_size"))
              .select(F.col("print").alias("p"), F.col("variant").alias("v"), F.col("best.id").alias("keep_id"),
                      (-F.col("best.chars")).alias("keep_chars"), "group_size"))
    shared = stored(groups.where("group_size > 1"), "exact-groups")
    placed = same.join(shared, (F.col("print") == F.col("p")) & (F.col("variant") == F.col("v")), "left")
    alone = F.col("group_size").isNull()
    stays = alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")))
    return (placed.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("turn"))
            .select("id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), (stays & (F.col("turn") == 1)).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256"), "chars"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of :func:`exact_groups`, with all their columns.

    Of rows with one id and equally long equal texts, the one with the smallest text stays.
    """
    report = exact_groups(docs, id_col, text_col)
    verdict = stored(report.groupBy("id", "text_sha256", "chars").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
                     .select(F.col("id").alias("of"), F.col("text_sha256").alias("sha"), F.col("chars").alias("size"), "kept", "times"), "exact-verdict")
    text = F.col("row").getField(text_col)
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row").getField(id_col).alias("own"),
                                                          F.sha2(content(text).cast("binary"), 256).alias("own_sha"),
                                                          F.coalesce(F.length(text), F.lit(0)).alias("own_size"))
    left = rows.join(verdict.where("kept"), F.col("own").eqNullSafe(F.col("of")) & (F.col("own_sha") == F.col("sha")) & (F.col("own_size") == F.col("size")))
    once = left.where("times = 1").select("row")
    first = left.where("times > 1").groupBy("own", "own_sha").agg(F.min_by("row", F.coalesce(text, F.lit(""))).alias("row")).select("row")
    return once.unionByName(first).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
