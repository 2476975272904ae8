"""Exact duplicates by a distributed content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters of their normalised bytes and sorted inside a
range, so that equal texts are neighbours, and a window compares neighbouring texts in full.
A splitter holds the first bytes, the SHA-256 of all bytes and a slot: texts with one long
beginning are told apart by the digest, and the copies of one text, however many, are spread
over ``slots`` neighbouring ranges. What meets per text afterwards is a row per slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, stage, text_of

SLOTS = 64
SPLITTER_BYTES = 64


def normalised(text: Column) -> Column:
    """The text without any of the characters of ``[\\x20\\x09-\\x0D]``, in UTF-8."""
    return F.encode(F.translate(text, SPACES, ""), "UTF-8")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the one
    with the smallest id; a null id comes last. A null text counts as empty. Of repeated rows
    (same id, same text) exactly one is kept. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).select(
        "doc_id",
        F.length("text").cast("long").alias("size"),
        normalised(F.col("text")).alias("body"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("slot"),
    )
    rows = rows.withColumns(
        {
            "head": F.substring("body", 1, SPLITTER_BYTES),
            "digest": F.unhex(F.sha2("body", 256)),
        }
    )
    best_first = [F.col("size").desc(), F.col("doc_id").asc_nulls_last()]
    neighbours = Window.partitionBy("head", "digest", "slot", "body").orderBy(*best_first)
    sorted_rows = rows.repartitionByRange("head", "digest", "slot").select(
        "doc_id", "size", "digest", "slot", F.row_number().over(neighbours).alias("place")
    )
    light = stage(sorted_rows, "exact-dedup")

    runs = light.groupBy("digest", "slot").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct((-F.col("size")).alias("rank"), F.col("doc_id").isNull(), "doc_id")).alias(
            "best"
        ),
    )
    group = Window.partitionBy("digest")
    runs = runs.select(
        F.col("digest").alias("run_digest"),
        F.col("slot").alias("run_slot"),
        F.sum("n").over(group).alias("group_size"),
        (F.min("best").over(group) == F.col("best")).alias("has_best"),
        F.min("best").over(group)["doc_id"].alias("keep_id"),
    )
    same_run = (F.col("digest") == F.col("run_digest")) & (F.col("slot") == F.col("run_slot"))
    return light.join(runs, same_run).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("has_best") & (F.col("place") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Repeated rows (same id, same normalised text) leave one row, the longest original first.
    """
    kept = exact_duplicates(docs, id_col, text_col).where("kept")
    named = kept.select(
        F.col("doc_id").alias("__kept_id"), F.unhex("text_sha256").alias("__kept_digest")
    )
    marked = docs.withColumn(
        "__digest", F.unhex(F.sha2(normalised(text_of(text_col)), 256))
    )
    same = marked[id_col].eqNullSafe(named["__kept_id"]) & (
        marked["__digest"] == named["__kept_digest"]
    )
    once = Window.partitionBy(id_col, "__digest").orderBy(F.length(text_of(text_col)).desc())
    return (
        marked.join(named, same, "left_semi")
        .withColumn("__place", F.row_number().over(once))
        .where("__place = 1")
        .drop("__place", "__digest")
    )
