"""Exact duplicates: group by a 128-bit content hash, compare bytes, keep the smallest id.

Texts count as equal when they are identical after each run of white space
(``[\\x20\\x09-\\x0D]+``) is replaced by one space.

Defined results: a null text is the empty text; all empty texts are one group. A group
whose ids are all null keeps id null; otherwise null ids are never the smallest. Rows
that repeat an id and text have the same decision, and ``drop_copies`` leaves one of
them. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.llm.common import SPACES, staged, text_of
from rivermark.registry import query

#: A run of white space that is not already one single space.
_RUNS = rf"[\x09-\x0D][{SPACES}]*|\x20[{SPACES}]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, _RUNS, " ")


def content_key(text: Column) -> Column:
    """128 bits of the content as binary."""
    return F.unhex(F.md5(text.cast("binary")))


def decisions(docs: DataFrame, key: Callable[[Column], Column] = content_key) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Grouping by (hash, text) compares the bytes of equal hashes, and each task first
    folds its own copies, so a text that a third of all rows share arrives as one row
    per task. What goes on from there has no texts.
    """
    rows = docs.select("doc_id", normalised(text_of()).alias("norm")).withColumn("key", key(F.col("norm")))

    def classes(of: DataFrame) -> DataFrame:
        return of.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    groups = staged(classes(rows).select("key", "keep_id", "group_size", sha))
    collided = groups.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("key")
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    if collided.isEmpty():
        return rows.drop("norm").join(groups, "key").select(*out)
    # Different texts behind one hash: for these the text itself is the join key.
    told = rows.join(collided, "key", "left_semi")
    clear = rows.join(collided, "key", "left_anti").drop("norm").join(groups, "key").select(*out)
    apart = classes(told).withColumn("text_sha256", sha)
    return clear.unionByName(told.join(apart, ["key", "norm"]).select(*out))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns: one row for each different text."""
    flags = decisions(docs).filter("kept")
    repeated = staged(
        flags.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"), "_n")
    )
    sha = F.sha2(normalised(text_of()).cast("binary"), 256)
    same = F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (sha == F.col("_keep_sha"))
    names = [F.col(f"_d.{c}") for c in docs.columns]
    kept = docs.alias("_d").join(repeated.alias("_k"), same)
    if repeated.filter("_n > 1").isEmpty():
        return kept.select(*names)
    once = kept.filter("_n = 1").select(*names)
    # Rows that repeat id and text: fold them in each task before they meet.
    many = kept.filter("_n > 1").select(F.struct(*names).alias("_row"), "_keep_id", "_keep_sha")
    folded = many.groupBy("_keep_id", "_keep_sha").agg(F.min("_row").alias("_row")).select("_row.*")
    return once.unionByName(folded)


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


@query("op8_exact_dedup", SQL)
def op8_exact_dedup(spark, sf_dir):
    from rivermark.llm.common import table

    return decisions(table(spark, sf_dir, "documents"))
