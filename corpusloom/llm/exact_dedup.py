"""Exact dedup by distributed MSD radix partitioning.

Texts, without white space and as bytes, are split recursively by successive
blocks of bytes: a level groups the documents of each open group by their next
block, and a group is closed when it is a singleton or when its texts end with
the block; the documents of a group that ended are equal. Block by block
comparison settles equality, so no digest is compared. Blocks widen eightfold
from level to level (a wide block is several one-byte levels at once), so texts
of any length end after a few levels, and after the first level only documents
that share a beginning move on.

A level counts its groups with partial aggregation before the shuffle and joins
the few groups of two or more back by an equi-join, which adaptive execution
splits where a group is hot: no task gathers a group. Levels are written to the
shared folder, which ends their lineage.

Defined cases. Null text: empty. Empty texts equal each other. Of equal texts the one
with the most code points stays, of those as long the one of the smallest doc_id. Rows
that repeat a doc_id in one group share its keep_id and exactly one of them is kept.
doc_id: of any type with an order; null is ordered last. Very long texts are compared
whole, block by block. Empty table: empty result. Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, without_space

FIRST_BLOCK, WIDEN = 64, 8


def radix_groups(rows: DataFrame, scratch: Scratch, block: int = FIRST_BLOCK, widen: int = WIDEN) -> DataFrame:
    """rows (…, rest binary) to (…, level, gid): equal rest, equal (level, gid).

    Rows whose text no other row has get a null gid.
    """
    keep = [c for c in rows.columns if c != "rest"]
    state, level, closed, old = rows.withColumn("gid", F.lit(0).cast("long")), 0, [], None
    while True:
        keyed = state.withColumns({
            "block": F.substring("rest", 1, block),
            "ended": F.octet_length("rest") <= block,
        })
        groups = keyed.groupBy("gid", "block", "ended").count().where("count > 1").drop("count")
        groups, groups_at = scratch.save(groups.withColumn("next_gid", F.monotonically_increasing_id()))
        # merged at every size: a broadcast of the groups would end with their growth
        split = keyed.join(groups.hint("merge"), ["gid", "block", "ended"], "left").select(
            *keep, F.lit(level).alias("level"), F.col("next_gid").alias("gid"),
            F.when(F.col("next_gid").isNotNull() & ~F.col("ended"), F.substring("rest", block + 1, 2**31 - 1)).alias("rest"),
        )
        split, at = scratch.save(split)
        scratch.drop(groups_at)
        closed.append(split.where("rest is null").drop("rest"))
        state = split.where("rest is not null").drop("level")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, closed)
        level, block = level + 1, min(block * widen, 2**30)


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    t = F.coalesce(F.col(text), F.lit(""))
    rest = without_space(t).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), F.length(t).cast("long").alias("n_chars"), F.sha2(rest, 256).alias("text_sha256"), rest.alias("rest"))
    found = radix_groups(rows, scratch)
    copies = found.where("gid is not null")
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id")
    best = copies.groupBy("level", "gid").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    best = best.select("level", "gid", "group_size", F.col("best.doc_id").alias("keep_id"))
    best, _ = scratch.save(best)  # a plain table: its join can be split where a group is hot
    joined = copies.join(best, ["level", "gid"])
    alone = found.where("gid is null").withColumns({"group_size": F.lit(1).cast("long"), "keep_id": F.col("doc_id")})
    columns = ["doc_id", "keep_id", "group_size", "text_sha256", "n_chars"]
    # the group in one column, so that rows are dealt by document too: (level, gid) alone may be hot
    chosen = F.row_number().over(Window.partitionBy("doc_id", F.struct("level", "gid")).orderBy(F.desc("n_chars"))) == 1
    joined = joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & chosen)
    return joined.select(*columns, "kept").unionByName(alone.select(*columns, F.lit(True).alias("kept")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies, with its columns; doc_id must be unique."""
    return docs.join(dedup(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
