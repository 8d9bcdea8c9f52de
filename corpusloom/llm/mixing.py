"""Mixing sources to target weights, in DataFrame functions only.

Tokens (words) are summed per source, each source gets a target share of the
mix, and a document is emitted floor(rate) times plus one more time when a
number hashed from its key and text falls below the fraction, rate being the source's
target over its size.

Defined cases. Null text: size 0. Null source: a source of its own, ordered
last. Empty table: empty result. A source without words: target and rate 0, so
its documents are not taken. Repeated rows: each counts towards its source. A
draw depends on key and text, so only rows equal in both share one, and texts
under one key or under none are drawn apart. Very long texts are counted whole.
All columns pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, fresh_name, word_count

#: Targets are broadcast up to so many sources, and joined by shuffle beyond.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: (source, source_size, target).

    sizes: (source, size). The targets' sum is share times all words, dealt
    by weight; none exceeds cap times its source's size. Filling sources in the
    order of cap over weight gives the fixed point of resharing the excess.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_rank", F.row_number().over(by_name)).withColumn(
        "_w", F.element_at(table, ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    )
    per = per.withColumn("_cap", cap * F.col("source_size").cast("double"))
    per = per.withColumn("_fill", F.col("_cap") / F.col("_w"))
    filling = Window.orderBy("_fill", "_rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_total", share * F.sum("source_size").over(everything).cast("double"))
    before = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("_w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("_level", (F.col("_total") - before) / onward)
    per = per.withColumn("_full", F.col("_level") >= F.col("_fill"))
    spent = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * (F.col("_total") - spent) / free)
    return per.select("source", "source_size", target.alias("target"))


def uniform(key: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key, the text and the seed only."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / float(2**52)


def repetitions(docs: DataFrame, key="doc_id", text="text", source="source", seed="mix", **targets) -> tuple[DataFrame, dict[str, str]]:
    """docs with four more columns, and what they are called: size, source_size, target, copies."""
    named = {n: fresh_name(docs, f"_mix_{n}") for n in ("size", "source_size", "target", "copies", "source")}
    scratch = Scratch(docs.sparkSession, "mixing")
    shares, _ = scratch.save(source_targets(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")), **targets))
    shares = shares.select(F.col("source").alias(named["source"]), F.col("source_size").alias(named["source_size"]), F.col("target").alias(named["target"]))
    few = shares.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    sized = docs.withColumn(named["size"], word_count(F.col(text)))
    joined = sized.join(F.broadcast(shares) if few else shares, sized[source].eqNullSafe(shares[named["source"]]), "left")
    rate = F.when(F.col(named["source_size"]) > 0, F.col(named["target"]) / F.col(named["source_size"])).otherwise(0.0)
    whole = F.floor(rate)
    extra = (uniform(F.col(key), F.col(text), seed) < rate - whole).cast("long")
    return joined.withColumn(named["copies"], whole + extra).drop(named["source"]), named


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each as often as it is taken, with docs' columns."""
    found, named = repetitions(docs, **options)
    copies = F.sequence(F.lit(1), F.col(named["copies"]).cast("int"))
    return found.where(F.col(named["copies"]) > 0).withColumn(named["source"], F.explode(copies)).select(*docs.columns)


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    found, named = repetitions(docs.select("doc_id", "text", "source"), **options)
    return found.select(
        "doc_id", F.col(named["size"]).alias("size"), F.col(named["source_size"]).alias("source_size"),
        F.col(named["target"]).alias("target"), (F.col(named["size"]) * F.col(named["copies"])).alias("taken"),
    )


SQL = r"""
WITH s AS (
  SELECT doc_id, source, coalesce(text, '') AS text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM p
), w AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM r
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= cap / w AS is_full FROM w
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
    w * (total - sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER ()) / nullif(sum(CASE WHEN is_full THEN 0.0 ELSE w END) OVER (), 0) END AS target FROM l
), d AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null') || ':' || s.text), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM d
"""
