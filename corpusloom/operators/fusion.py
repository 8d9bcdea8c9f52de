"""Fusing ranked lists: min-max weighted sums and reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.search import ranked

RRF_K = 60
POOL = 40


def min_max(value: Column, over) -> Column:
    """Scaled to [0, 1] within the window; 1 where all values are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(value.isNotNull(), 1.0))


def _weights(lexical: float, semantic: float) -> tuple[float, float]:
    if lexical < 0 or semantic < 0 or lexical + semantic == 0:
        raise ValueError("fusion weights must not be negative nor all zero")
    return lexical / (lexical + semantic), semantic / (lexical + semantic)


def _paired(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    a = lexical.select("query_id", "path", F.col("score").cast("double").alias("lexical_raw"), F.col("rank").alias("lexical_rank"))
    b = semantic.select("query_id", "path", F.col("similarity").alias("semantic_raw"), F.col("rank").alias("semantic_rank"))
    return a.join(b, ["query_id", "path"], "full_outer")


def weighted_fusion(lexical: DataFrame, semantic: DataFrame, weights=(0.5, 0.5), limit: int = 8) -> DataFrame:
    """Weighted sum of the min-max scaled scores; a missing side adds nothing."""
    wl, ws = _weights(*weights)
    query = Window.partitionBy("query_id")
    both = _paired(lexical, semantic)
    both = both.withColumns({
        "lexical_contribution": F.coalesce(wl * min_max(F.col("lexical_raw"), query), F.lit(0.0)),
        "semantic_contribution": F.coalesce(ws * min_max(F.col("semantic_raw"), query), F.lit(0.0)),
    })
    both = both.withColumn("hybrid_score", F.col("lexical_contribution") + F.col("semantic_contribution")).withColumn("fusion_strategy", F.lit("weighted"))
    return ranked(both, "hybrid_score", limit)


def rrf_fusion(lexical: DataFrame, semantic: DataFrame, weights=(0.5, 0.5), k: int = RRF_K, limit: int = 8) -> DataFrame:
    """Sum of weight / (k + rank); a missing side adds nothing."""
    wl, ws = _weights(*weights)
    both = _paired(lexical, semantic)
    both = both.withColumns({
        "lexical_contribution": F.coalesce(wl / (k + F.col("lexical_rank")), F.lit(0.0)),
        "semantic_contribution": F.coalesce(ws / (k + F.col("semantic_rank")), F.lit(0.0)),
    })
    both = both.withColumn("hybrid_score", F.col("lexical_contribution") + F.col("semantic_contribution")).withColumn("fusion_strategy", F.lit("rrf"))
    return ranked(both, "hybrid_score", limit)
