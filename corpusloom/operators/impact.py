"""Change impact: relations merged by priority, per-item and overall risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values per relationship: which one wins, where it sorts.
PRIORITY = {
    "test": 10, "configuration": 9, "direct_caller": 8, "api_consumer": 7, "direct_dependency": 6,
    "indirect_caller": 5, "indirect_dependency": 4, "direct_callee": 3, "indirect_callee": 2, "reverse_dependency": 1,
}
BUCKET = {
    "direct_caller": 0, "direct_callee": 1, "direct_dependency": 2, "test": 3, "indirect_caller": 4,
    "indirect_callee": 5, "indirect_dependency": 6, "api_consumer": 7, "configuration": 8, "reverse_dependency": 9,
}
# The risk of an item by its relationship (an API consumer's is high for a public symbol).
ITEM_RISK = {
    "direct_dependency": "high", "direct_caller": "high", "api_consumer": "medium", "test": "medium", "indirect_dependency": "medium",
    "indirect_caller": "medium", "direct_callee": "medium", "indirect_callee": "low", "configuration": "medium", "reverse_dependency": "low",
}
COUNTED = {
    "direct_dependency": "direct_dependents", "indirect_dependency": "indirect_dependents", "test": "tests", "api_consumer": "api_consumers",
    "configuration": "configuration", "reverse_dependency": "reverse_dependencies", "direct_caller": "direct_callers",
    "indirect_caller": "indirect_callers", "direct_callee": "direct_callees", "indirect_callee": "indirect_callees",
}


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def merge_items(relations: DataFrame, by: str = "target") -> DataFrame:
    """One row per (by, path) of all relations found for it.

    relations: (by, seq, path, relationship, reason, evidence array, depth, symbol).
    The relationship of highest priority wins with its reason (the earliest of equal
    ones), evidence is joined in order, and symbol and depth are the first that are set.
    """
    rows = relations.withColumn("_p", lookup(PRIORITY, F.col("relationship")))
    order = F.struct(-F.col("_p"), F.col("seq"))
    merged = rows.groupBy(by, "path").agg(
        F.min_by("relationship", order).alias("relationship"), F.min_by("reason", order).alias("reason"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"]))).alias("evidence"),
        F.min_by("symbol", F.when(F.coalesce(F.col("symbol"), F.lit("")) != "", F.col("seq"))).alias("symbol"),
        F.coalesce(F.min_by("depth", F.when(F.col("depth") != 0, F.col("seq"))), F.lit(0)).alias("depth"),
    )
    return merged


def item_risk(relationship: Column, public: Column) -> Column:
    return F.when((relationship == "api_consumer") & public, "high").otherwise(lookup(ITEM_RISK, relationship))


def ordered_items(items: DataFrame, by: str = "target", limit: int | None = None) -> DataFrame:
    """With position: by bucket of the relationship, depth and path."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(lookup(BUCKET, F.col("relationship")), "depth", "path"))
    out = items.withColumn("position", place)
    return out if limit is None else out.where(F.col("position") <= limit)


def impact_summary(items: DataFrame, by: str = "target") -> DataFrame:
    """One row per target with a count per relationship."""
    return items.groupBy(by).agg(*[F.count_if(F.col("relationship") == r).alias(name) for r, name in COUNTED.items()])


def overall_risk(summary: DataFrame) -> DataFrame:
    """With points and risk, from the counts, exported (boolean) and max_depth_reached."""
    points = (
        F.least(F.col("direct_dependents"), F.lit(5)) * 2 + F.least(F.col("indirect_dependents"), F.lit(3)) + F.least(F.col("tests"), F.lit(2))
        + F.when(F.col("api_consumers") > 0, 2).otherwise(0) + F.when(F.col("exported"), 1).otherwise(0) + F.when(F.col("max_depth_reached") >= 3, 1).otherwise(0)
    )
    risk = F.when(F.col("points") >= 8, "high").when(F.col("points") >= 4, "medium").otherwise("low")
    return summary.withColumn("points", points.cast("bigint")).withColumn("risk", risk)


def merge_surface(items: DataFrame) -> DataFrame:
    """One row per (path, direction, relationship): the nearest with its reason, evidence joined."""
    return items.groupBy("path", "direction", "relationship").agg(
        F.min("depth").alias("depth"), F.min_by(F.struct("reason", "source"), F.struct("depth", "seq")).alias("_x"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    ).select("path", "direction", "relationship", "depth", F.col("_x.reason").alias("reason"), F.col("_x.source").alias("source"), "evidence")


def surface_views(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a surface: what is directly affected, what transitively, and its distinct files.

    Files come as (path, position), numbered by their first place in the surface.
    """
    first = items.groupBy("path").agg(F.min("position").alias("_at"))
    files = first.select("path", F.row_number().over(Window.orderBy("_at")).alias("position"))
    return items.where("depth = 1"), items.where("depth >= 2"), files


def surface_summary(items: DataFrame) -> DataFrame:
    """Counts by relationship, by direction and by depth class in one pass."""
    spread = items.withColumn("depth_class", F.when(F.col("depth") <= 1, "direct").otherwise("transitive"))
    sets = [[F.col("relationship")], [F.col("direction")], [F.col("depth_class")]]
    return spread.groupingSets(sets, "relationship", "direction", "depth_class").agg(F.count("*").alias("items"))
