"""Retrieval quality: precision, recall, reciprocal rank and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.search import small


def per_query(retrieved: DataFrame, relevant: DataFrame, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, retrieved, relevant, hits, precision, recall, reciprocal_rank).

    retrieved: (query_id, path, rank); relevant: (query_id, path). Precision divides
    by what was retrieved. Every query of ``queries`` (query_id) gets a row, else every query
    that has relevant files; one without any scores 0.
    """
    truth = relevant.select("query_id", "path").distinct()
    want = truth.groupBy("query_id").agg(F.count("*").alias("relevant"))
    if queries is not None:
        want = queries.select("query_id").distinct().join(want, "query_id", "left")
    return _scores(_top(retrieved, k), truth, want)


def per_query_by_label(retrieved: DataFrame, members: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """per_query where the members of a query's labels are its relevant files.

    members: (path, label); queries: (query_id, label), a row for each label of a query. Members
    are counted once for each set of labels and looked up for what was retrieved, so they are
    never listed query by query.
    """
    top = _top(retrieved, k)
    members, queries = (t.where("label is not null").distinct() for t in (members.select("path", "label"), queries.select("query_id", "label")))
    asked = queries.groupBy("query_id").agg(F.sort_array(F.collect_set("label")).alias("_labels"))
    sets = small(asked.select("_labels").distinct().select("_labels", F.explode("_labels").alias("label")))
    counts = members.join(sets, "label").select("_labels", "path").distinct().groupBy("_labels").agg(F.count("*").alias("relevant"))
    truth = top.select("query_id", "path").join(queries, "query_id").join(members, ["path", "label"]).select("query_id", "path").distinct()
    return _scores(top, truth, asked.join(counts, "_labels").select("query_id", "relevant"))


def _top(retrieved: DataFrame, k: int) -> DataFrame:
    if k < 1:
        raise ValueError("k must be positive")
    return retrieved.where(F.col("rank") <= k).select("query_id", "path", "rank")


def _scores(top: DataFrame, truth: DataFrame, want: DataFrame) -> DataFrame:
    """The rows of per_query; truth: the distinct relevant (query_id, path), at least those in top."""
    joined = top.join(truth.withColumn("_hit", F.lit(1)), ["query_id", "path"], "left")
    got = joined.groupBy("query_id").agg(
        F.count("*").alias("retrieved"), F.count("_hit").alias("hits"), F.min(F.when(F.col("_hit").isNotNull(), F.col("rank"))).alias("first_rank")
    )
    out = want.join(got, "query_id", "left").fillna(0, ["retrieved", "relevant", "hits"])
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select(
        "query_id", "retrieved", "relevant", "hits", part("hits", "retrieved").alias("precision"), part("hits", "relevant").alias("recall"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def summary(cases: DataFrame) -> DataFrame:
    """One row: number of queries, mean precision and recall, MRR; 0 when empty."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return cases.agg(F.count("*").alias("queries"), mean("precision").alias("mean_precision"), mean("recall").alias("mean_recall"), mean("reciprocal_rank").alias("mrr"))


def strategy_summary(cases: DataFrame, metrics: list[str], by: str = "strategy") -> DataFrame:
    """Mean and median of each metric per strategy."""
    return cases.groupBy(by).agg(F.count("*").alias("cases"), *[x for m in metrics for x in (F.avg(m).alias(f"mean_{m}"), F.median(m).alias(f"median_{m}"))])


def latency(values: DataFrame, column: str, *by: str) -> DataFrame:
    """Median, 95th percentile (interpolated), smallest and largest."""
    return values.groupBy(*by).agg(
        F.count(column).alias("runs"), F.percentile(column, F.lit(0.5)).alias("median"), F.percentile(column, F.lit(0.95)).alias("p95"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    )


def coverage(required: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, missing, is_subset): what is required and was not found."""
    lost = required.join(found.select("query_id", "path"), ["query_id", "path"], "left_anti").groupBy("query_id").agg(F.count("*").alias("missing"))
    every = required.select("query_id").distinct()
    out = every.join(lost, "query_id", "left").fillna(0, ["missing"])
    return out.withColumn("is_subset", F.col("missing") == 0)


#: How far a required file came, most to least.
OUTCOMES = ("SELECTED", "RANKED_NOT_SELECTED", "DISCOVERED_NOT_RANKED", "NOT_DISCOVERED")


def outcomes(required: DataFrame, discovered: DataFrame, ranked: DataFrame, selected: DataFrame) -> DataFrame:
    """(query_id, path, outcome) for each required file."""
    out = required.select("query_id", "path").distinct()
    for name, table in (("_d", discovered), ("_r", ranked), ("_s", selected)):
        mark = table.select("query_id", "path").distinct().withColumn(name, F.lit(True))
        out = out.join(mark, ["query_id", "path"], "left")
    label = F.when(F.col("_s"), OUTCOMES[0]).when(F.col("_r"), OUTCOMES[1]).when(F.col("_d"), OUTCOMES[2]).otherwise(OUTCOMES[3])
    return out.select("query_id", "path", label.alias("outcome"))
