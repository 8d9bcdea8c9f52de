"""Diagnostics: pipeline traces, surface tags, lost files, task coverage, event records."""

from __future__ import annotations

import json
import logging
import os
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.impact import lookup

LOG = logging.getLogger("corpusloom.diagnostics")
SWITCH = "CORPUSLOOM_DIAGNOSTICS"
# Which stage counts as a path's source, and which tag wins.
STAGE_ORDER = {"retrieval": 0, "symbol": 1, "dependency": 2, "architecture": 3, "change_plan": 4}
TAG_ORDER = {"required": 0, "supporting": 1, "test": 2}
MAX_CANDIDATES = 50


def record(event: str, **fields) -> None:
    """One JSON line on the logger if diagnostics are switched on; never source text."""
    if os.environ.get(SWITCH):
        LOG.info(json.dumps({"event": event, **fields}, sort_keys=True, default=str))


@contextmanager
def timed(event: str, **fields):
    began = time.perf_counter()
    try:
        yield
    finally:
        record(event, seconds=round(time.perf_counter() - began, 6), **fields)


def trace(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, query_id, path): what each stage of a pipeline produced, as one table."""
    parts = [df.select(F.lit(s).alias("stage"), "query_id", "path").distinct() for s, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def discovery_source(traced: DataFrame) -> DataFrame:
    """(query_id, path, source, stages): the first discovery stage of each path."""
    known = traced.where(F.col("stage").isin(*STAGE_ORDER)).withColumn("_o", lookup(STAGE_ORDER, F.col("stage")))
    return known.groupBy("query_id", "path").agg(F.min_by("stage", "_o").alias("source"), F.count_distinct("stage").alias("stages"))


def surface_tag(required: Column, supporting: Column, test: Column) -> Column:
    """required, supporting, test or other, from membership flags."""
    return F.when(required, "required").when(supporting, "supporting").when(test, "test").otherwise("other")


def tagged(rows: DataFrame, surface: DataFrame) -> DataFrame:
    """rows (query_id, path, ...) with tag; surface: (query_id, path, tag)."""
    best = surface.withColumn("_o", lookup(TAG_ORDER, F.col("tag"))).groupBy("query_id", "path").agg(F.min_by("tag", "_o").alias("tag"))
    return rows.join(best, ["query_id", "path"], "left").fillna("other", ["tag"])


def top_lost(selection: DataFrame, reason: str | None = None, limit: int = 10) -> DataFrame:
    """(path, losses, tokens): the files most often excluded."""
    lost = selection.where(~F.col("selected"))
    lost = lost if reason is None else lost.where(F.col("reason") == reason)
    return lost.groupBy("path").agg(F.count("*").alias("losses"), F.max("tokens").alias("tokens")).orderBy(F.desc("losses"), "path").limit(limit)


def competing(selection: DataFrame) -> DataFrame:
    """(query_id, path, position, ahead, ahead_tokens): of an excluded file, what was selected before it.

    Running sums over a query's ranks, not a join of ranks on ranks.
    """
    before = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.when(F.col("selected"), 1).otherwise(0)
    out = selection.withColumns({
        "ahead": F.coalesce(F.sum(taken).over(before), F.lit(0)), "ahead_tokens": F.coalesce(F.sum(taken * F.col("tokens")).over(before), F.lit(0)).cast("bigint"),
    })
    return out.where(~F.col("selected")).select("query_id", "path", "position", "ahead", "ahead_tokens")


def task_coverage(retrieved: DataFrame, surface: DataFrame, cap: int = MAX_CANDIDATES) -> DataFrame:
    """Per query and strategy: precision, recall, F1, recalls by tag, tokens per required file.

    retrieved: (strategy, query_id, path, rank, tokens); surface: (query_id, path, tag).
    The first cap files count; empty surfaces, and tasks for which a strategy retrieved nothing,
    give 0.
    """
    if cap < 1:
        raise ValueError("cap must be positive")
    tag = tagged(retrieved.where(F.col("rank") <= cap), surface)
    count = lambda t: F.count_if(F.col("tag") == t)
    got = tag.groupBy("strategy", "query_id").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), *[count(t).alias(t) for t in TAG_ORDER])
    want = tagged(surface.select("query_id", "path").distinct(), surface).groupBy("query_id").agg(*[count(t).alias(f"all_{t}") for t in TAG_ORDER])
    names = [r.strategy for r in retrieved.select("strategy").distinct().collect()]  # as many as are configured
    tasks = want.select("query_id").union(got.select("query_id")).distinct()
    every = tasks.select("query_id", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("strategy"))
    j = every.join(got, ["strategy", "query_id"], "left").join(want, "query_id", "left").fillna(0)
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = part(F.col("required"), F.col("files")), part(F.col("required"), F.col("all_required"))
    return j.select(
        "strategy", "query_id", "files", p.alias("precision"), r.alias("recall"), part(2 * p * r, p + r).alias("f1"),
        part(F.col("supporting"), F.col("all_supporting")).alias("supporting_recall"), part(F.col("test"), F.col("all_test")).alias("test_recall"),
        part(F.col("tokens"), F.col("required")).alias("tokens_per_required_file"),
    )


def recurrences(outcomes: DataFrame) -> DataFrame:
    """(path, outcome, queries): outcomes that befall a file in more than one query."""
    return outcomes.groupBy("path", "outcome").agg(F.count_distinct("query_id").alias("queries")).where("queries > 1")


def scenario_check(items: DataFrame, expected: DataFrame, exact: bool = False) -> DataFrame:
    """(path, relationship, direction, state): found, missing and, if exact, unexpected."""
    keys = ["path", "relationship", "direction"]
    a = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    b = items.select(*keys).distinct().withColumn("_f", F.lit(True))
    state = F.when(F.col("_e") & F.col("_f"), "found").when(F.col("_e"), "missing").otherwise("unexpected")
    out = a.join(b, keys, "full_outer").select(*keys, state.alias("state"))
    return out if exact else out.where("state <> 'unexpected'")
