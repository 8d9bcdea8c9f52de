"""Context assembly: candidate ranking, first-seen dedupe, token budgets, focus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import CHARS_PER_TOKEN

DEFAULT_BUDGET = 8000
LAST = 10**9
FOCUS_SPANS, FALLBACK_SPANS = 8, 3


def rank_key(has: set[str]) -> list[Column]:
    """Sort columns of candidates: primaries, then expansions, then change-plan ones.

    has: the columns there are; others count as unset.
    """
    col = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in has else F.lit(default)
    primary = F.col("role") == "primary"
    planned = col("inclusion_reason", "") == "change_plan"
    bucket = F.when(planned, 4).when(F.col("architecture_rank").isNotNull(), F.least(F.col("architecture_rank"), F.lit(2))).otherwise(3) if "architecture_rank" in has else F.when(planned, 4).otherwise(3)
    return [
        F.when(primary, 0).otherwise(1),
        F.when(primary, col("retrieval_rank", LAST)).otherwise(bucket),
        F.when(primary, F.when(col("inclusion_reason", "") == "symbol_match", 0).otherwise(1)).otherwise(F.when(planned, col("change_priority", LAST)).otherwise(col("graph_distance", LAST))),
        F.when(primary, -col("retrieval_score", 0.0)).otherwise(F.when(planned, F.lit(0.0)).otherwise(F.when(F.col("role") == "dependent", 0.0).otherwise(1.0))),
        F.col("path"),
    ]


def rank_candidates(candidates: DataFrame, by: str = "query_id") -> DataFrame:
    """With position: 1-based rank per query in the total order of rank_key."""
    return candidates.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*rank_key(set(candidates.columns)))))


def first_seen(candidates: DataFrame, by: str = "query_id") -> DataFrame:
    """One row per path: that of the lowest seq."""
    n = F.row_number().over(Window.partitionBy(by, "path").orderBy("seq"))
    return candidates.withColumn("_n", n).where("_n = 1").drop("_n")


def select_within_budget(ranked: DataFrame, budget: int | None, by: str = "query_id") -> DataFrame:
    """(by, path, position, tokens, selected, reason, remaining_before): greedy in rank order.

    A candidate that doesn't fit what is left is passed over and later ones may still
    fit, so this is a fold, here over each query's sorted candidates.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col("position"), F.col("path"), F.col("tokens").cast("bigint").alias("tokens"))))
    whole = F.lit(budget).cast("bigint")
    none = F.array().cast("array<struct<position:int,path:string,tokens:bigint,selected:boolean,reason:string,remaining_before:bigint>>")

    def step(state: Column, x: Column) -> Column:
        fits = F.lit(True) if budget is None else x["tokens"] <= state["left"]
        reason = F.when(fits, F.lit(None).cast("string")).when(state["left"] == whole, "exceeds_total_budget").otherwise("over_budget")
        row = F.struct(x["position"].cast("int").alias("position"), x["path"].alias("path"), x["tokens"].alias("tokens"), fits.alias("selected"), reason.alias("reason"), state["left"].alias("remaining_before"))
        return F.struct(F.when(fits, state["left"] - x["tokens"]).otherwise(state["left"]).alias("left"), F.concat(state["rows"], F.array(row)).alias("rows"))

    folded = ranked.groupBy(by).agg(items.alias("_items")).select(by, F.aggregate("_items", F.struct(whole.alias("left"), none.alias("rows")), step, lambda s: s["rows"]).alias("_rows"))
    return folded.select(by, F.explode("_rows").alias("x")).select(by, "x.*")


def select_with_focus(ranked: DataFrame, spans: DataFrame, budget: int, by: str = "query_id", truncate: bool = False) -> DataFrame:
    """(by, path, position, start_line, end_line, tokens, selected, reason).

    As select_within_budget; a file that doesn't fit may be cut to what is left
    (truncate), or else its named spans, the first eight with evidence or the first
    three, are taken where they fit and don't overlap spans taken before.

    ranked: (by, path, position, tokens); spans: (by, path, start_line, end_line,
    tokens, evidence boolean). A query's candidates are few by construction.
    """

    def run(key, items: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        left, out, taken = budget, [], {}
        by_path = {p: g for p, g in parts.sort_values(["start_line", "end_line"]).groupby("path")} if len(parts) else {}
        for r in items.sort_values("position").itertuples():
            if r.tokens <= left:
                out.append((key[0], r.path, r.position, None, None, r.tokens, True, None))
                left -= r.tokens
                continue
            if truncate and left > 0:
                out.append((key[0], r.path, r.position, None, None, left, True, "truncated"))
                left = 0
                continue
            reason = "exceeds_total_budget" if left == budget else "over_budget"
            group = by_path.get(r.path)
            if group is not None:
                named = group[group["evidence"]].head(FOCUS_SPANS)
                for s in (named if len(named) else group.head(FALLBACK_SPANS)).itertuples():
                    clash = any(s.start_line <= b and a <= s.end_line for a, b in taken.get(r.path, ()))
                    if s.tokens <= left and not clash:
                        out.append((key[0], r.path, r.position, s.start_line, s.end_line, s.tokens, True, None))
                        taken.setdefault(r.path, []).append((s.start_line, s.end_line))
                        left -= s.tokens
            out.append((key[0], r.path, r.position, None, None, r.tokens, False, reason))
        return pd.DataFrame(out, columns=[by, "path", "position", "start_line", "end_line", "tokens", "selected", "reason"])

    kind = ranked.schema[by].dataType.simpleString()
    fresh = spans.select(*[F.col(c).alias(c) for c in spans.columns])  # spans may derive from ranked
    return ranked.select(by, "path", "position", "tokens").groupBy(by).cogroup(fresh.groupBy(by)).applyInPandas(
        run, f"{by} {kind}, path string, position int, start_line int, end_line int, tokens bigint, selected boolean, reason string")


def with_spans(taken: DataFrame, spans: DataFrame, paths: list[str] | None = None, by: str = "query_id") -> DataFrame:
    """Each whole file, followed by one item for each of its spans; paths limits which files.

    taken: (by, path, position, start_line, end_line, tokens); spans: (path, start_line,
    end_line, tokens). Pieces that are spans already stay as they are. Items are numbered
    by item in the order of position, start and end line.
    """
    whole = taken.where("start_line is null")
    whole = whole if paths is None else whole.where(F.col("path").isin(paths))
    columns = [by, "path", "position", "start_line", "end_line", "tokens"]
    parts = whole.select(by, "path", "position").join(spans.select("path", "start_line", "end_line", "tokens").distinct(), "path").select(*columns)
    order = [F.col("position"), F.col("start_line").asc_nulls_first(), F.col("end_line")]
    return taken.select(*columns).unionByName(parts).withColumn("item", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def truncated(source: Column, remaining: int) -> Column:
    return F.left(source, F.lit(remaining * CHARS_PER_TOKEN))


def budget_spend(selection: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """With spent_before, spent_after and remaining_after: running sums of what was selected."""
    order = Window.partitionBy(by).orderBy("position")
    used = F.when(F.col("selected"), F.col("tokens")).otherwise(0)
    after = F.sum(used).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return selection.withColumns({"spent_before": (after - used).cast("bigint"), "spent_after": after.cast("bigint"), "remaining_after": (F.lit(budget) - after).cast("bigint")})


def exclusion_category(reason: Column) -> Column:
    """Of an exclusion's reason; null of none."""
    return (
        F.when(reason == "exceeds_total_budget", "exceeds_total_budget").when(reason == "over_budget", "remaining_budget_too_small")
        .when(reason == "duplicate", "duplicate").when(reason.isNotNull(), "other")
    )


def budget_report(selection: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """Use of the budget per query, and counts per category."""
    chosen = F.when(F.col("selected"), F.col("tokens"))
    return selection.groupBy(by).agg(
        F.count_if("selected").alias("selected_items"), F.count_if(~F.col("selected")).alias("excluded_items"),
        F.coalesce(F.sum(chosen), F.lit(0)).cast("bigint").alias("spent"), F.avg(chosen).alias("mean_selected_tokens"), F.median(chosen).alias("median_selected_tokens"),
        F.count_if(F.col("reason") == "exceeds_total_budget").alias("oversized"), F.count_if(F.col("reason") == "over_budget").alias("over_budget"),
    ).withColumn("utilisation", F.col("spent") / F.lit(float(budget))).withColumn("unused", (F.lit(budget) - F.col("spent")).cast("bigint"))
