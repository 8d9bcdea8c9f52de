"""Queries over diagnostics, bound to documents as candidates and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import context as C
from corpusloom.operators import diagnostics as D
from corpusloom.plans.bind import table
from corpusloom.plans.context_plans import BUDGET, CANDIDATES_SQL, GREEDY_SQL, _candidates


def _selection(spark, d):
    return C.select_within_budget(C.rank_candidates(_candidates(spark, d)), BUDGET)


def discovery_sources(spark, d):
    """Which stage found a document first, of stages that see every third, fifth and seventh."""
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("path"))
    stages = {"retrieval": docs.where("path % 3 = 0"), "symbol": docs.where("path % 5 = 0"), "dependency": docs.where("path % 7 = 0"), "change_plan": docs.where("path % 2 = 0")}
    return D.discovery_source(D.trace(stages))


def competing_rows(spark, d):
    return D.competing(_selection(spark, d)).select("query_id", "path", F.col("position").cast("bigint").alias("position"), "ahead", "ahead_tokens")


def top_excluded(spark, d):
    return D.top_lost(_selection(spark, d), None, 10)


def _surface(spark, d):
    docs = table(spark, d, "documents")
    tag = F.when(F.col("doc_id") % 8 == 0, "required").when(F.col("doc_id") % 8 == 4, "supporting").when(F.col("doc_id") % 8 == 2, "test")
    return docs.select(F.col("source").alias("query_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), tag.alias("tag")).where("tag is not null")


_SURFACE_SQL = "surf AS (SELECT folder AS query_id, path, CASE doc_id % 8 WHEN 0 THEN 'required' WHEN 4 THEN 'supporting' ELSE 'test' END AS tag FROM files WHERE doc_id % 8 IN (0, 2, 4))"


def surface_tags(spark, d):
    c = D.tagged(_candidates(spark, d).select("query_id", "path"), _surface(spark, d))
    return c.groupBy("query_id", "tag").agg(F.count("*").alias("files"))


def task_coverage(spark, d):
    r = C.rank_candidates(_candidates(spark, d)).select(F.lit("ranked").alias("strategy"), "query_id", "path", F.col("position").alias("rank"), "tokens")
    t = D.task_coverage(r, _surface(spark, d), 10)
    return t.select("strategy", "query_id", "files", *[F.round(c, 6).alias(c) for c in t.columns[3:]])


COVERAGE_SQL = f"""WITH {CANDIDATES_SQL}, {_SURFACE_SQL}, g AS (SELECT r.query_id AS q, count(*) AS files, sum(tokens) AS tokens, count(*) FILTER (tag = 'required') AS req, count(*) FILTER (tag = 'supporting') AS sup, count(*) FILTER (tag = 'test') AS tst
  FROM ranked r LEFT JOIN surf s ON s.query_id = r.query_id AND s.path = r.path WHERE position <= 10 GROUP BY r.query_id),
w AS (SELECT query_id, count(*) FILTER (tag = 'required') AS ar, count(*) FILTER (tag = 'supporting') AS asup, count(*) FILTER (tag = 'test') AS atst FROM surf GROUP BY query_id),
x AS (SELECT coalesce(q, query_id) AS query_id, coalesce(files, 0) AS files, coalesce(tokens, 0) AS tokens, coalesce(req, 0) AS req, coalesce(sup, 0) AS sup, coalesce(tst, 0) AS tst, ar, asup, atst FROM g FULL JOIN w ON q = query_id),
m AS (SELECT *, CASE WHEN files > 0 THEN req / files ELSE 0 END AS p, CASE WHEN coalesce(ar, 0) > 0 THEN req / ar ELSE 0 END AS r FROM x)
SELECT 'ranked' AS strategy, query_id, files, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(CASE WHEN coalesce(asup, 0) > 0 THEN sup / asup ELSE 0 END, 6) AS supporting_recall,
  round(CASE WHEN coalesce(atst, 0) > 0 THEN tst / atst ELSE 0 END, 6) AS test_recall, round(CASE WHEN req > 0 THEN tokens / req ELSE 0 END, 6) AS tokens_per_required_file FROM m"""


def scenario_states(spark, d):
    """Expected relations of nations against those that trade shows."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("path"), F.when(F.col("s_acctbal") > 0, "call").otherwise("import").alias("relationship"), F.lit("incoming").alias("direction"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("path"), F.when(F.col("c_acctbal") > 4000, "call").otherwise("import").alias("relationship"), F.lit("incoming").alias("direction"))
    return D.scenario_check(s, c, exact=True)


SCENARIO_SQL = """WITH f AS (SELECT DISTINCT s_nationkey::VARCHAR AS path, CASE WHEN s_acctbal > 0 THEN 'call' ELSE 'import' END AS relationship FROM supplier), e AS (SELECT DISTINCT c_nationkey::VARCHAR AS path, CASE WHEN c_acctbal > 4000 THEN 'call' ELSE 'import' END AS relationship FROM customer)
SELECT coalesce(e.path, f.path) AS path, coalesce(e.relationship, f.relationship) AS relationship, 'incoming' AS direction, CASE WHEN e.path IS NOT NULL AND f.path IS NOT NULL THEN 'found' WHEN e.path IS NOT NULL THEN 'missing' ELSE 'unexpected' END AS state FROM e FULL JOIN f ON e.path = f.path AND e.relationship = f.relationship"""

QUERIES = {f.__name__: f for f in (discovery_sources, competing_rows, top_excluded, surface_tags, task_coverage, scenario_states)}
ORACLE_SQL = {
    "discovery_sources": "WITH t AS (SELECT source AS query_id, doc_id AS path, unnest([CASE WHEN doc_id % 3 = 0 THEN 'retrieval' END, CASE WHEN doc_id % 5 = 0 THEN 'symbol' END, CASE WHEN doc_id % 7 = 0 THEN 'dependency' END, CASE WHEN doc_id % 2 = 0 THEN 'change_plan' END]) AS stage, unnest([0, 1, 2, 4]) AS o FROM documents) SELECT query_id, path, arg_min(stage, o) AS source, count(DISTINCT stage) AS stages FROM t WHERE stage IS NOT NULL GROUP BY ALL",
    "competing_rows": f"{GREEDY_SQL}, c AS (SELECT *, coalesce(sum(CASE WHEN selected THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS ahead, coalesce(sum(CASE WHEN selected THEN tokens ELSE 0 END) OVER w, 0)::BIGINT AS ahead_tokens FROM greedy WINDOW w AS (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT query_id, path, position, ahead, ahead_tokens FROM c WHERE NOT selected",
    "top_excluded": f"{GREEDY_SQL} SELECT path, count(*) AS losses, max(tokens) AS tokens FROM greedy WHERE NOT selected GROUP BY path ORDER BY losses DESC, path LIMIT 10",
    "surface_tags": f"WITH {CANDIDATES_SQL}, {_SURFACE_SQL} SELECT c.query_id, coalesce(tag, 'other') AS tag, count(*) AS files FROM cand c LEFT JOIN surf s ON s.query_id = c.query_id AND s.path = c.path GROUP BY ALL",
    "task_coverage": COVERAGE_SQL,
    "scenario_states": SCENARIO_SQL,
}
