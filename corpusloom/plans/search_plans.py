"""Queries over retrieval: lexical, semantic, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import evaluate, fusion, search, semantic
from corpusloom.plans.bind import FILES_SQL, document_files, table
from corpusloom.plans.text_plans import SQL_TOKENS

ASKED = {"q1": "the and with src3", "q2": "nicht der und", "q3": "src7", "q4": "la une pour", "q5": "", "q6": "de en que los fr"}
_ASKED_SQL = "queries AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ASKED.items()) + ") v(query_id, query))"


def _files(spark, d):
    return document_files(spark, d)


def _layers():
    return {"path": F.col("path"), "import": F.col("imports"), "source": F.col("source")}


def _lexical(spark, d, limit):
    files = _files(spark, d)
    symbols = files.select("path", F.col("folder").alias("name"))
    return search.lexical_search(files, search.query_table(spark, ASKED), _layers(), symbols, limit)


def lexical_topk(spark, d):
    return _lexical(spark, d, 10).select("query_id", "path", "score", F.array_join("matched_terms", " ").alias("matched"), F.col("rank").cast("bigint").alias("rank"))


_TOK = SQL_TOKENS
LEXICAL_SQL = f"""WITH {FILES_SQL}, {_ASKED_SQL},
qt AS (SELECT query_id, term, min(i) AS pos FROM (SELECT query_id, unnest({_TOK.format('query')}) AS term, generate_subscripts({_TOK.format('query')}, 1) AS i FROM queries) GROUP BY ALL),
qc AS (SELECT query_id, string_agg(term, '' ORDER BY pos) AS compact, count(*) AS n FROM qt GROUP BY query_id),
post AS (
  SELECT DISTINCT path, 'path' AS layer, unnest({_TOK.format('path')}) AS term FROM files UNION ALL
  SELECT DISTINCT path, 'import', unnest({_TOK.format('imports')}) FROM files UNION ALL
  SELECT DISTINCT path, 'source', unnest({_TOK.format('source')}) FROM files),
hits AS (
  SELECT query_id, path, term, CASE layer WHEN 'path' THEN 5 WHEN 'import' THEN 3 ELSE 1 END AS points FROM post JOIN qt USING (term) UNION ALL
  SELECT query_id, path, term, 10 FROM (SELECT DISTINCT path, folder, unnest({_TOK.format('folder')}) AS term FROM files) JOIN qt USING (term) UNION ALL
  SELECT qc.query_id, path, qt.term, 100 FROM files JOIN qc ON array_to_string({_TOK.format('folder')}, '') = qc.compact JOIN qt ON qt.query_id = qc.query_id),
scored AS (SELECT query_id, path, sum(points)::BIGINT AS score FROM hits GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM scored)"""
LEXICAL_TOPK_SQL = LEXICAL_SQL + """, top AS (SELECT * FROM lex WHERE rank <= 10),
m AS (SELECT query_id, path, string_agg(term, ' ' ORDER BY pos) AS matched FROM (SELECT DISTINCT h.query_id, h.path, h.term, qt.pos FROM hits h JOIN qt ON qt.query_id = h.query_id AND qt.term = h.term) GROUP BY ALL)
SELECT query_id, path, score, matched, rank FROM top JOIN m USING (query_id, path)"""


def exact_symbol_match(spark, d):
    symbols = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")).alias("name"))
    return search.exact_symbols(symbols, search.query_table(spark, {"s1": "brand12 and Brand_34", "s2": "find brand_55 code"})).select("query_id", "token", "path", "name")


EXACT_SQL = """WITH q AS (SELECT * FROM (VALUES ('s1', 'brand12'), ('s1', 'brand_34'), ('s2', 'brand_55')) v(query_id, token)),
s AS (SELECT p_partkey::VARCHAR AS path, replace(p_brand, '#', '_') AS name FROM part)
SELECT query_id, token, path, name FROM q JOIN s ON lower(replace(name, '_', '')) = lower(replace(token, '_', ''))"""


def near_symbol_match(spark, d):
    symbols = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat_ws("_", F.replace(F.lower(F.col("p_type")), F.lit(" "), F.lit("_")), F.lit("x")).alias("name"))
    return search.near_symbols(symbols, search.query_table(spark, {"n1": "steel_promo brushed", "n2": "economy"})).select("query_id", "token", "path", "name")


NEAR_SQL = """WITH q AS (SELECT * FROM (VALUES ('n1', 'steel_promo', ['promo', 'steel']), ('n1', 'brushed', ['brushed']), ('n2', 'economy', ['economy'])) v(query_id, token, parts)),
s AS (SELECT p_partkey::VARCHAR AS path, replace(lower(p_type), ' ', '_') || '_x' AS name FROM part),
t AS (SELECT path, name, list_distinct(list_transform(regexp_extract_all(name, '[a-z0-9]+|[A-Z][a-z0-9]*'), lambda x: lower(x))) AS raw FROM s),
u AS (SELECT path, name, CASE WHEN len(list_filter(raw, lambda x: length(x) > 1)) > 0 THEN list_filter(raw, lambda x: length(x) > 1) ELSE raw END AS parts FROM t)
SELECT query_id, token, path, name FROM q JOIN u ON list_has_all(u.parts, q.parts) WHERE lower(replace(name, '_', '')) <> lower(replace(token, '_', ''))"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("vector"), "label")


def _probe(spark, d):
    """The stated query vectors: ids divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


def cosine_topk(spark, d):
    """The stated queries against all vectors."""
    found = semantic.semantic_search(_vectors(spark, d), _probe(spark, d), 10)
    return found.select("query_id", "path", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


_COS = "list_dot_product(list_transform({0}, lambda x: x::DOUBLE), list_transform({1}, lambda x: x::DOUBLE))"
SIM_SQL = f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
sim AS (SELECT q.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS path, CASE WHEN q.n * b.n > 0 THEN greatest(-1.0, least(1.0, list_dot_product(q.e, b.e) / (q.n * b.n))) ELSE 0 END AS similarity FROM n q JOIN n b ON q.vec_id % 20 = 0),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, path) AS rank FROM sim WHERE similarity > 0)"""
COSINE_SQL = f"WITH {SIM_SQL} SELECT query_id, path, round(similarity, 6) AS similarity, rank FROM sem WHERE rank <= 10"


def l2_normalised(spark, d):
    n = V.l2_normalise(F.col("vector"))
    return _vectors(spark, d).select("path", F.round(V.norm(F.col("vector")), 6).alias("norm"), F.round(V.norm(n), 6).alias("unit_norm"), F.round(F.get(n, F.lit(0)), 6).alias("first"))


L2_SQL = "WITH v AS (SELECT vec_id::VARCHAR AS path, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v) SELECT path, round(n, 6) AS norm, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS unit_norm, round(CASE WHEN n > 0 THEN e[1] / n ELSE e[1] END, 6) AS first FROM n"


def _two_lists(spark, d):
    """A lexical and a semantic ranking of the same vectors: label overlap, cosine."""
    sem = semantic.semantic_search(_vectors(spark, d), _probe(spark, d), 40)
    probe = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("label").alias("_l"))
    lex = _vectors(spark, d).join(search.small(probe)).select("query_id", "path", (F.when(F.col("label") == F.col("_l"), 100).otherwise(0) + F.length("path") * 3).cast("bigint").alias("score"))
    return search.ranked(lex, "score", 40), sem


_LISTS_SQL = f"""{SIM_SQL}, l0 AS (SELECT q.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS path, (CASE WHEN q.label = b.label THEN 100 ELSE 0 END + length(b.vec_id::VARCHAR) * 3)::BIGINT AS score FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0),
l1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM l0), lx AS (SELECT * FROM l1 WHERE rank <= 40), sx AS (SELECT * FROM sem WHERE rank <= 40),
lm AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w)::DOUBLE ELSE 1.0 END AS mm FROM lx WINDOW w AS (PARTITION BY query_id)),
sm AS (SELECT *, CASE WHEN max(similarity) OVER w > min(similarity) OVER w THEN (similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w) ELSE 1.0 END AS mm FROM sx WINDOW w AS (PARTITION BY query_id)),
j AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.path, s.path) AS path, l.mm AS lmm, s.mm AS smm, l.rank AS lr, s.rank AS sr FROM lm l FULL JOIN sm s ON l.query_id = s.query_id AND l.path = s.path)"""


def _fused(df):
    return df.select("query_id", "path", F.round("hybrid_score", 6).alias("hybrid_score"), F.col("rank").cast("bigint").alias("rank"), *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("lexical_rank", "semantic_rank")])


def weighted_fusion(spark, d):
    return _fused(fusion.weighted_fusion(*_two_lists(spark, d)))


def rrf_fusion(spark, d):
    return _fused(fusion.rrf_fusion(*_two_lists(spark, d)))


def _fusion_sql(score: str) -> str:
    return f"WITH {_LISTS_SQL}, h AS (SELECT query_id, path, {score} AS h, lr, sr FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h DESC, path) AS rank FROM h) SELECT query_id, path, round(h, 6) AS hybrid_score, rank, coalesce(lr, 0) AS lexical_rank, coalesce(sr, 0) AS semantic_rank FROM r WHERE rank <= 8"


def minmax_normalise(spark, d):
    w = Window.partitionBy("o_orderpriority")
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(fusion.min_max(F.col("o_totalprice"), w), 6).alias("scaled"))


def _cases(spark, d):
    """Neighbours of equal label are the relevant ones."""
    top = semantic.semantic_search(_vectors(spark, d), _probe(spark, d), 5)
    probe = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "label")
    return evaluate.per_query_by_label(top, _vectors(spark, d), probe, 5)


def precision_recall_mrr(spark, d):
    cases = _cases(spark, d)
    return cases.select("query_id", "retrieved", "relevant", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank")])


_CASES_SQL = f"""{SIM_SQL}, top AS (SELECT * FROM sem WHERE rank <= 5), truth AS (SELECT q.vec_id::VARCHAR AS query_id, b.vec_id::VARCHAR AS path FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id % 20 = 0),
g AS (SELECT t.query_id, count(*) AS retrieved, count(r.path) AS hits, min(CASE WHEN r.path IS NOT NULL THEN t.rank END) AS fr FROM top t LEFT JOIN truth r ON t.query_id = r.query_id AND t.path = r.path GROUP BY ALL),
w AS (SELECT query_id, count(*) AS relevant FROM truth GROUP BY ALL),
cases AS (SELECT w.query_id, coalesce(retrieved, 0) AS retrieved, relevant, coalesce(hits, 0) AS hits, CASE WHEN coalesce(retrieved, 0) > 0 THEN hits / retrieved ELSE 0 END AS precision, coalesce(hits, 0) / relevant AS recall, coalesce(1.0 / fr, 0) AS reciprocal_rank FROM w LEFT JOIN g USING (query_id))"""


def evaluation_summary(spark, d):
    s = evaluate.summary(_cases(spark, d))
    return s.select("queries", *[F.round(c, 6).alias(c) for c in ("mean_precision", "mean_recall", "mrr")])


def latency_percentiles(spark, d):
    s = evaluate.latency(table(spark, d, "events"), "value", "event_type")
    return s.select("event_type", "runs", *[F.round(c, 6).alias(c) for c in ("median", "p95", "min", "max")])


def strategy_summary(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("strategy"), F.col("l_discount").alias("precision"), F.col("l_tax").alias("recall"))
    s = evaluate.strategy_summary(li, ["precision", "recall"])
    return s.select("strategy", "cases", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


def required_outcomes(spark, d):
    """How far each required customer came: orders, open orders, large open orders."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_custkey").alias("path"), "o_orderstatus", "o_totalprice")
    prios = o.select("query_id").distinct()
    required = table(spark, d, "customer").select(F.col("c_custkey").alias("path")).join(F.broadcast(prios))
    found = evaluate.outcomes(required, o, o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus <> 'F' and o_totalprice > 300000"))
    return found.groupBy("query_id", "outcome").agg(F.count("*").alias("files"))


OUTCOMES_SQL = """WITH o AS (SELECT o_orderpriority AS query_id, o_custkey AS path, bool_or(o_orderstatus <> 'F') AS r, bool_or(o_orderstatus <> 'F' AND o_totalprice > 300000) AS s FROM orders GROUP BY ALL),
q AS (SELECT p.query_id, c_custkey AS path FROM customer, (SELECT DISTINCT o_orderpriority AS query_id FROM orders) p)
SELECT q.query_id, CASE WHEN s THEN 'SELECTED' WHEN r THEN 'RANKED_NOT_SELECTED' WHEN o.path IS NOT NULL THEN 'DISCOVERED_NOT_RANKED' ELSE 'NOT_DISCOVERED' END AS outcome, count(*) AS files
FROM q LEFT JOIN o ON q.query_id = o.query_id AND q.path = o.path GROUP BY ALL"""


def required_coverage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_custkey").alias("path"), "o_orderstatus")
    return evaluate.coverage(o.select("query_id", "path").distinct(), o.where("o_orderstatus = 'F'"))


QUERIES = {f.__name__: f for f in (lexical_topk, exact_symbol_match, near_symbol_match, cosine_topk, l2_normalised, weighted_fusion, rrf_fusion, minmax_normalise, precision_recall_mrr, evaluation_summary, latency_percentiles, strategy_summary, required_outcomes, required_coverage)}
ORACLE_SQL = {
    "lexical_topk": LEXICAL_TOPK_SQL,
    "exact_symbol_match": EXACT_SQL,
    "near_symbol_match": NEAR_SQL,
    "cosine_topk": COSINE_SQL,
    "l2_normalised": L2_SQL,
    "weighted_fusion": _fusion_sql("coalesce(0.5 * lmm, 0) + coalesce(0.5 * smm, 0)"),
    "rrf_fusion": _fusion_sql("coalesce(0.5::DOUBLE / (60 + lr), 0) + coalesce(0.5::DOUBLE / (60 + sr), 0)"),
    "minmax_normalise": "SELECT o_orderkey, round(CASE WHEN max(o_totalprice) OVER w > min(o_totalprice) OVER w THEN (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) ELSE 1.0 END, 6) AS scaled FROM orders WINDOW w AS (PARTITION BY o_orderpriority)",
    "precision_recall_mrr": f"WITH {_CASES_SQL} SELECT query_id, retrieved, relevant, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank::DOUBLE, 6) AS reciprocal_rank FROM cases",
    "evaluation_summary": f"WITH {_CASES_SQL} SELECT count(*) AS queries, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(reciprocal_rank::DOUBLE), 6) AS mrr FROM cases",
    "latency_percentiles": "SELECT event_type, count(value) AS runs, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY ALL",
    "strategy_summary": "SELECT l_returnflag AS strategy, count(*) AS cases, round(avg(l_discount), 6) AS mean_precision, round(median(l_discount), 6) AS median_precision, round(avg(l_tax), 6) AS mean_recall, round(median(l_tax), 6) AS median_recall FROM lineitem GROUP BY ALL",
    "required_outcomes": OUTCOMES_SQL,
    "required_coverage": "WITH r AS (SELECT DISTINCT o_orderpriority AS query_id, o_custkey AS path FROM orders), f AS (SELECT DISTINCT o_orderpriority AS query_id, o_custkey AS path FROM orders WHERE o_orderstatus = 'F') SELECT r.query_id, count(*) FILTER (f.path IS NULL) AS missing, count(*) FILTER (f.path IS NULL) = 0 AS is_subset FROM r LEFT JOIN f ON r.query_id = f.query_id AND r.path = f.path GROUP BY r.query_id",
}
