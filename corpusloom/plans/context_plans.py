"""Queries over context assembly, safety, snapshots, sets and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import token_estimate
from corpusloom.operators import context as C
from corpusloom.operators import firewall as W
from corpusloom.operators import incremental as N
from corpusloom.operators import plan as L
from corpusloom.plans.bind import FILES_SQL, document_files, table
from corpusloom.streaming import events as E

BUDGET = 8000


def _candidates(spark, d) -> DataFrame:
    """Documents of a source as its query's candidates, of three kinds."""
    f = document_files(spark, d)
    kind = F.col("doc_id") % 4
    return f.select(
        F.col("folder").alias("query_id"), "path", F.col("doc_id").alias("seq"), token_estimate(F.coalesce("source", F.lit(""))).alias("tokens"),
        F.when(kind == 0, "primary").when(kind == 1, "dependency").otherwise("dependent").alias("role"),
        F.when(kind == 0, (F.col("doc_id") % 7).cast("int")).alias("retrieval_rank"), F.when(kind == 0, (F.col("n_chars") % 5).cast("double")).alias("retrieval_score"),
        F.when(kind == 3, "change_plan").when((kind == 0) & (F.col("doc_id") % 3 == 0), "symbol_match").alias("inclusion_reason"),
        F.when(kind == 3, (F.col("doc_id") % 5).cast("int")).alias("change_priority"), F.when(F.col("doc_id") % 2 == 1, (F.col("doc_id") % 3).cast("int")).alias("graph_distance"),
        F.when(F.col("doc_id") % 5 == 0, (F.col("doc_id") % 4).cast("int")).alias("architecture_rank"),
    )


CANDIDATES_SQL = f"""{FILES_SQL}, cand AS (SELECT folder AS query_id, path, doc_id AS seq, greatest(1, ceil(length(coalesce(source, '')) / 4.0))::BIGINT AS tokens, doc_id % 4 AS kind,
  CASE doc_id % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'dependency' ELSE 'dependent' END AS role, CASE WHEN doc_id % 4 = 0 THEN doc_id % 7 END AS rr, CASE WHEN doc_id % 4 = 0 THEN (n_chars % 5)::DOUBLE END AS rs,
  CASE WHEN doc_id % 4 = 3 THEN 'change_plan' WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN 'symbol_match' END AS why, CASE WHEN doc_id % 4 = 3 THEN doc_id % 5 END AS cp, CASE WHEN doc_id % 2 = 1 THEN doc_id % 3 END AS gd,
  CASE WHEN doc_id % 5 = 0 THEN doc_id % 4 END AS ar FROM files),
keyed AS (SELECT *, CASE WHEN role = 'primary' THEN 0 ELSE 1 END AS k1, CASE WHEN role = 'primary' THEN coalesce(rr, 1000000000) WHEN why = 'change_plan' THEN 4 WHEN ar IS NOT NULL THEN least(ar, 2) ELSE 3 END AS k2,
  CASE WHEN role = 'primary' THEN (CASE WHEN why = 'symbol_match' THEN 0 ELSE 1 END) WHEN why = 'change_plan' THEN coalesce(cp, 1000000000) ELSE coalesce(gd, 1000000000) END AS k3,
  CASE WHEN role = 'primary' THEN -coalesce(rs, 0.0) WHEN why = 'change_plan' THEN 0 WHEN role = 'dependent' THEN 0 ELSE 1 END AS k4 FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k1, k2, k3, k4, path) AS position FROM keyed)"""


def candidate_rank(spark, d):
    r = C.rank_candidates(_candidates(spark, d))
    return r.select("query_id", "path", F.col("position").cast("bigint").alias("position"), "role", "tokens")


def dedupe_first(spark, d):
    """The first candidate of each path, in the order of precedence."""
    a = _candidates(spark, d).select("query_id", F.concat(F.lit("p"), (F.col("seq") % 17).cast("string")).alias("path"), "seq", "role")
    return C.first_seen(a)


def budget_greedy(spark, d):
    s = C.select_within_budget(C.rank_candidates(_candidates(spark, d)), BUDGET)
    return s.select("query_id", "path", F.col("position").cast("bigint").alias("position"), "tokens", "selected", F.coalesce("reason", F.lit("")).alias("reason"), "remaining_before")


GREEDY_SQL = f"""WITH RECURSIVE {CANDIDATES_SQL}, fold AS (
  SELECT query_id, path, position, tokens, tokens <= {BUDGET} AS selected, {BUDGET}::BIGINT AS remaining_before, CASE WHEN tokens <= {BUDGET} THEN {BUDGET} - tokens ELSE {BUDGET} END::BIGINT AS remaining FROM ranked WHERE position = 1
  UNION ALL SELECT r.query_id, r.path, r.position, r.tokens, r.tokens <= f.remaining, f.remaining, CASE WHEN r.tokens <= f.remaining THEN f.remaining - r.tokens ELSE f.remaining END::BIGINT
  FROM fold f JOIN ranked r ON r.query_id = f.query_id AND r.position = f.position + 1),
greedy AS (SELECT query_id, path, position, tokens, selected, CASE WHEN selected THEN '' WHEN remaining_before = {BUDGET} THEN 'exceeds_total_budget' ELSE 'over_budget' END AS reason, remaining_before FROM fold)"""


def budget_running_spend(spark, d):
    s = C.budget_spend(C.select_within_budget(C.rank_candidates(_candidates(spark, d)), BUDGET), BUDGET)
    return s.select("query_id", F.col("position").cast("bigint").alias("position"), "spent_before", "spent_after", "remaining_after", F.coalesce(C.exclusion_category(F.col("reason")), F.lit("")).alias("category"))


def budget_report(spark, d):
    r = C.budget_report(C.select_within_budget(C.rank_candidates(_candidates(spark, d)), BUDGET), BUDGET)
    return r.select("query_id", "selected_items", "excluded_items", "spent", "unused", "oversized", "over_budget", *[F.round(c, 6).alias(c) for c in ("utilisation", "mean_selected_tokens", "median_selected_tokens")])


def budget_unlimited(spark, d):
    s = C.select_within_budget(C.rank_candidates(_candidates(spark, d)), None)
    return s.groupBy("query_id").agg(F.count_if("selected").alias("selected_items"), F.sum("tokens").alias("tokens"))


def budget_focus(spark, d):
    """Files that don't fit are stood for by their first lines as spans."""
    r = C.rank_candidates(_candidates(spark, d))
    spans = r.select("query_id", "path", F.explode(F.array(*[F.struct(F.lit(1 + 10 * k).alias("start_line"), F.lit(10 + 10 * k).alias("end_line"), (F.col("tokens") / 10).cast("bigint").alias("tokens"), ((F.col("seq") + k) % 2 == 0).alias("evidence")) for k in range(4)])).alias("x")).select("query_id", "path", "x.*")
    return C.select_with_focus(r, spans, BUDGET)


def files_with_spans(spark, d):
    """Each candidate as a whole, then its first two tens of lines."""
    r = C.rank_candidates(_candidates(spark, d)).select("query_id", "path", "position", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), "tokens")
    spans = r.select("path", F.explode(F.array(F.lit(1), F.lit(11))).alias("start_line"), "tokens").select("path", "start_line", (F.col("start_line") + 9).alias("end_line"), F.floor(F.col("tokens") / 10).cast("bigint").alias("tokens"))
    out = C.with_spans(r, spans)
    return out.select("query_id", "path", F.coalesce("start_line", F.lit(0)).cast("bigint").alias("start_line"), "tokens", F.col("item").cast("bigint").alias("item"))


def change_items_kept(spark, d):
    """Items of orders by category, without tests and callees."""
    categories = F.array(*[F.lit(c) for c in _CATEGORIES])
    k = F.col("o_orderkey")
    items = table(spark, d, "orders").select(k.cast("string").alias("path"), F.get(categories, (k % 6).cast("int")).alias("category"), F.when(k % 5 == 0, "direct_callee").otherwise("direct_dependency").alias("relationship"))
    return L.kept_items(items, tests=False, callees=False).groupBy("category", "relationship").agg(F.count("*").alias("items"))


_CATEGORIES = ("primary_target", "test", "indirect_caller", "direct_dependency", "indirect_test", "architecture_entry")
_KEPT_SQL = f"""WITH x AS (SELECT o_orderkey % 6 AS c, CASE WHEN o_orderkey % 5 = 0 THEN 'direct_callee' ELSE 'direct_dependency' END AS relationship FROM orders)
SELECT ({list(_CATEGORIES)})[c + 1] AS category, relationship, count(*) AS items FROM x WHERE c IN (0, 2) OR (c IN (3, 5) AND relationship <> 'direct_callee') GROUP BY ALL"""


#: A detector for the secrets that documents hold, beside the built-in ones.
TOKEN_DETECTOR = W.Detector("token_assignment", r'token = "[0-9a-f]{40}"', "api_token", "high", "Potential token assignment detected")
DETECTORS = (*W.DETECTORS, TOKEN_DETECTOR)


def _guarded(spark, d):
    """Documents whose paths meet the path rules now and then."""
    f = document_files(spark, d)
    k = F.col("doc_id")
    return f.select(F.concat("path", F.when(k % 50 == 0, "/.env").when(k % 50 == 1, "/cert.PEM").when(k % 50 == 2, "/secrets.yaml").when(k % 50 == 3, "/secrets.py").otherwise("/t.md")).alias("path"), "source")


_GUARD_SQL = f"""{FILES_SQL}, g AS (SELECT path || CASE doc_id % 50 WHEN 0 THEN '/.env' WHEN 1 THEN '/cert.PEM' WHEN 2 THEN '/secrets.yaml' WHEN 3 THEN '/secrets.py' ELSE '/t.md' END AS path, doc_id % 50 AS k, source FROM files),
ln AS (SELECT path, k, unnest(string_split(source, chr(10))) AS l, generate_subscripts(string_split(source, chr(10)), 1) AS line FROM g),
fd AS (SELECT path, k, line, len(regexp_extract_all(l, 'token = "[0-9a-f]{{40}}"')) AS matches FROM ln WHERE regexp_matches(l, 'token = "[0-9a-f]{{40}}"'))"""


def firewall_findings(spark, d):
    f = W.findings(_guarded(spark, d), DETECTORS)
    return f.select("path", F.col("line").cast("bigint").alias("line"), "detector", "severity", "matches")


def firewall_decision(spark, d):
    f = _guarded(spark, d)
    return W.decisions(f, W.findings(f, DETECTORS))


def redact_lines(spark, d):
    s = W.safe_files(_guarded(spark, d), DETECTORS)
    return s.select("path", "decision", F.sha2(F.coalesce("safe_source", F.lit("")), 256).alias("safe_hash"))


_DECIDE = "CASE WHEN k IN (0, 1, 2) THEN 'block' WHEN EXISTS (SELECT 1 FROM fd WHERE fd.path = g.path) THEN 'redact' ELSE 'allow' END"


def _orders_as_files(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("path"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("source"), "o_orderkey")


def _store(spark, d):
    """An older snapshot: some orders absent, some with another text, some since gone."""
    o = _orders_as_files(spark, d)
    kept = o.where("o_orderkey % 7 <> 0").withColumn("source", F.when(F.col("o_orderkey") % 11 == 0, F.lit("old")).otherwise(F.col("source")))
    gone = o.where("o_orderkey % 13 = 0").withColumn("path", F.concat(F.lit("gone"), "path"))
    return N.with_hash(kept.unionByName(gone)).select("path", "content_hash")


_STORE_SQL = """cur AS (SELECT o_orderkey::VARCHAR AS path, sha256(concat_ws('|', o_orderstatus, o_orderpriority)) AS h FROM orders),
old AS (SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 11 = 0 THEN sha256('old') ELSE sha256(concat_ws('|', o_orderstatus, o_orderpriority)) END AS h FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT 'gone' || o_orderkey::VARCHAR, sha256(concat_ws('|', o_orderstatus, o_orderpriority)) FROM orders WHERE o_orderkey % 13 = 0)"""


def incremental_diff(spark, d):
    return N.diff(N.with_hash(_orders_as_files(spark, d)), _store(spark, d))


def stale_prune_anti(spark, d):
    return N.stale(_store(spark, d), N.with_hash(_orders_as_files(spark, d))).select("path")


def incremental_misses(spark, d):
    return N.misses(N.with_hash(_orders_as_files(spark, d)), _store(spark, d)).select("path")


def _sets(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("id"))
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return o, c


def set_union(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct()


def set_intersect(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


def set_except(spark, d):
    a, b = _sets(spark, d)
    return a.subtract(b)


_A, _B = "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 250000", "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0"


def top_n_per_group(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3").select("c_nationkey", "c_custkey", "rank")


def outcome_counts_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("orders"), F.grouping_id().cast("bigint").alias("level"))


def document_json(spark, d):
    """A JSON line per document, fields in order."""
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", "n_chars")).alias("json"))


def rendered_context(spark, d):
    """The selected files of each query as one text, ordered by position."""
    s = C.select_within_budget(C.rank_candidates(_candidates(spark, d)), BUDGET).where("selected")
    line = F.concat(F.lit("## "), "path", F.lit(" ("), F.col("tokens").cast("string"), F.lit(" tokens)"))
    g = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("x"))
    return g.select("query_id", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("rendered"))


def fingerprint(spark, d):
    """A short digest of each source's sorted files."""
    f = document_files(spark, d).groupBy("folder").agg(F.array_sort(F.collect_list("path")).alias("p"))
    return f.select("folder", F.substring(F.sha2(F.array_join("p", ","), 256), 1, 16).alias("fingerprint"))


def event_props(spark, d):
    """Fields read from the JSON of events."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


QUERIES = {f.__name__: f for f in (
    candidate_rank, dedupe_first, budget_greedy, budget_running_spend, budget_report, budget_unlimited, budget_focus, files_with_spans, change_items_kept, firewall_findings, firewall_decision, redact_lines, incremental_diff, stale_prune_anti,
    incremental_misses, set_union, set_intersect, set_except, top_n_per_group, outcome_counts_rollup, document_json, rendered_context, fingerprint, event_props)}
QUERIES |= {"event_tumbling": lambda s, d: E.tumbling(table(s, d, "events")), "event_sliding": lambda s, d: E.sliding(table(s, d, "events")), "event_sessions": lambda s, d: E.sessions(table(s, d, "events"))}
ORACLE_SQL = {
    "candidate_rank": f"WITH {CANDIDATES_SQL} SELECT query_id, path, position, role, tokens FROM ranked",
    "dedupe_first": f"WITH {CANDIDATES_SQL}, x AS (SELECT query_id, 'p' || (seq % 17)::VARCHAR AS path, seq, role FROM cand), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY seq) AS k FROM x) SELECT query_id, path, seq, role FROM n WHERE k = 1",
    "budget_greedy": f"{GREEDY_SQL} SELECT * FROM greedy",
    "budget_running_spend": f"{GREEDY_SQL} SELECT query_id, position, ({BUDGET} - remaining_before)::BIGINT AS spent_before, ({BUDGET} - remaining_before + CASE WHEN selected THEN tokens ELSE 0 END)::BIGINT AS spent_after, (remaining_before - CASE WHEN selected THEN tokens ELSE 0 END)::BIGINT AS remaining_after, CASE reason WHEN 'over_budget' THEN 'remaining_budget_too_small' ELSE reason END AS category FROM greedy",
    "budget_report": f"{GREEDY_SQL} SELECT query_id, count(*) FILTER (selected) AS selected_items, count(*) FILTER (NOT selected) AS excluded_items, coalesce(sum(tokens) FILTER (selected), 0)::BIGINT AS spent, ({BUDGET} - coalesce(sum(tokens) FILTER (selected), 0))::BIGINT AS unused, count(*) FILTER (reason = 'exceeds_total_budget') AS oversized, count(*) FILTER (reason = 'over_budget') AS over_budget, round(coalesce(sum(tokens) FILTER (selected), 0) / {BUDGET}.0::DOUBLE, 6) AS utilisation, round(avg(tokens) FILTER (selected), 6) AS mean_selected_tokens, round(median(tokens) FILTER (selected), 6) AS median_selected_tokens FROM greedy GROUP BY query_id",
    "budget_unlimited": f"WITH {CANDIDATES_SQL} SELECT query_id, count(*) AS selected_items, sum(tokens)::BIGINT AS tokens FROM cand GROUP BY query_id",
    "files_with_spans": f"""WITH {CANDIDATES_SQL}, u AS (SELECT query_id, path, position, 0::BIGINT AS start_line, tokens FROM ranked UNION ALL SELECT query_id, path, position, unnest([1, 11])::BIGINT, (tokens // 10)::BIGINT FROM ranked)
SELECT query_id, path, start_line, tokens, row_number() OVER (PARTITION BY query_id ORDER BY position, start_line) AS item FROM u""",
    "change_items_kept": _KEPT_SQL,
    "firewall_findings": f"WITH {_GUARD_SQL} SELECT path, line, 'token_assignment' AS detector, 'high' AS severity, matches FROM fd",
    "firewall_decision": f"WITH {_GUARD_SQL} SELECT path, {_DECIDE} AS decision FROM g",
    "redact_lines": f"""WITH {_GUARD_SQL}, x AS (SELECT path, source, {_DECIDE} AS decision FROM g) SELECT path, decision, sha256(CASE decision WHEN 'block' THEN '[BLOCKED by firewall]' WHEN 'redact' THEN regexp_replace(source, 'token = "[0-9a-f]{{40}}"', '[REDACTED]', 'g') ELSE coalesce(source, '') END) AS safe_hash FROM x""",
    "incremental_diff": f"WITH {_STORE_SQL} SELECT coalesce(c.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN c.h <> o.h THEN 'modified' ELSE 'unchanged' END AS state FROM cur c FULL JOIN old o ON c.path = o.path",
    "stale_prune_anti": f"WITH {_STORE_SQL} SELECT path FROM old WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.path = old.path AND cur.h = old.h)",
    "incremental_misses": f"WITH {_STORE_SQL} SELECT path FROM cur WHERE NOT EXISTS (SELECT 1 FROM old WHERE cur.path = old.path AND cur.h = old.h)",
    "set_union": f"{_A} UNION {_B}", "set_intersect": f"{_A} INTERSECT {_B}", "set_except": f"{_A} EXCEPT {_B}",
    "top_n_per_group": "WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) SELECT * FROM r WHERE rank <= 3",
    "outcome_counts_rollup": "SELECT o_orderpriority, o_orderstatus, count(*) AS orders, grouping(o_orderpriority, o_orderstatus)::BIGINT AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "document_json": """SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}' AS json FROM documents""",
    "rendered_context": f"{GREEDY_SQL} SELECT query_id, string_agg('## ' || path || ' (' || tokens::VARCHAR || ' tokens)', chr(10) ORDER BY position) AS rendered FROM greedy WHERE selected GROUP BY query_id",
    "fingerprint": f"WITH {FILES_SQL} SELECT folder, left(sha256(string_agg(path, ',' ORDER BY path)), 16) AS fingerprint FROM files GROUP BY folder",
    "event_props": "SELECT event_type, count(props->>'$.k') AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, max((props->>'$.k')::BIGINT) AS largest FROM events GROUP BY event_type",
    **E.ORACLE_SQL,
}
