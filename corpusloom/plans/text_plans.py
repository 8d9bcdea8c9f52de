"""Queries over text analysis: tokens, estimates, intent, request signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions import text as T
from corpusloom.plans.bind import table

#: Splits camel case and lowers A-Z, for engines without look-around.
SQL_TOKENS = (
    "regexp_extract_all(translate(regexp_replace(regexp_replace({0}, '([A-Z])([A-Z][a-z0-9])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),"
    " 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
)


def tokenize_terms(spark, d):
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("digest"))


def term_frequencies(spark, d):
    terms = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("files"))


def compact_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.compact_name(F.col("p_name")).alias("compact"), F.array_join(T.distinct_tokens(F.col("p_name")), " ").alias("terms"))


def camel_tokens(spark, d):
    """Names joined in camel case and taken apart again."""
    camel = F.concat(F.initcap(F.col("p_brand")), F.replace(F.initcap(F.col("p_type")), F.lit(" "), F.lit("")), F.lit("HTTPServer"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.tokens(camel), " ").alias("terms"))


def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


REQUESTS = (
    "Where should I modify the CheckoutService in app/services/checkout.py?", "what depends on billing.invoice", "where is LoginHandler implemented",
    "how does the payment flow work", "add retry support to HTTPClient", "", "workflow of orders", "rename old_name to new_name in src.core.util",
)
_VALUES = ", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in enumerate(REQUESTS))


def _requests(spark, d):
    """Stated requests, and each event's type as one more."""
    asked = spark.createDataFrame(list(enumerate(REQUESTS)), "id long, request string")
    seen = table(spark, d, "events").select((F.col("event_id") + 1000).alias("id"), F.concat_ws(" ", F.lit("how do i change"), "event_type").alias("request"))
    return asked.unionByName(seen)


_REQUESTS_SQL = f"requests AS (SELECT id::BIGINT AS id, request FROM (VALUES {_VALUES}) v(id, request) UNION ALL SELECT event_id + 1000, concat_ws(' ', 'how do i change', event_type) FROM events)"


def intent_classify(spark, d):
    return _requests(spark, d).select("id", T.intent(F.col("request")).alias("intent"))


def _intent_sql() -> str:
    arms = []
    for name, phrases in T.INTENT_PHRASES:
        tests = " OR ".join("contains(q, ' {0} ') OR starts_with(q, ' {0}')".format(p.replace("'", "''")) for p in phrases)
        arms.append(f"WHEN {tests} THEN '{name}'")
    return f"WITH {_REQUESTS_SQL}, p AS (SELECT id, trim(request) = '' AS blank, ' ' || lower(request) || ' ' AS q FROM requests) SELECT id, CASE WHEN blank THEN 'unknown' {' '.join(arms)} ELSE 'unknown' END AS intent FROM p"


def symbol_terms(spark, d):
    return _requests(spark, d).select("id", F.array_join(T.symbol_tokens(F.col("request")), " ").alias("symbols"))


_STOP = ", ".join(f"'{w}'" for w in T.NOT_SYMBOLS)
SYMBOL_TERMS_SQL = f"""WITH {_REQUESTS_SQL}, w AS (SELECT id, unnest(regexp_extract_all(lower(request), '[a-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(lower(request), '[a-z0-9_]+'), 1) AS i FROM requests),
f AS (SELECT id, w, min(i) AS i FROM w WHERE w NOT IN ({_STOP}) AND regexp_matches(w, '[a-z]') GROUP BY ALL)
SELECT r.id, coalesce(string_agg(f.w, ' ' ORDER BY f.i), '') AS symbols FROM requests r LEFT JOIN f USING (id) GROUP BY r.id"""


def request_analysis(spark, d):
    r = F.col("request")
    join = lambda c: F.array_join(c, " ")
    return _requests(spark, d).select("id", T.action(r).alias("action"), join(T.domain_terms(r)).alias("domain_terms"), join(T.path_mentions(r)).alias("paths"), join(T.module_mentions(r)).alias("modules"), join(T.type_mentions(r)).alias("types"))


_RSTOP = ", ".join(f"'{w}'" for w in T.REQUEST_STOP_WORDS)
_VERBS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ACTION_OF_VERB.items())
REQUEST_SQL = f"""WITH {_REQUESTS_SQL}
SELECT id, list_filter(list_transform(regexp_split_to_array(lower(request), '\\s+'), lambda w: CASE regexp_replace(w, '[^a-z]', '', 'g') {_VERBS} END), lambda a: a IS NOT NULL)[1] AS action,
  array_to_string(list_filter({SQL_TOKENS.format('request')}, lambda t: length(t) > 1 AND t NOT IN ({_RSTOP})), ' ') AS domain_terms,
  array_to_string(list_sort(list_distinct(regexp_extract_all(request, '[a-zA-Z_][\\w./]*(?:\\.\\w+)'))), ' ') AS paths,
  array_to_string(list_sort(list_distinct(regexp_extract_all(request, '[a-zA-Z_]\\w*(?:\\.[a-zA-Z_]\\w*)+'))), ' ') AS modules,
  array_to_string(regexp_extract_all(request, '\\b([A-Z][a-zA-Z0-9]+)\\b', 1), ' ') AS types
FROM requests"""


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


def path_predicates(spark, d):
    """Module names and file classes of paths made from parts."""
    path = F.concat(F.when(F.col("p_size") % 5 == 0, F.lit("tests/")).otherwise(F.lit("app/")), F.replace(F.lower(F.col("p_brand")), F.lit("#"), F.lit("_")), F.lit("/"),
                    F.when(F.col("p_size") % 7 == 0, F.lit("__init__")).when(F.col("p_size") % 11 == 0, F.lit("settings")).when(F.col("p_size") % 13 == 0, F.lit("test_x")).otherwise(F.concat(F.lit("m"), F.col("p_partkey").cast("string"))), F.lit(".py"))
    p = table(spark, d, "part").select("p_partkey", path.alias("path"))
    c = F.col("path")
    return p.select("p_partkey", "path", P.module_name(c).alias("module"), P.is_test(c).alias("is_test"), P.is_config(c).alias("is_config"), P.parent(c).alias("package"), F.array_join(P.dotted_prefixes(P.module_name(c)), " ").alias("prefixes"), P.singular(P.stem(c)).alias("leaf"))


PATH_SQL = r"""WITH p AS (SELECT p_partkey, (CASE WHEN p_size % 5 = 0 THEN 'tests/' ELSE 'app/' END) || replace(lower(p_brand), '#', '_') || '/' ||
  (CASE WHEN p_size % 7 = 0 THEN '__init__' WHEN p_size % 11 = 0 THEN 'settings' WHEN p_size % 13 = 0 THEN 'test_x' ELSE 'm' || p_partkey::VARCHAR END) || '.py' AS path FROM part),
m AS (SELECT *, replace(CASE WHEN path LIKE '%/\_\_init\_\_.py' ESCAPE '\' THEN left(path, length(path) - 12) ELSE left(path, length(path) - 3) END, '/', '.') AS module, string_split(path, '/') AS parts FROM p),
s AS (SELECT *, left(parts[-1], length(parts[-1]) - 3) AS stem FROM m)
SELECT p_partkey, path, module, starts_with(parts[-1], 'test_') OR ends_with(path, '_test.py') OR list_contains(parts, 'tests') OR list_contains(parts, 'test') AS is_test,
  stem IN ('config', 'settings', 'setup', 'conf') AS is_config, array_to_string(parts[:-2], '/') AS package,
  array_to_string(list_transform(range(1, len(string_split(module, '.')) + 1), lambda n: array_to_string(string_split(module, '.')[:n], '.')), ' ') AS prefixes,
  CASE WHEN length(stem) > 2 AND ends_with(lower(stem), 's') THEN left(lower(stem), length(stem) - 1) ELSE lower(stem) END AS leaf FROM s"""


QUERIES = {f.__name__: f for f in (tokenize_terms, term_frequencies, compact_names, camel_tokens, token_estimates, intent_classify, symbol_terms, request_analysis, content_hash, path_predicates)}

_T = SQL_TOKENS.format("text")
ORACLE_SQL = {
    "tokenize_terms": f"SELECT doc_id, len({_T})::BIGINT AS n_tokens, len(list_distinct({_T}))::BIGINT AS n_distinct, md5(array_to_string({_T}, ' ')) AS digest FROM documents",
    "term_frequencies": f"SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS files FROM (SELECT doc_id, unnest({_T}) AS term FROM documents) GROUP BY term",
    "compact_names": "SELECT p_partkey, array_to_string({0}, '') AS compact, array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i), ' ') AS terms FROM part".format(SQL_TOKENS.format("p_name")),
    "camel_tokens": "WITH c AS (SELECT p_partkey, upper(p_brand[1]) || lower(p_brand[2:]) || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || 'HTTPServer' AS n FROM part) SELECT p_partkey, array_to_string({0}, ' ') AS terms FROM c".format(SQL_TOKENS.format("n")),
    "token_estimates": "SELECT doc_id, greatest(1, ceil(length(coalesce(text, '')) / 4.0))::BIGINT AS tokens FROM documents",
    "intent_classify": _intent_sql(),
    "symbol_terms": SYMBOL_TERMS_SQL,
    "request_analysis": REQUEST_SQL,
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "path_predicates": PATH_SQL,
}
