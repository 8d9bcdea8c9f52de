"""Lexical retrieval: weighted term hits over path, import, source and symbol layers.

Any number of queries runs in one job. A file's terms are intersected with the
queries' terms before they are exploded, so only hits leave the scan; there is no
stored posting list to shuffle. Results carry an explicit rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# What a hit in each layer scores.
WEIGHTS = {"exact": 100, "symbol": 10, "path": 5, "import": 3, "source": 1}
DEFAULT_LIMIT = 10
#: Queries are sent to every task up to so many, and joined by shuffle beyond.
BROADCAST_QUERIES = 100_000
#: Up to so many distinct terms a file's terms are intersected with them in the scan; beyond,
#: postings hold every term and the join alone finds the hits. The hits are the same.
SCAN_TERMS = 5_000


def query_table(spark: SparkSession, queries: dict[str, str] | list[tuple[str, str]]) -> DataFrame:
    """(query_id, query, terms, compact); blank queries have no terms."""
    rows = list(queries.items()) if isinstance(queries, dict) else list(queries)
    table = spark.createDataFrame(rows, "query_id string, query string")
    terms = T.distinct_tokens(F.coalesce("query", F.lit("")))
    return table.withColumn("terms", terms).withColumn("compact", F.array_join("terms", ""))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, pos, term), one row per distinct term."""
    return queries.select("query_id", F.posexplode("terms").alias("pos", "term"))


def small(table: DataFrame, limit: int = BROADCAST_QUERIES) -> DataFrame:
    """table, marked for broadcast if it has no more rows than the limit."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def file_postings(files: DataFrame, layers: dict[str, Column], only: list[str] | None = None) -> DataFrame:
    """(path, layer, term): distinct terms of each layer; only: keep these terms."""
    wanted = F.array(*[F.lit(t) for t in only]).cast("array<string>") if only is not None else None

    def found(c: Column) -> Column:
        terms = T.distinct_tokens(F.coalesce(c, F.lit("")))
        return terms if wanted is None else F.array_intersect(terms, wanted)

    def tagged(name: str, c: Column) -> Column:
        return F.transform(found(c), lambda t: F.struct(F.lit(name).alias("layer"), t.alias("term")))

    pairs = F.flatten(F.array(*[tagged(name, c) for name, c in layers.items()]))
    # outer, as the filters that Spark infers for a plain explode would tokenise three times
    return files.select("path", F.explode_outer(pairs).alias("x")).where("x is not null").select("path", "x.layer", "x.term")


def symbol_postings(symbols: DataFrame) -> DataFrame:
    """(path, name, compact, terms) for each symbol row (path, name)."""
    t = T.tokens(F.col("name"))
    return symbols.select("path", "name", F.array_join(t, "").alias("compact"), F.array_distinct(t).alias("terms"))


def lexical_hits(files: DataFrame, queries: DataFrame, layers: dict[str, Column], symbols: DataFrame | None = None) -> DataFrame:
    """(query_id, path, term, points): every hit that scores."""
    asked = small(query_terms(queries))
    only = [r.term for r in asked.select("term").distinct().limit(SCAN_TERMS + 1).collect()]
    only = only if len(only) <= SCAN_TERMS else None
    weight = F.element_at(F.create_map(*[F.lit(x) for k in ("path", "import", "source") for x in (k, WEIGHTS[k])]), F.col("layer"))
    hits = file_postings(files, layers, only).join(asked, "term").select("query_id", "path", "term", weight.cast("long").alias("points"))
    if symbols is None:
        return hits
    named = symbol_postings(symbols)
    by_term = named.select("path", F.explode("terms").alias("term")).join(asked, "term").select("query_id", "path", "term", F.lit(WEIGHTS["symbol"]).cast("long").alias("points"))
    whole = small(queries.where("compact <> ''").select("query_id", "compact", "terms"))
    exact = named.select("path", "compact").join(whole, "compact").select("query_id", "path", F.explode("terms").alias("term"), F.lit(WEIGHTS["exact"]).cast("long").alias("points"))
    return hits.unionByName(by_term).unionByName(exact)


def ranked(scored: DataFrame, score: str, limit: int | None, key: str = "path") -> DataFrame:
    """With a 1-based rank per query: score descending, then key."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc(key))
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if limit is None else out.where(F.col("rank") <= limit)


def lexical_search(files: DataFrame, queries: DataFrame, layers: dict[str, Column], symbols: DataFrame | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(query_id, path, score, matched_terms, rank); a limit of 0 or less gives nothing."""
    hits = lexical_hits(files, queries, layers, symbols)
    if limit <= 0:
        return hits.limit(0).groupBy("query_id", "path").agg(F.sum("points").alias("score"), F.collect_set("term").alias("matched_terms")).withColumn("rank", F.lit(0))
    scored = hits.groupBy("query_id", "path").agg(F.sum("points").alias("score"), F.collect_set("term").alias("_terms"))
    top = ranked(scored, "score", limit)
    order = small(queries.select("query_id", "terms"))
    return top.join(order, "query_id").select("query_id", "path", "score", F.array_intersect("terms", "_terms").alias("matched_terms"), "rank")


def exact_symbols(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, token, path, name): names equal to a query word but for case and underscores."""
    words = queries.select("query_id", F.explode(T.symbol_tokens(F.col("query"))).alias("token")).withColumn("norm", T.normal_symbol(F.col("token")))
    return symbols.withColumn("norm", T.normal_symbol(F.col("name"))).join(small(words), "norm").drop("norm")


def near_symbols(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, token, path, name): names with every piece of a query word, exact ones left out.

    Relational division: pieces are joined and counted, not compared pair by pair.
    """
    words = queries.select("query_id", F.explode(T.symbol_tokens(F.col("query"))).alias("token"))
    pieces = words.withColumn("parts", T.loose_tokens(F.col("token"))).where(F.size("parts") > 0)
    pieces = pieces.select("query_id", "token", F.size("parts").alias("need"), F.explode("parts").alias("part"))
    parts = symbols.select("path", "name", F.explode(T.loose_symbol_tokens(F.col("name"))).alias("part"))
    matched = parts.join(small(pieces), "part").groupBy("query_id", "token", "need", "path", "name").agg(F.count_distinct("part").alias("have")).where("have = need")
    return matched.where(T.normal_symbol(F.col("name")) != T.normal_symbol(F.col("token"))).select("query_id", "token", "path", "name")
