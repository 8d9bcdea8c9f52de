"""Semantic retrieval: cosine similarity, over all vectors or over candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators.search import ranked, small

CANDIDATES = 40
#: Vectors or queries of one block, and numbers in it; blocks of vectors that there are at least,
#: and vectors that a block is worth.
BLOCK_ROWS, BLOCK_NUMBERS, LEAST_BLOCKS, LEAST_ROWS = 65_536, 1 << 22, 16, 4_096


def _numbers(table: DataFrame) -> DataFrame:
    """Vectors that are given, as floats or doubles."""
    exact = table.schema["vector"].dataType.elementType.typeName() in ("float", "double")
    return table.where("vector is not null").withColumn("vector", F.col("vector") if exact else F.col("vector").cast("array<double>"))


def nearest(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, path, similarity): up to ``limit`` rows a query from each block of vectors, the best among them.

    Each block of vectors meets each block of queries in a group of its own, so every query is
    compared with all vectors, whatever the number of either.
    """
    asked, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    rows = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(width or 1, 1)))
    count = vectors.count()
    of_vectors = max(-(-count // rows), min(LEAST_BLOCKS, -(-count // LEAST_ROWS)), 1)
    of_queries = max(-(-asked // rows), 1)

    def dealt(table: DataFrame, key: str, own: int, others: int, block) -> DataFrame:
        at = F.pmod(F.xxhash64(key, "vector"), F.lit(own)).cast("int")
        return _numbers(table.select(key, "vector")).withColumn("_own", at).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("_block", block).select("_block", key, "vector")

    mine = dealt(vectors, "path", of_vectors, of_queries, F.col("_own") * of_queries + F.col("_other"))
    theirs = dealt(queries, "query_id", of_queries, of_vectors, F.col("_other") * of_queries + F.col("_own"))
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, path {kind(vectors, 'path')}, similarity double"
    return mine.groupBy("_block").cogroup(theirs.groupBy("_block")).applyInArrow(lambda x, q: V.nearest(x, q, limit), schema)


def semantic_search(vectors: DataFrame, queries: DataFrame, limit: int = 10, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, path, similarity, rank) of positive similarities.

    candidates: (query_id, path) pairs, as from a lexical search; only they are compared.
    """
    if candidates is None:
        return ranked(nearest(vectors, queries, max(limit, 0)), "similarity", max(limit, 0))
    pairs = candidates.select("query_id", "path").join(small(queries.select("query_id", F.col("vector").alias("_q"))), "query_id")
    scored = vectors.join(pairs, "path").select("query_id", "path", V.cosine(F.col("vector"), F.col("_q")).alias("similarity"))
    return ranked(scored.where("similarity > 0"), "similarity", max(limit, 0))


def document_text(files: DataFrame) -> DataFrame:
    """(path, document): what is embedded of a file.

    files: (path, imports, functions, classes, methods arrays, source).
    """
    part = lambda name: F.concat(F.lit(f"{name}: "), F.array_join(F.coalesce(F.col(name), F.array().cast("array<string>")), " "))
    return files.select(
        "path", F.concat_ws("\n", F.concat(F.lit("path: "), "path"), part("imports"), part("functions"), part("classes"), part("methods"), F.concat(F.lit("source: "), F.coalesce("source", F.lit("")))).alias("document")
    )
