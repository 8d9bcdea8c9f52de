"""Embedding sources: cached vectors by content and model, and a batched HTTP source."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.incremental import Store, with_hash

SCHEMA = "path string, content_hash string, embedding_identity string, vector array<double>"
HTTP_BATCH = 2048


def identity(embedder) -> str:
    """What a vector depends on besides its text: the model and its dimensions."""
    known = [f"{a}={getattr(embedder, a)}" for a in ("_model", "model", "dimensions", "_dimensions") if getattr(embedder, a, None) is not None]
    return hashlib.sha256((", ".join(known) or type(embedder).__name__).encode()).hexdigest()


def cached_vectors(documents: DataFrame, store: Store, embed, name: str) -> tuple[DataFrame, int]:
    """(path, vector) of documents (path, document), embedding only what the store lacks.

    embed is a function of a text column, name the identity of its model. Returns the
    number of documents embedded as well.
    """
    current = with_hash(documents, "document").withColumn("embedding_identity", F.lit(name))
    schema = documents.sparkSession.createDataFrame([], SCHEMA).schema
    old, keys = store.load(schema), ["path", "content_hash", "embedding_identity"]
    new = current.join(old.select(*keys), keys, "left_anti")
    count = new.count()
    if count or store.current() is None:
        made = new.select(*keys, embed("document").alias("vector"))
        store.publish(old.unionByName(made))
    every = store.load(schema)
    return current.select(*keys).join(every, keys).select("path", "vector"), count


def http_embedding(send: Callable[[str, bytes], bytes], url: str, model: str, batch: int = HTTP_BATCH):
    """A function of a text column that posts batches and checks what comes back.

    send(url, body) does the request, so tests and offline runs can stand in for it.
    """

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[list[float]] = []
            for at in range(0, len(part), batch):
                texts = part.iloc[at:at + batch].fillna("").tolist()
                reply = json.loads(send(url, json.dumps({"model": model, "input": texts}).encode()))
                rows = sorted(reply["data"], key=lambda r: r["index"])
                if len(rows) != len(texts) or len({len(r["embedding"]) for r in rows}) > 1:
                    raise ValueError("the embedding source returned another number or shape of vectors")
                out += [[float(v) for v in r["embedding"]] for r in rows]
            yield pd.Series(out)

    return embed
