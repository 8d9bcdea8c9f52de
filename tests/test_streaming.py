import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.vectors import hash_vector
from corpusloom.operators import code
from corpusloom.operators import incremental as N
from corpusloom.sources import vectors
from corpusloom.streaming import events, incremental


def test_index_stream(spark, tmp_path):
    src, schema = f"{tmp_path}/in", code.analyse(spark.createDataFrame([], "path string, source string")).schema
    store = N.Store(spark, f"file://{tmp_path}/store")

    def arrive(rows):
        spark.createDataFrame(rows, "path string, source string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("path string, source string").parquet(src)
        incremental.index_stream(stream, store, code.analyse, schema, f"{tmp_path}/cp").awaitTermination()
        return {r.path: len(r.symbols) for r in store.load(schema).collect()}

    assert arrive([("a.py", "def f(): pass"), ("b.py", "x = 1")]) == {"a.py": 1, "b.py": 0}
    assert arrive([("b.py", "class C:\n  def m(self): pass")]) == {"a.py": 1, "b.py": 2}


def test_windows_on_stream(spark, tmp_path, tiny_dir):
    e = spark.read.parquet(f"{tiny_dir}/events.parquet")
    e.write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/ev")
    q = events.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("tumbled").collect()))
    assert got == sorted(map(tuple, events.tumbling(e).collect()))


def test_running_budget(spark, tmp_path):
    rows = [(1, 5.0), (1, 4.0), (1, 3.0), (2, 20.0), (2, 1.0)]
    spark.createDataFrame(rows, "user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/b")
    stream = spark.readStream.schema("user_id long, value double").parquet(f"{tmp_path}/b")
    q = incremental.running_budget(stream, 10.0).writeStream.format("memory").queryName("budget").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.user_id: (r.spent, r.admitted) for r in spark.table("budget").collect()} == {1: (9.0, 2), 2: (1.0, 1)}


def test_vector_cache(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two"), ("b", "three")], "path string, document string")
    store = N.Store(spark, f"file://{tmp_path}/vec")
    from corpusloom.functions.vectors import hashed_embedding

    embed = hashed_embedding(64)
    got, n = vectors.cached_vectors(docs, store, embed, "m1")
    assert n == 2 and {r.path: list(r.vector) for r in got.collect()}["a"] == pytest.approx(hash_vector("one two", 64))
    assert vectors.cached_vectors(docs, store, embed, "m1")[1] == 0
    changed = docs.withColumn("document", F.when(F.col("path") == "a", "new").otherwise(F.col("document")))
    assert vectors.cached_vectors(changed, store, embed, "m1")[1] == 1
    assert vectors.cached_vectors(docs, store, embed, "m2")[1] == 2


def test_http_embedding(spark):
    def send(url, body):
        texts = json.loads(body)["input"]
        return json.dumps({"data": [{"index": i, "embedding": [len(t), 1]} for i, t in reversed(list(enumerate(texts)))]}).encode()

    df = spark.createDataFrame([("ab",), ("abcd",), (None,)], "t string")
    got = [r.v for r in df.select(vectors.http_embedding(send, "http://x/v1/embeddings", "m", 2)("t").alias("v")).collect()]
    assert got == [[2.0, 1.0], [4.0, 1.0], [0.0, 1.0]]
