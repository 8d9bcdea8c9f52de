import math
import random

import pytest

from corpusloom.operators import evaluate, semantic
from corpusloom.plans import catalog


def brute_cosine(a, b):
    def dot(x, y):
        total = 0.0
        for u, v in zip(x, y, strict=False):
            total += 0.0 if u is None or v is None else u * v
        return total

    n = (dot(a, a) ** 0.5 if dot(a, a) == dot(a, a) else math.nan) * (dot(b, b) ** 0.5 if dot(b, b) == dot(b, b) else math.nan)
    if not (n > 0 or n != n):
        return 0.0
    found = dot(a, b) / n
    return max(-1.0, min(1.0, found if found == found else 1.0))


def brute_search(vectors, queries, k):
    out = []
    for q, a in queries:
        scored = sorted((-brute_cosine(a, b), p) for p, b in vectors if a is not None and b is not None)
        out += [(q, p, -s, i + 1) for i, (s, p) in enumerate([x for x in scored if x[0] < 0][:k])]
    return sorted(out)


def odd_vectors(rng, n):
    """Copies, scaled copies, blank, short, gappy, huge, tiny and non-finite vectors among others."""
    out = []
    for i in range(n):
        v = [float(rng.randint(-2, 2)) for _ in range(5)]
        kind = rng.randint(0, 12)
        v = {0: [], 1: v[:3], 2: [math.nan, *v[1:]], 3: [*v[:4], math.inf], 4: [None, *v[1:]], 5: [x * 1e-160 for x in v], 6: [x * 1e180 for x in v], 7: [x * 3.3 for x in v], 8: None, 9: [1.0] * 5}.get(kind, v)
        out.append((f"p{i}", v))
    return out


@pytest.mark.parametrize("limit", [1, 4, 200])
def test_search_in_blocks(spark, monkeypatch, limit):
    """Blocks of a few rows find what all pairs do, ties by path and odd numbers included."""
    monkeypatch.setattr(semantic, "BLOCK_ROWS", 9)
    rng = random.Random(limit)
    vectors, queries = odd_vectors(rng, 90), odd_vectors(rng, 25)
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} string, vector array<double>")
    got = semantic.semantic_search(table(vectors, "path"), table(queries, "query_id"), limit).select("query_id", "path", "similarity", "rank")
    assert sorted(map(tuple, got.collect())) == brute_search(vectors, queries, limit)
    assert semantic.semantic_search(table(vectors, "path"), table([], "query_id"), limit).isEmpty()
    assert semantic.semantic_search(table([], "path"), table(queries, "query_id"), limit).isEmpty()


@pytest.mark.parametrize("name", ["cosine_topk", "precision_recall_mrr", "evaluation_summary"])
def test_pairs_are_no_rows(spark, tiny_dir, name):
    """A similarity search doesn't make a row of every pair."""
    plan = catalog.QUERIES[name](spark, tiny_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_relevance_by_label(spark):
    """Looked up by label, the relevant files give what listing them query by query gives."""
    rng = random.Random(4)
    members = [(rng.choice([None, *(f"p{i}" for i in range(30))]), rng.choice([None, 1, 2, 3, 4])) for _ in range(80)]
    queries = [(rng.choice([None, *(f"q{i}" for i in range(12))]), rng.choice([None, 1, 2, 3, 9])) for _ in range(25)]
    top = [(f"q{q}", f"p{p}", i + 1) for q in range(14) for i, p in enumerate(rng.sample(range(30), rng.randint(0, 7)))]
    members = spark.createDataFrame(members, "path string, label int")
    queries = spark.createDataFrame(queries, "query_id string, label int")
    top = spark.createDataFrame(top, "query_id string, path string, rank int")
    want = evaluate.per_query(top, members.join(queries, "label"), 5)
    got = evaluate.per_query_by_label(top, members, queries, 5)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    with pytest.raises(ValueError):
        evaluate.per_query_by_label(top, members, queries, 0)


@pytest.mark.parametrize("name", ["evaluation_summary", "precision_recall_mrr"])
def test_relevant_files_are_not_listed(spark, tiny_dir, monkeypatch, name):
    """Of the relevant files only those retrieved become rows."""
    real, seen = evaluate._scores, []
    monkeypatch.setattr(evaluate, "_scores", lambda top, truth, want: seen.append((top.count(), truth.count())) or real(top, truth, want))
    catalog.QUERIES[name](spark, tiny_dir)
    assert seen and all(truth <= top for top, truth in seen)
