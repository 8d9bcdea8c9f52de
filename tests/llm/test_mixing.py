import math
import random

import pytest

from corpusloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Reshare the excess round by round until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        free = [s for s in names if s not in full]
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] >= cap * sizes[s]]
        if not over:
            return full | got
        full |= {s: cap * sizes[s] for s in over}


def test_targets_and_taken(spark):
    rng = random.Random(3)
    names = ["b", "a", "é", "Z", "tiny", None, "empty"]
    rows = []
    for i in range(900):
        s = rng.choices(names, [30, 5, 4, 9, 0.5, 3, 1])[0]
        rows.append((i, None if s == "empty" else "w " * rng.randint(1, 40), s))
    rows.append((5000, "w " * 30000, "b"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS target")
    got = mixing.mixing_report(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    assert len(got) == len(rows)
    source = {d: s for d, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], abs=1e-6)
        assert r.taken in ({0} if not r.size else {r.size * math.floor(r.target / r.source_size), r.size * (math.floor(r.target / r.source_size) + 1)})
        assert r.taken <= 2 * r.size
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixing_report(df.repartition(7)).collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.taken // r.size for r in got if r.size)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixing_report(df).count() == 0 == mixing.mix(df).count()
    none = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, "x", "a"), (None, "x", "a")], df.schema)
    got = mixing.mixing_report(none).collect()
    assert len(got) == 4 and all(r.taken <= 2 * r.size for r in got)


def test_native(spark, tiny_dir):
    plan = mixing.mixing_report(spark.read.parquet(f"{tiny_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_names_and_rows_without_ids(spark):
    rows = [(None, f"word {i}", "a", i) for i in range(400)] + [(7, f"more {i}", "a", i) for i in range(400)] + [(i, "x y", "b", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_size long")
    got = mixing.mix(df, weights=(1, 2), share=1.2)
    assert got.columns == df.columns and {r._mix_size for r in got.collect()} <= set(range(400))
    taken = {None: 0, 7: 0}
    for r in got.collect():
        if r.doc_id in taken and r.source == "a":
            taken[r.doc_id] += 1
    rate = targets({"a": 1600, "b": 800}, (1, 2), 1.2)["a"] / 1600
    for n in taken.values():  # drawn apart, so near the rate
        assert abs(n - 400 * rate) < 60
