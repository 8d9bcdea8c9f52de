import itertools
import math
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import crf

GOOD = "the of and to in is that for with was be it on as at by are this or from".split()


def good(rng, n=5):
    return "\n".join(" ".join(rng.choice([*GOOD, f"word{rng.randint(0, 99)}"]) for _ in range(12)) + "." for _ in range(n))


def bad(rng, n=5):
    return "\n".join(" ".join(f"{rng.choice('#$%&')*3}x{rng.randint(0, 99)}" for _ in range(12)) for _ in range(n))


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    m = crf.ChainCRF(weights=rng.normal(size=crf.WIDTH), transitions=rng.normal(size=(2, 2)))
    x = rng.normal(size=(6, crf.WIDTH))
    e = m.emissions(x)
    total, goods = 0.0, np.zeros(6)
    for labels in itertools.product((0, 1), repeat=6):
        s = sum(e[t] for t, y in enumerate(labels) if y) + sum(m.transitions[a, b] for a, b in zip(labels, labels[1:], strict=False))
        total += math.exp(s)
        goods += math.exp(s) * np.array(labels)
    assert m.marginals(x) == pytest.approx((goods / total).tolist())


def test_long_chain_is_stable():
    m = crf.ChainCRF(weights=np.full(crf.WIDTH, 3.0), transitions=np.array([[2.0, -2.0], [-2.0, 2.0]]))
    p = m.marginals(np.ones((5000, crf.WIDTH)))
    assert all(0.0 <= v <= 1.0 for v in p)


def test_learns_and_holds_out(spark):
    rng = random.Random(1)
    docs = [(i, (good if i % 3 else bad)(rng, rng.randint(1, 9)), "x") for i in range(300)]
    labels = [(i, int(bool(i % 3)), 0) for i in range(300)]
    # labels of held-out rows are wrong on purpose: they must not matter
    labels = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels] + [(7, None, 0), (8, 1, 0), (None, 1, 0)]
    extra = [(1000, None, "x"), (1001, "", "x"), (1002, " \n\t", "x"), (1003, good(rng, 400), "x"), (1003, good(rng, 400), "x"), (None, good(rng), "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = crf.report(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    for r in got:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= crf.THRESHOLD)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert r.predicted == int(bool(r.doc_id % 3))
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == by[1002].score == 0.0
    assert by[1003].predicted == 1
    kept = crf.keep_good(d, crf.train(d, lab))
    assert kept.columns == d.columns and kept.where("doc_id % 3 = 0 and doc_id < 300").count() == 0


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert crf.report(d, lab).first().score == 0.5
    assert crf.report(d.limit(0), lab).count() == 0


def test_table_accuracy(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = crf.report(spark.read.parquet(f"{at}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    chains = [rng.normal(size=(n, crf.WIDTH)) for n in (4, 3, 1)]
    lines = [rng.integers(0, 2, size=len(x)).astype(float) for x in chains]
    p = crf.Likelihood(chains, lines, np.array([1.0, 0.0, 1.0]), 1.0)
    theta = rng.normal(size=p.size) * 0.3
    got = p.gradient(theta)
    for i in range(p.size):
        step = np.zeros(p.size)
        step[i] = 1e-5
        assert got[i] == pytest.approx((p.value(theta + step) - p.value(theta - step)) / 2e-5, rel=1e-4, abs=1e-6)


def test_value_by_enumeration():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(5, crf.WIDTH)), np.array([1.0, 0.0, 0.0, 1.0, 1.0])
    p = crf.Likelihood([x], [y], np.array([1.0]), 0.0)
    theta = rng.normal(size=p.size) * 0.3
    e, t2 = p.z @ theta[:-4], theta[-4:].reshape(2, 2)

    def of(labels):
        return sum(e[t] for t, v in enumerate(labels) if v) + sum(t2[a, b] for a, b in zip(labels, labels[1:], strict=False))

    total = math.log(sum(math.exp(of(c)) for c in itertools.product((0, 1), repeat=5)))
    assert p.value(theta) == pytest.approx(p.weight[0] * (of(tuple(int(v) for v in y)) - total))


def test_lines_change_label_inside_documents():
    """A junk line in a good document, which few have, is marked bad; its neighbours stay good."""
    rng = random.Random(5)
    texts = [(good(rng, 4) + "\n" + (bad if i % 20 == 1 else good)(rng, 1) + "\n" + good(rng, 4), 1) if i % 2 else (bad(rng, 6), 0) for i in range(160)]
    m = crf.ChainCRF.fit([crf.line_features(t)[0] for t, _ in texts], [y for _, y in texts])
    p = m.marginals(crf.line_features(texts[1][0])[0])
    assert p[4] < 0.5 < min(p[1], p[7])


def test_ids_of_other_types_and_repeated_ids(spark):
    rng = random.Random(6)
    rows = [(f"d{i % 90}", (good if i % 2 else bad)(rng)) for i in range(90)] + [("d1", "other text"), (None, good(rng))]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    lab = spark.createDataFrame([(f"d{i}", i % 2) for i in range(90)], "doc_id string, quality int")
    got = crf.report(d, lab).collect()
    assert len(got) == 92 and sorted(map(tuple, got), key=str) == sorted(map(tuple, crf.report(d.repartition(5), lab).collect()), key=str)
    ints = crf.report(d.selectExpr("CAST(substr(doc_id, 2) AS int) AS doc_id", "text"), lab.selectExpr("CAST(substr(doc_id, 2) AS int) AS doc_id", "quality"))
    assert ints.schema["doc_id"].dataType.simpleString() == "int" and ints.count() == 92
