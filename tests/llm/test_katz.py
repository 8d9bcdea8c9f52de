import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import katz


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return low.encode().split() + ["END"]


class Brute:
    """The same model from plain dictionaries, with its own arithmetic."""

    def __init__(self, rows, min_count=1):
        train = [tokens(t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
        self.uni = Counter(w for t in train for w in t)
        self.pair = Counter(p for t in train for p in zip(["START", *t[:-1]], t, strict=True))
        self.history = Counter(h for t in train for h in ["START", *t[:-1]])
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.bu, self.bp = self.slope(self.uni), self.slope(self.pair)
        self.unk = 1 - sum(self.star(c, self.bu) for c in self.uni.values()) / max(self.n, 1)
        self.kept = {p: c for p, c in self.pair.items() if c >= min_count}
        self.alpha = {}
        after = {}
        for (x, w), c in self.kept.items():
            after.setdefault(x, []).append((w, c))
        for h in self.history:
            own = after.get(h)
            if own:
                self.alpha[h] = (1 - sum(self.star(c, self.bp) / self.history[h] for _, c in own)) / (1 - sum(self.word(w) for w, _ in own))

    @staticmethod
    def slope(counts):
        nn = Counter(counts.values())
        r = sorted(nn)
        if len(r) < 2:
            return -1.5
        xs, ys = [], []
        for i, x in enumerate(r):
            q = r[i - 1] if i else 0
            t = r[i + 1] if i + 1 < len(r) else 2 * x - q
            xs.append(math.log(x))
            ys.append(math.log(nn[x] / (0.5 * (t - q))))
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        return min(sum((a - mx) * (b - my) for a, b in zip(xs, ys, strict=True)) / sum((a - mx) ** 2 for a in xs), -1.05)

    @staticmethod
    def star(c, b):
        return c * (1 + 1 / c) ** (b + 1)

    def word(self, w):
        return self.star(self.uni[w], self.bu) / self.n if w in self.uni else self.unk

    def p(self, h, w):
        if (h, w) in self.kept:
            return self.star(self.kept[h, w], self.bp) / self.history[h]
        return self.alpha.get(h, 1.0) * self.word(w)

    def row(self, d, text):
        t = tokens(text)
        base = sum(math.log10((self.uni[w] + 1) / (self.n + self.v + 1)) for w in t)
        score = sum(math.log10(self.p(h, w)) for h, w in zip(["START", *t[:-1]], t, strict=True))
        return d, zlib.crc32(str(d).encode()) % 7 == 2, len(t), sum(self.uni[w] > 0 for w in t), self.n, base, score


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_against_brute(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["The", "É"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, rows[0][1]), (503, rows[0][1]), (504, "only here"), (506, "x " * 3000)]
    model = Brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS bucket").repartition(3)
    got = [tuple(r) for r in katz.score(df, block_chars=900, bucket_tokens=20).collect()]
    same(got, [model.row(*r) for r in rows])
    cut = Brute(rows, min_count=2)
    same([tuple(r) for r in katz.score(df, block_chars=900, min_count=2).collect()], [cut.row(*r) for r in rows])
    for h in list(model.history)[:20]:  # every history's distribution sums to one
        assert sum(model.p(h, w) for w in model.uni) + model.alpha.get(h, 1.0) * model.unk == pytest.approx(1.0)


def test_table(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = Brute(rows)
    same([tuple(r) for r in katz.report(docs).collect()], [model.row(*r) for r in rows])


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(d, "a b") for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in katz.report(df).collect()} == {(0, 0, 0.0, 0.0)}
    assert katz.report(df.limit(0)).count() == 0


def test_packed_counts():
    for v in ([], [0, 1, 254, 255, 256, 2**40], [300] * 5):
        a = np.array(v, dtype=np.int64)
        assert katz.large(katz.small(a), len(a)).tolist() == v


def test_query_keeps_pairs_seen_once(spark, tmp_path):
    from corpusloom.llm.queries import QUERIES

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(30)], k=20))) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model = Brute(rows)
    assert 1 in model.kept.values()
    same([tuple(r) for r in QUERIES["op8_lm_scoring"](spark, str(tmp_path)).collect()], [model.row(*r) for r in rows])


def test_null_ids_train(spark):
    rows = [(None, "a b a"), (None, "a b"), (1, "a c")]
    got = katz.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3 and {r.train_tokens for r in got} == {sum(len(tokens(t)) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2)}
