import random

import numpy as np
import xxhash

from corpusloom.llm import simhash


def brute_fingerprint(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (id, fp) to {index: smallest id reachable}."""
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), fps[i][0]), fps[i][0])
    return [low[find(i)] for i in range(n)]


def test_fingerprint():
    rng = random.Random(3)
    for k in list(range(8)) + [500]:
        text = " \n".join(rng.choice(["The", "é", "of", "a\x0bb", "x y"]) for _ in range(k))
        assert simhash.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)


def test_components_against_all_pairs(spark):
    rng = random.Random(5)
    fps = []
    base = [rng.getrandbits(64) for _ in range(12)]
    for i in range(400):
        f = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append((i * 7 % 401, f))
    df = spark.createDataFrame([(d, int(np.uint64(f).astype(np.int64))) for d, f in fps], "doc_id long, fp long")
    real = simhash.fingerprints
    simhash.fingerprints = lambda *a: df
    try:
        got = {r.doc_id: r.component_id for r in simhash.near_components(df).collect()}
    finally:
        simhash.fingerprints = real
    assert got == {d: c for (d, _), c in zip(fps, brute_components(fps), strict=True)}


def test_query_and_edge_rows(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, "  \n"), (9004, "one two"), (9005, "ONE two"), (9005, "ONE two")], "doc_id long, text string")
    df = docs.union(more)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps), strict=True))
    got = sorted(tuple(r) for r in simhash.report(df.selectExpr("*", "1 AS fp", "2 AS component_id")).collect())
    assert got == want
    assert simhash.report(df.limit(0)).count() == 0


def test_similar_documents(spark):
    """Near copies of each original are found and nothing else is touched."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    rows, groups = [], {}
    for g in range(25):
        base = rng.choices(vocab, k=rng.choice([60, 200, 1200]))
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(max(1, len(words) // 120)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    sets = [set(simhash.shingle_hashes(simhash._tokens(t), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS segments", "2 AS d")
    got = {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()}
    assert got == {i: r for i, r in enumerate(root) if r != i}
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_similar_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "two words"), (5, "two words"), (None, "two words"), (None, "x"), (6, "z " * 20000), (7, "Z\t" * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id for r in simhash.drop_near_copies(df).collect()), key=str)
    assert got == [1, 3, 5, 6, None]
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def brute_similar(rows):
    sets = [set(simhash.shingle_hashes(simhash._tokens(t), 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return {i: r for i, r in enumerate(root) if r != i}


def found_similar(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()}


def test_similar_appended_and_truncated(spark):
    """Copies with new words added at the end, or cut off, down to the threshold itself."""
    rng = random.Random(12)
    rows = []
    for g in range(60):
        n = rng.choice([60, 120, 300])
        base = [f"g{g}w{i}" for i in range(n)]
        cut = (n - 4) // 5 - rng.choice([0, 0, 1])
        more = (n - 4) // 4 - rng.choice([0, 0, 1])
        for words in (base, base[:n - cut], [*base, *(f"g{g}x{i}" for i in range(more))]):
            rows.append((len(rows), " ".join(words)))
    want = brute_similar(rows)
    assert len(want) == 120
    assert found_similar(spark, rows) == want


def test_similar_in_crowded_keys(spark):
    """Near copies among many variants of one template that are only related."""
    rng = random.Random(13)
    template = [f"t{i}" for i in range(200)]
    rows = []
    for g in range(300):
        words = list(template)
        for i in rng.sample(range(200), 20):
            words[i] = f"g{g}w{i}"
        rows.append((len(rows), " ".join(words)))
        if g % 10 == 0:
            for i in rng.sample(range(200), 4):
                words[i] = f"g{g}y{i}"
            rows.append((len(rows), " ".join(words)))
    want = brute_similar(rows)
    assert len(want) >= 20
    assert found_similar(spark, rows) == want


def test_hot_segment_values(spark):
    """Links through values that many fingerprints hold connect what all pairs connect."""
    from corpusloom.llm.common import Scratch

    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:3]:  # crowds that share a segment, some of them near each other
        for _ in range(60):
            fps.add(base ^ (rng.getrandbits(3) << 40) ^ (1 << rng.randrange(33, 64)))
            fps.add(base ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)))
    fps = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_components([(f, f & (2**64 - 1)) for f in fps])
    for hot in (4, 1000):
        edges = [(r.u, r.v) for r in simhash.links(df, Scratch(spark, "test"), 2, hot).collect()]
        assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 2 for u, v in edges)
        low = {f: f for f in fps}
        moved = True
        while moved:
            moved = False
            for u, v in edges:
                if low[u] != low[v]:
                    low[u] = low[v] = min(low[u], low[v])
                    moved = True
        assert [low[f] for f in fps] == want


def test_rows_that_share_an_id(spark):
    """Each row is a document: different texts under one id both stay."""
    rng = random.Random(2)
    a, b = (" ".join(rng.choices([f"v{i}" for i in range(500)], k=80)) for _ in range(2))
    rows = [(1, a, "p"), (1, b, "q"), (2, a, "r"), (3, b + " end", "s"), (3, "other", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `row` string")
    got = simhash.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(r.row for r in got.collect()) == ["p", "q", "t"]


def linked_sets(fps, pairs):
    """{index: smallest index reachable over pairs}."""
    low = list(range(len(fps)))
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                moved = True
    return low


def test_fingerprint_pairs(spark):
    """Pairs of documents connect what fingerprints within two bits connect, copies included."""
    from corpusloom.llm.common import Scratch

    rng = random.Random(21)
    base = [rng.getrandbits(64) for _ in range(15)]
    fps = []
    for _ in range(300):
        f = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    marked = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    pairs = [tuple(r) for r in simhash.fingerprint_pairs(marked, Scratch(spark, "test")).collect()]
    assert all(a < b and (fps[a] ^ fps[b]).bit_count() <= 2 for a, b in pairs)
    assert linked_sets(fps, pairs) == brute_components(list(enumerate(fps)))


def test_pipeline_stage_is_by_fingerprints(spark, monkeypatch):
    """Without the exact search that follows, linked fingerprints join near copies, but only similar ones."""
    import corpus_pipeline

    rng = random.Random(22)
    vocab = [f"w{i}" for i in range(4000)]
    rows, near = [], set()
    for _ in range(30):
        words = rng.choices(vocab, k=1500)
        rows.append((len(rows), " ".join(words)))
        words[rng.randrange(1500)] = "changed"
        if ((simhash.fingerprint(rows[-1][1]) ^ simhash.fingerprint(" ".join(words))) & (2**64 - 1)).bit_count() <= 2:
            near.add(len(rows))
        rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), "a b c d"), (len(rows) + 1, "a b c d " * 40)]  # similar in no way that counts
    for name in ("star_pairs", "open_pairs"):
        monkeypatch.setattr(simhash, name, lambda rows, *a: rows.select("doc_id", "doc_id").toDF("a", "b").limit(0))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert near and left == {d for d, _ in rows} - near
