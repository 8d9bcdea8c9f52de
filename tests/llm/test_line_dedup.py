import hashlib
import random

import pytest

from corpusloom.llm import line_dedup
from corpusloom.llm.common import Scratch


def words(line):
    return len(line.encode().split())


def brute(rows, min_words):
    """rows: distinct (doc_id, text). Longest earlier match from every line."""
    seq, owner = [], []
    for d, t in sorted(rows):
        real = [i for i, x in enumerate((t or "").split("\n")) if words(x)]
        for i in real:
            seq.append((t or "").split("\n")[i])
            owner.append((d, i))
        seq.append(object())
        owner.append(None)
    gone, longest = {}, {}
    for i in range(len(seq)):
        if owner[i] is None:
            continue
        best = 0
        for j in range(i):
            n = 0
            while i + n < len(seq) and isinstance(seq[i + n], str) and seq[j + n] == seq[i + n]:
                n += 1
            best = max(best, n)
        longest[i] = best
        if best and sum(words(seq[i + x]) for x in range(best)) >= min_words:
            for x in range(best):
                d, ln = owner[i + x]
                gone.setdefault(d, set()).add(ln)
    return gone, longest


def texts(rng, n, alphabet, most):
    pool = [" ".join([w] * rng.randint(1, 6)) for w in alphabet]
    blocks = [[rng.choice(pool) for _ in range(rng.randint(2, 9))] for _ in range(4)]
    out = []
    for _ in range(n):
        lines = []
        while len(lines) < most:
            lines += rng.choice(blocks) if rng.random() < 0.5 else [rng.choice([*pool, "", " ", f"u{rng.random()}"])]
            if rng.random() < 0.15:
                break
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("seed,n,alphabet,most", [(1, 25, "abcdefgh", 14), (2, 12, "ab", 20), (3, 8, "a", 17)])
def test_against_brute(spark, seed, n, alphabet, most):
    rng = random.Random(seed)
    rows = list(enumerate(texts(rng, n, alphabet, most)))
    rows += [(900, None), (901, ""), (902, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone, longest = brute([r for r in rows if r[1] is not None], 7)
    scratch = Scratch(spark, "t")
    lines, _ = scratch.save(line_dedup.sequence(df, "text", "doc_id"))
    order = {r.p: k for k, r in enumerate(sorted(lines.collect(), key=lambda r: r.p))}
    found = line_dedup.copied_prefixes(line_dedup.suffix_levels(lines, scratch), scratch).collect()
    assert {order[r.p]: r.l for r in found} == {i: v for i, v in longest.items() if v}
    got = {r.doc_id: r for r in line_dedup.report(df, 7).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        left = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, ()))
        assert got[d].n_removed == len(gone.get(d, ()))
        assert got[d].text_sha256 == hashlib.sha256(left.encode()).hexdigest()


def test_columns_and_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, f"{long}\nnew", "x"), (1, f"old\n{long}", "y"), (3, long, "z"), (3, long, "z"), (4, None, "n"), (None, "alone", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, p string")
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, "new", "x"), (1, f"old\n{long}", "y"), (4, None, "n"), (None, "alone", "q")], key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    clash = line_dedup.dedup_lines(df.selectExpr("*", "7 AS _ld_text", "8 AS _ld_runs"))
    assert clash.columns == [*df.columns, "_ld_text", "_ld_runs"] and {(r._ld_text, r._ld_runs) for r in clash.collect()} == {(7, 8)}
    assert line_dedup.dedup_lines(df, drop_emptied=False).count() == 6


def test_short_runs(spark):
    rows = [(1, "one two three\nfour five\nown"), (2, "one two three\nfour five"), (3, "x\nRead more now"), (4, "y\nRead more now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.dedup_lines(df).collect())) == [rows[0], rows[2], (4, "y")]
    assert sorted(map(tuple, line_dedup.dedup_lines(df, min_words=5).collect())) == [rows[0], rows[2], rows[3]]
