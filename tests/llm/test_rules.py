import random

from corpusloom.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = text.encode().split()
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {p + k for at in where.values() if len(at) > 1 for p in at for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), len(b"".join(words).decode()), sum(text.count(c) for c in q.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(7)
    texts = [None, "", " ", "one", "a a a a", "a b c a b c", "x\n\nx\nx \n", "é #*$%&|<> \x0b z"]
    texts += [rng.choice([" ", "\n", "\t "]).join(rng.choice(["the", "of", "Wort", "é#", "a"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    texts.append(" ".join(rng.choice("abcdefgh") for _ in range(20000)))
    rows = list(enumerate(texts)) + [(3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS kept")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.report(df).collect())
    want = []
    for d, t in rows:
        m = brute(t)
        want.append((d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want)
    assert q.report(df.limit(0)).count() == 0


def test_table_compiles_to_one_projection(spark, tiny_dir):
    plan = q.report(spark.read.parquet(f"{tiny_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_clean_and_junk(spark):
    clean = " ".join(f"the word{i} of thing{i * 7}" for i in range(40))
    junk = " ".join(f"$$$w{i} ###" for i in range(80))
    got = {r.doc_id: r.kept for r in q.report(spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False}
