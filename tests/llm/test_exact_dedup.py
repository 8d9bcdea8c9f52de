import hashlib
import random

from corpusloom.llm import exact_dedup


def brute(rows):
    groups = {}
    norm = [t.translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) if t else "" for _, t in rows]
    for k, (d, t) in enumerate(rows):
        groups.setdefault(norm[k], []).append((-len(t or ""), d))
    out = []
    for k, (d, t) in enumerate(rows):
        g = groups[norm[k]]
        out.append((d, min(g)[1], len(g), min(g)[1] == d, hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out)


def test_against_brute(spark):
    rng = random.Random(0)
    long = "".join(rng.choice("abcé ") for _ in range(9000))
    texts = [None, "", " \n", "a", "a ", " a\t", "ab", long, long + "x", long + " ", long[:-1], "a" * 64, "a" * 65, "a" * 63 + " a", "a" * 512, "a" * 576, "a" * 577, "é ", "é"]
    rows = [(i, rng.choice(texts)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS gid", "2 AS block")
    assert sorted(tuple(r) for r in exact_dedup.report(df).collect()) == brute(rows)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r[4] for r in brute(rows)})


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "x y"), (1, "x y"), (1, "z"), (2, "xy"), (None, "z")], "doc_id long, text string")
    got = exact_dedup.report(df).collect()
    assert sum(r.kept for r in got) == 2
    assert {r.keep_id for r in got} == {1}
    assert exact_dedup.report(df.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    least = -(2**63)
    got = {r.doc_id: r.keep_id for r in exact_dedup.report(spark.createDataFrame([(least, "x"), (5, "x"), (7, "y")], "doc_id long, text string")).collect()}
    assert got == {least: least, 5: least, 7: 7}
    got = {r.doc_id: r.keep_id for r in exact_dedup.report(spark.createDataFrame([("b", "x"), ("a", " x"), ("c", "x "), (None, "x")], "doc_id string, text string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", None: "a"}
