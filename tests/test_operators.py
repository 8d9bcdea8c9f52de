import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import context as X
from corpusloom.operators import evaluate, firewall, fusion, graph, search


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("text,want", [
    ("HTTPServerError", ["http", "server", "error"]), ("snake_case2Name", ["snake", "case2", "name"]), ("", []), ("éa B", ["a", "b"]), ("ABC", ["abc"]), ("getURLs", ["get", "ur", "ls"]),
])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.lit(text))) == want


def test_cosine(spark):
    f = lambda a, b: one(spark, V.cosine(F.array(*map(F.lit, a)).cast("array<double>"), F.array(*map(F.lit, b)).cast("array<double>")))
    assert f([1, 0], [0, 1]) == 0.0
    assert f([2, 0], [5, 0]) == 1.0
    assert f([0, 0], [1, 1]) == 0.0
    assert f([1, 1], [1, 1, 9]) == pytest.approx(2 / (2**0.5 * 83**0.5))


def test_search_edges(spark):
    files = spark.createDataFrame([("a/b.py", "alpha beta"), ("c.py", None)], "path string, source string")
    layers = {"path": F.col("path"), "source": F.col("source")}
    q = search.query_table(spark, {"q": "alpha alpha B", "empty": "", "sep": "--"})
    rows = search.lexical_search(files, q, layers).collect()
    assert [(r.query_id, r.path, r.score, r.matched_terms) for r in rows] == [("q", "a/b.py", 6, ["alpha", "b"])]
    assert search.lexical_search(files, q, layers, limit=0).count() == 0
    assert search.lexical_search(files.limit(0), q, layers).count() == 0


def test_fusion_weights(spark):
    a = spark.createDataFrame([("q", "x", 3, 1), ("q", "y", 3, 2)], "query_id string, path string, score int, rank int")
    b = spark.createDataFrame([("q", "y", 0.5, 1)], "query_id string, path string, similarity double, rank int")
    for bad in ((-1, 2), (0, 0)):
        with pytest.raises(ValueError):
            fusion.weighted_fusion(a, b, bad)
        with pytest.raises(ValueError):
            fusion.rrf_fusion(a, b, bad)
    got = {r.path: r.hybrid_score for r in fusion.weighted_fusion(a, b).collect()}
    assert got == {"x": 0.5, "y": 1.0}


def test_evaluate_edges(spark):
    top = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, path string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("none", "z")], "query_id string, path string")
    got = {r.query_id: (r.precision, r.recall, r.reciprocal_rank) for r in evaluate.per_query(top, rel, 5).collect()}
    assert got == {"q": (0.5, 0.5, 0.5), "none": (0.0, 0.0, 0.0)}
    with pytest.raises(ValueError):
        evaluate.per_query(top, rel, 0)
    assert evaluate.summary(evaluate.per_query(top, rel.limit(0))).first().mrr == 0.0


def test_graph_cycles(spark):
    e = graph.edge_table(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("c", "d")], "src string, dst string"))
    s = spark.createDataFrame([("q", "a")], "query_id string, node string")
    assert {(r.node, r.depth) for r in graph.reach(e, s, 2).collect()} == {("b", 1), ("c", 2)}
    assert graph.reach(e, s, 0).count() == 0
    assert [r.node for r in graph.reach(e, s, 9, max_nodes=2).collect()] == ["b", "c"]
    with pytest.raises(ValueError):
        graph.neighbours(e, "zzz")
    roles = {r.node: r.role for r in graph.expand(e, spark.createDataFrame([("q", "b")], "query_id string, node string"), 1, 12).collect()}
    assert roles == {"a": "dependency", "c": "dependency"}


def test_budget(spark):
    ranked = spark.createDataFrame([("q", p, i + 1, t) for i, (p, t) in enumerate([("a", 5), ("b", 100), ("c", 4), ("d", 1)])], "query_id string, path string, position int, tokens long")
    got = {r.path: (r.selected, r.reason) for r in X.select_within_budget(ranked, 10).collect()}
    assert got == {"a": (True, None), "b": (False, "over_budget"), "c": (True, None), "d": (True, None)}
    assert {r.reason for r in X.select_within_budget(ranked, 0).collect()} == {"exceeds_total_budget"}
    assert all(r.selected for r in X.select_within_budget(ranked, None).collect())
    spans = spark.createDataFrame([("q", "b", 1, 9, 3, True), ("q", "b", 5, 6, 1, True), ("q", "b", 20, 30, 2, False)], "query_id string, path string, start_line int, end_line int, tokens long, evidence boolean")
    focus = [(r.path, r.start_line, r.selected) for r in X.select_with_focus(ranked, spans, 10).orderBy("position", "start_line").collect()]
    assert ("b", 1, True) in focus and ("b", 5, True) not in focus and ("b", 20, True) not in focus


def test_firewall(spark):
    key = "sk-" + "a" * 24
    files = spark.createDataFrame([("a.py", f"x\nk = '{key}' {key}\n"), (".env", "A=1"), ("d/secrets.yaml", ""), ("secrets.py", "ok"), ("k.PEM", ""), ("b.py", None), ("s.py", "xoxb-1234567890-abc")], "path string, source string")
    rows = firewall.findings(files).collect()
    assert [(r.path, r.line, r.type, r.matches) for r in rows] == [("a.py", 2, "api_key", 2)]
    got = {r.path: (r.decision, r.safe_source) for r in firewall.safe_files(files).collect()}
    assert got["a.py"] == ("redact", "x\nk = '[REDACTED]' [REDACTED]\n")
    assert {p for p, v in got.items() if v[0] == "block"} == {".env", "d/secrets.yaml", "k.PEM"}
    assert got["secrets.py"][0] == got["b.py"][0] == got["s.py"][0] == "allow"
    assert not firewall.is_safe(firewall.decisions(files, firewall.findings(files)))
    assert {r.decision for r in firewall.safe_files(files, enabled=False).collect()} == {"allow"}


def test_reach_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("q", "a")], "query_id string, node string")
    found = lambda **way: {r.node: r.depth for r in graph.reach(edges, start, 4, **way).collect()}
    assert found() == {"b": 1, "c": 2, "d": 3}
    assert found(cycles=True) == {"b": 1, "c": 2, "a": 3, "d": 3}
    assert graph.reach(edges, start, 0, cycles=True).isEmpty()
    with pytest.raises(ValueError):
        graph.reach(edges, start, -1)


def test_with_spans(spark):
    taken = spark.createDataFrame([("q", "a.py", 1, None, None, 9), ("q", "b.py", 2, 3, 4, 2), ("q", "c.py", 3, None, None, 5)], "query_id string, path string, position int, start_line int, end_line int, tokens bigint")
    spans = spark.createDataFrame([("a.py", 5, 6, 1), ("a.py", 1, 2, 1), ("b.py", 3, 4, 2), ("c.py", 1, 1, 1)], "path string, start_line int, end_line int, tokens bigint")
    rows = lambda **way: [(r.path, r.start_line) for r in X.with_spans(taken, spans, **way).orderBy("item").collect()]
    assert rows() == [("a.py", None), ("a.py", 1), ("a.py", 5), ("b.py", 3), ("c.py", None), ("c.py", 1)]
    assert rows(paths=["c.py"]) == [("a.py", None), ("b.py", 3), ("c.py", None), ("c.py", 1)]
