import textwrap

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import calls, code, imports
from corpusloom.operators import incremental as N
from corpusloom.sources import tree

FILES = {
    "app/__init__.py": "",
    "app/_helpers.py": "def tidy(x):\n    return x.strip()\n",
    "app/payments.py": """
        import os
        from app import _helpers
        from .models import Invoice as Bill

        RATE = 3

        class Gateway(Bill):
            def __init__(self, bill: Bill):
                self.bill = Bill()

            @staticmethod
            def charge(amount: int, *rest, key=None, **more):
                return _helpers.tidy(amount)

            def pay(self):
                self.bill.total()
                return unknown_thing(os.path)

        def make():
            g = Gateway(None)
            g.pay()
            Gateway.charge(1)
            return g
        """,
    "app/models.py": "class Invoice:\n    def total(self):\n        return 1\n",
    "main.py": "import app.payments\nfrom app.payments import make as build, Gateway\n\nbuild()\napp.payments.make()\nprint(Gateway)\n",
    "tests/test_pay.py": "from app.payments import make\n\ndef test_make():\n    assert make()\n",
    "venv/skip.py": "x = 1\n",
    "notes.txt": "no",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(textwrap.dedent(text).lstrip("\n"))
    return str(at)


@pytest.fixture(scope="module")
def analysis(spark, root):
    return code.analyse(tree.read_tree(spark, root)).cache()


def test_scan(spark, root):
    assert tree.discover(root) == ["app/__init__.py", "app/_helpers.py", "app/models.py", "app/payments.py", "main.py", "tests/test_pay.py"]
    assert tree.read_tree(spark, root).count() == 6
    with pytest.raises(FileNotFoundError):
        tree.discover(root + "/none")
    with pytest.raises(NotADirectoryError):
        tree.discover(root + "/main.py")


def test_symbols_and_spans(analysis):
    got = [(r.path, r.name, r.kind, r.parent_class) for r in code.symbols(analysis).collect()]
    assert ("app/payments.py", "charge", "method", "Gateway") in got
    assert [g[1] for g in got if g[0] == "app/payments.py"] == ["Gateway", "__init__", "charge", "pay", "make"]
    args = code.rows_of(analysis, "symbols").where("name = 'charge'").first().args
    assert [(a.name, a.annotation) for a in args] == [("amount", "int"), ("rest", None), ("key", None), ("more", None)]
    span = code.rows_of(analysis, "spans").where("name = 'charge'").first()
    assert (span.start_line, span.end_line) == (11, 13)
    assert code.find_symbols(code.symbols(analysis), "make", "function").count() == 1
    with pytest.raises(ValueError):
        code.find_symbols(code.symbols(analysis), "make", "module")


def test_import_graph(analysis):
    got = {(r.src, r.dst) for r in imports.import_edges(analysis).collect()}
    assert got == {
        ("app/payments.py", "app/_helpers.py"), ("app/payments.py", "app/models.py"), ("main.py", "app/payments.py"), ("tests/test_pay.py", "app/payments.py"),
    }


def test_call_graph(analysis):
    edges, unresolved = calls.build(analysis)
    show = lambda n: ".".join(filter(None, (n.path, n.parent_class, n.name)))
    got = {(r.kind, show(r.src), show(r.dst)) for r in edges.collect()}
    p = "app/payments.py"
    for want in (
        ("method_call", f"{p}.make", f"{p}.Gateway.pay"), ("method_call", f"{p}.make", f"{p}.Gateway.charge"),
        ("call", f"{p}.Gateway.charge", "app/_helpers.py.tidy"), ("method_call", f"{p}.Gateway.pay", "app/models.py.Invoice.total"), ("instantiation", f"{p}.make", f"{p}.Gateway"),
        ("call", "main.py", f"{p}.make"), ("reference", "main.py", f"{p}.Gateway"), ("call", "tests/test_pay.py.test_make", f"{p}.make"), ("import", "main.py", p),
        ("reference", p, "app/models.py.Invoice"),
    ):
        assert want in got, want
    lost = {(r.name, r.reason) for r in unresolved.collect()}
    assert ("unknown_thing", "unresolved_name") in lost
    assert not any(n == "print" for n, _ in lost)
    assert calls.relationship(edges, "called_by").count() == calls.relationship(edges, "calls").count() > 0
    assert calls.statistics(edges, unresolved).first()["import"] >= 4


def test_syntax_errors(spark):
    files = spark.createDataFrame([("a.py", "def f(:\n"), ("b.py", "x = 1"), ("c.py", None)], "path string, source string")
    a = code.analyse(files)
    assert {r.path: r.error is None for r in a.collect()} == {"a.py": False, "b.py": True, "c.py": True}
    with pytest.raises(SyntaxError):
        code.require_parsed(a)
    assert code.rows_of(a, "refs").count() == 0


def test_span_text(spark, root, analysis):
    files = tree.read_tree(spark, root)
    spans = code.rows_of(analysis, "spans").where("name = 'total'")
    assert code.span_text(files, spans).first().text == "    def total(self):\n        return 1\n"


def test_incremental(spark, root, tmp_path):
    schema = code.analyse(tree.read_tree(spark, root)).schema
    store = N.Store(spark, f"file://{tmp_path}/store")
    files = tree.read_tree(spark, root)
    parse = lambda df: code.analyse(df)
    _, first = N.refresh(files, store, parse, schema)
    assert first == {"files": 6, "parsed": 6, "removed": 0, "hits": 0}
    _, warm = N.refresh(files, store, parse, schema)
    assert warm["parsed"] == 0 and warm["hits"] == 6
    changed = files.withColumn("source", F.when(F.col("path") == "main.py", "y = 2").otherwise(F.col("source"))).where("path <> 'app/_helpers.py'")
    now, third = N.refresh(changed, store, parse, schema)
    assert third["parsed"] == 1 and third["removed"] == 2
    assert now.count() == 5
