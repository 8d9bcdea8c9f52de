import json

import pytest
from pyspark.sql import functions as F

from corpusloom import api
from corpusloom.operators import architecture, impact, plan
from corpusloom.operators.corpus import TargetError
from corpusloom.operators.plan import plan_risk
from tests.test_code import root  # noqa: F401


@pytest.fixture(scope="module")
def engine(spark, root):  # noqa: F811
    return api.Engine.open(spark, root)


def test_resolve(engine):
    c = engine.corpus
    assert c.resolve("app/payments.py::make").symbol == "make"
    assert c.resolve("app.models").path == "app/models.py"
    assert c.resolve("Invoice").kind == "symbol"
    assert c.resolve("payments").path == "app/payments.py"
    for bad in ("", "nope", "app/none.py", "::x", "app/models.py::nope"):
        with pytest.raises(TargetError):
            c.resolve(bad)


def test_impact(engine):
    r = engine.analyze_impact("app/models.py")
    got = {i.path: (i.relationship, i.depth) for i in r["items"].collect()}
    assert got["app/payments.py"] == ("direct_dependency", 1)
    assert got["main.py"] == ("indirect_dependency", 2)
    assert r["summary"].first().direct_dependents == 1
    make = {i.path: i.relationship for i in engine.analyze_impact("make")["items"].collect()}
    assert make["main.py"] == "direct_caller"
    assert make["tests/test_pay.py"] == "test"
    assert engine.analyze_impact("app/models.py", max_depth=0)["items"].where("relationship like '%_dependency'").count() == 0


def test_surface(engine):
    rows = {(r.path, r.relationship, r.direction): r.depth for r in engine.change_surface("app/payments.py").collect()}
    assert rows[("main.py", "import", "incoming")] == 1
    assert rows[("app/models.py", "import", "outgoing")] == 1
    assert all(k[2] == "outgoing" for k in {(r.path, r.relationship, r.direction) for r in engine.change_surface("app/payments.py", direction="outgoing").collect()})
    with pytest.raises(ValueError):
        engine.change_surface("app/payments.py", direction="sideways")


def test_context(engine):
    r = engine.get_context("where is make implemented in payments", max_tokens=400)
    assert r["intent"] == "implementation"
    assert 0 < r["total_estimated_tokens"] <= 400
    assert "app/payments.py" in r["rendered_safe_context"]
    small = engine.get_context("payments make", max_tokens=30)
    assert small["total_estimated_tokens"] <= 30
    with pytest.raises(api.ArgumentError):
        engine.get_context("x", max_tokens=0)


@pytest.mark.parametrize("strategy", ["lexical", "semantic", "rrf", "weighted"])
def test_strategies(engine, strategy):
    paths = [r.path for r in engine.retrieve("gateway charge payments", strategy).orderBy("rank").collect()]
    assert "app/payments.py" in paths[:2]  # by bags of words the short main.py may come first
    assert len(set(paths)) == len(paths)


def test_architecture(engine):
    subs = {r.subsystem: r for r in engine.discover_subsystems().collect()}
    assert set(subs) == {"app", "root", "tests"}
    assert subs["app"].dependents == ["root", "tests"]
    r = engine.inspect_architecture("app/payments.py")
    assert {x.node for x in r["dependencies"].collect()} == {"app._helpers", "app.models"}
    found = engine.architecture_candidates("change payments")["candidates"].collect()
    assert (found[0].id, found[0]["rank"]) in {("app.payments", 0), ("app/payments.py", 0)}
    why = engine.explain_architecture_match("payments", "app.models")
    assert why["relevant"] and why["dependency_paths"].first().chain == ["app.payments", "app.models"]
    assert not engine.explain_architecture_match("payments", "nothing")["relevant"]


def test_inspect_symbol(engine):
    r = engine.inspect_symbol("Gateway.charge")
    assert r["nodes"].count() == 1
    assert r["callees"].where(F.col("node").like("app/_helpers.py%")).count() == 1


def test_plan(engine):
    p = engine.change_plan("fix the Gateway in app/payments.py")
    assert p["analysis"]["action"] == "fix"
    assert p["targets"][0].target == "app/payments.py" and p["targets"][0].score == 100
    items = p["items"].orderBy("priority").collect()
    assert items[0].category == "primary_target" and [i.priority for i in items] == list(range(1, len(items) + 1))
    assert "tests/test_pay.py" in {r.path for r in p["tests"].collect()}
    c = engine.change_context("fix the Gateway in app/payments.py", max_tokens=500)
    assert c["context"]["total_estimated_tokens"] <= 500
    assert {"matched_symbols", "blocked_files", "firewall"} <= set(c["context"])
    why = engine.explain_change(c, "app/payments.py")
    assert why["in_plan"] and why["selected"] and why["firewall"] == "allowed" and why["category"] == "primary_target"
    assert engine.explain_change(c, "no/such.py")["budget_status"] == "not_considered"
    with pytest.raises(api.ArgumentError):
        engine.change_plan("x", "../out.py")


def test_plan_payload(engine):
    p = engine.change_plan_payload("fix the Gateway in app/payments.py")
    assert json.loads(json.dumps(p)) == p
    assert p["primary_target"]["target"] == "app/payments.py" and p["risk"] in ("low", "medium", "high")
    place = {a["target"]: a for a in p["architecture"]}["app/payments.py"]
    assert (place["kind"], place["package"], place["subsystem"]) == ("file", "app", "app")
    assert place["dependencies"] == ["app._helpers", "app.models"] and place["dependents"] == ["main", "tests.test_pay"]
    assert [i["priority"] for i in p["inspection_order"]] == list(range(1, len(p["inspection_order"]) + 1))
    module = engine.change_plan_payload("update app.payments", "app.payments")
    assert "public/API-facing symbols affected" in module["risk_factors"]
    assert module["inspection_order"][0]["path"] == "app/payments.py"


def test_kept_items(spark):
    rows = [("a", "primary_target", "primary"), ("b", "test", "test_of"), ("c", "direct_caller", "direct_caller"), ("d", "direct_dependency", "direct_callee"), ("e", "direct_dependency", "direct_dependency"), ("f", "architecture_entry", "x")]
    items = spark.createDataFrame(rows, "path string, category string, relationship string")
    left = lambda **off: "".join(sorted(r.path for r in plan.kept_items(items, **off).collect()))
    assert left() == "abcdef" and left(tests=False) == "acdef" and left(callers=False) == "abdef"
    assert left(callees=False) == "abcef" and left(dependencies=False) == "abcdf" and left(architecture=False) == "abcde"


def test_package_module(spark):
    got = spark.createDataFrame([("a/__init__.py",), ("a/b.py",), ("c.py",)], "path string").select(plan.dotted(F.col("path")).alias("m"))
    assert [r.m for r in got.collect()] == ["a", "a.b", "c"]


def test_impact_context(engine):
    r = engine.impact_context("app/models.py", max_tokens=10000)
    paths = [x.path for x in r["selection"].where("selected").orderBy("position").collect()]
    assert paths[:2] == ["app/models.py", "app/payments.py"] and "main.py" in paths
    assert engine.change_question_context("what breaks if make changes")["target"]
    with pytest.raises(TargetError):
        engine.change_question_context("zzz qqq")


def test_architecture_context(engine):
    wide = api.Engine(engine.corpus, architecture=True)
    got = {r.path: r for r in wide.candidates("payments").collect()}
    assert any(r.inclusion_reason == "architecture" for r in got.values())
    assert len(got) >= engine.candidates("payments").count()


def test_views(engine):
    near, far, files = impact.surface_views(engine.change_surface("app/models.py"))
    assert all(r.depth == 1 for r in near.collect()) and all(r.depth >= 2 for r in far.collect())
    order = [r.path for r in files.orderBy("position").collect()]
    assert len(order) == len(set(order)) and set(order) == {r.path for r in near.union(far).collect()}
    subs = engine.discover_subsystems()
    assert [r.subsystem for r in architecture.containing(subs, "module", "app.models").collect()] == ["app"]
    with pytest.raises(ValueError):
        architecture.containing(subs, "planet", "x")


def test_plan_risk():
    assert plan_risk({"tests": 3}) == ("low", [])
    level, why = plan_risk({"affected": 25, "callers": 6, "tests": 0, "subsystems": 2})
    assert level == "high" and len(why) == 4
