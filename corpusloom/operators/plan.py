"""Change planning: targets of a request, affected files, tests, risk, inspection order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions import text as T
from corpusloom.operators import architecture as A
from corpusloom.operators.corpus import PLAN, Corpus, TargetError
from corpusloom.operators.impact import lookup

# Scores and categories by kind of match and by relationship.
TARGET_SCORES = {"exact_file": 100, "exact_module": 90, "exact_symbol": 85, "exact_package": 80, "search": 60, "architecture": 40, "fallback": 25, "unresolved": 20}
CATEGORY = {
    "direct_caller": "direct_caller", "indirect_caller": "indirect_caller", "direct_dependency": "direct_dependency", "indirect_dependency": "indirect_dependency",
    "direct_callee": "direct_dependency", "indirect_callee": "indirect_dependency", "test": "test", "configuration": "broader_neighbor", "api_consumer": "architecture_entry", "reverse_dependency": "direct_caller",
}
BASE_SCORE = {
    "direct_caller": 80, "indirect_caller": 50, "direct_dependency": 70, "indirect_dependency": 40, "direct_callee": 65, "indirect_callee": 35,
    "test": 75, "configuration": 30, "api_consumer": 60, "reverse_dependency": 55,
}
TARGET_FIELDS = "seq int, target string, kind string, score int, confidence string, reason string"
ITEM_FIELDS = "path string, module string, symbol string, category string, score int, confidence string, reason string, relationship string"
ITEM_KEYS = ("path", "module", "symbol", "category", "score", "confidence", "reason", "relationship", "priority")
CALLERS, CALLEES = ("direct_caller", "indirect_caller"), ("direct_callee", "indirect_callee")
DEPENDENCIES, TESTS = ("direct_dependency", "indirect_dependency"), ("test", "indirect_test")
# What a category says of a file.
CATEGORY_MEANING = {
    "primary_target": "primary change target", "direct_caller": "direct caller of the change target", "indirect_caller": "indirect caller of the change target",
    "direct_dependency": "direct dependency of the change target", "indirect_dependency": "indirect dependency of the change target",
    "architecture_entry": "architecture entry point / API consumer", "test": "affected test", "indirect_test": "indirectly affected test",
    "subsystem_neighbor": "same-subsystem neighbor", "broader_neighbor": "broader neighbourhood / configuration",
}


def analyse_request(spark, request: str) -> dict:
    """action, tokens, domain_terms, paths, modules and types of a request."""
    r = F.lit(request)
    row = spark.range(1).select(T.action(r).alias("action"), T.tokens(r).alias("tokens"), T.domain_terms(r).alias("domain_terms"), T.path_mentions(r).alias("paths"), T.module_mentions(r).alias("modules"), T.type_mentions(r).alias("types")).first()
    return row.asDict()


def merge_targets(found: DataFrame) -> DataFrame:
    """One row per target: best score, first kind and confidence, reasons in order."""
    return found.groupBy("target").agg(
        F.min_by("kind", "seq").alias("kind"), F.max("score").alias("score"), F.min_by("confidence", "seq").alias("confidence"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x["reason"])).alias("reasons"),
    )


def discover_targets(corpus: Corpus, request: str, explicit: str | None = None) -> DataFrame:
    """Ranked targets of a request, from its mentions, a search and the architecture."""
    spark, said = corpus.spark, analyse_request(corpus.spark, request)
    rows, S = [], TARGET_SCORES

    def add(target, kind, score, confidence, reason):
        rows.append((len(rows), target, kind, score, confidence, reason))

    if explicit:
        try:
            t = corpus.resolve(explicit)
            if t.kind == "file":
                add(t.path, "file", S["exact_file"], "confirmed", "explicit file target")
            elif t.symbol is None:
                add(t.module, "module", S["exact_module"], "confirmed", "explicit module target")
            else:
                add(t.module, "module", S["exact_symbol"], "confirmed", f"explicit symbol target: {t.module}")
        except TargetError:
            if corpus.arch_nodes.where((F.col("kind") == "package") & (F.col("id") == explicit)).isEmpty():
                add(explicit, "module", S["unresolved"], "possible", "explicit target (unresolved)")
            else:
                add(explicit, "package", S["exact_package"], "confirmed", "explicit package target")
    known = {(r.kind, r.id) for r in corpus.arch_nodes.where(F.col("id").isin([*said["paths"], *said["modules"]])).collect()}
    for p in said["paths"]:
        if ("file", p) in known:
            add(p, "file", S["exact_file"], "confirmed", f"file path in request: {p}")
        elif ("package", p) in known:
            add(p, "package", S["exact_package"], "likely", f"package path in request: {p}")
    for m in said["modules"]:
        if ("module", m) in known:
            add(m, "module", S["exact_module"], "confirmed", f"module in request: {m}")
    if said["types"]:
        homes = corpus.symbols.where(F.col("name").isin(said["types"])).withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("path", "line"))).where("n <= 3")
        for h in homes.orderBy("name", "n").collect():
            add(corpus.module_of(h.path), "module", S["exact_symbol"], "confirmed", f"symbol '{h.name}' defined in {h.path}")
    if said["domain_terms"]:
        query = " ".join(said["domain_terms"])
        for r in corpus.search({"q": query}, PLAN["search"]).where("rank <= 10").orderBy("rank").collect():
            add(r.path, "file", S["search"], "likely", f"lexical match for '{query}' (score={r.score})")
        for s in corpus.signals(query).where("kind <> 'file'").limit(15).collect():
            add(s.id, s.kind, S["architecture"], "likely" if s.kind == "module" else "possible", f"architecture signal: {s.reason}")
    if not rows:
        for r in corpus.search({"q": request}, 5).where("rank <= 3").orderBy("rank").collect():
            add(r.path, "file", S["fallback"], "possible", "fallback lexical search for full request")
    merged = merge_targets(spark.createDataFrame(rows, TARGET_FIELDS))
    return merged.orderBy(F.desc("score"), "target").limit(PLAN["targets"])


def dotted(path):
    """A path as a module; a package's own file names the package."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("/"), F.lit(".")), r"\.py", ""), r"\.__init__$", "")


def affected_files(corpus: Corpus, targets: list) -> DataFrame:
    """Files that the first targets' impact reaches, numbered; of several the first, capped."""
    parts = []
    for i, t in enumerate(targets[:PLAN["primary"]]):
        try:
            items, _ = corpus.impact(t.target, PLAN["impact_depth"], 200)
        except TargetError:
            continue
        parts.append(items.where(F.col("path") != t.target).withColumn("_t", F.lit(i)))
    if not parts:
        return corpus.spark.createDataFrame([], ITEM_FIELDS + ", position int")
    every = reduce(DataFrame.unionByName, parts)
    first = F.row_number().over(Window.partitionBy("path").orderBy("_t", "position"))
    rel = F.col("relationship")
    category = F.when((rel == "reverse_dependency") & (F.col("depth") != 1), "indirect_caller").otherwise(lookup(CATEGORY, rel))
    score = F.greatest(lookup(BASE_SCORE, rel) - 10 * F.col("depth"), F.lit(10)).cast("int")
    kept = every.withColumn("_n", first).where("_n = 1").orderBy("_t", "position").limit(PLAN["affected"])
    place = F.row_number().over(Window.orderBy("_t", "position"))  # of the few that are kept
    return kept.select("path", dotted(F.col("path")).alias("module"), "symbol", category.alias("category"), score.alias("score"), F.lit("confirmed").alias("confidence"), "reason", F.col("relationship"), place.alias("position"))


def likely_tests(corpus: Corpus, affected: DataFrame, targets: list) -> DataFrame:
    """Tests that import what is affected, match its name or share a subsystem; numbered and capped."""
    mods = {t.target for t in targets if t.kind == "module"} | {t.target.replace("/", ".").removesuffix(".py").removesuffix(".__init__") for t in targets if t.kind == "file"}
    mods |= {r.module for r in affected.select("module").collect()}
    leaves = sorted({m.rsplit(".", 1)[-1] for m in mods} - {""})
    homes = sorted({(t.target.split("/")[0] if "/" in t.target else t.target.split(".")[0]) for t in targets})
    tests = corpus.files.where(F.contains("path", F.lit("test"))).select("path").withColumn("module", F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit(".")))
    edges = corpus.arch_edges().where(F.col("dst").isin(sorted(mods))).groupBy(F.col("src").alias("module")).agg(F.array_sort(F.collect_set("dst")).alias("_used"))
    j = tests.join(edges, "module", "left").withColumn("_sub", A.subsystem_of(F.col("path")))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.py$", "")
    match = F.filter(F.array(*[F.lit(x) for x in leaves]).cast("array<string>"), lambda x: F.contains(stem, x))
    used = F.col("_used").isNotNull()
    reason = F.when(used, F.concat(F.lit("test: imports affected module ("), F.array_join("_used", ", "), F.lit(")"))).when(F.size(match) > 0, F.concat(F.lit("test: matching name for '"), F.get(match, F.lit(0)), F.lit("'"))).when(F.col("_sub").isin(homes), F.concat(F.lit("test: same subsystem '"), "_sub", F.lit("'")))
    out = j.withColumn("reason", reason).where("reason is not null")
    out = out.select("path", "module", F.lit(None).cast("string").alias("symbol"), F.when(used, "test").otherwise("indirect_test").alias("category"), F.when(used, 70).otherwise(40).alias("score"), F.when(used, "confirmed").otherwise("likely").alias("confidence"), "reason", F.lit("test_of").alias("relationship"))
    kept = out.orderBy(F.desc("score"), "path").limit(PLAN["tests"])
    return kept.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "path")))


def enrich(corpus: Corpus, targets: list) -> tuple[list[dict], DataFrame]:
    """Architecture of the first targets that are nodes: a dict for each, and their neighbours.

    A module counts before a file and a package of the same name. Neighbours are
    (target, direction, node, package): modules, or packages around a package.
    """
    first = [t.target for t in targets[:PLAN["primary"]]]
    order = F.when(F.col("kind") == "module", 0).when(F.col("kind") == "file", 1).otherwise(2)
    kinds = {r.id: r.kind for r in corpus.arch_nodes.where(F.col("id").isin(first)).groupBy("id").agg(F.min_by("kind", order).alias("kind")).collect()}
    files = {r.module: r.file for r in corpus.modules.where(F.col("module").isin(first)).collect()}
    rows = []
    for t in (t for t in first if t in kinds):
        path = {"file": t, "module": files.get(t, t)}.get(kinds[t], "" if t == "." else f"{t}/")
        package = None if kinds[t] != "file" else path.rsplit("/", 1)[0] if "/" in path else "."
        rows.append({"target": t, "kind": kinds[t], "module": t, "package": package, "subsystem": path.split("/")[0] if "/" in path else "root"})
    entry = F.array_min(F.transform("entry_files", lambda x: P.module_name(x)))
    entries = {r.subsystem: r.entry for r in corpus.subsystems.where(F.col("subsystem").isin([r["subsystem"] for r in rows])).select("subsystem", entry.alias("entry")).collect()}
    for r in rows:
        r["entry_module"] = entries.get(r["subsystem"])
    at = corpus.spark.createDataFrame([(r["target"], corpus.module_of(r["target"]) if r["kind"] == "file" else r["target"], r["kind"] == "package") for r in rows], "target string, at string, pack boolean")
    edges = corpus.arch_edges().distinct().withColumn("pack", F.lit(False))
    if any(r["kind"] == "package" for r in rows):
        owner = corpus.files.select(F.col("path").alias("node"), A.package_of(F.col("path")).alias("group"))
        edges = edges.unionByName(A.lifted_edges(corpus.imports, owner).select("src", "dst", F.lit(True).alias("pack")))
    few = F.broadcast(at)  # at most the first targets
    out = edges.join(few.withColumnRenamed("at", "src"), ["src", "pack"]).select("target", F.lit("dependency").alias("direction"), F.col("dst").alias("node"))
    into = edges.join(few.withColumnRenamed("at", "dst"), ["dst", "pack"]).select("target", F.lit("dependent").alias("direction"), F.col("src").alias("node"))
    top = F.when(F.contains("node", F.lit(".")), F.substring_index("node", ".", 2))
    return rows, out.unionByName(into).withColumn("package", top)


def plan_risk(counts: dict) -> tuple[str, list[str]]:
    """Level and factors from counts of affected, callers, dependents, packages, subsystems, tests."""
    ladder = (
        ("affected", ((20, 3, "many affected files ({})"), (10, 2, "moderate affected files ({})"), (5, 1, "some affected files ({})"))),
        ("callers", ((5, 2, "many callers ({})"), (2, 1, "some callers ({})"))),
        ("dependents", ((3, 2, "many dependents ({})"), (0, 1, "some dependents ({})"))),
        ("packages", ((4, 2, "cross-package change ({} packages)"), (1, 1, "cross-package change ({} packages)"))),
        ("subsystems", ((1, 3, "cross-subsystem change ({} subsystems)"),)),
        ("public", ((0, 2, "public/API-facing symbols affected"),)),
    )
    points, factors = 0, []
    for name, steps in ladder:
        for above, worth, said in steps:
            if counts.get(name, 0) > above:
                points += worth
                factors.append(said.format(counts[name]))
                break
    if counts.get("tests", 0) < 2:
        points += 1
        factors.append("limited test coverage" if counts.get("tests") else "no tests identified")
    if counts.get("unresolved", 0) > 0:
        points += 1
        factors.append(f"unresolved references ({counts['unresolved']})")
    return ("high" if points >= 6 else "medium" if points >= 3 else "low"), factors


def inspection_order(spark, primary, affected: DataFrame, dependents: list[tuple[str, str]], tests: DataFrame, path: str | None = None, module: str | None = None) -> DataFrame:
    """Items numbered by priority: primary, callers, dependencies, dependents, tests, the rest.

    path and module: the primary target's file, which a module is defined in.
    """
    bucket = F.when(F.col("category") == "direct_caller", 1).when(F.col("category") == "direct_dependency", 2).when(F.col("category").isin("indirect_caller", "indirect_dependency", "broader_neighbor", "subsystem_neighbor"), 5)
    a = affected.withColumn("_b", bucket).withColumnRenamed("position", "_s").where("_b is not null")
    t = tests.withColumn("_b", F.lit(4)).withColumnRenamed("position", "_s")
    head = [(path or primary.target, module or primary.target, None, "primary_target", 100, primary.confidence, primary.reasons[0], "primary", 0, 0)] if primary else []
    head += [(d, d, None, "architecture_entry", 55, "likely", f"architecture dependent of {of}", "architecture_dependent", 3, i) for i, (of, d) in enumerate(dependents)]
    h = spark.createDataFrame(head, ITEM_FIELDS + ", _b int, _s int")
    every = h.unionByName(a).unionByName(t)
    return every.withColumn("priority", F.row_number().over(Window.orderBy("_b", "_s"))).drop("_b", "_s").where(F.col("priority") <= PLAN["items"])


def change_plan(corpus: Corpus, request: str, target: str | None = None) -> dict:
    """The whole plan: request analysis, targets, affected files, tests, risk, order."""
    targets = discover_targets(corpus, request, target).collect()
    affected = corpus.scratch.save(affected_files(corpus, targets))
    tests = corpus.scratch.save(likely_tests(corpus, affected, targets))
    named = [t for t in targets[:PLAN["primary"]] if t.kind != "package"]
    module = {t.target: t.target if t.kind == "module" else corpus.module_of(t.target) for t in named}
    edges = corpus.arch_edges()
    near = edges.where(F.col("dst").isin(list(module.values()))).withColumn("n", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where("n <= 3").collect()
    dependents = [(t, r.src) for t, m in module.items() for r in sorted(near, key=lambda r: r.n) if r.dst == m]
    placed, around = enrich(corpus, targets)
    around = corpus.scratch.save(around)
    own = {r["package"] for r in placed} - {None}
    packs = around.where(F.col("package").isNotNull() & ~F.col("package").isin(sorted(own))).select("package").distinct().count() + len(own)
    rows = affected.select("category", "relationship", "reason", "symbol").collect()
    counts = {
        "affected": len(rows), "callers": sum(r.category in ("direct_caller", "indirect_caller") for r in rows), "dependents": sum(r.relationship == "reverse_dependency" for r in rows),
        "packages": packs, "subsystems": len({r["subsystem"] for r in placed}), "public": sum(r["entry_module"] == r["module"] for r in placed), "tests": tests.count(), "unresolved": sum("unresolved" in (r.reason or "").lower() for r in rows),
    }
    risk, factors = plan_risk(counts)
    primary = targets[0] if targets else None
    path = None if primary is None else corpus._module_file(primary.target) if primary.kind == "module" else primary.target
    order = inspection_order(corpus.spark, primary, affected, dependents, tests, path, corpus.module_of(path) if path and "/" in path and primary.kind != "package" else path)
    said = f"Change plan for '{request}': primary target={primary.target if primary else 'multiple candidates'}, affected_files={counts['affected']}, tests={counts['tests']}, risk={risk}"
    return {
        "request": request, "analysis": analyse_request(corpus.spark, request), "targets": targets, "affected": affected, "tests": tests, "items": order, "risk": risk, "factors": factors, "counts": counts,
        "symbols": sorted({r.symbol for r in rows if r.symbol}), "architecture": placed, "neighbours": around, "summary": said,
    }


def kept_items(items: DataFrame, tests: bool = True, dependencies: bool = True, callers: bool = True, callees: bool = True, architecture: bool = True) -> DataFrame:
    """Items of the wanted categories; the primary target always stays."""
    category, callee = F.col("category"), F.col("relationship").isin(*CALLEES)
    keep = (
        F.when(category == "primary_target", True).when(category.isin(*TESTS), F.lit(tests)).when(category.isin(*CALLERS), F.lit(callers))
        .when(callee, F.lit(callees)).when(category.isin(*DEPENDENCIES), F.lit(dependencies)).otherwise(F.lit(architecture))
    )
    return items.where(keep)


def payload(plan: dict) -> dict:
    """A plan as one JSON-safe value, its affected files grouped by what they are to the target.

    Everything in it is capped by the plan but the neighbours of its few first targets.
    """
    def listed(rows: DataFrame, by: str) -> list[dict]:
        return [{k: r[k] for k in ITEM_KEYS} for r in (x.asDict() for x in rows.withColumn("priority", F.col(by)).orderBy(by).collect())]

    def shown(t) -> dict:
        return {"target": t.target, "kind": t.kind, "score": t.score, "confidence": t.confidence, "reasons": list(t.reasons)}

    affected, tests, items = listed(plan["affected"], "position"), listed(plan["tests"], "position"), listed(plan["items"], "priority")
    near: dict = {}
    for r in plan["neighbours"].orderBy("target", "direction", "node").collect():
        near.setdefault((r.target, r.direction), []).append((r.node, r.package))
    places = []
    for a in plan["architecture"]:
        sides = {d: near.get((a["target"], d), []) for d in ("dependency", "dependent")}
        packs = {d: sorted({p for _, p in v if p}) for d, v in sides.items()}
        deps = [n for n, _ in sides["dependency"]]
        places.append(a | {"dependencies": deps, "dependents": [n for n, _ in sides["dependent"]], "neighbors": deps, "dependency_packages": packs["dependency"], "dependent_packages": packs["dependent"]})
    targets, said = [shown(t) for t in plan["targets"]], plan["analysis"]
    return {
        "request": plan["request"],
        "analysis": {"action": said["action"], "domain_terms": list(said["domain_terms"]), "path_candidates": list(said["paths"]), "module_candidates": list(said["modules"]), "symbol_candidates": list(said["types"])},
        "primary_target": targets[0] if targets else None, "target_candidates": targets, "affected_files": affected, "affected_symbols": plan["symbols"],
        "callers": [i for i in affected if i["category"] in CALLERS],
        "callees": [i for i in affected if i["relationship"] in CALLEES],
        "dependencies": [i for i in affected if i["category"] in DEPENDENCIES and i["relationship"] not in CALLEES],
        "dependents": [i for i in affected if i["relationship"] == "reverse_dependency"],
        "architecture": places, "tests": tests, "inspection_order": items, "risk": plan["risk"], "risk_factors": list(plan["factors"]),
        "confidence": targets[0]["confidence"] if targets else "unresolved", "summary": plan["summary"],
        "statistics": {"target_count": len(targets), "affected_file_count": len(affected), "test_count": len(tests), "inspection_item_count": len(items), "arch_info_count": len(places)},
        "deterministic": True,
    }
