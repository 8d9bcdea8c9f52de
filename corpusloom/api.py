"""The engine's public queries over one corpus; results are DataFrames or plain dicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import architecture as A
from corpusloom.operators import calls as K
from corpusloom.operators import code as C
from corpusloom.operators import context as X
from corpusloom.operators import firewall as W
from corpusloom.operators import fusion, graph, semantic
from corpusloom.operators import impact as I
from corpusloom.operators import plan as L
from corpusloom.operators.corpus import Corpus, TargetError
from corpusloom.sources.tree import declarative_files, read_tree

RETRIEVED, POOL = 8, 40
MAX_DEPTH, MAX_LIMIT = 6, 200
# How files enter an impact context, in this order.
IMPACT_ROLES = {
    "direct_caller": ("dependent", "primary"), "direct_callee": ("dependency", "dependency"), "direct_dependency": ("dependent", "dependent"), "test": ("test", "primary"),
    "indirect_caller": ("dependent", "dependent"), "indirect_callee": ("dependency", "dependency"), "indirect_dependency": ("dependent", "dependent"),
    "api_consumer": ("api_consumer", "primary"), "configuration": ("configuration", "primary"), "reverse_dependency": ("dependency", "dependency"),
}
NEEDS = {"implementation": "dependencies", "explanation": "dependencies", "dependency": "dependents", "modification": "dependents", "unknown": "both"}


class ArgumentError(ValueError):
    """An argument out of its range."""


def check(name: str, value, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ArgumentError(f"{name} must be a whole number from {low} to {high}")
    return value


def check_path(value: str) -> str:
    """A relative path inside the corpus."""
    if not value or value.startswith(("/", "~")) or ".." in value.split("/") or (":" in value and "::" not in value):
        raise ArgumentError(f"not a path inside the corpus: {value!r}")
    return value


class Engine:
    """All queries of one snapshot."""

    def __init__(self, corpus: Corpus, embed=None, architecture: bool = False):
        """With architecture, the files of architecture candidates enter contexts as well."""
        self.corpus, self.spark, self.architecture = corpus, corpus.spark, architecture
        self.embed = embed or V.hashed_embedding()

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> Engine:
        return cls(Corpus(spark, read_tree(spark, root), declarative_files(spark, root)), **options)

    def retrieve(self, query: str, strategy: str = "rrf", limit: int = RETRIEVED) -> DataFrame:
        """(query_id, path, rank, ...) by lexical, semantic, rrf or weighted retrieval."""
        if strategy not in ("lexical", "semantic", "rrf", "weighted"):
            raise ArgumentError(f"unknown strategy: {strategy}")
        c = self.corpus
        lexical = c.scratch.save(c.search({"q": query}, limit if strategy == "lexical" else POOL))
        if strategy == "lexical":
            return lexical
        docs = semantic.document_text(C.document_parts(c.analysis, c.files)).join(lexical.select("path"), "path", "left_semi")
        vectors = docs.select("path", self.embed("document").alias("vector"))
        asked = self.spark.createDataFrame([("q", query)], "query_id string, query string").select("query_id", self.embed("query").alias("vector"))
        near = c.scratch.save(semantic.semantic_search(vectors, asked, limit if strategy == "semantic" else POOL))
        if strategy == "semantic":
            return near
        return (fusion.rrf_fusion if strategy == "rrf" else fusion.weighted_fusion)(lexical, near, limit=limit)

    def candidates(self, query: str, depth: int = 1, expanded: int = 12) -> DataFrame:
        """Primary files, symbol matches and their neighbours, ranked."""
        return self._ranked(self._found(query, depth, expanded))

    def _ranked(self, found: DataFrame) -> DataFrame:
        sized = X.first_seen(found).join(self.corpus.files.select("path", T.token_estimate(F.col("source")).alias("tokens")), "path")
        return X.rank_candidates(sized)

    def _placed(self, query: str) -> DataFrame:
        """(query_id, path, architecture_rank): a file for each architecture candidate of a query."""
        c = self.corpus
        init = F.when(F.endswith("path", F.lit("__init__.py")), 0).otherwise(1)
        own = c.files.select(F.lit("file").alias("kind"), F.col("path").alias("id"), "path")
        mods = c.modules.select(F.lit("module").alias("kind"), F.col("module").alias("id"), F.col("file").alias("path"))
        packs = c.files.select(A.package_of(F.col("path")).alias("id"), "path").groupBy("id").agg(F.min_by("path", F.struct(init, F.col("path"))).alias("path"))
        at = own.unionByName(mods).unionByName(packs.withColumn("kind", F.lit("package")))
        rows = c.architecture_candidates(query).join(at, ["kind", "id"]).groupBy("path").agg(F.min("rank").alias("architecture_rank"))
        return rows.select(F.lit("q").alias("query_id"), "path", "architecture_rank")

    def _found(self, query: str, depth: int, expanded: int = 12) -> DataFrame:
        """Candidates with seq; the neighbours are those of named or matched files, if there are any."""
        c = self.corpus
        wanted = self.spark.range(1).select(T.intent(F.lit(query))).first()[0]
        hits = c.scratch.save(self.retrieve(query).select("query_id", "path", F.col("rank").alias("retrieval_rank"), F.col("hybrid_score").alias("retrieval_score"), "lexical_rank", "semantic_rank"))
        matched = c.scratch.save(c.symbol_matches({"q": query}).select("query_id", "path").distinct())
        named = matched.join(hits, ["query_id", "path"], "left_anti")
        placed = c.scratch.save(self._placed(query)) if self.architecture else None
        seeds = matched if placed is None else matched.union(placed.where("architecture_rank = 0").select("query_id", "path")).distinct()
        seeds = hits if seeds.isEmpty() else seeds
        near = graph.expand(c.imports, seeds.select("query_id", F.col("path").alias("node")), depth, expanded, NEEDS[wanted])
        lexical, semantic = F.col("lexical_rank").isNotNull(), F.col("semantic_rank").isNotNull()
        how = F.when(F.col("_m"), "symbol_match").when(lexical & semantic, "hybrid_match").when(semantic, "semantic_match").otherwise("lexical_match")
        null = lambda kind: F.lit(None).cast(kind)
        marked = hits.join(matched.withColumn("_m", F.lit(True)), ["query_id", "path"], "left")
        a = marked.select("query_id", "path", F.lit("primary").alias("role"), "retrieval_rank", "retrieval_score", how.alias("inclusion_reason"), null("int").alias("graph_distance"), F.lit(0).alias("seq"))
        b = named.select("query_id", "path", F.lit("primary").alias("role"), null("int").alias("retrieval_rank"), null("double").alias("retrieval_score"), F.lit("symbol_match").alias("inclusion_reason"), null("int").alias("graph_distance"), F.lit(1).alias("seq"))
        d = near.select("query_id", F.col("node").alias("path"), "role", null("int").alias("retrieval_rank"), null("double").alias("retrieval_score"), F.col("role").alias("inclusion_reason"), F.col("distance").alias("graph_distance"), F.lit(1).alias("seq"))
        every = a.unionByName(d).unionByName(b.withColumn("seq", F.lit(3)))
        if placed is None:
            return every
        e = placed.select("query_id", "path", F.lit("dependency").alias("role"), F.lit("architecture").alias("inclusion_reason"), "architecture_rank", F.lit(2).alias("seq"))
        return every.unionByName(e, allowMissingColumns=True)

    def get_context(self, query: str, max_tokens: int = X.DEFAULT_BUDGET, dependency_depth: int = 1) -> dict:
        """Files for a question within a token budget, made safe to hand out."""
        check("max_tokens", max_tokens, 1, 10**7)
        check("dependency_depth", dependency_depth, 0, MAX_DEPTH)
        return self._packed(query, self.corpus.scratch.save(self.candidates(query, dependency_depth)), max_tokens)

    def _packed(self, query: str, ranked: DataFrame, max_tokens: int) -> dict:
        c = self.corpus
        spans = c.spans.join(ranked.select("query_id", "path"), "path")
        asked = self.spark.range(1).select(T.symbol_tokens(F.lit(query)).alias("t")).first().t
        seen = T.normal_symbol(F.col("name")).isin([t.replace("_", "") for t in asked]) if asked else F.lit(False)
        parts = spans.select("query_id", "path", "start_line", "end_line", "tokens", seen.alias("evidence"))
        chosen = c.scratch.save(X.select_with_focus(ranked, parts, max_tokens))
        taken = chosen.where("selected")
        whole = taken.where("start_line is null").join(c.files, "path").select("position", "path", "start_line", "source")
        cut = taken.where("start_line is not null").join(c.spans.select("path", "start_line", "end_line", F.col("text").alias("source")).distinct(), ["path", "start_line", "end_line"]).select("position", "path", "start_line", "source")
        safe = _safe(whole.unionByName(cut).withColumnRenamed("path", "_p"))
        text = safe.orderBy("position", F.coalesce("start_line", F.lit(0))).collect()  # no more than the budget
        rendered = "\n\n".join(f"### {r.path}" + (f":{r.start_line}" if r.start_line else "") + f"\n{r.safe_source}" for r in text)
        judged = {d: sorted({r.path for r in text if r.decision == d}) for d in ("allow", "redact", "block")}
        matched = c.symbol_matches({"q": query}).select("name").distinct().orderBy("name").limit(MAX_LIMIT).collect()
        return {
            "matched_symbols": [r.name for r in matched], "blocked_files": judged["block"], "firewall": judged,
            "query": query, "budget": max_tokens, "intent": self.spark.range(1).select(T.intent(F.lit(query))).first()[0], "selection": chosen, "safe": safe,
            "total_estimated_tokens": taken.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0], "rendered_safe_context": rendered,
        }

    def analyze_impact(self, target: str, max_depth: int = 4, limit: int = MAX_LIMIT) -> dict:
        check("max_depth", max_depth, 0, MAX_DEPTH)
        check("limit", limit, 1, MAX_LIMIT)
        t = self.corpus.resolve(target)
        items, summary = self.corpus.impact(t, max_depth, limit)
        return {"target": t.label, "kind": t.kind, "items": items, "summary": summary, "risk": summary.first().risk}

    def impact_context(self, target: str, max_depth: int = 4, max_tokens: int = X.DEFAULT_BUDGET) -> dict:
        """A changed target and what its change reaches, in a fixed order, within a token budget."""
        check("max_depth", max_depth, 0, MAX_DEPTH)
        check("max_tokens", max_tokens, 1, 10**7)
        c = self.corpus
        t = c.resolve(target)
        items, _ = c.impact(t, max_depth)
        pick = lambda i: I.lookup({k: v[i] for k, v in IMPACT_ROLES.items()}, F.col("relationship"))
        place = I.lookup({k: i + 1 for i, k in enumerate(IMPACT_ROLES)}, F.col("relationship"))
        own = self.spark.createDataFrame([(t.path, "primary", "symbol_match", 0, 0)], "path string, role string, inclusion_reason string, bucket int, depth int")
        rows = own.unionByName(items.select("path", pick(1).alias("role"), pick(0).alias("inclusion_reason"), place.alias("bucket"), "depth"))
        sized = rows.join(c.files.select("path", T.token_estimate(F.col("source")).alias("tokens")), "path").withColumn("query_id", F.lit("q"))
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("bucket", "depth", "path"))
        return self._packed(target, c.scratch.save(sized.withColumn("position", order)), max_tokens) | {"target": t.label, "intent": "impact"}

    def change_question_context(self, query: str) -> dict:
        """The impact context of the first symbol that a question names."""
        found = self.corpus.symbol_matches({"q": query}).head(1)
        if not found:
            raise TargetError("the question names no symbol")
        return self.impact_context(f"{found[0].path}::{found[0].name}")

    def change_surface(self, targets, max_depth: int = 2, direction: str = "both", limit: int | None = None) -> DataFrame:
        return self.corpus.surface(targets, max_depth, direction, limit)

    def inspect_symbol(self, name: str, max_depth: int = 1) -> dict:
        """The nodes of a name, who calls them and what they call."""
        check("max_depth", max_depth, 1, MAX_DEPTH)
        leaf = name.split("::")[-1].split(".")[-1]
        found = self.corpus.symbols.where(F.col("name") == leaf)
        start = found.select(F.lit("q").alias("query_id"), F.concat_ws("\n", "path", "name", "kind", F.coalesce("parent_class", F.lit(""))).alias("node"))
        pairs = self.corpus.call_pairs
        return {"nodes": found.orderBy("path", "line"), "callers": graph.reach(graph.reverse(pairs), start, max_depth, graph.MAX_NODES), "callees": graph.reach(pairs, start, max_depth, graph.MAX_NODES)}

    def inspect_architecture(self, target: str, max_depth: int = 1) -> dict:
        """A node with its subsystem and neighbours."""
        check("max_depth", max_depth, 0, MAX_DEPTH)
        order = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "package", 1).otherwise(2)
        found = self.corpus.arch_nodes.where(F.col("id") == target).orderBy(order).head(1)
        if not found:
            raise ArgumentError(f"no architecture node: {target}")
        node = found[0]
        module = self.corpus.module_of(target) if node.kind == "file" else target
        start = self.spark.createDataFrame([("q", module)], "query_id string, node string")
        edges = self.corpus.arch_edges()
        out = graph.reach(edges, start, max_depth, MAX_LIMIT, cycles=True)
        into = graph.reach(graph.reverse(edges), start, max_depth, MAX_LIMIT, cycles=True)
        home = target.split("/")[0] if "/" in target else target.split(".")[0]
        return {"kind": node.kind, "id": node.id, "module": module, "subsystem": home, "dependencies": out.orderBy("depth", "node"), "dependents": into.orderBy("depth", "node"), "statistics": A.statistics(A.containment(self.corpus.files))}

    def discover_subsystems(self, max_subsystems: int = 50) -> DataFrame:
        check("max_subsystems", max_subsystems, 1, MAX_LIMIT)
        return self.corpus.subsystems.orderBy("subsystem").limit(max_subsystems)

    def architecture_candidates(self, query: str, limit: int = 50) -> dict:
        check("limit", limit, 1, MAX_LIMIT)
        return {"signals": self.corpus.signals(query), "candidates": self.corpus.architecture_candidates(query, limit)}

    def explain_architecture_match(self, query: str, target: str) -> dict:
        """Why a node is among a query's candidates, with chains from the matched modules."""
        row = self.corpus.architecture_candidates(query).where(F.col("id") == target).head(1)
        if not row:
            return {"relevant": False, "reason": None, "dependency_paths": None}
        starts = self.corpus.signals(query).where("kind = 'module'").select(F.col("id").alias("query_id"), F.col("id").alias("node"))
        chains = graph.shortest_chain(self.corpus.arch_edges(), starts, MAX_DEPTH).where(F.col("node") == target)
        return {"relevant": True, "reason": row[0].reason, "rank": row[0]["rank"], "dependency_paths": chains.select("chain")}

    def change_plan(self, request: str, target: str | None = None) -> dict:
        if target is not None:
            check_path(target)
        return L.change_plan(self.corpus, request, target)

    def change_plan_payload(self, request: str, target: str | None = None) -> dict:
        """The plan as one JSON-safe value."""
        return L.payload(self.change_plan(request, target))

    def change_context(self, request: str, target: str | None = None, max_tokens: int = X.DEFAULT_BUDGET, max_files: int | None = None, **include: bool) -> dict:
        """The plan, and the files of the request and of the plan within a budget, made safe.

        include: tests, dependencies, callers, callees, architecture; a category that is False
        adds no files of the plan. A file that retrieval found as well keeps its place there.
        """
        check("max_tokens", max_tokens, 1, 10**7)
        if max_files is not None:
            check("max_files", max_files, 1, 10**7)
        plan = self.change_plan(request, target)
        kept = L.kept_items(plan["items"], **include).join(self.corpus.files.select("path"), "path", "left_semi").orderBy("priority")
        kept = kept if max_files is None else kept.limit(max_files)
        dependent = F.col("category").isin(*L.CALLERS, *L.DEPENDENCIES, *L.TESTS)
        items = kept.select(F.lit("q").alias("query_id"), "path", F.when(dependent, "dependent").otherwise("dependency").alias("role"), F.lit("change_plan").alias("inclusion_reason"), F.col("priority").alias("change_priority"), (F.col("priority") + 9).alias("seq"))
        ranked = self.corpus.scratch.save(self._ranked(self._found(request, 1).unionByName(items, allowMissingColumns=True)))
        return plan | {"context": self._packed(request, ranked, max_tokens), "ranked": ranked}

    def explain_change(self, changed: dict, path: str) -> dict:
        """Why a file is in a change_context result or not: plan, ranking, budget and firewall."""
        at = F.col("path") == path
        item = (changed["items"].where(at).orderBy("priority").head(1) or [None])[0]
        seen = (changed["ranked"].where(at).head(1) or [None])[0]
        rows = changed["context"]["selection"].where(at).orderBy(F.desc("selected")).head(1)
        chosen = bool(rows) and rows[0].selected
        judged = [d for d, paths in changed["context"]["firewall"].items() if path in paths]
        planned = seen is not None and seen.inclusion_reason == "change_plan"
        return {
            "path": path, "in_plan": item is not None, "category": item and item.category, "category_explanation": item and L.CATEGORY_MEANING.get(item.category),
            "relationship": item and item.relationship, "priority": item and item.priority, "confidence": item and item.confidence,
            "target": changed["targets"][0].target if changed["targets"] else None, "evidence": item.reason if item else seen and seen.inclusion_reason,
            "selected": chosen, "survived_ranking": bool(rows), "survived_budget": chosen,
            "budget_status": "selected" if chosen else f"excluded:{rows[0].reason}" if rows else "not_considered",
            "role": seen.role if chosen else None, "inclusion_reason": seen.inclusion_reason if chosen else None, "change_plan_source": chosen and planned,
            "firewall": {"allow": "allowed", "redact": "redact", "block": "blocked"}[judged[-1]] if judged else "not_present",
        }

    def statistics(self) -> DataFrame:
        return K.statistics(*self.corpus.call_graph)


def _safe(body: DataFrame) -> DataFrame:
    """(position, path, start_line, decision, safe_source); each piece judged on its own."""
    keyed = body.select(F.concat_ws("\n", F.col("position").cast("string"), F.coalesce(F.col("start_line").cast("string"), F.lit("0")), "_p").alias("_k"), "position", "_p", "start_line", "source")
    found = W.findings(keyed.select(F.col("_k").alias("path"), "source"))
    per = found.groupBy(F.col("path").alias("_k")).agg(F.collect_set("type").alias("_types"), F.collect_set("line").alias("_lines"))
    j = keyed.join(per, "_k", "left")
    block = W.path_block(F.col("_p")).isNotNull()
    decision = F.when(block, "block").when(F.col("_types").isNotNull(), "redact").otherwise("allow")
    text = F.when(block, W.BLOCKED_TEXT).when(F.col("_types").isNotNull(), W.redacted(F.col("source"), F.col("_types"), F.col("_lines"))).otherwise(F.col("source"))
    return j.select("position", F.col("_p").alias("path"), "start_line", decision.alias("decision"), text.alias("safe_source"))
