"""A code corpus as a snapshot of tables, and the analyses composed over it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions import text as T
from corpusloom.operators import architecture as A
from corpusloom.operators import calls as K
from corpusloom.operators import code as C
from corpusloom.operators import graph as G
from corpusloom.operators import impact as I
from corpusloom.operators import imports as M
from corpusloom.operators import search as S
from corpusloom.sources.scratch import Scratch

# Bounds of the analyses.
IMPACT_DEPTH, IMPACT_NODES, SURFACE_DEPTH, SURFACE_NODES = 4, 2000, 2, 2000
PLAN = {"targets": 30, "primary": 5, "affected": 50, "tests": 15, "items": 40, "impact_depth": 3, "search": 20}
SIGNALS, SIGNALS_PER_TOKEN = 24, 4
ARCH_CAPS = {"package": 6, "module": 24, "file": 24}


class TargetError(ValueError):
    """A target that is unknown, ambiguous or malformed."""


@dataclass(frozen=True)
class Target:
    kind: str  # file, module, symbol or symbol_in_file
    path: str
    module: str
    label: str
    symbol: str | None = None


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Corpus:
    """Tables of one snapshot, each computed on first use and kept in the shared folder."""

    def __init__(self, spark: SparkSession, files: DataFrame, configuration: DataFrame | None = None):
        self.spark, self.scratch = spark, Scratch(spark, "corpus")
        self.files = self.scratch.save(files.select("path", "source"))
        self.configuration = configuration

    @cached_property
    def analysis(self) -> DataFrame:
        return self.scratch.save(C.analyse(self.files))

    @cached_property
    def symbols(self) -> DataFrame:
        return self.scratch.save(C.rows_of(self.analysis, "symbols").drop("args", "pos"))

    @cached_property
    def spans(self) -> DataFrame:
        return self.scratch.save(C.span_text(self.files, C.rows_of(self.analysis, "spans").drop("pos")))

    @cached_property
    def modules(self) -> DataFrame:
        return self.scratch.save(M.module_table(self.files))

    @cached_property
    def imports(self) -> DataFrame:
        return self.scratch.save(M.import_edges(self.analysis))

    @cached_property
    def call_graph(self) -> tuple[DataFrame, DataFrame]:
        edges, unresolved = K.build(self.analysis)
        return self.scratch.save(edges), self.scratch.save(unresolved)

    @cached_property
    def subsystems(self) -> DataFrame:
        return self.scratch.save(A.subsystems(self.files, self.imports))

    @cached_property
    def arch_nodes(self) -> DataFrame:
        return self.scratch.save(A.nodes(self.files))

    # targets

    def _has(self, path: str) -> bool:
        return not self.files.where(F.col("path") == path).isEmpty()

    def _module_file(self, name: str) -> str | None:
        found = self.modules.where(F.col("module") == name).head(1)
        return found[0].file if found else None

    def module_of(self, path: str) -> str:
        parts = path.removesuffix(".py").split("/")
        return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)

    def resolve(self, target: str) -> Target:
        """path::symbol, path, dotted module, unique symbol, unique leaf name."""
        raw = str(target).strip().replace("\\", "/")
        if not raw:
            raise TargetError("empty target")
        if "::" in raw:
            place, _, name = raw.partition("::")
            if not place.strip() or not name.strip():
                raise TargetError(f"malformed target: {raw}")
            path = self._place(place)
            own = self.symbols.where((F.col("path") == path) & (F.col("name") == name)).orderBy("kind", "line").head(1)
            if not own:
                raise TargetError(f"{name} is not defined in {path}")
            return Target("symbol_in_file", path, self.module_of(path), place if "/" in place or place.endswith(".py") else raw, name)
        if raw.endswith(".py") or "/" in raw:
            path = raw if raw.endswith(".py") else f"{raw}.py"
            if not self._has(path):
                raise TargetError(f"no file matches {raw}")
            return Target("file", path, self.module_of(path), path)
        if file := self._module_file(raw):
            return Target("module", file, raw, raw)
        homes = [r.path for r in self.symbols.where(F.col("name") == raw).select("path").distinct().orderBy("path").limit(20).collect()]
        if len(homes) == 1:
            return Target("symbol", homes[0], self.module_of(homes[0]), raw, raw)
        if homes:
            raise TargetError(f"ambiguous symbol {raw}: {', '.join(homes)}")
        leaves = [r.path for r in self.files.where(P.stem(F.col("path")) == raw).select("path").orderBy("path").limit(20).collect()]
        if len(leaves) == 1:
            return Target("module", leaves[0], self.module_of(leaves[0]), raw)
        raise TargetError(f"ambiguous module {raw}: {', '.join(leaves)}" if leaves else f"nothing matches {raw}")

    def _place(self, raw: str) -> str:
        path = raw if raw.endswith(".py") else f"{raw}.py"
        if self._has(path):
            return path
        if file := self._module_file(raw):
            return file
        raise TargetError(f"no file or module matches {raw}")

    def call_node(self, t: Target) -> str | None:
        """The node of a target in key form, a class before a function before a method."""
        if t.symbol is None:
            return None
        order = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).otherwise(2)
        found = self.symbols.where((F.col("path") == t.path) & (F.col("name") == t.symbol)).orderBy(order, "line").head(1)
        return _key_text(t.path, found[0].name, found[0].kind, found[0].parent_class) if found else None

    @cached_property
    def call_pairs(self) -> DataFrame:
        """(src, dst) keys of calls between nodes."""
        kinds = ["call", "method_call", "instantiation"]
        return self.scratch.save(self.call_graph[0].where(F.col("kind").isin(kinds)).select(_key(F.col("src")).alias("src"), _key(F.col("dst")).alias("dst")).where("src <> dst").distinct())

    def _calls(self, t: Target, depth: int, callers: bool) -> DataFrame:
        """(path, name, depth) reached from the target along calls, other files only."""
        key = self.call_node(t)
        if key is None or depth < 1:
            return self.spark.createDataFrame([], "path string, name string, depth int")
        start = self.spark.createDataFrame([("t", key)], "query_id string, node string")
        pairs = G.reverse(self.call_pairs) if callers else self.call_pairs
        parts = F.split("node", "\n")
        found = G.reach(pairs, start, depth, G.MAX_NODES).select(F.get(parts, F.lit(0)).alias("path"), F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("name"), "depth")
        return found.where(F.col("path") != t.path)

    # impact

    def impact_relations(self, t: Target, depth: int = IMPACT_DEPTH) -> DataFrame:
        """Every relation of files to a target: (target, seq, path, relationship, reason, evidence, depth, symbol)."""
        start = self.spark.createDataFrame([("t", t.path)], "query_id string, node string")
        rev = self.scratch.save(G.reach(G.reverse(self.imports), start, depth, IMPACT_NODES).select(F.col("node").alias("path"), "depth"))
        direct = F.col("depth") == 1
        parts = [self._rel(0, rev, F.when(direct, "direct_dependency").otherwise("indirect_dependency"), F.when(direct, f"imports {t.label} directly").otherwise(F.concat(F.lit(f"imports {t.label} transitively (depth "), F.col("depth").cast("string"), F.lit(")"))), F.array(F.lit("dependency_edge")), F.col("depth"))]
        if t.symbol is not None:
            parts += self._symbol_relations(t, rev)
        parts.append(self._test_relations(t))
        seen = _union([p.select("path") for p in parts]).distinct()
        tests = parts[-1].select("path")
        config = seen.join(tests, "path", "left_anti").where(P.is_config(F.col("path")))
        parts.append(self._rel(4, config, F.lit("configuration"), F.lit(f"configuration file imports {t.label}"), F.array(F.lit("config_file_imports_target")), F.lit(0)))
        if self.configuration is not None and t.module:
            bare = t.path[:-3] if t.path.endswith(".py") else t.path
            named = self.configuration.where(F.contains("source", F.lit(t.module)) | F.contains("source", F.lit(bare)))
            parts.append(self._rel(5, named, F.lit("configuration"), F.concat(F.lit("declarative config "), "path", F.lit(f" references module {t.module}")), F.array(F.lit("config_text_reference")), F.lit(0)))
        if t.symbol is not None:
            for seq, callers in ((6, True), (7, False)):
                who = self._calls(t, depth, callers).groupBy("path").agg(F.min("depth").alias("depth"), F.min_by("name", F.struct("depth", "name")).alias("name"))
                side = "caller" if callers else "callee"
                named = F.coalesce("name", F.lit("module"))
                how = F.when(F.col("depth") == 1, F.lit("directly")).otherwise(F.concat(F.lit("transitively (depth "), F.col("depth").cast("string"), F.lit(")")))
                reason = F.concat(F.lit(f"calls {t.label} "), how) if callers else F.concat(F.lit(f"{t.label} calls "), named, F.lit(" "), how)
                parts.append(self._rel(seq, who, F.when(F.col("depth") == 1, f"direct_{side}").otherwise(f"indirect_{side}"), reason, F.array(F.lit("resolved_ast_call")), F.col("depth")))
        known = _union([p.select("path") for p in parts]).distinct()
        own = self.imports.where(F.col("src") == t.path).select(F.col("dst").alias("path")).join(known, "path", "left_anti")
        parts.append(self._rel(8, own, F.lit("reverse_dependency"), F.lit(f"the changed target {t.label} imports this file directly"), F.array(F.lit("dependency_edge")), F.lit(1)))
        return _union(parts).withColumn("target", F.lit(t.label)).where(F.col("path") != t.path)

    @staticmethod
    def _rel(seq: int, rows: DataFrame, relationship, reason, evidence, depth, symbol=None) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select(F.lit(seq).alias("seq"), "path", relationship.alias("relationship"), reason.alias("reason"), evidence.cast("array<string>").alias("evidence"), depth.cast("int").alias("depth"), (none if symbol is None else F.lit(symbol)).alias("symbol"))

    def _inits(self, path: str) -> list[str]:
        parts = path.split("/")
        return ["/".join([*parts[:n], "__init__.py"]) for n in range(1, len(parts))]

    def _symbol_relations(self, t: Target, rev: DataFrame) -> list[DataFrame]:
        named = C.rows_of(self.analysis, "from_imports").where(F.col("name") == t.symbol).select("path").distinct()
        exporters = self.scratch.save(named.where(F.col("path").isin(self._inits(t.path))))
        through = self.imports.join(exporters.select(F.col("path").alias("dst")), "dst").select(F.col("src").alias("path")).join(named, "path", "left_semi").distinct()
        users = rev.where("depth = 1").select("path").union(through).distinct()
        mod = t.module
        bound = C.rows_of(self.analysis, "imports").where((F.col("module") == mod) | F.startswith("module", F.lit(f"{mod}."))).select("path", F.coalesce("alias", F.substring_index("module", ".", -1)).alias("b"))
        bound = bound.union(C.rows_of(self.analysis, "from_imports").where(F.col("module") == mod).select("path", F.coalesce("alias", "name").alias("b")))
        text = self.files.join(bound, "path").where(F.contains("source", F.concat("b", F.lit(f".{t.symbol}")))).select("path").distinct()
        bases = C.rows_of(self.analysis, "bases").where(F.col("base") == t.symbol).select("path").distinct()
        mark = lambda df, name: df.withColumn(name, F.lit(True))
        found = users.join(mark(named, "_a"), "path", "left").join(mark(text, "_b"), "path", "left").join(mark(bases, "_c"), "path", "left")
        evidence = F.filter(F.array(F.when(F.col("_a"), "symbol_import"), F.when(F.col("_b"), "symbol_text_reference"), F.when(F.col("_c"), "base_class")), lambda x: x.isNotNull())
        found = found.withColumn("e", evidence).where("size(e) > 0").join(rev.where("depth = 1"), "path", "left").fillna(0, ["depth"])
        a = self._rel(1, found, F.lit("api_consumer"), F.lit(f"references symbol {t.symbol} defined in {t.label}"), F.col("e"), F.col("depth"), t.symbol)
        pack = P.module_name(F.col("path"))
        b = self._rel(2, exporters, F.lit("api_consumer"), F.concat(F.lit("package "), pack, F.lit(f" re-exports {t.symbol}")), F.array(F.lit("package_export")), F.lit(0), t.symbol)
        return [a, b]

    def _test_relations(self, t: Target) -> DataFrame:
        tests = self.files.where(P.is_test(F.col("path")))
        uses = self.imports.where(F.col("dst") == t.path).select(F.col("src").alias("path"), F.lit(True).alias("_i"))
        j = tests.join(uses, "path", "left")
        reason = F.when(F.col("_i"), f"test file imports {t.label} directly")
        if t.symbol is not None:
            named = C.rows_of(self.analysis, "from_imports").where(F.col("name") == t.symbol).select("path", F.lit(True).alias("_s")).distinct()
            j = j.join(named, "path", "left")
            reason = reason.when(F.col("_s"), f"test file imports symbol {t.symbol}").when(F.contains("source", F.lit(f".{t.symbol}")), f"test source references symbol {t.symbol}")
        leaf = t.path.split("/")[-2] if t.path.endswith("/__init__.py") else t.path.split("/")[-1].removesuffix(".py")
        reason = reason.when(P.tests_module(F.col("path"), F.lit(leaf)), f"test filename corresponds to module {t.module or t.path}")
        j = j.withColumn("why", reason).where("why is not null")
        return self._rel(3, j, F.lit("test"), F.col("why"), F.array(F.lit("test_name_match")), F.lit(0))

    def impact(self, target: str | Target, max_depth: int = IMPACT_DEPTH, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(items in order, one-row summary with points and risk)."""
        t = target if isinstance(target, Target) else self.resolve(target)
        merged = self.scratch.save(I.merge_items(self.impact_relations(t, max_depth)))
        risk = I.item_risk(F.col("relationship"), F.coalesce(~F.startswith("symbol", F.lit("_")), F.lit(False)))
        items = I.ordered_items(merged.withColumn("risk", risk), limit=limit).orderBy("position")
        start = self.spark.createDataFrame([("t", t.path)], "query_id string, node string")
        reached = G.reach(G.reverse(self.imports), start, max_depth, IMPACT_NODES).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth_reached"))
        exported = merged.agg(F.coalesce(F.max(F.array_contains("evidence", "package_export")), F.lit(False)).alias("exported"))
        counts = merged.agg(*[F.count_if(F.col("relationship") == r).alias(n) for r, n in I.COUNTED.items()])
        return items, I.overall_risk(counts.join(reached).join(exported).withColumn("target", F.lit(t.label)))

    # change surface

    def surface(self, targets, max_depth: int = SURFACE_DEPTH, direction: str = "both", limit: int | None = None) -> DataFrame:
        """(path, relationship, direction, depth, reason, source, evidence) around the targets."""
        if max_depth < 0 or (limit is not None and limit < 0):
            raise ValueError("depth and limit must not be negative")
        way = (direction or "").strip() or "both"
        if way not in ("both", "incoming", "outgoing"):
            raise ValueError(f"unknown direction: {direction}")
        ways = ["incoming", "outgoing"] if way == "both" else [way]
        known = {(t.path, t.symbol): t for t in map(self.resolve, targets if isinstance(targets, (list, tuple)) else [targets])}
        parts = [p for t in known.values() for p in self._surface_parts(t, max_depth, ways)]
        if not parts:
            return self.spark.createDataFrame([], "path string, relationship string, direction string, depth int, reason string, source string, evidence array<string>")
        rows = _union(parts).withColumn("seq", F.xxhash64("source", "reason"))
        merged = I.merge_surface(rows)
        order = F.row_number().over(Window.orderBy("direction", "relationship", "depth", "path", "reason"))
        out = merged.withColumn("position", order)
        return out if limit is None else out.where(F.col("position") <= limit)

    def _surface_parts(self, t: Target, depth: int, ways: list[str]) -> list[DataFrame]:
        parts, start = [], self.spark.createDataFrame([("t", t.path)], "query_id string, node string")

        def add(rows: DataFrame, relationship, way: str, reason, evidence=None) -> None:
            parts.append(rows.select("path", relationship.alias("relationship"), F.lit(way).alias("direction"), F.greatest(F.col("depth"), F.lit(1)).cast("int").alias("depth"), reason.alias("reason"), F.lit(t.label).alias("source"), (F.array().cast("array<string>") if evidence is None else evidence).alias("evidence")))

        how = F.when(F.col("depth") == 1, F.lit("directly")).otherwise(F.concat(F.lit("transitively (depth "), F.col("depth").cast("string"), F.lit(")")))
        for way in ways:
            into = way == "incoming"
            if depth >= 1:
                near = G.reach(G.reverse(self.imports) if into else self.imports, start, depth, SURFACE_NODES).withColumnRenamed("node", "path")
                add(near, F.lit("import"), way, F.concat("path", F.lit(f" imports {t.label} "), how) if into else F.concat(F.lit(f"{t.label} imports "), "path", F.lit(" "), how), F.array(F.lit("dependency_edge")))
                if t.symbol is not None:
                    near, who = self._calls(t, depth, into), F.coalesce("name", "path")
                    add(near, F.lit("call"), way, F.concat(who, F.lit(f" calls {t.label} "), how) if into else F.concat(F.lit(f"{t.label} calls "), who, F.lit(" "), how))
        if t.symbol is not None:
            items = self.impact(t, SURFACE_DEPTH)[0].where(F.col("relationship").isin("api_consumer", "test", "configuration"))
            kind = F.when(F.col("relationship") != "api_consumer", "other").when(F.array_contains("evidence", "base_class"), "inheritance").otherwise("symbol_reference")
            add(items, kind, "incoming", F.col("reason"), F.col("evidence"))
            if "outgoing" in ways:
                bases = C.rows_of(self.analysis, "bases").where((F.col("path") == t.path) & (F.col("class_name") == t.symbol)).select("base", F.substring_index("base", ".", -1).alias("name"))
                homes = bases.where(F.col("name") != t.symbol).join(self.symbols.select("name", "path"), "name").where(F.col("path") != t.path).withColumn("depth", F.lit(1))
                add(homes, F.lit("inheritance"), "outgoing", F.concat(F.lit(f"{t.label} subclasses "), "base"), F.array(F.lit("base_class")))
        return parts

    # retrieval

    def search(self, queries: dict[str, str], limit: int = S.DEFAULT_LIMIT) -> DataFrame:
        """Lexical search over paths, imports, sources and symbols."""
        files = self.files.join(C.import_terms(self.analysis), "path", "left")
        layers = {"path": F.col("path"), "import": F.col("imports"), "source": F.col("source")}
        return S.lexical_search(files, S.query_table(self.spark, queries), layers, self.symbols, limit)

    def symbol_matches(self, queries: dict[str, str]) -> DataFrame:
        """(query_id, token, path, name, exact), exact ones first."""
        table = S.query_table(self.spark, queries)
        a = S.exact_symbols(self.symbols.select("path", "name"), table).select("query_id", "token", "path", "name", F.lit(True).alias("exact"))
        b = S.near_symbols(self.symbols.select("path", "name"), table).select("query_id", "token", "path", "name", F.lit(False).alias("exact"))
        return a.unionByName(b).distinct().orderBy("query_id", F.desc("exact"), "path", "name")

    # architecture

    def signals(self, query: str) -> DataFrame:
        """(kind, id, reason): nodes that a query names, by path or by leaf; capped."""
        asked = self.spark.createDataFrame([(query,)], "q string")
        runs = asked.select(F.explode(F.regexp_extract_all("q", F.lit(r"[A-Za-z_][\w./]*"), F.lit(0))).alias("run")).where("run like '%.%' or run like '%/%'")
        runs = runs.select(F.explode(F.array(F.rtrim(F.lit("."), F.col("run")), F.lower(F.rtrim(F.lit("."), F.col("run"))))).alias("run")).distinct()
        forms = runs.select(F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.col("run").alias("id")), F.struct(F.lit("file").alias("kind"), F.concat("run", F.lit(".py")).alias("id")), F.struct(F.lit("package").alias("kind"), F.replace("run", F.lit("."), F.lit("/")).alias("id")), F.struct(F.lit("package").alias("kind"), F.col("run").alias("id")), F.struct(F.lit("module").alias("kind"), F.col("run").alias("id")))).alias("x")).select("x.*").distinct()
        direct = self.arch_nodes.join(F.broadcast(forms), ["kind", "id"]).select("kind", "id", F.lit(0).alias("o"), F.lit("").alias("token"))
        words = asked.select(F.explode(T.symbol_tokens(F.col("q"))).alias("token")).where("length(token) > 1").withColumn("leaf", P.singular(F.col("token")))
        leaf = F.when(F.col("kind") == "module", F.substring_index("id", ".", -1)).when(F.col("kind") == "package", F.substring_index("id", "/", -1)).otherwise(P.stem(F.col("id")))
        near = self.arch_nodes.where("id <> '.'").withColumn("leaf", P.singular(leaf)).join(F.broadcast(words), "leaf")
        order = F.when(F.col("kind") == "module", 0).when(F.col("kind") == "package", 1).otherwise(2)
        n = F.row_number().over(Window.partitionBy("token").orderBy(order, "id"))
        near = near.withColumn("n", n).where(F.col("n") <= SIGNALS_PER_TOKEN).select("kind", "id", F.lit(1).alias("o"), "token")
        every = direct.unionByName(near).groupBy("kind", "id").agg(F.min(F.struct("o", "token")).alias("first"))
        reason = F.concat(F.lit("direct "), "kind", F.lit(" match"))
        return every.orderBy("first", "kind", "id").limit(SIGNALS).select("kind", "id", reason.alias("reason")).orderBy("kind", "id")

    def arch_edges(self) -> DataFrame:
        """(src, dst) between modules."""
        m = self.modules.select("module", "file")
        a, b = m.select(F.col("file").alias("src"), F.col("module").alias("ms")), m.select(F.col("file").alias("dst"), F.col("module").alias("md"))
        return self.imports.join(a, "src").join(b, "dst").select(F.col("ms").alias("src"), F.col("md").alias("dst"))

    def architecture_candidates(self, query: str, limit: int | None = None) -> DataFrame:
        """(kind, id, rank, direction, reason, score): matches, neighbours, same subsystem."""
        sig = self.scratch.save(self.signals(query))
        edges, tree = self.arch_edges(), A.containment(self.files)
        hit = sig.select("kind", "id", F.lit(0).alias("rank"), F.lit("matched").alias("direction"), "reason")
        mods = sig.where("kind = 'module'").select("id").orderBy("id").limit(ARCH_CAPS["module"])
        packs = sig.where("kind = 'package'").select("id").orderBy("id").limit(ARCH_CAPS["package"])
        deps = edges.join(mods.withColumnRenamed("id", "src"), "src").select(F.lit("module").alias("kind"), F.col("dst").alias("id"), F.lit(1).alias("rank"), F.lit("dependency").alias("direction"), F.lit("dependency of a match").alias("reason"))
        users = edges.join(mods.withColumnRenamed("id", "dst"), "dst").select(F.lit("module").alias("kind"), F.col("src").alias("id"), F.lit(1).alias("rank"), F.lit("dependent").alias("direction"), F.lit("dependent of a match").alias("reason"))
        inside = tree.where("parent_kind = 'package' and kind = 'file'").join(packs.withColumnRenamed("id", "parent"), "parent").select("kind", "id", F.lit(1).alias("rank"), F.lit("contained").alias("direction"), F.lit("in a matched package").alias("reason"))
        own = sig.select(F.when(F.col("kind") == "module", F.substring_index("id", ".", 1)).otherwise(F.substring_index("id", "/", 1)).alias("subsystem")).distinct()
        peers = self.subsystems.join(F.broadcast(own), "subsystem").select(F.lit("module").alias("kind"), F.explode("modules").alias("id"), F.lit(2).alias("rank"), F.lit("subsystem").alias("direction"), F.lit("same subsystem").alias("reason"))
        every = _union([hit, deps.distinct(), users.distinct(), inside.distinct(), peers.distinct()])
        best = every.groupBy("kind", "id").agg(F.min(F.struct("rank", "direction", "reason")).alias("x")).select("kind", "id", "x.*")
        cap = F.create_map(*[F.lit(v) for pair in ARCH_CAPS.items() for v in pair])[F.col("kind")]
        n = F.row_number().over(Window.partitionBy("kind").orderBy("rank", "direction", "id"))
        out = best.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n").withColumn("score", F.round(1.0 / (F.col("rank") + 1), 3)).orderBy("rank", "direction", "kind", "id")
        return out if limit is None else out.limit(limit)


def _key(n):
    return F.concat_ws("\n", n["path"], F.coalesce(n["name"], F.lit("")), F.coalesce(n["kind"], F.lit("")), F.coalesce(n["parent_class"], F.lit("")))


def _key_text(path: str, name: str | None, kind: str | None, cls: str | None) -> str:
    return "\n".join((path, name or "", kind or "", cls or ""))
