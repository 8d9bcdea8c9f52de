"""The call graph: references resolved to symbols by prioritised joins.

Every reference is offered the ways to resolve it as joins with the file's own
definitions, its import bindings, sibling modules, the module table and receiver
hints; the first way that applies decides, also when it finds nothing. Hints name
classes through the same resolution, in rounds. All tables stay distributed.

A node is a struct (path, name, kind, parent_class); a module has a null name.
"""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import dotted_prefixes
from corpusloom.operators.code import rows_of
from corpusloom.operators.graph import longest_prefix
from corpusloom.operators.imports import absolute_from_imports, module_table, package_parts
from corpusloom.sources.scratch import Scratch

NODE = "struct<path:string,name:string,kind:string,parent_class:string>"
HINT_ROUNDS = 3
KIND_ORDER = {"class": 0, "function": 1, "method": 2}


def node(path: Column, name: Column | None = None, kind: Column | None = None, cls: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    parts = {"path": path, "name": name, "kind": kind, "parent_class": cls}
    return F.struct(*[(null if v is None else v).alias(k) for k, v in parts.items()])


def symbol_choice(symbols: DataFrame) -> DataFrame:
    """(file, symbol, target): of equal names in a file a class, then function, then method."""
    order = F.struct(F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).otherwise(2), F.coalesce("line", F.lit(0)), F.coalesce("parent_class", F.lit("")))
    return symbols.groupBy(F.col("path").alias("file"), F.col("name").alias("symbol")).agg(F.min_by(node(F.col("path"), F.col("name"), F.col("kind"), F.col("parent_class")), order).alias("target"))


def bindings(analysis: DataFrame) -> DataFrame:
    """(path, bound, module, file, symbol): what names a file's imports bind; the last wins.

    A module binding has no symbol. ``import a.b`` binds a.
    """
    table = module_table(analysis)
    keyed = table.select(F.col("module").alias("key"), F.col("file").alias("value"))
    plain = rows_of(analysis, "imports")
    deep = longest_prefix(plain.select(F.col("module").alias("name")), keyed).withColumnRenamed("name", "module").withColumnRenamed("target", "known")
    i = plain.join(deep, "module").withColumn("first", F.substring_index("module", ".", 1))
    i = i.join(table.select(F.col("module").alias("first"), F.col("file").alias("first_file")), "first", "left")
    named = F.col("alias").isNotNull()
    a = i.select("path", F.coalesce("alias", "first").alias("bound"), F.when(named, F.col("known")).otherwise(F.col("first")).alias("module"), F.when(named, F.col("value")).otherwise(F.col("first_file")).alias("file"), F.lit(None).cast("string").alias("symbol"), F.struct(F.lit(0).alias("k"), "pos").alias("seq"))
    f = absolute_from_imports(analysis).where("absolute <> '' and name <> '*'")
    deep = longest_prefix(f.select(F.col("absolute").alias("name")), keyed).withColumnRenamed("name", "absolute").withColumnRenamed("target", "known")
    f = f.join(deep, "absolute").withColumn("inner", F.concat_ws(".", "known", "name")).join(table.select(F.col("module").alias("inner"), F.col("file").alias("sub")), "inner", "left")
    is_module = F.col("sub").isNotNull()
    b = f.select("path", F.coalesce("alias", "name").alias("bound"), F.when(is_module, F.col("inner")).otherwise(F.col("known")).alias("module"), F.coalesce("sub", "value").alias("file"), F.when(~is_module, F.col("name")).alias("symbol"), F.struct(F.lit(1).alias("k"), "pos").alias("seq"))
    last = F.row_number().over(Window.partitionBy("path", "bound").orderBy(F.desc("seq")))
    return a.unionByName(b).withColumn("_n", last).where("_n = 1").drop("_n", "seq")


class Resolver:
    """The tables that references are resolved against."""

    def __init__(self, analysis: DataFrame, scratch: Scratch):
        self.symbols = scratch.save(rows_of(analysis, "symbols").drop("args"))
        self.modules = scratch.save(module_table(analysis))
        self.bound = scratch.save(bindings(analysis))
        self.choice = scratch.save(symbol_choice(self.symbols))
        self.scratch = scratch

    def walked(self, at: DataFrame) -> DataFrame:
        """(id, target): at (id, module, file, rest) followed along rest.

        Modules are entered as long as each next one exists; then a symbol of the last
        file is taken, or the module itself when rest is used up.
        """
        deeper = at.select("id", "module", F.posexplode_outer(F.when(F.size("rest") > 0, dotted_prefixes(F.array_join("rest", ".")))).alias("i", "tail"))
        deeper = deeper.where("i is not null").withColumn("module", F.when(F.col("module") == "", F.col("tail")).otherwise(F.concat_ws(".", "module", "tail"))).drop("tail")
        hit = deeper.join(self.modules, "module").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "file"))).alias("hits"))
        run = F.filter("hits", lambda x, k: x["i"] == k)
        j = at.join(hit, "id", "left").withColumn("run", F.coalesce(run, F.array().cast("array<struct<i:int,file:string>>")))
        n = F.size("run")
        j = j.withColumn("last", F.when(n > 0, F.element_at("run", -1)["file"]).otherwise(F.col("file"))).withColumn("next", F.get("rest", n))
        found = j.join(self.choice.select(F.col("file").alias("last"), F.col("symbol").alias("next"), "target"), ["last", "next"], "left")
        return found.select("id", F.when(F.col("next").isNull(), node(F.col("last"))).otherwise(F.col("target")).alias("target"))

    def resolve(self, refs: DataFrame, hints: DataFrame | None) -> DataFrame:
        """refs (id, path, scope, name, kind) with target, null where unresolved.

        hints: (path, scope, var, cls): variables known to hold an instance of a class.
        """
        parts = F.split("name", r"\.")
        r = refs.withColumns({"head": F.get(parts, F.lit(0)), "rest": F.slice(parts, 2, 1000)}).withColumn("simple", F.size("rest") == 0)
        ways = []

        def way(rank: int, found: DataFrame) -> None:
            ways.append(found.select("id", F.lit(rank).alias("rank"), "target"))

        top = self.symbols.where("kind <> 'method'").groupBy("path", F.col("name").alias("head")).agg(F.min(F.when(F.col("kind") == "function", 0).otherwise(1)).alias("as"), F.max(F.col("kind") == "class").alias("is_class"))
        local = r.join(top, ["path", "head"])
        way(0, local.where("simple").withColumn("target", node(F.col("path"), F.col("head"), F.when(F.col("as") == 0, "function").otherwise("class"))))
        methods = self.symbols.where("kind = 'method'").select("path", F.col("parent_class").alias("head"), F.col("name").alias("m")).distinct()
        inside = local.where("not simple and is_class").withColumn("m", F.element_at("rest", -1)).join(methods.withColumn("_y", F.lit(True)), ["path", "head", "m"], "left")
        way(0, inside.withColumn("target", F.when(F.col("_y"), node(F.col("path"), F.col("m"), F.lit("method"), F.col("head")))))

        b = r.join(self.bound.withColumnRenamed("bound", "head"), ["path", "head"])
        picked = b.where("simple").join(self.choice, ["file", "symbol"], "left").withColumn("found", F.when(F.col("symbol").isNull() & F.col("file").isNotNull(), node(F.col("file"))).otherwise(F.col("target")))
        way(1, picked.where("found is not null").withColumn("target", F.when(~((F.col("kind") == "call") & F.col("found.name").isNull()), F.col("found"))))
        way(1, b.where("not simple and (symbol is not null or file is null)").withColumn("target", F.lit(None).cast(NODE)))
        way(1, self.walked(b.where("not simple and symbol is null and file is not null").select("id", "module", "file", "rest")))

        own = package_parts(F.col("path"))
        sib = r.where(F.size(own) > 0).withColumn("module", F.concat_ws(".", F.array_join(own, "."), "head")).join(self.modules, "module")
        way(3, sib.where("simple").withColumn("target", node(F.col("file"))))
        way(2, self.walked(sib.where("not simple").select("id", "module", "file", "rest")))

        known = longest_prefix(r.select("name"), self.modules.select(F.col("module").alias("key"), F.col("file").alias("value")))
        pre = r.join(known, "name").withColumn("used", F.size(F.split("target", r"\.")))
        way(4, pre.where("simple").withColumn("target", node(F.col("value"))))
        way(3, self.walked(pre.where("not simple").select("id", F.col("target").alias("module"), F.col("value").alias("file"), F.slice(parts, F.col("used") + 1, F.lit(1000)).alias("rest"))))

        if hints is not None:
            own_methods = self.symbols.where("kind = 'method'").select(F.col("path").alias("cpath"), F.col("parent_class").alias("cname"), F.col("name").alias("m")).distinct()
            seen = r.join(hints.select("path", F.col("scope").alias("scope"), F.col("var").alias("head"), "cls"), ["path", "scope", "head"])
            way(2, seen.where("simple").withColumn("target", F.col("cls")))
            meth = lambda df: df.withColumns({"cpath": F.col("cls.path"), "cname": F.col("cls.name")}).join(own_methods, ["cpath", "cname", "m"]).withColumn("target", node(F.col("cpath"), F.col("m"), F.lit("method"), F.col("cname")))
            way(5, meth(seen.where("size(rest) = 1").withColumn("m", F.get("rest", F.lit(0)))))
            selfs = r.where("head = 'self' and size(rest) = 2 and scope like '%.%'").withColumns({"owner": F.substring_index("scope", ".", 1), "var": F.concat(F.lit("self."), F.get("rest", F.lit(0))), "m": F.get("rest", F.lit(1))})
            way(5, meth(selfs.join(hints.where("var like 'self.%'").select("path", F.col("scope").alias("owner"), "var", "cls"), ["path", "owner", "var"])))
        offered = ways[0]
        for w in ways[1:]:
            offered = offered.unionByName(w)
        # the first way decides, a null of it too; of one way's answers a found one
        best = offered.groupBy("id").agg(F.min_by("target", F.struct("rank", F.col("target").isNull())).alias("target"))
        return refs.join(best, "id", "left")

    def class_hints(self, analysis: DataFrame, rounds: int = HINT_ROUNDS) -> DataFrame | None:
        """(path, scope, var, cls) from assignments and annotated parameters."""
        a = rows_of(analysis, "assigns").select("path", F.when(F.col("name").like("self.%"), F.substring_index("scope", ".", 1)).otherwise(F.coalesce("scope", F.lit(""))).alias("scope"), F.coalesce("scope", F.lit("")).alias("at"), F.col("name").alias("var"), F.col("target").alias("name"), F.lit(1).alias("first"), "pos")
        p = rows_of(analysis, "params").select("path", F.col("scope").alias("scope"), F.col("scope").alias("at"), F.col("name").alias("var"), F.col("annotation").alias("name"), F.lit(0).alias("first"), "pos")
        last = F.row_number().over(Window.partitionBy("path", "scope", "var").orderBy(F.desc("first"), F.desc("pos")))
        h = a.unionByName(p).withColumn("_n", last).where("_n = 1 and var <> name").drop("_n", "first", "pos")
        h = self.scratch.save(h.withColumn("id", F.monotonically_increasing_id()))
        if h.isEmpty():
            return None
        known, count = None, -1
        for _ in range(rounds):
            asked = h.select("id", "path", F.col("at").alias("scope"), "name", F.lit("name").alias("kind"))
            got = self.resolve(asked, known).where("target.kind = 'class'").select("id", F.col("target").alias("cls"))
            known = self.scratch.save(h.join(got, "id").select("path", "scope", "var", "cls"))
            now = known.count()
            if now == count:
                break
            count = now
        return known


def build(analysis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): edges (kind, src, dst, evidence, line), unresolved references."""
    scratch = Scratch(analysis.sparkSession, "calls")
    analysis = scratch.save(analysis)
    r = Resolver(analysis, scratch)
    refs = scratch.save(rows_of(analysis, "refs").select(F.monotonically_increasing_id().alias("id"), "path", F.coalesce("source_symbol", F.lit("")).alias("scope"), "name", "kind", "line", "evidence"))
    done = scratch.save(r.resolve(refs, r.class_hints(analysis)))
    kind = F.when(F.col("kind") != "call", "reference").when(F.col("target.kind") == "class", "instantiation").when(F.col("target.kind") == "method", "method_call").otherwise("call")
    proof = F.when(F.col("kind") == "call", F.array_distinct(F.concat(F.array(F.lit("resolved_ast_call")), "evidence"))).otherwise(F.col("evidence"))
    used = scoped(done.where("target is not null"), r.symbols).select(kind.alias("kind"), "src", F.col("target").alias("dst"), proof.alias("evidence"), "line")
    edges = used.unionByName(import_statements(analysis, r)).distinct()
    bound = r.bound.where("file is null").select("path", F.col("bound").alias("head")).withColumn("_external", F.lit(True))
    lost = done.where("target is null").withColumn("head", F.substring_index("name", ".", 1)).where("not (kind = 'name' and name not like '%.%')").join(bound, ["path", "head"], "left")
    lost = lost.where(F.col("_external").isNull() & ~F.col("head").isin(*dir(builtins)))
    dots = F.contains("name", F.lit("."))
    reason = F.when((F.col("kind") == "call") & dots, F.when(F.col("head") == "self", "unresolved_receiver").otherwise("unresolved_module")).when(dots, "unresolved_attribute").otherwise("unresolved_name")
    return edges, lost.select("path", F.when(F.col("scope") != "", F.col("scope")).alias("source_symbol"), "name", reason.alias("reason"), "line").distinct()


def scoped(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with src, the node that a scope means."""
    first, second = F.substring_index("scope", ".", 1), F.get(F.split("scope", r"\."), F.lit(1))
    meth = symbols.where("kind = 'method'").select("path", F.col("parent_class").alias("_a"), F.col("name").alias("_b")).distinct().withColumn("_m", F.lit(True))
    top = symbols.where("kind <> 'method'").groupBy("path", F.col("name").alias("_a")).agg(F.max(F.col("kind") == "function").alias("_f"), F.max(F.col("kind") == "class").alias("_c"))
    j = refs.withColumns({"_a": first, "_b": F.coalesce(second, F.lit(""))}).join(meth, ["path", "_a", "_b"], "left").join(top, ["path", "_a"], "left")
    src = (
        F.when(F.col("scope") == "", node(F.col("path"))).when(F.col("_m"), node(F.col("path"), F.col("_b"), F.lit("method"), F.col("_a")))
        .when((F.col("_b") != "") & F.col("_f"), node(F.col("path"), F.col("_a"), F.lit("function"))).when(F.col("_b") != "", node(F.col("path"), F.col("_b"), F.lit("function")))
        .when(F.col("_c"), node(F.col("path"), F.col("_a"), F.lit("class"))).otherwise(node(F.col("path"), F.col("_a"), F.lit("function")))
    )
    return j.withColumn("src", src).drop("_a", "_b", "_m", "_f", "_c")


def import_statements(analysis: DataFrame, r: Resolver) -> DataFrame:
    """Edges of import statements, and references to what from-imports name."""
    keyed = r.modules.select(F.col("module").alias("key"), F.col("file").alias("value"))
    a = rows_of(analysis, "imports").select("path", F.col("module").alias("name"), "line", F.lit("import_statement").alias("e"))
    f = absolute_from_imports(analysis).where("absolute <> ''")
    b = f.select("path", F.col("absolute").alias("name"), "line", F.lit("from_import_statement").alias("e"))
    every = a.unionByName(b)
    out = every.join(longest_prefix(every.select("name"), keyed), "name").select(F.lit("import").alias("kind"), node(F.col("path")).alias("src"), node(F.col("value")).alias("dst"), F.array("e").alias("evidence"), "line")
    named = rows_of(analysis, "from_imports").where("name <> '*'").withColumn("bound", F.coalesce("alias", "name")).select("path", "bound", "line").join(r.bound, ["path", "bound"]).join(r.choice, ["file", "symbol"], "left")
    hit = F.when(F.col("symbol").isNull() & F.col("file").isNotNull(), node(F.col("file"))).otherwise(F.col("target"))
    refs = named.withColumn("hit", hit).where("hit is not null").select(F.lit("reference").alias("kind"), node(F.col("path")).alias("src"), F.col("hit").alias("dst"), F.array(F.lit("from_import_statement")).alias("evidence"), "line")
    return out.unionByName(refs)


RELATIONSHIPS = {"calls": (True, True), "called_by": (True, False), "references": (False, True), "referenced_by": (False, False), "imports": (None, True), "imported_by": (None, False)}


def relationship(edges: DataFrame, name: str) -> DataFrame:
    """One of six views as (node, other, kind, line); the -by ones swap the ends."""
    calls, forward = RELATIONSHIPS[name]
    kinds = {True: ["call", "method_call", "instantiation"], False: ["reference"], None: ["import"]}[calls]
    a, b = ("src", "dst") if forward else ("dst", "src")
    return edges.where(F.col("kind").isin(kinds)).select(F.col(a).alias("node"), F.col(b).alias("other"), "kind", "line")


def statistics(edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    kinds = ("call", "method_call", "instantiation", "reference", "import")
    return edges.agg(F.count("*").alias("edges"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]).join(unresolved.agg(F.count("*").alias("unresolved")))
