"""Architecture of a corpus: containment, aggregated edges, subsystems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import file_name, module_name, parent
from corpusloom.operators.graph import layers


def package_of(path):
    """The directory of a file; "." at the top."""
    return parent(path)


def nodes(files: DataFrame) -> DataFrame:
    """(kind, id): files, their modules, and packages with files of their own."""
    f = files.select("path").distinct()
    parts = F.array(
        F.struct(F.lit("file").alias("kind"), F.col("path").alias("id")),
        F.struct(F.lit("module").alias("kind"), module_name(F.col("path")).alias("id")),
        F.struct(F.lit("package").alias("kind"), package_of(F.col("path")).alias("id")),
    )
    root = f.sparkSession.createDataFrame([("package", ".")], "kind string, id string")
    return f.select(F.explode(parts).alias("x")).select("x.*").unionByName(root).distinct()


def containment(files: DataFrame) -> DataFrame:
    """(parent_kind, parent, kind, id): package to file, file to module, package to package.

    A package lies in the nearest ancestor directory that is a package.
    """
    f = files.select("path").distinct()
    direct = f.select(F.explode(F.array(
        F.struct(F.lit("package").alias("parent_kind"), package_of(F.col("path")).alias("parent"), F.lit("file").alias("kind"), F.col("path").alias("id")),
        F.struct(F.lit("file").alias("parent_kind"), F.col("path").alias("parent"), F.lit("module").alias("kind"), module_name(F.col("path")).alias("id")),
    )).alias("x")).select("x.*")
    packs = nodes(files).where("kind = 'package'").select("id")
    parts = F.split("id", "/")
    above = packs.where("id <> '.'").select("id", F.explode(F.concat(F.array(F.lit(".")), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>")))).alias("anc"))
    near = above.join(packs.select(F.col("id").alias("anc")), "anc").groupBy("id").agg(F.max(F.struct(F.when(F.col("anc") == ".", 0).otherwise(F.length("anc")).alias("n"), "anc")).alias("x"))
    nested = near.select(F.lit("package").alias("parent_kind"), F.col("x.anc").alias("parent"), F.lit("package").alias("kind"), "id")
    return direct.unionByName(nested)


def lifted_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(src, dst, weight) between owners; owner: (node, group). Self edges drop."""
    a = owner.select(F.col("node").alias("src"), F.col("group").alias("gs"))
    b = owner.select(F.col("node").alias("dst"), F.col("group").alias("gd"))
    lifted = edges.join(a, "src").join(b, "dst").where("gs <> gd")
    return lifted.groupBy(F.col("gs").alias("src"), F.col("gd").alias("dst")).agg(F.count("*").alias("weight"))


def subsystem_of(path):
    """The first path segment; files at the top belong to root."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("root")


def subsystems(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per subsystem: its packages, files, entry files and neighbours.

    edges: (src, dst) between files. Entry files are used from other subsystems.
    """
    f = files.select("path").distinct().withColumn("subsystem", subsystem_of(F.col("path")))
    listed = lambda c: F.array_sort(F.collect_set(c))
    base = f.groupBy("subsystem").agg(listed(package_of(F.col("path"))).alias("packages"), listed("path").alias("files"), listed(module_name(F.col("path"))).alias("modules"))
    own = edges.select("src", "dst", subsystem_of(F.col("src")).alias("a"), subsystem_of(F.col("dst")).alias("b")).where("a <> b")
    out = own.groupBy(F.col("a").alias("subsystem")).agg(listed("b").alias("dependencies"))
    into = own.groupBy(F.col("b").alias("subsystem")).agg(listed("a").alias("dependents"), listed("dst").alias("entry_files"))
    found = base.join(out, "subsystem", "left").join(into, "subsystem", "left")
    none = F.array().cast("array<string>")
    return found.withColumns({c: F.coalesce(F.col(c), none) for c in ("dependencies", "dependents", "entry_files")})


def containing(found: DataFrame, kind: str, value: str) -> DataFrame:
    """The subsystems (as subsystems gives them) that hold a file, module or package."""
    if kind not in ("file", "module", "package"):
        raise ValueError(f"unknown kind: {kind}")
    return found.where(F.array_contains(f"{kind}s", value))


def package_layers(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, node, layer): layers of packages inside each subsystem."""
    f = files.select("path").distinct()
    packs = f.select(subsystem_of(F.col("path")).alias("group"), package_of(F.col("path")).alias("node")).distinct()
    inner = edges.select(subsystem_of(F.col("src")).alias("group"), subsystem_of(F.col("dst")).alias("_g"), package_of(F.col("src")).alias("src"), package_of(F.col("dst")).alias("dst"))
    return layers(packs, inner.where("group = _g and src <> dst").drop("_g").distinct())


def statistics(tree: DataFrame) -> DataFrame:
    """Counts per kind of node and per kind of containment."""
    return tree.groupBy("parent_kind", "kind").agg(F.count("*").alias("edges"), F.count_distinct("parent").alias("parents"), F.count_distinct("id").alias("children"))


def leaf(path):
    return F.regexp_replace(file_name(path), r"\.py$", "")
