"""The import graph between files, by joins of imports with the module table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import absolute_base, module_name, parent, path_order
from corpusloom.operators.code import rows_of
from corpusloom.operators.graph import longest_prefix


def module_table(files: DataFrame) -> DataFrame:
    """(module, file): of equal names the file first in path order."""
    m = files.select("path", module_name(F.col("path")).alias("module"), path_order(F.col("path")).alias("o"))
    return m.groupBy("module").agg(F.min_by("path", "o").alias("file"))


def package_parts(path):
    return F.when(parent(path) == ".", F.array().cast("array<string>")).otherwise(F.split(parent(path), "/"))


def absolute_from_imports(analysis: DataFrame) -> DataFrame:
    """from-imports with absolute, the module meant; null where too many dots are given."""
    f = rows_of(analysis, "from_imports")
    base = F.when(F.col("level") == 0, F.array().cast("array<string>")).otherwise(absolute_base(package_parts(F.col("path")), F.col("level")))
    own = F.when(F.col("module") == "", F.array().cast("array<string>")).otherwise(F.array("module"))
    return f.withColumn("absolute", F.when(base.isNotNull(), F.array_join(F.concat(base, own), ".")))


def import_edges(analysis: DataFrame) -> DataFrame:
    """(src, dst) distinct, inside the corpus, without self edges.

    ``import a.b`` means the deepest known prefix; ``from m import n`` the module m.n
    if there is one, else m.
    """
    table = module_table(analysis)
    plain = rows_of(analysis, "imports").select("path", F.col("module").alias("name"))
    deep = longest_prefix(plain, table.select(F.col("module").alias("key"), F.col("file").alias("value")))
    a = plain.join(deep, "name").select(F.col("path").alias("src"), F.col("value").alias("dst"))
    f = absolute_from_imports(analysis).where("absolute is not null")
    inner = F.when(F.col("name") != "*", F.when(F.col("absolute") == "", F.col("name")).otherwise(F.concat_ws(".", "absolute", "name")))
    f = f.select("path", "absolute", inner.alias("inner"))
    sub = table.select(F.col("module").alias("inner"), F.col("file").alias("_sub"))
    own = table.select(F.col("module").alias("absolute"), F.col("file").alias("_own"))
    b = f.join(sub, "inner", "left").join(own, "absolute", "left").select(F.col("path").alias("src"), F.coalesce("_sub", "_own").alias("dst"))
    return a.unionByName(b).where("dst is not null and src <> dst").distinct()
