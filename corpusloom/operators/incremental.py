"""Incremental snapshots: parse what is new by content hash, drop what is gone.

A store is a Parquet table keyed by (path, content_hash, schema_version), written as
a new version each time; a pointer file names the current one, so readers never see a
half-written version. What cannot be read counts as a miss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
KEY = ["path", "content_hash"]


def with_hash(files: DataFrame, text: str = "source") -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, state): added, modified, removed or unchanged, by full outer join on path."""
    a = current.select("path", F.col("content_hash").alias("_new"))
    b = stored.select("path", F.col("content_hash").alias("_old"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") != F.col("_old"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def misses(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of current that the store has no entry for."""
    return current.join(stored.select(*KEY), KEY, "left_anti")


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Entries of the store that current no longer has."""
    return stored.join(current.select(*KEY), KEY, "left_anti")


class Store:
    """Versions of one keyed table below a folder that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str, version: int = SCHEMA_VERSION):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointer(self) -> str:
        return f"{self.folder}/CURRENT-{self.version}"

    def current(self) -> str | None:
        fs, p = self._fs(self._pointer())
        if not fs.exists(p):
            return None
        names = sorted(str(s.getPath().getName()) for s in fs.listStatus(p))
        return names[-1] if names else None

    def load(self, schema) -> DataFrame:
        name = self.current()
        if name is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(f"{self.folder}/{name}")

    def publish(self, table: DataFrame) -> str:
        """Write a version, then name it in the pointer folder by one atomic rename."""
        last = self.current()
        name = f"v{int(last[1:]) + 1 if last else 1:08d}"
        table.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        fs, made = self._fs(f"{self.folder}/.{name}")
        _, pointer = self._fs(self._pointer())
        fs.mkdirs(pointer)
        fs.mkdirs(made)
        fs.rename(made, self._fs(f"{self._pointer()}/{name}")[1])
        return name

    def clear(self) -> None:
        fs, p = self._fs(self.folder)
        fs.delete(p, True)


def refresh(files: DataFrame, store: Store, parse: Callable[[DataFrame], DataFrame], schema) -> tuple[DataFrame, dict[str, int]]:
    """(entries, stats): parsed entries of files, reusing those whose text is unchanged.

    parse: (path, content_hash, source) to schema, which begins with path, content_hash.
    """
    current, old = with_hash(files), store.load(schema)
    new = misses(current, old)
    kept = old.join(current.select(*KEY), KEY, "left_semi").select(*[f.name for f in schema])
    n = {"files": current.count(), "parsed": new.count(), "removed": stale(old, current).count()}
    n["hits"] = n["files"] - n["parsed"]
    if n["parsed"] or n["removed"] or store.current() is None:
        store.publish(kept.unionByName(parse(new).select(*[f.name for f in schema])))
    return store.load(schema), n
