"""Source trees as tables (path, source).

Spark's file index hides names that begin with an underscore, so package files would
vanish; the tree is listed on the driver, and texts are read on the executors by the
Python data source ``source_tree``. The folder must be mounted on every node.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that are never entered, and files read for declarations.
PRUNED = (".git", ".venv", "venv", "__pycache__", "node_modules")
DECLARATIVE = ("pyproject.toml", "setup.cfg", "tox.ini")
FILES_PER_PARTITION = 200


def check_root(root: str) -> str:
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    return os.path.abspath(root)


def discover(root: str, suffix: str = ".py") -> list[str]:
    """Relative paths of files with exactly the suffix, in path order."""
    root, found = check_root(root), []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in PRUNED]
        for name in names:
            full = os.path.join(folder, name)
            if os.path.splitext(name)[1] == suffix and os.path.isfile(full):
                found.append(os.path.relpath(full, root).replace(os.sep, "/"))
    return sorted(found, key=lambda p: p.split("/"))


def read_tolerant(path: str) -> str:
    """Strict UTF-8; what can't be read is empty."""
    try:
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    except (OSError, ValueError):
        return ""


class _Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def partitions(self) -> list[InputPartition]:
        paths = discover(self.root, self.suffix)
        return [_Slice(paths[i:i + FILES_PER_PARTITION]) for i in range(0, len(paths), FILES_PER_PARTITION)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for p in partition.paths:
            yield p, read_tolerant(os.path.join(self.root, p))


class SourceTree(DataSource):
    """spark.read.format("source_tree").option("suffix", ".py").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, source string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(check_root(self.options.get("path", "")), self.options.get("suffix", ".py"))


def read_tree(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """(path, source) of a tree."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("suffix", suffix).load(check_root(root))


def declarative_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, source) of the declarative configuration files at the top."""
    rows = [(n, read_tolerant(os.path.join(root, n))) for n in DECLARATIVE if os.path.isfile(os.path.join(root, n))]
    return spark.createDataFrame(rows, "path string, source string")


def repository_id(root: str):
    """First 16 hex digits of the root's digest, as a Column."""
    return F.substring(F.sha2(F.lit(os.path.realpath(root)), 256), 1, 16)
