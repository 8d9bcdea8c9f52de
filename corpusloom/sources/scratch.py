"""Tables in the shared folder that end the lineage of iterative operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it (tests) gets a folder of its own.

    On a cluster the setting is required, as only it names a folder that every executor sees.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(f"/tmp/checkpoints/corpusloom-{os.getpid()}-{uuid.uuid4().hex[:8]}")
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


class Scratch:
    """Numbered tables below one folder, so lineage ends there.

    A lost executor costs a read from the shared folder, never a recomputation that could
    number rows differently.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.count = spark, 0
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write df as Parquet; return it reread, with its path."""
        path = f"{self.root}/t{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def save(self, df: DataFrame) -> DataFrame:
        return self.put(df)[0]

    def drop(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
