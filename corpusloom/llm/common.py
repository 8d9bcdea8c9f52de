"""What the training-data operators share: word rules, tables and scratch space."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import scratch

#: White space between words, as a Java (and RE2) character class body.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = rf"[^{WS}]+"
WS_RUN = rf"[{WS}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, UPPER, LOWER)


def without_space(text: Column) -> Column:
    return F.translate(text, WS_CHARS, "")


def word_count(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """The words in order; an empty array for null, empty or blank text."""
    edge = rf"^{WS_RUN}|{WS_RUN}$"
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), edge, "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_RUN))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """batches in slices: Spark bounds a batch by its bytes, and Python holds a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


class Scratch(scratch.Scratch):
    """Tables below the shared folder; save returns the reread table with its path."""

    def save(self, df: DataFrame) -> tuple[DataFrame, str]:
        return self.put(df)
