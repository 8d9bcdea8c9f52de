"""The corpus pipeline: quality, line dedup, near-dedup, mixing, encoding.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and works on
all that the stage before kept. ``run`` applies them to ``documents``, writing each
stage's rows to the shared folder and rereading them, which also ends their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, crf, line_dedup, mixing, simhash
from corpusloom.llm.common import Scratch, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled ones, doesn't reject."""
    return crf.keep_good(docs, crf.train(docs, read(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id.

    Linked fingerprints propose by multi-index hashing and shingle sets decide; an exact search
    by prefixes follows for the pairs of the same similarity that fingerprints don't reach.
    """
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian 32-bit) of each document, checked by decoding."""
    return bpe.encode_documents(docs, entries=100_000)  # workers serve the other stages too


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near_copies), ("mixing", mix), ("bpe", encode)]

#: The classifier, the suffix array's cuts and BPE are beyond SQL: tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs, _ = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
