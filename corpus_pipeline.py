"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Documents are known by ``doc_id``: a row without one cannot be referred to by a link or a
passage and stays where rows are dropped by id; rows that repeat an id share its fate. Null
texts count as empty, and of them one document stays; very long texts are read whole by every
stage; ties (equal texts, near copies) are settled by id, as each stage says; an empty table
gives an empty one; other columns are carried to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeops.llm import bpe, chunk_dedup, decontaminate, quality_fm, simhash
from pipeops.llm.tables import stored, table

QUALITY_THRESHOLD = 0.3
#: Benchmark items with fewer characters in their words are no evidence of a leak.
EVIDENCE_CHARS = 16


def _without(docs: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    """The documents whose id is not in ``dropped``, which is written first, so that its size is known to the join."""
    return docs.join(stored(dropped.select("doc_id").distinct(), label), "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    machine = quality_fm.learn(docs, table(spark, sf_dir, "labels"))
    return quality_fm.accepted(docs, machine, QUALITY_THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return _without(docs, chunk_dedup.duplicates(docs).where(~F.col("kept")), "exact-copies")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    groups = simhash.near_duplicates(docs, words=4, bits=4)
    return _without(docs, groups.where(F.col("doc_id") != F.col("component_id")), "near-copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), min_chars=EVIDENCE_CHARS), "contaminated")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_split`` of what is left."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: No SQL: the classifier is trained, fingerprints and BPE have no SQL form; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
