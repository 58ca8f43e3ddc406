"""The registered queries of this subpackage; where SQL has no form, tests compare with brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeops.session import scratch

from . import (
    arc_warc, bpe, chunk_dedup, decontaminate, hadamard_clusters, language_nb, periodic_runs, pii_votes, quality_fm, secret_forest, simhash, style_tree, token_rollups,
)
from .tables import stored, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.secrets(table(spark, sf_dir, "documents"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.archived(table(spark, sf_dir, "pages"), least_bytes=0)


def op6_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.main_text(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)


def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.duplicates(table(spark, sf_dir, "documents"))


def op9_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_votes.digest(pii_votes.personal_data(table(spark, sf_dir, "documents")))


#: The two tokenizer versions of the rollup.
TOKENIZERS = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are loaded with the first tokenizer; toxic ones are withdrawn, good ones recounted with the second.

    The withdrawal is delivered twice, and what was committed is folded in between.
    """
    old, new = TOKENIZERS
    counted = bpe.count(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), TOKENIZERS)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # texts are counted where they lie; only counts meet the labels
    known = stored(stored(counted, "counts").join(labels, "doc_id", "left"), "counted")
    first = known.withColumns({"tokenizer_version": F.lit(old), "n_tokens": F.col("n_tokens")[0]})
    withdrawn = first.where("toxic = 1").withColumn("op", F.lit("delete"))
    recounted = known.where("quality = 1 AND coalesce(toxic, 0) <> 1").withColumns(
        {"op": F.lit("revise"), "tokenizer_version": F.lit(new), "n_tokens": F.col("n_tokens")[1], "old_source": F.col("source"), "old_lang": F.col("lang"), "old_tokenizer_version": F.lit(old), "old_n_tokens": F.col("n_tokens")[0]}
    )
    rollup = token_rollups.Rollup(spark, scratch(spark, "rollup"))
    rollup.apply("load", first.withColumn("op", F.lit("insert")))
    rollup.apply("withdraw", withdrawn)
    rollup.compact()
    rollup.apply("withdraw", withdrawn)
    rollup.apply("recount", recounted)
    return rollup.totals()


def op11_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_nb.identify(table(spark, sf_dir, "documents"))


def op12_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hadamard_clusters.cluster(table(spark, sf_dir, "embeddings"), scale=1024, centroids=8, rounds=10, seed=3)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find(table(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_benchmark_passages": op2_benchmark_passages,
    "op3_quality_machine": op3_quality_machine,
    "op4_secret_forest": op4_secret_forest,
    "op5_arc_to_warc": op5_arc_to_warc,
    "op6_style_tree": op6_style_tree,
    "op7_simhash": op7_simhash,
    "op8_chunk_recipes": op8_chunk_recipes,
    "op9_weak_pii": op9_weak_pii,
    "op10_token_rollup": op10_token_rollup,
    "op11_language_bayes": op11_language_bayes,
    "op12_hadamard_clusters": op12_hadamard_clusters,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op8_chunk_recipes": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_hadamard_clusters": hadamard_clusters.sql(),
}
