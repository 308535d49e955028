"""The subpackage's queries, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import (
    op1_bpe_lexicon,
    op10_chroma_fingerprints,
    op2_host_paths,
    op3_paragraph_dedup,
    op4_neighbour_quality,
    op5_minmax_dedup,
    op6_permutation_index,
    op7_linear_grouping,
    op8_pu_toxicity,
    op9_license_rules,
)
from loomline.llm.shared import written


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents through the word-end BPE and back, as digests."""
    return op1_bpe_lexicon.digests(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of whole pages."""
    return op2_host_paths.extract(_table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated paragraphs of whole documents: where each is and which one stays."""
    return op3_paragraph_dedup.removals(_table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of whole documents."""
    return op4_neighbour_quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_near(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates among whole documents: three words, similarity 0.85."""
    return op5_minmax_dedup.near_duplicates(_table(spark, folder, "documents"), 3, 85)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of whole documents."""
    return op8_pu_toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents into sequences of 2048 tokens."""
    return op7_linear_grouping.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence rules that whole documents match."""
    return op9_license_rules.scan(_table(spark, folder, "documents"))


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every row whose id is divisible by 20, among all rows."""
    return op6_permutation_index.every_twentieth(_table(spark, folder, "embeddings"))


def op10_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings played as melodies: each one's links with every twentieth, or as one of them."""
    op = op10_chroma_fingerprints
    marks = written(op.fingerprints(_table(spark, folder, "embeddings"), "vec_id", "embedding", render=True), "marks")
    return op.linked(marks, marks.where("id % 20 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_lexicon": op1_bpe,
        "op2_host_paths": op2_html,
        "op3_paragraph_dedup": op3_substrings,
        "op4_neighbour_quality": op4_quality,
        "op5_minmax_dedup": op5_near,
        "op7_linear_grouping": op7_packing,
        "op8_pu_toxicity": op8_toxicity,
        "op9_license_rules": op9_licenses,
        "op6_permutation_index": op6_neighbours,
        "op10_chroma_fingerprints": op10_audio,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_license_rules": op9_license_rules.sql()}
