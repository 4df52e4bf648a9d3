"""The corpus pipeline: documents to a training mix.

Each stage calls one operator on all that the stage before kept, and its decisions take effect. Between stages the
documents are written as Parquet to the shared folder and read back. Stages are (name, function of (spark, docs, sf_dir)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archloom.llm import decontaminate, mixing, passages, quality, simhash
from archloom.llm.shared import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go: among them all with fewer than 50 words, null and empty texts."""
    return quality.judge(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays (nulls last); of repeated rows one."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out of the later ones; no document goes, and rows with a null doc_id stay as they are."""
    return passages.remove_repeats(docs, count="n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go; null and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy. Rows without words have none; null is a source of its own."""
    return mixing.mixture(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("benchmark decontamination", decontamination), ("mixing", mix)]

#: Fingerprints, MinHash, alignments and Newton iterations have no SQL; tests/llm checks the stages' operators by brute force or planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "stage-" + name.replace(" ", "-"))
    return docs
