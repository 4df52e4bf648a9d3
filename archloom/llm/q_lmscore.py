"""op2: the query; Zstandard isn't SQL, so the tests recompute sizes and counts."""

from pyspark.sql import DataFrame, SparkSession

from .lmscore import compression_score


def op2_compression_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain is the documents labelled quality = 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    # Merged at all sizes: ids grow with the documents, so they are never broadcast.
    return compression_score(docs, docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left_semi"), keep=["doc_id"])


QUERIES = {"op2_compression_cross_entropy": op2_compression_cross_entropy}
ORACLES: dict = {}
