"""op1: the query; a trained model isn't SQL, so the tests measure held-out accuracy."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .toxicity import fit_model, score


def _third(c):
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~_third(F.col("doc_id")))
    scored = score(docs, fit_model(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", _third(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict = {}
