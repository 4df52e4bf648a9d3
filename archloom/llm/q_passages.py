"""op10: the query; MinHash isn't SQL, so the tests measure recall on planted passages and compare the linking of candidates with brute force."""

from pyspark.sql import DataFrame, SparkSession

from .passages import repeated_passages


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_paragraph_minhash": op10_paragraph_minhash}
ORACLES: dict = {}
