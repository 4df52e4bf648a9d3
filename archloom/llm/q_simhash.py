"""op9: the query; SQL has no XXH64, so the tests compare it with brute force."""

from pyspark.sql import DataFrame, SparkSession

from .simhash import near_duplicates


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
ORACLES: dict = {}
