"""op7: the query; the Newton iterations aren't SQL, so the tests check its conditions."""

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix


def op7_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_entropy_balancing": op7_entropy_balancing}
ORACLES: dict = {}
