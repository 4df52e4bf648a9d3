"""op3: the query; edit-bounded search isn't SQL, so the tests compare it with brute force."""

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminated


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
ORACLES: dict = {}
