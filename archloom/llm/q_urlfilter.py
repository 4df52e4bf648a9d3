"""op4: the query and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from .urlfilter import judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, keep=["page_id"])


_CASES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in _CASES]
SQL = rf"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, _, v in _FITS)} ELSE 'allow' END AS verdict FROM u
"""
QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {"op4_url_filter": SQL}
