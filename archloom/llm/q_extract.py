"""op8: the query, and SQL that holds for pages shaped like the table's: one article, whose tags are all block-level or <b>."""

from pyspark.sql import DataFrame, SparkSession

from .extract import extract_text


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])


SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?s)^.*?<article>|</article>.*$', '', 'g') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', chr(10), 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
QUERIES = {"op8_html_extraction": op8_html_extraction}
ORACLES = {"op8_html_extraction": SQL}
