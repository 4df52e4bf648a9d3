"""op6: the query and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from .bundles import round_trip
from .shared import new_folder


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "bundles"))


_BIT = " + ".join(f"(ascii(substr(bits, 5 * i + {k + 1}, 1)) - 48) * {16 >> k}" for k in range(5))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, sha1(h) AS x FROM p),
b AS (SELECT page_id, h, array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(x, (i + 1)::INT, 1))] for i in range(40)], '') AS bits FROM s),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + {_BIT})::INT, 1) for i in range(32)], '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM m
"""
QUERIES = {"op6_warc_bundles": op6_warc_bundles}
ORACLES = {"op6_warc_bundles": SQL}
