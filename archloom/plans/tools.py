"""Small jobs beside the conversion: log clean-up and single documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archloom.functions import rewrite


def clean_log(spark: SparkSession, path: str, patterns: list[str]) -> DataFrame:
    """The lines of a log (value string) that match none of the patterns at their start."""
    return spark.read.text(path).where(~F.col("value").rlike("^(?:" + "|".join(patterns) + ")"))


def rewrite_document(text: str, url: str, mode: str = "html") -> tuple[str, str]:
    """(title, text) of one document, seen against an empty archive: all links lead outside."""
    if mode == "html":
        return rewrite.html(text, url, lambda key: False)[:2]
    at = rewrite.Archive(url, lambda key: False)
    return "", rewrite.css(text, at) if mode == "css" else rewrite.javascript(text, at) if mode == "javascript" else text
