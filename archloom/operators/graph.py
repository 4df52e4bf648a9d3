"""Redirect graphs: each source has one target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import cut_lineage


def closure(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """edges (src, dst; src distinct), expected (path) -> (src, dst, reason).

    reason is ok if following the edges ends at an expected key, already_expected if the source is one itself,
    loop if it ends in a circle, missing_target if it ends at a key that is neither. Pointers are doubled each
    round, so a chain of n takes log2(n) rounds; each round is a table written to the shared folder (spark.checkpoint.dir).
    """
    ends = expected.select(F.col("path").alias("at"), F.lit("ok").alias("found"))
    known = edges.join(expected, edges.src == expected.path, "left_semi")
    rest = edges.join(expected, edges.src == expected.path, "left_anti")
    # to: where 2**round steps lead; reason: set once that is settled.
    now = rest.join(ends, rest.dst == ends.at, "left").select("src", "dst", F.col("dst").alias("to"), F.col("found").alias("reason"))
    now = cut_lineage(now)
    rows = now.count()
    for step_no in range(64):
        step = now.select(F.col("src").alias("s"), F.col("to").alias("t"), F.col("reason").alias("r"))
        open_rows = now.where("reason IS NULL").join(step, F.col("to") == F.col("s"), "left")
        moved = open_rows.select("src", "dst", F.coalesce("t", "to").alias("to"), F.when(F.col("s").isNull(), "missing_target").otherwise(F.col("r")).alias("reason"))
        now = cut_lineage(now.where("reason IS NOT NULL").union(moved))
        # Once the steps outnumber the rows, what is still open runs in a circle.
        if 2 ** (step_no + 1) > rows or now.where("reason IS NULL").isEmpty():
            break
    return now.select("src", "dst", F.coalesce("reason", F.lit("loop")).alias("reason")).union(known.select("src", "dst", F.lit("already_expected")))
