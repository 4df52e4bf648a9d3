"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: bit i is 1 if it is set in more than half of the XXH64 hashes (seed 42) of
the text's 3-word shingles. Two fingerprints at most two bits apart are linked. They are found
through two indexes, one on each half: of two differing bits, either at most one lies in the high
half (the ball of radius 1 around the high half, 33 lookups), or both do and the low halves are
equal (1 lookup). Fetched entries are verified on all 64 bits. Work is done on distinct fingerprints,
so a hot text costs one entry. An index bucket with more than ``hot_bucket`` entries (many
fingerprints with one half in common) isn't paired up: its fingerprints are looked up by the balls of
radius 1 around the whole 64 bits instead, which meet in one or more keys exactly if the two are at most two bits apart,
and a key has at most 65 entries. Both ways are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .graph import components
from .shared import numbered, staged
from .text import buffers

HALF = [0] + [1 << i for i in range(32)]
WHOLE = [0] + [(1 << i) - ((1 << 64) if i == 63 else 0) for i in range(64)]
LOW = 0xFFFFFFFF


def fingerprints(texts: pa.Array) -> np.ndarray:
    """uint64 fingerprint of each whole text. A-Z are lowered; fewer than three words: one shingle of them all; none, or null: zero."""
    data, offsets = buffers(texts)
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i in range(len(texts)):
        ws = data[offsets[i] : offsets[i + 1]].tobytes().lower().split()
        if not ws:
            continue
        text = b" ".join(ws)
        if len(ws) <= 3:
            out[i] = digest(text, 42)
            continue
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = [0, *(ends[:-3] + 1).tolist()]
        hashes = np.array([digest(text[a:b], 42) for a, b in zip(starts, ends[2:].tolist())], np.uint64)
        total = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
            part = hashes[at : at + (1 << 16)]
            total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _signed(texts: pa.Array) -> pa.Array:
    return pa.array(fingerprints(texts).view(np.int64))


#: The fingerprint of a column as a signed long.
fingerprint = F.arrow_udf(_signed, LongType())
#: The same, declared nondeterministic: else the planner computes it once more for a null check below a join on it.
fingerprint_once = F.arrow_udf(_signed, LongType()).asNondeterministic()


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, hot_bucket: int = 1024) -> DataFrame:
    """fps (fp long, distinct) -> (x, y): every ordered pair of different fingerprints at most two bits apart, once each."""
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW))
    table = fps.select(F.explode(F.array(F.struct(F.lit(0).alias("part"), hi.alias("value")), F.struct(F.lit(1).alias("part"), lo.alias("value")))).alias("k"), F.col("fp").alias("y")).select("k.part", "k.value", "y")
    probes = fps.select(
        F.explode(F.concat(F.transform(F.array(*map(F.lit, HALF)), lambda m: F.struct(F.lit(0).alias("part"), m.cast("long").bitwiseXOR(hi).alias("value"))), F.array(F.struct(F.lit(1).alias("part"), lo.alias("value"))))).alias("k"),
        F.col("fp").alias("x"),
    ).select("k.part", "k.value", "x")
    hot = staged(table.groupBy("part", "value").count().where(F.col("count") > hot_bucket).select("part", "value"), "hot")
    near = (F.col("x") != F.col("y")) & (_distance("x", "y") <= 2)
    any_hot = not hot.isEmpty()
    cold = table.join(hot, ["part", "value"], "left_anti") if any_hot else table
    high = F.shiftrightunsigned(F.col("x").bitwiseXOR(F.col("y")), 32)
    # A pair that the low half fetches is only taken where the high half can't.
    found = probes.join(cold, ["part", "value"]).where(near & ((F.col("part") == 0) | (F.bit_count(high) == 2))).select("x", "y")
    if not any_hot:
        return found
    def ball(side: DataFrame, name: str) -> DataFrame:
        masks = F.array(*[F.lit(m).cast("long") for m in WHOLE])
        return side.distinct().select(F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col(name)))).alias("key"), name)

    xs = probes.join(hot, ["part", "value"], "left_semi").select("x")
    ys = table.join(hot, ["part", "value"], "left_semi").select("y")
    rest = ball(xs, "x").join(ball(ys, "y"), "key").where(near).select("x", "y")
    return found.union(rest).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_bucket: int = 1024) -> DataFrame:
    """One row a row of docs: doc_id, fingerprint (16 hex digits), n_near (other rows linked directly), component_id (smallest doc_id reachable).

    Null and empty texts have the fingerprint zero and are linked like others. Repeated rows count
    as rows: each is linked to the others. A null doc_id is kept, counted in n_near, and never a component_id unless all of its component are null.
    An empty table gives an empty result; other columns are ignored.
    """
    return with_components(staged(docs.select(docs[doc_id].alias("doc_id"), fingerprint(docs[text]).alias("fp")), "fingerprints"), hot_bucket).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id"
    )


def classes(rows: DataFrame, hot_bucket: int = 1024) -> DataFrame:
    """rows (doc_id, fp), a table -> (fp, n_near, root, component_id): one row a distinct fingerprint."""
    fps = staged(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    pairs = staged(links(fps.select("fp"), hot_bucket), "links")
    roots = components(pairs.where("x > y").select(F.col("x").alias("u"), F.col("y").alias("v"))).select(F.col("node").alias("fp"), "root")
    near = pairs.join(fps.select(F.col("fp").alias("y"), F.col("n").alias("m")), "y").groupBy(F.col("x").alias("fp")).agg(F.sum("m").alias("others"))
    linked = fps.join(roots, "fp").join(near, "fp", "left")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = fps.join(roots, "fp", "left_anti").select("fp", (F.col("n") - 1).alias("n_near"), F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return linked.join(least, "root").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "root", "component_id").union(alone)


def with_components(rows: DataFrame, hot_bucket: int = 1024) -> DataFrame:
    return rows.join(classes(rows, hot_bucket), "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_bucket: int = 1024) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component (nulls last), one row of each; of rows that repeat this doc_id, any one, always the same for the same table.

    Null and empty texts have the fingerprint zero: one of them all stays. All columns stay, whatever their names; an empty table gives an empty result.
    """
    rows = staged(docs.select(docs[doc_id].alias("doc_id"), fingerprint(docs[text]).alias("fp")), "fingerprints")
    best = rows.join(classes(rows, hot_bucket).select("fp", "root", "component_id"), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # The one fingerprint that stays, and how many rows have it under this doc_id.
    stay = best.groupBy("root", "component_id").agg(F.min("fp").alias("least")).join(best.groupBy("root", "fp").agg(F.count("*").alias("n")), "root").where("fp = least")
    stay = staged(stay.select("least", F.col("component_id").alias("id"), "n"), "stay")
    own, names = numbered(docs)
    marked = own.withColumn("f", fingerprint_once(own[names[text]]))
    chosen = marked.join(stay, (F.col("f") == F.col("least")) & F.col(names[doc_id]).eqNullSafe(F.col("id")))
    once = chosen.where("n = 1").select(*names.values()).toDF(*docs.columns)
    if stay.where("n > 1").isEmpty():
        return once
    rows = chosen.where("n > 1").select("least", "id", F.struct(*names.values()).alias("row"))
    # Repeats are combined before the shuffle, however many there are.
    kept = rows.groupBy("least", "id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.union(kept.select(*[f"row.{c}" for c in names.values()]).toDF(*docs.columns))
