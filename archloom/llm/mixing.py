"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all rates r in (0, 2) of the documents that meet the
targets, the one with the largest entropy is an exponential tilt: r / (2 - r) = exp(l * size), with one
multiplier l per source, found by Newton iterations on the convex dual. Its gradient and curvature are
sums over the documents, and depend on a document by its source and size only, so they are aggregated once to
(source, size, number), and an iteration is one aggregation of that table.

Rates become copies by a fixed hash of each document: copies = floor(rate), and one more where
hash - fraction falls under a cut. The cuts are chosen per source and class of sizes (powers of two),
the largest class first, so that what one class misses the next makes up; the residue is that of the smallest class.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, staged

WORD = r"[^\x20\x09-\x0D]+"
BINS = 2048


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size; one row each) -> with rank and target. Weights repeat over the sources in code point order, null last.

    All targets together are share times all sizes; one stops at most times its source's size, and the rest takes over by weight.
    """
    order = [F.col("source").isNull(), F.col("source")]
    # A global rank without one task for all: range partitions, then offsets of partitions.
    parted = staged(sources.select("source", "source_size").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources-parted")
    sizes = parted.groupBy("part").count().orderBy("part").collect()  # a row a partition
    offsets = {r.part: sum(x["count"] for x in sizes if x.part < r.part) for r in sizes}
    offset = F.coalesce(*[F.when(F.col("part") == k, F.lit(n)) for k, n in offsets.items()], F.lit(0))
    table = parted.select("source", "source_size", (offset + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).cast("long").alias("rank"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = staged(table.withColumn("weight", w), "sources")
    limit = most * F.col("source_size")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped, n = 0.0, F.lit(False), sum(r["count"] for r in sizes)
    for _ in range(n + 2):  # each round but the last stops at least one more source
        full, free = table.agg(_sum(F.when(capped, limit).otherwise(0.0)), _sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        last, level = level, (total - float(full)) / float(free)
        if level == last:
            break
        capped = F.col("weight") * level > limit
    else:
        raise RuntimeError("the targets don't settle")
    return table.withColumn("target", F.least(limit, F.col("weight") * level))


def _sum(x: Column) -> Column:
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(x.cast("decimal(38, 9)"))


def _rate(multiplier: Column, size: Column, mean: Column) -> Column:
    return 2.0 / (1.0 + F.exp(-F.least(F.greatest(multiplier * size / mean, F.lit(-700.0)), F.lit(700.0))))


def multipliers(pre: DataFrame, goals: DataFrame, tolerance: float = 1e-9, rounds: int = 80) -> DataFrame:
    """pre (rank, size, n), goals (rank, source_size, target) -> (rank, mean, l). l is +-infinity where the target is a bound of what rates can give. RuntimeError if so many rounds aren't enough."""
    sums = pre.where("size > 0").groupBy("rank").agg(F.sum("n").alias("docs"), _sum(F.col("n") * F.col("size") * F.col("size").cast("double")).cast("double").alias("squares"))
    inf = float("inf")
    share = F.col("target") / F.col("source_size")
    # From where the rates would be right if all words lay in documents of their mean size.
    level = F.log(share / (2.0 - share)) * F.col("source_size") * (F.col("source_size") / F.col("docs")) / F.col("squares")
    start = F.when(F.col("target") >= 2.0 * F.col("source_size") * (1 - 1e-12), F.lit(inf)).when(F.col("target") <= 0, F.lit(-inf)).otherwise(level)
    state = staged(
        goals.join(sums, "rank").select("rank", (F.col("source_size") / F.col("docs")).alias("mean"), "target", start.alias("l"), F.lit(-inf).alias("low"), F.lit(inf).alias("high"), F.lit(False).alias("done")), "dual"
    )
    for _ in range(rounds):
        r = _rate(F.col("l"), F.col("size"), F.col("mean"))
        each = pre.where("size > 0").join(state.where("NOT done AND abs(l) < double('infinity')"), "rank")
        g = each.groupBy("rank").agg(
            _sum(F.col("n") * F.col("size") * r).cast("double").alias("sum"), _sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r * (1 - r / 2)).cast("double").alias("slope")
        )
        x = state.join(g, "rank", "left")
        gap = F.col("sum") - F.col("target")
        low, high = F.when(gap < 0, F.col("l")).otherwise(F.col("low")), F.when(gap > 0, F.col("l")).otherwise(F.col("high"))
        widest = 4 * (1 + F.abs("l"))
        step = F.greatest(-widest, F.least(widest, F.when(F.col("slope") > 0, -gap / F.col("slope")).otherwise(-F.signum(gap) * widest)))
        to = F.col("l") + step
        to = F.when((to > F.col("low2")) & (to < F.col("high2")), to).otherwise((F.col("low2") + F.col("high2")) / 2)
        x = x.withColumn("low2", low).withColumn("high2", high)
        done = F.col("done") | F.col("sum").isNull() | (F.abs(gap) <= tolerance * F.col("target"))
        new = staged(x.select("rank", "mean", "target", F.when(done, F.col("l")).otherwise(to).alias("l"), F.col("low2").alias("low"), F.col("high2").alias("high"), done.alias("done")), "dual")
        discard(state)
        state = new
        if state.where("NOT done").isEmpty():
            break
    else:
        raise RuntimeError(f"no solution within {rounds} Newton iterations")
    return state.select("rank", "mean", "l")


def _cuts(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source: per class of sizes, the first bin that gets no further copy. At most 64 classes of BINS rows."""
    out, carry = [], 0.0
    for c in sorted(rows["class"].unique(), reverse=True):
        part = rows[rows["class"] == c].sort_values("bin")
        want = float(part["expected"].sum()) + carry
        sums = [0.0, *part["size"].cumsum()]
        best = min(range(len(sums)), key=lambda i: (abs(sums[i] - want), i))
        carry = want - sums[best]
        cut = int(part["bin"].iloc[best]) if best < len(part) else 1 << 30
        out.append((int(rows["rank"].iloc[0]), int(c), cut))
    return pd.DataFrame(out, columns=["rank", "class", "cut"])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """One row a row of docs: doc_id, size, source_size, target, taken (size times 0, 1 or 2 copies), copies.

    A null or empty text has size 0 and takes nothing; null is a source of its own, last in order. Sources
    without words have target 0. Rows that repeat doc_id and text are numbered, and each number is drawn by itself. An empty table gives an empty result.
    The same table gives the same rows in any order or partitioning: hashes decide, and all sums are exact.
    """
    rows = staged(docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), words(docs[text]).alias("size"), F.xxhash64(docs[doc_id], docs[text]).alias("h")), "sizes")
    return copies(drawn(rows, repeated(rows)), weights, share).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """The mix itself: each row of docs as often as mix() has copies of it, with its columns and copy (1, 2), which takes the place of a column of that name. Rows without words have none.

    Of rows that repeat doc_id and text and differ elsewhere, any may be the ones taken. An empty table gives an empty result.
    """
    measured = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc"), docs[source].cast("string").alias("source"), words(docs[text]).alias("size"), F.xxhash64(docs[doc_id], docs[text]).alias("h"))
    basis = staged(measured.select("source", "size", "h"), "sizes")
    again = repeated(basis)
    taken = copies(drawn(measured, again), weights, share, drawn(basis, again)).where("copies > 0")
    each = taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(*[F.col("doc")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns) if c != "copy"], "copy")


def repeated(rows: DataFrame) -> DataFrame | None:
    """The staged hashes (h) that more than one row has; None if there are none."""
    again = staged(rows.groupBy("h").count().where("count > 1").select("h"), "repeated")
    return None if again.isEmpty() else again


def drawn(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """rows (h, ...) -> with u, a number in [0, 1), instead of h: rows with one h are numbered in parts of their own, however many there are, and each number has its u."""
    rest = [c for c in rows.columns if c != "h"]
    if again is None:
        return rows.select(*rest, hashed(F.col("h"), F.lit(0)).alias("u"))
    once = rows.join(again, "h", "left_anti").select(*rest, hashed(F.col("h"), F.lit(0)).alias("u"))
    some = staged(rows.join(again, "h", "left_semi").withColumn("salt", (F.rand(1) * 256).cast("int")), "repeated-rows")
    of = Window.partitionBy("h").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    before = some.groupBy("h", "salt").count().select("h", "salt", F.coalesce(F.sum("count").over(of), F.lit(0)).alias("before"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("h", "salt").orderBy(F.lit(1))) - 1
    return once.union(some.join(before, ["h", "salt"]).select(*rest, hashed(F.col("h"), nth.cast("int")).alias("u")))


def hashed(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / float(1 << 53)


def copies(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, basis: DataFrame | None = None) -> DataFrame:
    """rows (source, size, u, ...) -> with source_size, target and copies. basis: source, size and u of the same rows, if these are dear to compute."""
    basis = rows if basis is None else basis
    counts = staged(basis.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)
    pre = counts.join(goals.select("source", "rank"), counts.source.eqNullSafe(goals.source)).select("rank", "size", "n")
    dual = multipliers(staged(pre, "counts-ranked"), goals)
    known = staged(goals.join(dual, "rank", "left").select(F.col("source").alias("s"), "rank", "source_size", "target", "mean", "l"), "rates")
    def rated(x: DataFrame) -> DataFrame:
        x = x.join(known, x["source"].eqNullSafe(known["s"]))
        r = F.when(F.col("l") == float("inf"), 2.0).when((F.col("size") == 0) | F.col("l").isNull() | (F.col("l") == float("-inf")), 0.0).otherwise(_rate(F.col("l"), F.col("size"), F.col("mean")))
        x = x.withColumn("r", r).withColumn("whole", F.least(F.floor("r"), F.lit(2))).withColumn("part", F.col("r") - F.col("whole"))
        free = (F.col("size") > 0) & (F.col("part") > 0)
        return x.withColumn("class", F.when(free, F.floor(F.log2("size"))).cast("int")).withColumn("bin", F.when(free, F.floor((F.col("u") - F.col("part") + 1) * (BINS / 2))).cast("int"))

    hist = rated(basis).where("bin IS NOT NULL").groupBy("rank", "class", "bin").agg(F.sum("size").alias("size"), _sum(F.col("size") * F.col("part")).cast("double").alias("expected"))
    cuts = staged(hist.groupBy("rank").applyInPandas(_cuts, "rank long, class int, cut int"), "cuts")
    c = cuts.select(F.col("rank").alias("__rank"), F.col("class").alias("__class"), "cut")
    x = rated(rows)
    y = x.join(c, (x["rank"] == c["__rank"]) & (x["class"] == c["__class"]), "left")
    extra = F.when(F.col("bin") < F.col("cut"), 1).otherwise(0)
    return y.select(*[rows[k] for k in rows.columns], "source_size", "target", (F.col("whole") + extra).cast("long").alias("copies"))
