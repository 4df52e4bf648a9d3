"""LM scoring by compression cross-entropy.

Two Zstandard dictionaries are made, one of in-domain text and one of the general corpus: the words that save most
(count times length) in each, the best at the end, where they cost least to refer to. A text is compressed
under both; the score is the difference of the sizes over their sum, (general - domain) / (general +
domain): higher is closer to the domain, zero is neither.

Counts run over every word of every document. They are combined in each task before the shuffle, and only the
words that fill a dictionary (a fixed number of bytes) come to the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, row_wise, staged
from .text import buffers


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n long) over all texts."""

    def flush(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()
        for b in batches:
            data, offsets = buffers(b.column(0))
            for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                n.update(data[a:z].tobytes().split())
                if len(n) > 1_000_000:  # bounds a task's memory; the sums meet after the shuffle
                    yield flush(n)
                    n.clear()
        if n:
            yield flush(n)

    return texts.select(texts[text].alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(texts: DataFrame, text: str = "text", size: int = 112_640) -> bytes:
    """The words that save most (count times length, then by bytes), up to size bytes: least first. A word found once saves nothing, and one of under 3 bytes is no match to Zstandard.

    Long words are entries like others, so a language without blanks has its repeated runs.

    A histogram of savings gives a bound that lets through what fills the dictionary and little more; only these words come to the driver.
    """
    gain = F.col("n") * F.length("word")
    counts = staged(word_counts(texts, text).where((F.col("n") > 1) & (F.length("word") >= 3) & (F.length("word") < size)).withColumn("gain", gain), "words")
    steps = counts.groupBy(F.floor(F.log2("gain") * 16).alias("step")).agg(F.sum(F.length("word") + 1).alias("bytes")).collect()  # at most 16 for each power of two
    total, least = 0, 0
    for r in sorted(steps, key=lambda r: -r.step):
        total, least = total + r.bytes, r.step
        if total >= size:
            break
    best = counts.where(F.floor(F.log2("gain") * 16) >= least).select("word", "gain").collect()
    discard(counts)
    out, used = [], 0
    for r in sorted(best, key=lambda r: (-r.gain, bytes(r.word))):
        w = bytes(r.word) + b" "
        if used + len(w) > size:
            continue
        out.append(w)
        used += len(w)
    return b"".join(reversed(out)) or b" " * 8


def score(docs: DataFrame, domain: bytes, general: bytes, text: str = "text", keep: list[str] | None = None, level: int = 3) -> DataFrame:
    """The columns ``keep`` of every row (default: all but the text), with n_bytes, domain_bytes, general_bytes (compressed sizes) and score."""
    packers: list[zstandard.ZstdCompressor] = []  # two for each task

    def scored(texts: pa.Array) -> list[pa.Array]:
        if not packers:
            for content in (domain, general):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                packers.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        data, offsets = buffers(texts)
        raw = memoryview(data.tobytes())
        sizes = [[len(p.compress(raw[a:z])) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())] for p in packers]
        return [pa.array(offsets[1:] - offsets[:-1]), pa.array(sizes[0], pa.int64()), pa.array(sizes[1], pa.int64()), pa.array([(g - d) / (g + d) for d, g in zip(*sizes)], pa.float64())]

    return row_wise(docs, text, keep, "n_bytes long, domain_bytes long, general_bytes long, score double", scored)


def compression_score(docs: DataFrame, domain: DataFrame, text: str = "text", domain_text: str = "text", keep: list[str] | None = None, dict_bytes: int = 112_640, level: int = 3) -> DataFrame:
    """Scores every row of docs against the texts of the domain; the general dictionary is made of docs themselves.

    Null and empty texts have the same size under both: score 0. An empty domain leaves its dictionary blank; repeated
    rows are counted and scored one by one; an empty table gives an empty result. Columns named as a measure give way.
    """
    made = dictionary(domain, domain_text, dict_bytes), dictionary(docs, text, dict_bytes)
    return score(docs, *made, text=text, keep=keep, level=level)
