"""Substring dedup by paragraph MinHash banding.

A paragraph is a window of ``length`` words that begins at a content-defined anchor: the word whose
hash is the least of some ``gap`` successive ones. Anchors depend on the text around them alone, so a passage
that is repeated in the midst of other text has the same paragraphs there: one of length + gap - 1 words
has a paragraph in common with each copy, and they cover all of it but at most gap - 1 words at each end.

1. One scan writes a table of all paragraphs: where each is, a 64-bit key of its words, and its bands of MinHash values of 3-word
   shingles. A task marks one or two rows of each key that tell whether it is in one document or in more; only these
   go on, so a passage that a third of all documents share is a row or two a task from there on.
2. Band after band, the marked rows are sorted by value and read as a stream. Equal paragraphs of different documents show
   up side by side (equal key and equal band: 128 bits). Paragraphs that share a value with one of another document are
   verified by exact Jaccard on their shingles, fetched again for these alone; a set of them that several bands bring up is verified once.
   A value of over ``block`` paragraphs is split exactly: two sets with Jaccard j share one of their rarest
   n - ceil(j * n) + 1 shingles (prefix filter), and what still shares one with over ``block`` others is verified block by block
   in separate tasks. Nothing is dropped, no group is gathered.
3. Linked paragraphs are clustered by connected components. The smallest document of a cluster keeps its
   text; the others lose it, and removed paragraphs that touch are one region.
4. At both ends of a run of such paragraphs the words beside it are compared with those beside the same paragraph in the first document
   that has it word for word, so that a passage shared with that document goes from its first word to its last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .graph import components
from .shared import discard, numbered, staged
from .text import Words, mix, ngrams, slices, words

SHINGLE = 3
#: Eight bands of two rows find a pair with Jaccard 0.7 with probability 0.995, one with 25 / 31 (one word of 30 changed) with 0.9997.
BANDS, ROWS = 8, 2
_REGIONS = StructType([StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())), StructField("n_removed", LongType())])
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_EQUAL, _FEW, _MANY = 0, 1, 2
#: Bytes of text looked at in one go: the arrays made of them stay in a core's cache.
_PIECE = 1 << 18


def anchors(w: Words, hashes: np.ndarray, length: int, gap: int) -> np.ndarray:
    """First words of the paragraphs, of all texts: the least hash of some gap successive starts (of all, if a text has fewer), where length words follow in the same text."""
    fits = len(hashes) - length + 1
    if fits <= 0:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(w.row[:fits] == w.row[length - 1 :])
    if not len(start):
        return start
    value = mix(hashes[start] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)
    row = w.row[start]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(np.append(first, len(start)))
    nth = np.repeat(np.arange(len(first)), count)
    chosen = (value == np.minimum.reduceat(value, first)[nth]) & (count[nth] < gap)
    at = start + (nth + 1) * gap  # texts lie at least gap apart, so no window meets two
    padded = np.full(int(at[-1]) + gap + 1, np.uint64(2**64 - 1))
    padded[at] = value
    there = np.zeros(len(padded) + 1, np.int32)
    there[at + 1] = 1
    there = np.cumsum(there, dtype=np.int32)
    low = _sliding(np.minimum, padded, gap)
    low[there[gap:] - there[:-gap] < gap] = 0  # only windows full of starts count
    chosen |= value == _sliding(np.maximum, low, gap)[at - gap + 1]
    # In a run of equal words each start would be an anchor: every gap-th stays, and the last.
    same = np.zeros(len(start), bool)
    same[:-1] = (value[1:] == value[:-1]) & (start[1:] == start[:-1] + 1)
    if same.any():
        order = np.arange(len(start))
        begin = np.ones(len(start), bool)
        begin[1:] = ~same[:-1]
        chosen &= ~same | ((order - np.maximum.accumulate(np.where(begin, order, 0))) % gap == 0)
    return start[chosen]


def _sliding(of: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """of over every n successive values, by doubling."""
    size = 1
    while size < n:
        step = min(size, n - size)
        x = of(x[: len(x) - step], x[step:])
        size += step
    return x


def sketches(shingles: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Of the windows of so many shingles: 128 bits, in two arrays, in which each shingle sets one. Two sets differ by at least as many shingles as their sketches do by bits."""
    if not len(at):
        return [np.zeros(0, np.uint64)] * 2
    h = mix(shingles)
    bit, half = np.uint64(1) << (h >> np.uint64(58)), h >> np.uint64(57) & np.uint64(1)
    return [_sliding(np.bitwise_or, bit * (half ^ np.uint64(1) if i else half), width)[at] for i in range(2)]


def paragraphs(texts: pa.Array, length: int, gap: int, bands: int = BANDS) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, anchors, keys, values of the first bands (bands x n), shingle hashes at every word). A band's value is the least 32 bits of either row; those of the first band are even, all others odd."""
    w = words(texts)
    hashes = w.hashes(lower=True)
    at = anchors(w, hashes, length, gap)
    shingles, _ = ngrams(hashes, w.row, SHINGLE)
    values = np.zeros((bands, len(at)), np.uint64)
    if not len(at):
        return w, at, np.zeros(0, np.uint64), values, shingles
    keys, _ = ngrams(hashes, w.row, length)
    for i in range(bands * ROWS):
        least = _sliding(np.minimum, (shingles * _SEEDS[i] >> np.uint64(32)).astype(np.uint32), length - SHINGLE + 1)[at]
        values[i // ROWS] = (values[i // ROWS] << np.uint64(32)) | least
    values &= ~np.uint64(1)
    values[1:] |= np.uint64(1)
    return w, at, keys[at], values, shingles


def _home(doc_id: Column) -> Column:
    """A document's number while paragraphs are compared."""
    return F.xxhash64(doc_id)


def _version(text: Column) -> Column:
    """Tells the texts of rows that share a doc_id apart."""
    return F.xxhash64(text)


def _leads(keys: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """Marks for each key one row, and one of another document if there is any."""
    order = np.lexsort((homes, keys))
    k, h = keys[order], homes[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    last = np.append(first[1:], True)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
    out = np.zeros(len(k), bool)
    out[order[first | (last & (h != h[begin]))]] = True
    return out


def _scan(docs: DataFrame, doc_id: str, text: str, length: int, gap: int, held: int = 1 << 18) -> DataFrame:
    """(doc_id, version long, pos int, key long, lead boolean, sketch_0 long, sketch_1 long, band_0 long, ...): a row a paragraph; pos counts words. held: paragraphs among which a task marks leads; the others have the first band alone."""
    source = docs.select(docs[doc_id].alias("doc_id"), _home(docs[doc_id]).alias("home"), _version(docs[text]).alias("version"), docs[text].alias("t"))
    names = ["doc_id", "version", "pos", "key", "lead", "sketch_0", "sketch_1", *[f"band_{b}" for b in range(BANDS)]]
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            docs_, homes, versions, pos, keys, bits, bands = zip(*parts)
            key, band = np.concatenate(keys), np.concatenate(bands, axis=1).view(np.int64)
            lead = _leads(key, pa.concat_arrays(homes).to_numpy())
            columns = [pa.concat_arrays(docs_), pa.concat_arrays(versions), pa.array(np.concatenate(pos)), pa.array(key), pa.array(lead), *[pa.array(np.concatenate([x[i] for x in bits]).view(np.int64), mask=~lead) for i in range(2)], pa.array(band[0]), *[pa.array(x, mask=~lead) for x in band[1:]]]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in slices(batches, "t", _PIECE):
            w, at, keys, bands, shingles = paragraphs(b.column(3), length, gap)
            if not len(at):
                continue
            row = w.row[at]
            take = pa.array(row)
            parts.append((b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), (at - w.first[row]).astype(np.int32), keys.view(np.int64), sketches(shingles, at, length - SHINGLE + 1), bands))
            n += len(at)
            if n >= held:
                yield flush()
                parts, n = [], 0
        if parts:
            yield flush()

    return source.mapInArrow(run, f"doc_id {kind}, version long, pos int, key long, lead boolean" + "".join(f", {x} long" for x in names[5:]))


def _partnered(begin: np.ndarray, size: np.ndarray, apart: np.ndarray, sketch: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """Of rows in runs (first rows, numbers of rows): which have another in their run, to be compared, with sketches that differ by at most so many bits."""
    out = np.zeros(len(apart), bool)
    for d in range(1, int(size.max(initial=1))):
        larger = size > d
        begin, size = begin[larger], size[larger]
        x = np.repeat(begin - np.concatenate([[0], np.cumsum(size - d)[:-1]]), size - d) + np.arange(int((size - d).sum()))
        near = (sum(np.bitwise_count(s[x] ^ s[x + d]) for s in sketch) <= most) & (apart[x] != apart[x + d])
        out[x[near]] = True
        out[x[near] + d] = True
    return out


def _partnered_of_many(apart: np.ndarray, sketch: tuple[np.ndarray, np.ndarray], most: int, cells: int = 1 << 18) -> np.ndarray:
    """What _partnered() says of the rows of one large run: neighbours in the order of sketches first, then those that have no partner yet against all, some ``cells`` pairs at a time."""
    out, order = np.zeros(len(apart), bool), np.lexsort(sketch[::-1])
    for d in range(1, min(17, len(apart))):
        x, y = order[:-d], order[d:]
        near = (sum(np.bitwise_count(s[x] ^ s[y]) for s in sketch) <= most) & (apart[x] != apart[y])
        out[x[near]] = True
        out[y[near]] = True
    left, step = np.flatnonzero(~out), max(1, cells // max(1, len(apart)))
    for a in range(0, len(left), step):
        x = left[a : a + step, None]
        near = sum(np.bitwise_count(s[x] ^ s) for s in sketch) <= most
        near &= apart[x] != apart
        out[left[a : a + step]] = near.any(axis=1)  # a partner that has none yet finds this row in its turn
    return out


def _runs(block: int, most: int, streak: int = 1 << 17):
    """Over rows (value, key, home, sketch_0, sketch_1) sorted by value: (kind, crowd, key, home, several).

    _EQUAL: the key is in several documents; crowd is the value of the first band. _FEW, _MANY: the key is one of up to
    block, or more, that share a value; crowd names them. There is a row for each key, and only those are left whose sketch differs
    from another's by at most so many bits: no others can be near. Of a run of over ``streak`` rows, all are handed on as _MANY, as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 5
        open_run: int | None = None  # value of a run that is handed on already

        def made(kind: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), *map(pa.array, columns)], ["kind", "crowd", "key", "home", "several"])

        def judged(v: np.ndarray, k: np.ndarray, h: np.ndarray, s: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(v):  # all of a batch is one run, which may go on
                return
            same = v[1:] == v[:-1]
            alone = np.append(True, ~same) & np.append(~same, True)
            if open_run is not None:
                alone &= v != open_run
            v, k, h, s, t = (x[~alone] for x in (v, k, h, s, t))  # mostly little is left
            if not len(v):
                return
            order = np.lexsort((k, v))
            v, k, h, s, t = (x[order] for x in (v, k, h, s.view(np.uint64), t.view(np.uint64)))
            new = np.append(True, v[1:] != v[:-1])
            fresh = new | np.append(True, k[1:] != k[:-1])
            each = np.flatnonzero(fresh)  # a row for each key of a run
            several = np.add.reduceat(np.append(False, ~fresh[1:] & (h[1:] != h[:-1])), each) > 0
            begin = np.flatnonzero(new[each])
            size = np.diff(np.append(begin, len(each)))
            handed = np.zeros(len(begin), bool) if open_run is None else v[each][begin] == open_run
            if handed.any():
                hot = np.repeat(np.repeat(handed, size), np.diff(np.append(each, len(v))))
                yield made(np.full(int(hot.sum()), _MANY), v[hot], k[hot], h[hot], np.zeros(int(hot.sum()), bool))
            v, k, h, s, t = (x[each] for x in (v, k, h, s, t))
            equal = several & ~np.repeat(handed, size) & (v & 1 == 0)
            apart, few = np.where(several, k, h), ~handed & (size <= block)
            sel = _partnered(begin[few], size[few], apart, (s, t), most)
            for i in np.flatnonzero(~handed & ~few):
                of = slice(begin[i], begin[i] + size[i])
                sel[of] = _partnered_of_many(apart[of], (s[of], t[of]), most)
            left = np.add.reduceat(sel, begin, dtype=np.int64)
            many = np.repeat(left > block, size)
            name = np.where(many, v, np.repeat(np.add.reduceat(np.where(sel, mix(k.view(np.uint64)), np.uint64(0)), begin), size).view(np.int64))
            if equal.any() or sel.any():
                columns = [np.concatenate([a[equal], c[sel]]) for a, c in ((v, name), (k, k), (h, h), (several, several))]
                yield made(np.concatenate([np.full(int(equal.sum()), _EQUAL), np.where(many[sel], _MANY, _FEW)]), *columns)

        for b in batches:
            if not b.num_rows:
                continue
            now = [np.concatenate([x, y.to_numpy()]) for x, y in zip(rest, b.columns)]
            to = int(np.searchsorted(now[0], now[0][-1]))
            yield from judged(*(x[:to] for x in now))
            rest = [x[to:] for x in now]
            if len(rest[0]) > streak:
                open_run = int(rest[0][0])
                yield from judged(*rest)
                rest = [x[:0] for x in rest]
        yield from judged(*rest)

    return run


def _crowds(table: DataFrame, block: int, most: int) -> list[DataFrame]:
    """Staged results of _runs(), band by band: the shuffle of one is gone before that of the next."""
    found = []
    for b in range(BANDS):
        rows = table.where("lead").select(F.col(f"band_{b}").alias("value"), "key", _home(F.col("doc_id")).alias("home"), "sketch_0", "sketch_1").repartition("value").sortWithinPartitions("value")
        found.append(staged(rows.mapInArrow(_runs(block, most), "kind tinyint, crowd long, key long, home long, several boolean"), "crowds"))
    return found


def _members(crowds: list[DataFrame], early: int = 0) -> DataFrame:
    """(kind, crowd, key, home, several, apart, late): a row for each paragraph of a crowd. several: it is in more than one document. apart tells what needn't be compared: paragraphs that only the same document has. late: the first ``early`` bands don't have it in this crowd."""
    rows = reduce(DataFrame.union, [c.withColumn("late", F.lit(i >= early)) for i, c in enumerate(crowds)]).where(F.col("kind") != _EQUAL)
    rows = rows.groupBy("kind", "crowd", "key").agg(F.min("home").alias("home"), F.max("home").alias("other"), F.max("several").alias("several"), F.min("late").alias("late"))
    several = F.col("several") | (F.col("home") != F.col("other"))
    return rows.select("kind", "crowd", "key", "home", several.alias("several"), F.when(several, F.col("key")).otherwise(F.col("home")).alias("apart"), "late")


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, length: int, gap: int) -> DataFrame:
    """wanted (home, keys array<long>) -> (key, band_0, shingles array<long>), from the documents that have them."""
    source = docs.select(_home(docs[doc_id]).alias("home"), docs[text].alias("t")).join(wanted, "home").select("t", "keys")
    width = length - SHINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", _PIECE):
            w, at, keys, bands, shingles = paragraphs(b.column(0), length, gap, 1)
            if not len(at):
                continue
            rows = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
            mine = lambda k, r: mix(k ^ mix(r.astype(np.uint64)))  # noqa: E731 - a key in a row; one too many does no harm
            sel = np.flatnonzero(np.isin(mine(keys, w.row[at]), mine(b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64), rows)))
            sel = sel[np.unique(keys[sel], return_index=True)[1]]
            if not len(sel):
                continue
            sets = np.sort(shingles[at[sel][:, None] + np.arange(width)].view(np.int64), axis=1)
            keep = np.ones(sets.shape, bool)
            keep[:, 1:] = sets[:, 1:] != sets[:, :-1]
            ends = np.append(0, np.cumsum(keep.sum(axis=1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys[sel].view(np.int64)), pa.array(bands[0][sel].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(sets[keep]))], ["key", "band_0", "shingles"])

    return source.mapInArrow(run, "key long, band_0 long, shingles array<long>").groupBy("key").agg(F.first("band_0").alias("band_0"), F.first("shingles").alias("shingles"))


def _near_pairs(first: np.ndarray, second: np.ndarray, sets: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows of sets (padded with numbers that no two rows share) have Jaccard >= least."""
    out = np.zeros(len(first), bool)
    for a in range(0, len(first), 2048):
        x, y = first[a : a + 2048], second[a : a + 2048]
        both = (sets[x][:, :, None] == sets[y][:, None, :]).sum(axis=(1, 2))
        out[a : a + 2048] = both >= least * (sizes[x] + sizes[y] - both)
    return out


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root (of each row the least row of its component) after rows x and y are joined."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def _marks(sets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """sketches() of sets of shingles."""
    h = mix(sets.view(np.uint64))
    bit, half = np.where(np.arange(sets.shape[1]) < sizes[:, None], np.uint64(1) << (h >> np.uint64(58)), np.uint64(0)), h >> np.uint64(57) & np.uint64(1)
    return [np.bitwise_or.reduce(bit * (half ^ np.uint64(1) if i else half), axis=1) for i in range(2)]


def _forest(begin: np.ndarray, size: np.ndarray, keys: np.ndarray, apart: np.ndarray, sides: np.ndarray, sets: np.ndarray, sizes: np.ndarray, least: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between the paragraphs of groups (first rows, numbers of rows), each of one or two blocks: of pairs with Jaccard >= least that aren't of one document alone, a star for each component.

    What is linked already isn't compared again, nor are pairs whose sketches rule it out. known: rows of a group that have it in common are linked from the start, and these links aren't returned.
    """
    rows = np.arange(len(keys))
    root = rows
    if known is not None:
        group = np.repeat(np.arange(len(begin)), size)
        order = np.lexsort((rows, known, group))
        new = np.append(True, (group[order][1:] != group[order][:-1]) | (known[order][1:] != known[order][:-1]))[: len(rows)]
        root = np.zeros(len(rows), np.int64)
        root[order] = order[np.maximum.accumulate(np.where(new, rows, 0))]
    were, root, marks = root, root.copy(), _marks(sets, sizes)
    for d in range(1, int(size.max(initial=1))):
        larger = size > d
        begin, size = begin[larger], size[larger]
        n = size - d
        x = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        x = x[root[x] != root[x + d]]
        y = x + d
        ask = (keys[x] != keys[y]) & (apart[x] != apart[y]) & ((sides[x] != sides[y]) | (sides[x] == 0))
        ask &= sum(np.bitwise_count(m[x] ^ m[y]) for m in marks) <= (sizes[x] + sizes[y]) * ((1 - least) / (1 + least)) + 1e-9
        x, y = x[ask], y[ask]
        near = _near_pairs(x, y, sets, sizes, least)
        root = _joined(root, x[near], y[near])
    linked = (root != rows) & (were == rows)
    return keys[linked], keys[root[linked]]


def _verify(least: float):
    """Over rows (crowd, a, b, key, apart, root, side, shingles) sorted by (crowd, a, b): the links of each such group. A group is at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None

        def judged(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            c, x, y, keys, apart, roots, sides = (b.column(i).to_numpy() for i in range(7))
            n = pc.list_value_length(b.column(7)).to_numpy(zero_copy_only=False).astype(np.int64)
            width = int(n.max(initial=1))
            sets = np.arange(len(n) * width, dtype=np.int64).reshape(len(n), width)  # no hash, or one in 2**40
            sets[np.arange(width) < n[:, None]] = b.column(7).flatten().to_numpy()
            begin = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            u, v = _forest(begin, np.diff(np.append(begin, len(c))), keys, apart, sides, sets, n, least, roots)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.RecordBatch.from_arrays([pa.concat_arrays([p, q]) for p, q in zip(rest.columns, b.columns)], b.schema.names)
            last = [b.column(i).to_numpy() for i in range(3)]
            to = int(np.flatnonzero(np.append(True, np.logical_or.reduce([z[1:] != z[:-1] for z in last])))[-1])  # the last group may go on
            if to:
                yield from judged(b.slice(0, to))
            rest = b.slice(to)
        if rest is not None:
            yield from judged(rest)

    return run


def _prefixes(many: DataFrame, least: float) -> DataFrame:
    """many (key, shingles), a row a key -> (crowd, key): crowds of those that share a rare shingle, among them each pair with Jaccard >= least.

    Two sets of n >= m shingles with Jaccard >= least have at least t = least / (1 + least) * (n + m) in common, so the n - t + 1 rarest
    of the one and the m - t + 1 rarest of the other share one. Of the smaller (or of two of a size) these are among the first
    m - 2 * least / (1 + least) * m + 1; of the larger, among the first n - least * n + 1, but rows past the former number only count as far as the smallest set they meet allows.
    """
    each = many.select("key", F.explode("shingles").alias("s"))
    rare = each.join(each.groupBy("s").agg(F.count("*").alias("m")), "s").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("m", "s"))).alias("all"))  # of one paragraph
    first = lambda share: (F.size("all") - F.ceil(F.size("all") * share - 1e-9) + 1).cast("int")
    # Shingles of one paragraph alone meet nothing.
    found = rare.select("key", F.size("all").alias("n"), first(2 * least / (1 + least)).alias("own"), F.posexplode(F.slice("all", F.lit(1), first(least))).alias("i", "p")).where("p.m > 1")
    found = found.select("key", "n", "i", (F.col("i") < F.col("own")).alias("own"), F.col("p.s").alias("crowd"))
    low = found.where("own").groupBy("crowd").agg(F.min("n").alias("low"))
    reached = F.col("i") <= F.col("n") - F.ceil((F.col("n") + F.col("low")) * (least / (1 + least)) - 1e-9)
    return found.join(low, "crowd").where(F.col("own") | reached).select("crowd", "key")


def _links(members: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """members (kind, crowd, key, apart, root), sets (key, shingles) -> (u, v): links that, with those between each key and its root, have the components of all pairs of a crowd with Jaccard >= least."""
    sets, one = sets.select("key", "shingles"), F.lit(0)
    names = ["crowd", "a", "b", "key", "apart", "root", "side"]
    asked = members.where(F.col("kind") == _FEW).select("crowd", one.alias("a"), one.alias("b"), "key", "apart", "root", one.alias("side"))
    many = members.where(F.col("kind") == _MANY)
    if not many.isEmpty():
        # A paragraph that several bands have in a crowd is looked at once.
        many = staged(many.groupBy("key").agg(F.min("apart").alias("apart"), F.min("root").alias("root")), "many")
        parted = staged(_prefixes(many.join(sets, "key"), least).join(many, "key"), "parted")
        sizes = parted.groupBy("crowd").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("crowd", "n")
        # Block i meets every block j: as the smaller or the larger of the two.
        parts = F.ceil(F.col("n") / block).cast("int")
        mine = F.pmod(F.xxhash64("key"), parts).cast("int")
        spread = parted.join(sizes, "crowd").select("crowd", "key", "apart", "root", mine.alias("i"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("j"))
        spread = spread.select("crowd", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "key", "apart", "root", F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"))
        asked = asked.union(spread)
    return asked.join(sets, "key").select(*names, "shingles").repartition("crowd", "a", "b").sortWithinPartitions("crowd", "a", "b").mapInArrow(_verify(least), "u long, v long")


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 30, gap: int = 21, jaccard: float = 0.7, block: int = 256) -> DataFrame:
    """(doc_id, version, start, stop, first_doc): stretches of words (start .. stop - 1) that another document has too, exactly or nearly; they overlap.

    Equal and near paragraphs (a chain of Jaccard >= jaccard) are found at the same anchors. first_doc is the smallest doc_id of all that are linked: that one keeps its text. Rows that repeat a
    doc_id are one document; version, a hash of the text, tells unlike texts of one apart. Null doc_ids are left out: nothing could name what to remove. What repeats within one document alone is none of this operator's.
    """
    docs = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).where("doc_id IS NOT NULL")
    table = staged(_scan(docs, "doc_id", "text", length, gap), "paragraphs")
    most = int(2 * (length - SHINGLE + 1) * (1 - jaccard) / (1 + jaccard) + 1e-9)  # shingles that two sets may differ by
    crowds = _crowds(table, block, most)
    places = staged(table.select("doc_id", "version", "pos", "key", "band_0"), "places")
    discard(table)
    hot = _members(crowds[:1]).where((F.col("kind") == _MANY) & F.col("several"))
    equal = crowds[0].where(F.col("kind") == _EQUAL).select("crowd", "key").union(hot.select("crowd", "key")).select("key", F.col("crowd").alias("band_0"), F.lit(None).cast("long").alias("root")).distinct()
    members = staged(_members(crowds, 2).drop("several"), "members")
    for done in crowds[1:]:  # the first names the equal ones
        discard(done)
    wanted = members.groupBy("key").agg(F.min("home").alias("home")).groupBy("home").agg(F.collect_list("key").alias("keys"))  # of one document: bounded by its length
    sets = staged(_sets(docs, wanted, "doc_id", "text", length, gap), "shingle-sets")
    few = F.col("kind") == _FEW
    links = staged(_links(members.where(few & ~F.col("late")).withColumn("root", F.col("key")), sets, jaccard, block), "links")
    known = components(links, "paragraph-clusters").select(F.col("node").alias("key"), "root")
    # Crowds that the first bands have linked whole needn't be verified again.
    rooted = members.where(~few | F.col("late")).join(known, "key", "left").withColumn("root", F.coalesce("root", "key"))
    apart = rooted.groupBy("kind", "crowd").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("kind", "crowd")
    left = staged(rooted.join(apart, ["kind", "crowd"], "left_semi").select("kind", "crowd", "key", "apart", "root"), "members")
    discard(members)
    links = staged(_links(left, sets, jaccard, block), "links")
    named = staged(sets.select("key", "band_0"), "named")
    for done in (left, sets):
        discard(done)
    known = components(links.union(known), "paragraph-clusters").select(F.col("node").alias("key"), "root")
    near = named.join(known, "key").select("key", "band_0", "root")
    some = equal.union(near).groupBy("key", "band_0").agg(F.max("root").alias("root"))
    placed = places.join(some, ["key", "band_0"]).withColumn("root", F.coalesce("root", F.xxhash64("key", "band_0")))
    placed = staged(placed, "placed")
    for done in (places, crowds[0]):
        discard(done)
    first = placed.groupBy("root").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("most")).where("first_doc <> most").select("root", "first_doc")
    found = staged(placed.join(first, "root").select("doc_id", "version", "pos", "key", "band_0", "first_doc"), "found")
    discard(placed)
    windows = found.select("doc_id", "version", F.col("pos").alias("start"), (F.col("pos") + length).alias("stop"), "first_doc")
    return windows.union(_extended(docs, found, length, gap))


def _extended(docs: DataFrame, found: DataFrame, length: int, gap: int) -> DataFrame:
    """(doc_id, version, start, stop, first_doc): of the paragraphs a document loses that an earlier one has word for word, the outermost of each run, with the up to gap - 1 words at either side that stand beside it there too."""
    holders = found.groupBy("key", "band_0").agg(F.min(F.struct("doc_id", "version", "pos")).alias("at"), F.max("doc_id").alias("most")).where("at.doc_id <> most").select("key", "band_0", F.col("at.doc_id").alias("doc2"), F.col("at.version").alias("version2"), F.col("at.pos").alias("pos2"))
    lost = found.where("doc_id <> first_doc").join(holders, ["key", "band_0"]).where("doc_id <> doc2")
    of = Window.partitionBy("doc_id", "version").orderBy("pos")  # of one document
    lost = lost.withColumn("before", F.lag("pos").over(of)).withColumn("after", F.lead("pos").over(of))
    outer = lost.withColumn("left", F.col("before").isNull() | (F.col("before") + length < F.col("pos"))).withColumn("right", F.col("after").isNull() | (F.col("pos") + length < F.col("after")))
    edges = staged(outer.where("left OR right").drop("before", "after", "key", "band_0"), "edges")
    asked = edges.select("doc_id", "version", "pos").union(edges.select("doc2", "version2", "pos2"))
    beside = staged(_beside(docs, asked, length, gap - 1), "beside")
    theirs = beside.select(F.col("doc_id").alias("doc2"), F.col("version").alias("version2"), F.col("pos").alias("pos2"), F.col("front").alias("front2"), F.col("back").alias("back2"))
    both = edges.join(beside, ["doc_id", "version", "pos"]).join(theirs, ["doc2", "version2", "pos2"])
    shared = lambda a, b: F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()), F.lit(False)) - 1, F.lit(0)).cast("int")
    # Both arrays end in a null, so there is a first place where they part.
    n, m = F.when(F.col("left"), shared(F.col("front"), F.col("front2"))).otherwise(0), F.when(F.col("right"), shared(F.col("back"), F.col("back2"))).otherwise(0)
    return both.select("doc_id", "version", (F.col("pos") - n).alias("start"), (F.col("pos") + length + m).alias("stop"), "first_doc")


def _beside(docs: DataFrame, asked: DataFrame, length: int, most: int) -> DataFrame:
    """asked (doc_id, version, pos) -> the same, once each, with front and back: hashes of up to ``most`` words before and behind the paragraph there, the nearest first, and a null at the end."""
    places = asked.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("at"))  # of one document: bounded by its length
    source = docs.select("doc_id", F.col("text").alias("t"), _version(F.col("text")).alias("version")).join(places, ["doc_id", "version"]).select("doc_id", "version", "t", "at")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", _PIECE):
            w = words(b.column(2))
            hashes = np.append(w.hashes(lower=True).view(np.int64), 0)
            pos = b.column(3).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False))
            sides, steps = [], np.arange(most + 1)
            for start, sign, least, end in ((w.first[row] + pos - 1, -1, w.first[row], w.first[row + 1]), (w.first[row] + pos + length, 1, w.first[row], w.first[row + 1])):
                at = start[:, None] + sign * steps
                there = (at >= least[:, None]) & (at < end[:, None]) & (steps < most)
                size = there.sum(axis=1) + 1  # and a null
                flat = np.concatenate([hashes[np.where(there, at, len(hashes) - 1)], np.zeros((len(pos), 1), np.int64)], axis=1)
                used = np.arange(most + 2) < size[:, None]
                null = np.arange(most + 2) == (size - 1)[:, None]
                sides.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat[used], mask=null[used])))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(pos, pa.int32()), *sides], ["doc_id", "version", "pos", "front", "back"])

    found = source.mapInArrow(run, f"doc_id {kind}, version long, pos int, front array<long>, back array<long>")
    return found.groupBy("doc_id", "version", "pos").agg(F.first("front").alias("front"), F.first("back").alias("back"))  # repeated rows


def regions(found: DataFrame) -> DataFrame:
    """Per text of a document: doc_id, version, first_docs (who keeps what it loses), starts, ends (regions to remove: words start .. end - 1), n_removed (words).

    Documents that keep all their repeated paragraphs have empty arrays.
    """
    lost = F.col("doc_id") != F.col("first_doc")
    each = found.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.when(lost, F.struct("start", "stop")))).alias("at"), F.sort_array(F.collect_set(F.when(lost, F.col("first_doc")))).alias("first_docs"))  # of one document: bounded by its length

    @F.arrow_udf(_REGIONS)
    def merged(places: pa.Array) -> pa.Array:
        out = []
        for at in places.to_pylist():
            starts, ends = [], []
            for p in at:
                if ends and p["start"] <= ends[-1]:
                    ends[-1] = max(ends[-1], p["stop"])
                else:
                    starts.append(p["start"])
                    ends.append(p["stop"])
            out.append({"starts": starts, "ends": ends, "n_removed": sum(ends) - sum(starts)})
        return pa.array(out, pa.struct([("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("n_removed", pa.int64())]))

    return each.select("doc_id", "version", "first_docs", merged("at").alias("r")).select("doc_id", "version", "first_docs", "r.starts", "r.ends", "r.n_removed")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """One row a document (a row each of its texts, if they are unlike) with a passage that another document has too: doc_id, first_docs, starts, ends, n_removed (see regions(); how: see occurrences()).

    Documents without one, among them all with fewer than ``length`` words, null and empty ones, have no
    row. An empty table gives an empty result; other columns are ignored.
    """
    return regions(occurrences(docs, doc_id, text, **how)).drop("version")


def cut(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without words start .. end - 1 and the blanks after them; all else stays as it is."""
    w = words(pa.array([text]))
    raw, out, at = w.data.tobytes(), [], 0
    for s, e in zip(starts, ends):
        out.append(raw[at : w.start[s]])
        at = int(w.start[e]) if e < len(w.start) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: str | None = None, **how: float) -> DataFrame:
    """docs without the repeated passages, but for the first document of each; all rows and columns stay, whatever their names. count names a column that holds a text's characters, if there is one.

    Null and empty texts, and rows with a null doc_id, stay as they are; repeated rows all lose the same; an empty table gives an empty result; how: see occurrences().
    """
    gone = regions(occurrences(docs, doc_id, text, **how)).where("n_removed > 0").select(F.col("doc_id").alias("id"), "version", "starts", "ends")
    rows, names = numbered(docs)
    t = names[text]
    joined = rows.join(gone, (rows[names[doc_id]] == gone["id"]) & (_version(rows[t]) == gone["version"]), "left")

    @F.arrow_udf(StringType())
    def without(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([t if t is None or s is None else cut(t, s, e) for t, s, e in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist())], pa.string())

    made = joined.withColumn("new", without(t, "starts", "ends"))
    if count in names:
        c = names[count]
        made = made.withColumn("chars", F.when(F.col("starts").isNotNull(), F.length("new").cast(rows.schema[c].dataType)).otherwise(F.col(c)))
    return made.select(*["new" if n == text else "chars" if n == count else c for n, c in names.items()]).toDF(*docs.columns)
