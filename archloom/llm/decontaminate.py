"""Benchmark decontamination by the q-gram lemma.

A text of n characters and a copy of it with at most k edits share at least n - q + 1 - k * q of their q-grams, on
diagonals (position in the document minus position in the item) that span at most k. Shared q-grams
are counted in bands of 2 (k + 1) diagonals that overlap by half, so every such copy lies in one band whole;
a band whose count reaches the bound is verified by an alignment confined to it. Nothing that meets the budget is missed.
Items so periodic that no q-gram of theirs tells a place are aligned with every stretch instead.

The items are compiled into arrays, a block of at most ``block_chars`` characters at a time; every
block is searched for in every document, one pass of the documents each, so a large benchmark costs passes, not memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

OUTPUT = "item_id {id}, start long, end long, edits int, item_chars int"
_B = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22
#: Places of one q-gram in an item above which it doesn't count; postings looked at in one go.
_OFTEN, _PAIRS = 32, 1 << 21


def _spaces() -> np.ndarray:
    table = np.zeros(0x3001, bool)
    table[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
    return table


_SPACE = _spaces()


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the text in lower case with runs of white space as one blank, none at the ends; and where each lay in the text."""
    low = text.lower()
    if len(low) != len(text):  # a few letters lower to two; those stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    x = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(x, 0x3000)] & (x <= 0x3000)
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[:1] = ~space[:1]
    at = np.flatnonzero(keep)
    if len(at) and space[at[-1]]:
        at = at[:-1]
    return np.where(space[at], np.uint32(32), x[at]), at


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, by doubling windows."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    window, size, out, done = x.astype(np.uint64) + np.uint64(1), 1, None, 0
    rest = q
    while rest:
        if rest & 1:
            if out is None:
                out, done = window, size
            else:
                n = len(x) - done - size + 1
                out = out[:n] * _power(size) + window[done : done + n]
                done += size
        rest >>= 1
        if rest:
            n = len(x) - 2 * size + 1
            window, size = window[:n] * _power(size) + window[size : size + n], 2 * size
    out = out[: len(x) - q + 1]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


@dataclass
class Part:
    """Postings of the q-grams of some items, all of one q and of lengths that are alike. bound: of each item (all of the block) the q-grams that a copy shares at least; reach: characters that a copy spans at most."""

    q: int
    gram: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    slots: np.ndarray
    bound: np.ndarray
    least: int
    reach: int


@dataclass
class Block:
    """Items compiled: their code points and budgets, postings of their q-grams, the items that must be whole words, and those too periodic for a bound."""

    ids: list
    chars: list[np.ndarray]
    budget: np.ndarray
    parts: list[Part]
    short: set[int]
    periodic: list[int]


def compile_block(items: list[tuple[object, str | None]], q: int, rate: float) -> Block | None:
    """Items of which q gives no positive bound are short: they get the largest q that does. Of a q-gram that an item has over _OFTEN times, none count, and the bound is less by these."""
    ids, chars, groups, short, periodic = [], [], {}, set(), []
    for ident, text in items:
        x, _ = normal(text or "")
        if not len(x):
            continue
        j, n, k = len(ids), len(x), int(rate * len(x))
        ids.append(ident)
        chars.append(x)
        own = q
        if n - q + 1 - k * q <= 0:
            short.add(j)
            own = max(1, min(q, n // (k + 1)))
        g = grams(x, own)
        _, which, count = np.unique(g, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[which] <= _OFTEN)
        bound = len(rare) - k * own
        if bound <= 0:
            periodic.append(j)
        else:
            groups.setdefault((own, n.bit_length() // 3), []).append((j, g[rare], rare.astype(np.int32), bound, n + k))
    if not ids:
        return None
    budget = np.array([int(rate * len(x)) for x in chars], np.int64)
    parts = []
    for (own, _), members in sorted(groups.items()):
        g = np.concatenate([m[1] for m in members])
        it = np.repeat(np.array([m[0] for m in members], np.int32), [len(m[1]) for m in members])
        p = np.concatenate([m[2] for m in members])
        order = np.argsort(g, kind="stable")
        uniq, first = np.unique(g[order], return_index=True)
        slots = np.zeros(1 << _SLOTS, bool)
        slots[(uniq >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True
        bound = np.full(len(ids), 1 << 40, np.int64)
        for m in members:
            bound[m[0]] = m[3]
        parts.append(Part(own, uniq, np.append(first, len(g)), it[order], p[order], slots, bound, min(m[3] for m in members), max(m[4] for m in members)))
    return Block(ids, chars, budget, parts, short, periodic)


def aligned(region: np.ndarray, item: np.ndarray, k: int, low: int, width: int) -> tuple[int, int, int] | None:
    """The item against a stretch of the region, on the diagonals low .. low + width - 1 (region position minus item position).

    Returns (edits, start, end) in the region for the fewest edits (the first such end), None if over k.
    Free ends in the region; row i holds cells for region ends i + low .. i + low + width - 1.
    """
    n, big = len(region), 1 << 20
    steps = np.arange(width + 1)
    # cell d of row i: i items used, region end e = i + low + d
    e = low + steps
    cost = np.where((e >= 0) & (e <= n), 0, big)
    begin = e.copy()
    for i in range(1, len(item) + 1):
        e = i + low + steps
        ok = (e >= 1) & (e <= n)
        same = np.zeros(width + 1, bool)
        same[ok] = region[e[ok] - 1] == item[i - 1]
        take = cost + np.where(same, 0, 1)  # from (i-1, e-1): same diagonal
        skip = np.append(cost[1:], big) + 1  # from (i-1, e): the item's character is missing
        new = np.minimum(take, skip)
        start = np.where(take <= skip, begin, np.append(begin[1:], 0))
        new[(e < 0) | (e > n)] = big
        new[e == 0] = min(i, big)
        start[e == 0] = 0
        # from (i, e-1): a character more in the region
        run = new - steps
        best = np.minimum.accumulate(run)
        if (best < run).any():
            at = np.maximum.accumulate(np.where(run == best, steps, -1))
            new, start = best + steps, start[at]
        cost, begin = new, start
        if cost.min() > k:
            return None
    d = int(np.argmin(cost))
    if cost[d] > k:
        return None
    return int(cost[d]), int(begin[d]), int(len(item) + low + d)


def _find(region: np.ndarray, item: np.ndarray) -> int:
    """Where the region has the item without edits, or -1."""
    raw, part, at = region.astype("<u4").tobytes(), item.astype("<u4").tobytes(), -1
    while (at := raw.find(part, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def _words(x: np.ndarray, first: int, last: int, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of all whole-word copies of a short item in x[first:last]."""
    flat, want = x[first:last].tobytes().decode("utf-32-le", "surrogatepass"), item.tobytes().decode("utf-32-le", "surrogatepass")
    before = x[first - 1 : first].tobytes().decode("utf-32-le", "surrogatepass")
    after = x[last : last + 1].tobytes().decode("utf-32-le", "surrogatepass")
    text = f"{before or ' '}{flat}{after or ' '}"
    edge = [not (text[i].isalnum() and text[i + 1].isalnum()) for i in range(len(flat) + 1)]
    out = []
    for a in range(len(flat)):
        if edge[a]:
            for z in range(max(a + 1, a + len(want) - k), min(len(flat), a + len(want) + k) + 1):
                if edge[z] and (e := _distance(flat[a:z], want)) <= k:
                    out.append((e, first + a, first + z))
    return out


def search(text: str | None, b: Block, q: int = 0) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, edits) of the copies in the whole text, at most one for each item and place; start and end count code points of the text."""
    if not text:
        return []
    x, at = normal(text)
    found: dict[tuple[int, int, int], int] = {}

    def add(j: int, edits: int, a: int, z: int) -> None:
        if z > a:
            key = (j, int(at[a]), int(at[z - 1]) + 1)
            found[key] = min(edits, found.get(key, edits))

    hashed: dict[int, np.ndarray] = {}
    for part in b.parts:
        if part.q not in hashed:
            hashed[part.q] = grams(x, part.q)
        g = hashed[part.q]
        hit = np.flatnonzero(part.slots[(g >> np.uint64(64 - _SLOTS)).astype(np.int64)])
        if len(hit) < part.least:
            continue
        which = np.minimum(np.searchsorted(part.gram, g[hit]), len(part.gram) - 1)
        true = part.gram[which] == g[hit]
        hit, which = hit[true], which[true]
        if len(hit) < part.least:
            continue
        bands: set[tuple[int, int]] = set()
        for i, z in _stretches(hit, part.first[which + 1] - part.first[which], part.reach):
            bands |= _bands(hit[i:z], which[i:z], part, b)
        for j, c in sorted(bands):
            k, step, m = int(b.budget[j]), int(b.budget[j]) + 1, len(b.chars[j])
            first = max(0, c * step - k)
            last = min(len(x), (c + 2) * step + m + k)
            if j in b.short:
                for e, a, z in _words(x, first, last, b.chars[j], k):
                    add(j, e, a, z)
                continue
            same = _find(x[first:last], b.chars[j])
            r = (0, same, same + m) if same >= 0 else aligned(x[first:last], b.chars[j], k, c * step - k - first, 2 * step + 2 * k)
            if r:
                add(j, r[0], first + r[1], first + r[2])
    for j in b.periodic:  # no bound: every stretch is aligned
        k, m = int(b.budget[j]), len(b.chars[j])
        for first in range(0, max(1, len(x) - m + k + 1), max(1024, m)):
            last = min(len(x), first + max(1024, m) + m + k)
            if r := aligned(x[first:last], b.chars[j], k, -k, last - first + 2 * k):
                add(j, r[0], first + r[1], first + r[2])
    best: dict[int, list[tuple[int, int, int]]] = {}
    for (j, a, z), e in sorted(found.items(), key=lambda f: (f[0][0], f[1], f[0][1], f[0][2])):  # of overlapping copies of one item, that with the fewest edits
        if not any(a < o[1] and o[0] < z for o in best.setdefault(j, [])):
            best[j].append((a, z, e))
    return sorted((j, *o) for j, mine in best.items() for o in mine)


def _stretches(hit: np.ndarray, postings: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Ranges of the hits, each of at most _PAIRS postings or 2 * reach characters, that overlap by reach: a copy's hits lie in one whole."""
    total = np.cumsum(postings)
    out, i = [], 0
    while True:
        done = total[i - 1] if i else 0
        z = max(int(np.searchsorted(total, done + _PAIRS, "right")), int(np.searchsorted(hit, hit[i] + 2 * reach)), i + 1)
        out.append((i, min(z, len(hit))))
        if z >= len(hit):
            return out
        i = max(i + 1, int(np.searchsorted(hit, hit[z - 1] - reach)))


def _bands(hit: np.ndarray, which: np.ndarray, part: Part, b: Block) -> set[tuple[int, int]]:
    """(item, first cell) of the bands whose shared q-grams reach the bound."""
    n = part.first[which + 1] - part.first[which]
    start = np.repeat(part.first[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    # An item without enough of its q-grams in all has none in a band. One that repeats in a band counts once.
    enough = np.bincount(part.item[np.unique(start)], minlength=len(b.ids)) >= part.bound
    sel = enough[part.item[start]]
    start = start[sel]
    if not len(start):
        return set()
    item, place = part.item[start].astype(np.int64), part.place[start].astype(np.int64)
    diagonal = np.repeat(hit, n)[sel] - place
    step = b.budget[item] + 1
    cell = np.floor_divide(diagonal, step)
    low, span, long = int(cell.min()), int(cell.max()) - int(cell.min()) + 3, int(place.max()) + 1
    once = np.unique((item * span + (cell - low)) * long + place)
    cells, counts = np.unique(once // long, return_counts=True)
    joined = np.zeros(len(cells), bool)
    joined[:-1] = cells[1:] == cells[:-1] + 1
    more = np.where(joined, np.append(counts[1:], 0), 0)
    has = np.append(False, joined[:-1])
    bands = {(int(c) // span, int(c) % span + low) for c, k in zip(cells, counts + more) if k >= part.bound[int(c) // span]}
    # A band that begins one cell before holds this cell too.
    return bands | {(int(c) // span, int(c) % span + low - 1) for c, k, h in zip(cells, counts, has) if not h and k >= part.bound[int(c) // span]}


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items, streamed to the driver and handed on in blocks of bounded size."""
    part, size = [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        part.append((r.i, r.t))
        size += len(r.t or "")
        if size >= block_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.08, block_chars: int = 4 << 20, keep: list[str] | None = None) -> DataFrame:
    """A row for each copy of a benchmark item in a document: the document's columns ``keep`` (doc_id), item_id, start, end, edits, item_chars.

    A copy is a stretch of the document within floor(rate * item's length) edits of the item, in lower case with white
    space collapsed; start and end are code points of the document's text. Items so short that the lemma gives no bound with q are searched with
    a smaller one, and count only as whole words. Null and empty texts, on either side, have no copies; documents without copies have no
    row; repeated rows are searched one by one; an empty benchmark or table gives an empty result.
    """
    keep = [c for c in (keep if keep is not None else [doc_id]) if c not in ("item_id", "start", "end", "edits", "item_chars")]
    kind = benchmark.schema[item_id].dataType.simpleString()
    source = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("t"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema.fields[:-1]) + OUTPUT.format(id=kind)
    result = None
    spark = docs.sparkSession
    for part in blocks(benchmark, item_id, item_text, block_chars):
        compiled = compile_block(part, q, rate)
        if compiled is None:
            continue
        shared = spark.sparkContext.broadcast(compiled)  # at most block_chars characters and their q-grams

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                rows, items = [], []
                for i, t in enumerate(batch.column(batch.num_columns - 1)):
                    for f in search(t.as_py(), b, q):
                        rows.append(i)
                        items.append(f)
                if rows:
                    kept = [c.take(pa.array(rows)) for c in batch.columns[:-1]]
                    j, a, z, e = zip(*items)
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([b.ids[x] for x in j]), pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(e, pa.int32()), pa.array([len(b.chars[x]) for x in j], pa.int32())], [*batch.schema.names[:-1], "item_id", "start", "end", "edits", "item_chars"])

        found = source.mapInArrow(run, kinds)
        result = found if result is None else result.union(found)
    if result is None:
        result = source.select(*[F.col(f"k{i}") for i in range(len(keep))], F.lit(None).cast(kind).alias("item_id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("int").alias("edits"), F.lit(None).cast("int").alias("item_chars")).where(F.lit(False))
    return result.toDF(*keep, "item_id", "start", "end", "edits", "item_chars")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.08, block_chars: int = 4 << 20) -> DataFrame:
    """The rows of docs without a copy of any item, with the columns they have. Null and empty texts stay."""
    out = docs
    for part in blocks(benchmark, item_id, item_text, block_chars):
        compiled = compile_block(part, q, rate)
        if compiled is None:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(compiled)
        out = out.where(_free(shared, q)(out[text]))
    return out


def _free(shared, q: int):
    @F.arrow_udf(BooleanType())
    def free(texts: pa.Array) -> pa.Array:
        return pa.array([not search(t.as_py(), shared.value, q) for t in texts], pa.bool_())

    return free
