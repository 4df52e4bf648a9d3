"""Operators that compare texts: 3, 9 and 10."""

import random
from collections import defaultdict

import pyarrow as pa
import xxhash

from archloom.llm import decontaminate, graph, passages, simhash
from archloom.llm.text import words

from .helpers import awkward, documents, lower, prose, split


def brute_fingerprint(text):
    w = split(lower(text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_links(prints):
    near, root = [0] * len(prints), list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                near[i] += 1
                near[j] += 1
                root[find(i)] = find(j)
    return near, [find(i) for i in range(len(prints))]


def test_near_duplicates(spark):
    rows = awkward()
    prints = [brute_fingerprint(t) for _, t in rows]
    near, groups = brute_links(prints)
    least = defaultdict(list)
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g].append(i)
    want = sorted((str(i), f"{p:016x}", n, str(min(least[g], default=None))) for (i, _), p, n, g in zip(rows, prints, near, groups))
    for hot in (1024, 1):  # 1: all buckets that aren't single go the hot way
        got = simhash.near_duplicates(documents(spark, rows), hot_bucket=hot).collect()
        assert sorted((str(r.doc_id), r.fingerprint, r.n_near, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_by_bits(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for x in base:
        for _ in range(25):
            y = x
            for _ in range(rng.randrange(1, 4)):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    want = sorted((signed(x), signed(y)) for x in prints for y in prints if x != y and (x ^ y).bit_count() <= 2)
    for hot in (1024, 3):
        assert sorted(map(tuple, simhash.links(fps, hot).collect())) == want


def test_keep_one(spark):
    rows = awkward()
    docs = documents(spark, rows)
    got = simhash.keep_one(docs).collect()
    _, groups = brute_links([brute_fingerprint(t) for _, t in rows])
    members = defaultdict(list)
    for (i, _), g in zip(rows, groups):
        members[g].append(i)
    want = sorted(str(min([i for i in m if i is not None], default=None)) for m in members.values())
    assert sorted(str(r.doc_id) for r in got) == want and got[0].asDict().keys() == set(docs.columns)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    loops = {a for a, b in edges} - {x for a, b in edges if a != b for x in (a, b)}
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for x in root if x not in loops}


def distance(region, item):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, r in enumerate(region, 1):
            new.append(min(row[j - 1] + (c != r), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits, letters):
    t = list(text)
    for _ in range(edits):
        p, kind = rng.randrange(len(t)), rng.random()
        if kind < 0.4:
            t[p] = rng.choice(letters)
        elif kind < 0.7:
            t.insert(p, rng.choice(letters))
        elif len(t) > 1:
            del t[p]
    return "".join(t)


def test_qgram_search_misses_nothing():
    rng, letters = random.Random(5), "abcdefg hij"
    for _ in range(150):
        item = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(8, 110))).split())
        k = int(0.08 * len(item))
        noise = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(150)))
        doc = noise() + edited(rng, item, rng.randrange(k + 4), letters) + noise()
        block = decontaminate.compile_block([(7, item)], 8, 0.08)
        found = decontaminate.search(doc, block)
        flat = bytes_of(decontaminate.normal(doc)[0])
        d = distance(flat, item)
        if block.short:
            d = min((distance_whole(flat[a:z], item) for a, z in word_stretches(flat, len(item), k)), default=k + 1)
        assert bool(found) == (d <= k), (item, doc)
        for _, a, z, e in found:
            assert e >= d and 0 <= a < z <= len(doc)


def word_stretches(text, n, k):
    edge = [not (t[0].isalnum() and t[1].isalnum()) for t in zip(" " + text, text + " ")]
    return [(a, z) for a in range(len(text)) for z in range(a + 1, len(text) + 1) if edge[a] and edge[z] and abs(z - a - n) <= k]


def distance_whole(x, y):
    """Of all of x."""
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        new = [i]
        for j, r in enumerate(y, 1):
            new.append(min(row[j - 1] + (c != r), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_short_items_are_whole_words_within_their_budget():
    block = decontaminate.compile_block([(1, "art"), (3, "a silver spoon")], 8, 0.08)
    got = lambda t: [block.ids[f[0]] for f in decontaminate.search(t, block)]
    assert got("a party began") == [] and got("the art began") == [1] and got("Art") == [1]
    assert got("lost a silver spoon") == got("lost a silvr spoon") == got("lost a silver spoons") == [3] and got("lost a silvr spon") == []


def test_periodic_text_takes_bounded_memory():
    import resource

    items = [(1, "ab" * 150), (2, "the cat sat on the mat and ate " * 8)]
    block = decontaminate.compile_block(items, 8, 0.08)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = "ab" * 100_000 + " " + "the cat sat on the mat and ate " * 2000
    assert {block.ids[f[0]] for f in decontaminate.search(text, block)} == {1, 2}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB
    assert decontaminate.search("ab" * 100, block) == []


def bytes_of(x):
    return x.astype("<u4").tobytes().decode("utf-32-le")


def test_contaminated(spark):
    rng = random.Random(6)
    items = [(1, prose(rng, 30)), (2, prose(rng, 12)), (3, "Caf\u00e9 \u0130stanbul " + prose(rng, 20)), (4, None), (5, ""), (6, "tiny"), (7, prose(rng, 400))]
    text = dict(items)
    rows = awkward(2, 15) + [(300, prose(rng, 40) + " " + text[1].upper().replace(" ", " \n ") + prose(rng, 10)), (301, text[2]), (302, "x " + edited(rng, text[7], 40, "abc") + " y"), (303, text[3] + " and again " + text[3]), (304, text[1][: len(text[1]) // 2]), (300, text[2])]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, start string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.contaminated(documents(spark, rows), bench).collect())
    assert [(x[0], x[1]) for x in got] == [(300, 1), (300, 2), (301, 2), (302, 7), (303, 3), (303, 3)]
    assert {x[4] for x in got if x[0] != 302} == {0}
    assert got == sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.contaminated(documents(spark, rows), bench, block_chars=50).collect())
    clean = [r.doc_id for r in decontaminate.clean(documents(spark, rows), bench).collect()]
    assert sorted(map(str, clean)) == sorted(str(i) for i, _ in rows if i not in (300, 301, 302, 303))
    assert decontaminate.contaminated(documents(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0


def test_anchors_depend_on_the_text_alone():
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (10, 29, 30, 31, 45, 50, 51, 300, 5)] + ["same " * 200, "", prose(rng, 80)]
    together = pa.array(texts)

    def of(arr):
        w = words(arr)
        at = passages.anchors(w, w.hashes(True), 30, 21)
        return [sorted((at[w.row[at] == r] - w.first[r]).tolist()) for r in range(len(arr))]

    assert of(together) == [of(pa.array([t]))[0] for t in texts] == [of(together.slice(i, 1))[0] for i in range(len(texts))]
    for t, at in zip(texts, of(together)):
        starts = len(split(t)) - 29
        assert all(any(a <= p < a + 21 for p in at) for a in range(0, starts - 20)) and (starts <= 0) == (not at)


def test_repeated_passages(spark):
    rng = random.Random(9)
    passage, other = prose(rng, 55), prose(rng, 90)
    near = other.split()
    near[45] = "changed"
    rows = awkward(3, 10) + [(i, prose(rng, rng.randrange(0, 80)) + " " + passage + "\n" + prose(rng, rng.randrange(0, 80))) for i in range(400, 440)] + [(450, other), (451, " ".join(near)), (452, passage.upper()), (453, prose(rng, 40) + " " + " ".join(passage.split()[:25])), (454, prose(rng, 60) * 2)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert set(range(400, 440)) | {450, 451, 452} <= set(got) and not set(got) & {100, 101, 102, 103, 104, 105, 453, 454, 5, 6, 7, 8, 9}
    assert got[400].n_removed == 0 and got[400].starts == [] and got[450].n_removed == 0
    assert all(got[i].n_removed >= 30 and 400 in got[i].first_docs and max(got[i].first_docs) < i for i in [*range(401, 440), 452])
    assert got[111].first_docs == [0] and got[112].first_docs == [1]
    out = {(r.doc_id, r.text): r for r in passages.remove_repeats(docs, count="n_chars").collect()}
    assert sum(1 for _ in out) <= len(rows)
    texts = {i: t for i, t in out}
    assert passage in texts[400] and not any(passage in texts[i] for i in range(401, 440))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.values())
    assert texts[100] is None and texts[454] == dict(rows)[454]
    assert passages.repeated_passages(documents(spark, [])).count() == 0


def test_near_paragraphs_in_blocks(spark):
    rng = random.Random(10)
    base = prose(rng, 30).split()
    rows = []
    for i in range(40):  # each differs from the first in one word of its own: all linked by it
        w = list(base)
        if i:
            w[i % 28 + 1] = f"z{i}"
        rows.append((i, " ".join(w)))
    docs = documents(spark, rows)
    for block in (256, 5):
        got = {r.doc_id: r.first_docs for r in passages.repeated_passages(docs, block=block).collect()}
        assert len(got) >= 36 and all(f == [0] for i, f in got.items() if i)


def test_cut():
    t = "\u00e9 one  two\nthree four "
    assert passages.cut(t, [1], [3]) == "\u00e9 three four " and passages.cut(t, [0], [5]) == "" and passages.cut(t, [4], [5]) == "\u00e9 one  two\nthree "


def recall_of_edited_passages(spark, seed, n=250):
    """Share of the passages of 50 to 90 words with two changed words, in the midst of unlike text, of which the later copy loses words."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        passage = prose(rng, rng.randrange(50, 91), 50_000).split()
        other = list(passage)
        for at in rng.sample(range(len(other)), 2):
            other[at] = f"changed{i}"
        rows += [(2 * i + k, " ".join([prose(rng, 80, 50_000), *p, prose(rng, 80, 50_000)])) for k, p in enumerate((passage, other))]
    got = {r.doc_id for r in passages.repeated_passages(documents(spark, rows)).collect() if r.n_removed}
    assert all(i % 2 for i in got)
    return len(got) / n


def test_recall_of_short_edited_passages(spark):
    assert recall_of_edited_passages(spark, 12) >= 0.9


def test_bands_find_pairs_at_the_threshold():
    rng, hit, n = random.Random(14), 0, 400
    for i in range(n):
        a = [f"w{rng.randrange(100_000)}" for _ in range(30)]
        b = list(a)
        b[-5:] = [f"z{i}{j}" for j in range(5)]  # 23 of 33 shingles in common: Jaccard 0.697
        bands = [passages.paragraphs(pa.array([" ".join(x)]), 30, 21)[3] for x in (a, b)]
        hit += bool((bands[0] == bands[1]).any())
    assert hit >= 0.97 * n


def test_whole_passages_go(spark):
    rng, rows, sizes = random.Random(15), [], [51, 51, 55, 60, 60, 80, 150, 400]
    for i, n in enumerate(sizes):
        passage = " ".join(f"p{i}.{j}" for j in range(n))
        rows += [(2 * i + k, f"{prose(rng, 70, 50_000)} {passage} {prose(rng, 70, 50_000)}") for k in (0, 1)]
    got = {r.doc_id: r.text for r in passages.remove_repeats(documents(spark, rows)).collect()}
    for i, n in enumerate(sizes):
        assert got[2 * i] == rows[2 * i][1]
        rest = split(got[2 * i + 1])
        # A window that is near because it begins or ends in up to four other words takes them along.
        assert not [w for w in rest if w.startswith("p")] and len(rest) >= 140 - 8


def test_unlike_texts_of_one_document(spark):
    rng = random.Random(16)
    passage, short, long = prose(rng, 60), "only a few words", prose(rng, 200, 50_000)
    rows = [(1, passage), (2, prose(rng, 50, 50_000) + " " + passage), (2, short), (2, long)]
    got = [(r.doc_id, r.text) for r in passages.remove_repeats(documents(spark, rows)).collect()]
    assert len(got) == 4 and {(1, passage), (2, short), (2, long)} <= set(got) and not any(passage in t for i, t in got if i == 2)


def test_forest_against_all_pairs():
    """Components of the links against those of all pairs by exact Jaccard, for groups of one and of two blocks."""
    import numpy as np

    rng = random.Random(17)
    for _ in range(60):
        begin, rows = [], []
        for _ in range(rng.randrange(1, 5)):
            begin.append(len(rows))
            base = [rng.sample(range(1000), 12) for _ in range(2)]
            two = rng.random() < 0.5
            for _ in range(rng.randrange(1, 14)):
                s = list(rng.choice(base))
                for _ in range(rng.randrange(4)):
                    s[rng.randrange(12)] = rng.randrange(1000)
                rows.append((len(rows) + 5000, rng.randrange(4), rng.choice([1, 2]) if two else 0, sorted(set(s)), len(begin)))
        keys, apart, sides = (np.array([r[i] for r in rows]) for i in range(3))
        sizes = np.array([len(r[3]) for r in rows])
        sets = np.array([r[3] + [-1 - 20 * i - j for j in range(12 - len(r[3]))] for i, r in enumerate(rows)])
        root = list(range(len(rows)))

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for i, p in enumerate(rows):
            for j, q in enumerate(rows[:i]):
                if p[4] == q[4] and p[1] != q[1] and (p[2] != q[2] or not p[2]) and len(set(p[3]) & set(q[3])) >= 0.7 * len(set(p[3]) | set(q[3])):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        u, v = passages._forest(np.array(begin), np.diff([*begin, len(rows)]), keys, apart, sides, sets, sizes, 0.7)
        assert dict(zip((u - 5000).tolist(), (v - 5000).tolist())) == {i: find(i) for i in range(len(rows)) if find(i) != i}


def test_one_value_fills_whole_batches():
    """A band value of more rows than a batch has: its run goes on over batches of nothing else, and is judged once or, beyond the streak, as it comes."""
    import numpy as np

    value = np.repeat([2, 12, 20], [1, 1000, 1])
    columns = [value, np.arange(1002), np.arange(1002) % 900, np.full(1002, 7), np.full(1002, 7)]
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["value", "key", "home", "s", "t"])
    for start, streak in ((0, 1 << 17), (1, 1 << 17), (0, 150), (1, 150)):
        batches = [whole.slice(i, min(100, 1002 - i)) for i in range(start, 1002, 100)]
        got = [r for b in passages._runs(256, 9, streak)(iter(batches)) for r in b.to_pylist()]
        assert {(r["kind"], r["crowd"]) for r in got} == {(passages._MANY, 12)} and sorted(r["key"] for r in got) == list(range(1, 1001))
    assert not list(passages._runs(256, 9)(iter([])))


def test_links_that_are_known_are_not_returned():
    import numpy as np

    base = list(range(100, 128))
    sets = np.array([sorted([*base[i:], *range(1000 + 50 * i, 1000 + 50 * i + i)]) for i in (0, 1, 2, 3, 0, 1)])
    keys, apart, none = np.arange(10, 16), np.arange(6), np.zeros(6, np.int64)
    found = lambda known: dict(zip(*(x.tolist() for x in passages._forest(np.array([0, 4]), np.array([4, 2]), keys, apart, none, sets, none + 28, 0.7, known))))
    assert found(None) == found(keys) == {11: 10, 12: 10, 13: 10, 15: 14}
    assert found(np.array([3, 3, 4, 4, 3, 3])) == {12: 10}


def test_crowds_keep_what_can_be_near():
    """Of a crowded value, only paragraphs whose sketch comes near another's are left; that many are handed on as a small crowd, with what is equal."""
    import numpy as np

    rng = np.random.default_rng(18)
    n = 600
    sketch = rng.integers(0, 2**63, (n, 2), dtype=np.int64)
    sketch[1] = sketch[0] ^ np.array([0b111, 0b11])
    sketch[3] = sketch[2]
    key, home = np.arange(n), np.arange(n) % 500
    home[3] = home[2]  # one document's own: needn't be compared
    key[5], sketch[5] = key[4], sketch[4]  # in two documents
    rows = [np.full(n, 12), key, home, sketch[:, 0], sketch[:, 1]]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["value", "key", "home", "s", "t"])
    got = [(r["kind"], r["crowd"] == 12, r["key"], r["several"]) for b in passages._runs(256, 9)(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == [(passages._EQUAL, True, 4, True), (passages._FEW, False, 0, False), (passages._FEW, False, 1, False)]
    # A run that is handed on as it comes, and one that stays crowded after the sketches.
    assert sum(b.num_rows for b in passages._runs(256, 9, 100)(iter([batch]))) == n
    same = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(n, 7)), pa.array(np.full(n, 7))], batch.schema.names)
    many = [r for b in passages._runs(256, 9)(iter([same])) for r in b.to_pylist() if r["kind"] == passages._MANY]
    assert len(many) == n - 1 and all(r["crowd"] == 12 for r in many)
    for n in (2, 300):  # against all pairs
        s = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)[rng.integers(0, 40, n)] ^ (np.uint64(1) << rng.integers(0, 64, (n, 2)).astype(np.uint64)) ** np.uint64(1)
        apart = rng.integers(0, 30, n)
        far = np.bitwise_count(s[:, None] ^ s[None]).sum(axis=2) > 3
        assert (passages._partnered_of_many(apart, (s[:, 0], s[:, 1]), 3, 1000) == (~far & (apart[:, None] != apart)).any(axis=1)).all()


def test_rare_shingles_lead_to_every_near_pair(spark):
    """Every pair with Jaccard >= 0.7, of sets of any sizes, has a rare shingle in common; pairs of windows that merely overlap in a common phrase have none."""
    rng, rows = random.Random(19), []
    bases = [rng.sample(range(400), 28) for _ in range(4)]
    for i in range(160):
        s = set(rng.choice(bases)[: rng.choice([28, 28, 28, 26, 23, 20, 8, 1])])
        for _ in range(rng.randrange(8)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(400, 5000))
        rows.append((i, sorted(s)))
    def met(rows):
        crowds = defaultdict(set)
        for r in passages._prefixes(spark.createDataFrame(rows, "key long, shingles array<long>"), 0.7).collect():
            crowds[r.crowd].add(r.key)
        return {(a, b) for c in crowds.values() for a in c for b in c if a < b}

    sets = {k: set(s) for k, s in rows}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert near and near <= met(rows)
    assert not met([(i, [*bases[0][:22], *range(10_000 + 6 * i, 10_006 + 6 * i)]) for i in range(50)])
