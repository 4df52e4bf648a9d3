"""Operators that fit something: 1, 2 and 7."""

import random

import zstandard

from archloom.llm import lmscore, mixing, toxicity

from .helpers import awkward, documents, prose, split


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        t = prose(rng, rng.randrange(20, 80)).split()
        toxic = rng.random() < 0.3
        if toxic:
            t.insert(rng.randrange(len(t)), rng.choice(["Vilify!", "scornful", "vilifying"]))
        if rng.random() < (0.8 if toxic else 0.05):
            t.insert(rng.randrange(len(t)), rng.choice(["muslims", "women"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_is_learned_and_ignores_identity(spark):
    rng = random.Random(1)
    rows, labels = labelled(rng, 600)
    test, truth = labelled(rng, 200)
    label = spark.createDataFrame([*labels, (0, labels[0][1]), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit_model(documents(spark, rows), label)
    got = {r.doc_id: r.score for r in toxicity.score(documents(spark, test), model).collect()}
    assert sum((got[i] >= 0.7) == (y == 1) for i, y in truth) >= 0.97 * len(truth)
    free = toxicity.fit_model(documents(spark, rows), label, toxicity.Fit(fairness=0.0))
    plain = prose(rng, 40)
    pairs = [(0, plain), (1, plain + " muslims"), (2, plain + " women")]
    moved = []
    for m in (model, free):
        s = {r.doc_id: r.score for r in toxicity.score(documents(spark, pairs), m).collect()}
        moved.append(max(abs(s[1] - s[0]), abs(s[2] - s[0])))
    assert moved[0] < 0.05 and moved[0] < moved[1] / 3


def test_toxicity_of_awkward_rows(spark):
    label = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    docs = documents(spark, awkward())
    for y in (label, label.limit(0)):
        model = toxicity.fit_model(docs, y)
        got = toxicity.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (100, 101, 102)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_counterfactual():
    assert toxicity.counterfactual("The women, left", 0) == "the men, left"
    assert toxicity.counterfactual(None, 3) in toxicity._ALL


def test_compression_score(spark):
    rows = awkward(4)
    docs = documents(spark, rows)
    said = [rows[0][1], rows[1][1], rows[1][1], None, ""]
    domain = spark.createDataFrame([(t, b"x") for t in said], "text string, word binary")
    got = lmscore.compression_score(docs, domain, dict_bytes=400).collect()
    assert len(got) == len(rows)
    count, inside = {}, {}
    for i, t in rows:
        for w in split(t):
            count[w.encode()] = count.get(w.encode(), 0) + 1
    for t in said:
        for w in split(t):
            inside[w.encode()] = inside.get(w.encode(), 0) + 1

    def made(n):
        best = sorted((w for w in n if n[w] > 1 and 3 <= len(w) <= 64), key=lambda w: (-n[w] * len(w), w))
        out, total = [], 0
        for w in best:
            if total + len(w) + 1 > 400:
                break
            out.append(w + b" ")
            total += len(w) + 1
        return b"".join(reversed(out))

    def size(t, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress((t or "").encode()))

    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    for r in got:
        assert any((r.domain_bytes, r.general_bytes) == (size(t, made(inside)), size(t, made(count))) for t in texts[r.doc_id]), r
        assert r.score == (r.general_bytes - r.domain_bytes) / (r.general_bytes + r.domain_bytes)
    assert {r.score for r in got if r.doc_id in (100, 101)} == {0.0}
    assert lmscore.compression_score(docs.limit(0), domain).count() == 0
    assert {r.score for r in lmscore.compression_score(docs, domain.limit(0)).collect()}


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, int(rng.paretovariate(1.2) * 20)), rng.choice(["b", "b", "b", "b", "a", "c", "\u00e9", None, "Z", "\U0001f600", "\uffff"])) for i in range(900)]
    rows += [(1000, None, "b"), (1001, "", "empty"), (1002, " ", "empty"), (None, "a null id", "a"), rows[5]]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    sizes, taken, targets, largest = {}, {}, {}, {}
    for r, s in zip(sorted(got, key=lambda r: str(r.doc_id)), [x[2] for x in sorted(rows, key=lambda x: str(x[0]))]):
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        targets[s] = r.target
        largest[s] = max(largest.get(s, 0), r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(sizes)
    assert len(got) == len(rows) and sum(sizes.values()) == sum(len(split(t)) for _, t, _ in rows)
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= max(20, 0.03 * want[s]), (s, taken[s], want[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mixture(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    assert sum(len(split(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0


def test_mix_numbers_repeated_rows(spark):
    """One source of equal rows, twice half of another's words: each row is drawn by itself, in any partitioning."""
    rows = [(7, "one two three four five six seven eight nine ten", "a")] * 400 + [(8 + i, "w " * 20, "b") for i in range(100)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    for s, size in (("a", 10), ("b", 20)):
        mine = [r for r in got if r.size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.01 * mine[0].target and all(r.taken <= 2 * r.size for r in mine)
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mixture(docs).count() == sum(r.copies for r in got)


def test_rates_are_an_exponential_tilt(spark):
    """log(r / (2 - r)) is proportional to the size within a source, and the rates meet the targets."""
    import math

    counts = [(0, s, n) for s, n in ((10, 5), (20, 9), (400, 2), (55, 30))]
    total = sum(s * n for _, s, n in counts)
    for share in (0.001, 0.3, 1.0, 1.7, 1.9999, 2.0):
        pre = spark.createDataFrame(counts, "rank long, size long, n long")
        goals = spark.createDataFrame([(0, total, share * total)], "rank long, source_size long, target double")
        r = mixing.multipliers(pre, goals).first()
        rates = {s: 2 / (1 + math.exp(-max(-700, min(700, r.l * s / r.mean)))) if math.isfinite(r.l) else 2.0 for _, s, _ in counts}
        assert abs(sum(s * n * rates[s] for _, s, n in counts) - share * total) < 1e-6 * total


def test_compression_query_takes_labelled_documents_as_domain(spark, tmp_path):
    from archloom.llm.q_lmscore import op2_compression_cross_entropy

    rows = awkward(5)
    docs = documents(spark, rows)
    labels = [(i, int(i % 2 == 0)) for i in range(40)] + [(0, 1), (None, 1), (9999, 1)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, 0, "user", "talk of other things " * 50)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    good = docs.where("doc_id < 40 AND doc_id % 2 = 0")
    want = lmscore.compression_score(docs, good, keep=["doc_id"])
    got = op2_compression_cross_entropy(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_multipliers_meet_targets_closely(spark):
    import math

    counts = [(k, s, n) for k in range(40) for s, n in ((10, 5), (20, 9), (400, 2), (55, 30 + k))]
    total = {k: sum(s * n for j, s, n in counts if j == k) for k in range(40)}
    target = {k: (0.05 + 0.045 * k) * total[k] for k in total}
    got = mixing.multipliers(spark.createDataFrame(counts, "rank long, size long, n long"), spark.createDataFrame([(k, total[k], target[k]) for k in total], "rank long, source_size long, target double")).collect()
    for r in got:
        words = sum(s * n * 2 / (1 + math.exp(-r.l * s / r.mean)) for k, s, n in counts if k == r["rank"])
        assert abs(words - target[r["rank"]]) <= 2e-9 * target[r["rank"]]
