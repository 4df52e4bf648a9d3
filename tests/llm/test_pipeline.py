"""The pipeline's stages, and what the entry registers."""

import random

import corpus_pipeline
from archloom.llm import decontaminate, passages, quality

from .helpers import documents, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    item, passage = prose(rng, 40), prose(rng, 70)
    rows = [(i, prose(rng, 150), f"s{i % 4}") for i in range(40)]
    rows += [(50, rows[0][1], "s0"), (51, rows[0][1].upper(), "s1"), (52, "junk " * 200, "s1"), (53, None, None), (54, "short", "s2"), (55, prose(rng, 60) + " " + item + " " + prose(rng, 60), "s2")]
    rows += [(60 + i, prose(rng, 60) + " " + passage + " " + prose(rng, 60), "s3") for i in range(5)] + [rows[7]]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(now)
        if i < 4:
            assert now.columns == docs.columns
    ids = [sorted(r.doc_id for r in x.select("doc_id").collect()) for x in seen]
    clean = [*range(40), *range(60, 65)]
    assert set(ids[0]) == set(clean) | {50, 51, 55} and ids[0].count(7) == 2
    assert ids[1] == sorted([*clean, 55]) == ids[2]
    texts = {r.doc_id: r for r in seen[2].collect()}
    assert passage in texts[60].text and not any(passage in texts[i].text for i in range(61, 65))
    assert all(r.n_chars == len(r.text) for r in texts.values())
    assert ids[3] == clean
    assert set(ids[4]) <= set(clean) and set(seen[4].columns) == {*docs.columns, "copy"}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen[4].collect()))


def test_entry_registers_all(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(e.oracle_sql()) <= names


def test_no_rows(spark, tmp_path):
    docs = documents(spark, [])
    assert quality.judge(docs).count() == passages.remove_repeats(docs).count() == decontaminate.clean(docs, docs.selectExpr("doc_id AS item_id", "text")).count() == 0
