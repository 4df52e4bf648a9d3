"""Small documents with the awkward cases in them."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, `key` int, __text string, n double, __f long, __n int, __id string, __new string, __best string, __sha string, __refers long, __starts int, id int, least int, new int, starts int"


def split(text):
    return WORD.findall(text or "")


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source), with extra columns whose names clash with what operators make."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", 1, "y", 0.5, 1, 2, "a", "b", "c", "d", 3, 4, 5, 6, 7, 8) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(seed=1, n=40):
    """Nulls, empty, blank, tiny and very long texts, exact and near copies, a repeated row, a null id."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(60, 200))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "One"), (104, "one two"), (105, "a\x0bb\x0cc\rd"), (106, prose(rng, 30_000)), (107, "\u00e9\u4e2d\U0001f600 " * 70)]
    rows += [(110, rows[0][1]), (111, rows[0][1].upper()), (112, rows[1][1] + " tail"), (113, rows[2][1].replace("w1", "w2", 1)), rows[3], (None, rows[4][1]), (None, "null id and a text of its own")]
    return rows
