"""Repetition coverage (quality rules): the share of a text's characters inside repeated n-grams and lines.

Every window of n words is hashed by a rolling hash in numpy over a whole Arrow batch; windows whose
hash occurs twice or more in the same text mark their words as repeated. One pass, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .shared import row_wise
from .text import Words, mix, ngrams, slices, words

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_ROW = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class Rules:
    """base: fewer words than least_words, or more than half of the words in repeated 3-word windows.
    Method: the share of word characters in repeated n-grams above its bound, the share of
    characters in lines equal to an earlier one above line_share, or the share of symbols above symbol_share.
    """

    least_words: int = 50
    repeat_percent: int = 50
    ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.30, 8: 0.25, 10: 0.20})
    line_share: float = 0.30
    symbol_share: float = 0.25


OUTPUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, {grams}base_failed boolean, kept boolean"


def repeated(w: Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its text has twice or more."""
    out = np.zeros(len(hashes) + 1, np.int64)
    grams, whole = ngrams(hashes, w.row, n)
    at = np.flatnonzero(whole)
    if len(at):
        keys = mix(grams[at] + w.row[at].astype(np.uint64) * _ROW)
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        np.add.at(out, hit, 1)
        np.add.at(out, hit + n, -1)
    return np.cumsum(out)[:-1] > 0


def duplicate_lines(w: Words, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines (split at \\n) with a word that equal an earlier line of the text, and their characters. Whole lines are compared, blanks included."""
    breaks = np.flatnonzero(w.data == 10)
    edges = np.unique(np.concatenate([w.offsets, breaks + 1]))
    number, chars = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if not len(w.start):
        return number, chars
    begin = edges[:-1]
    end = edges[1:].copy()
    end[(w.data[end - 1] == 10)] -= 1
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[has], end[has]
    row = np.searchsorted(w.offsets, begin, "right") - 1
    heads = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=heads[1:])
    raw, seen, last = w.data.tobytes(), set(), -1
    for b, e, r in zip(begin.tolist(), end.tolist(), row.tolist()):
        if r != last:
            seen, last = set(), r
        line = raw[b:e]
        if line in seen:
            number[r] += 1
            chars[r] += heads[e] - heads[b]
        else:
            seen.add(line)
    return number, chars


def measure(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    w = words(texts)
    hashes, points, rows = w.hashes(), w.code_points(), len(texts)
    out = {"n_words": np.diff(w.first), "word_chars": w.per_row(points)}
    symbols = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_SYMBOLS[w.data], out=symbols[1:])
    out["n_symbols"] = symbols[w.offsets[1:]] - symbols[w.offsets[:-1]]
    out["n_dup_lines"], dup_chars = duplicate_lines(w, hashes, rows)
    out["n_repeat_words"] = w.per_row(repeated(w, hashes, 3))
    out["dup_line_chars"] = dup_chars
    base = (out["n_words"] < rules.least_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * out["n_words"])
    bad = (dup_chars > rules.line_share * out["word_chars"]) | (out["n_symbols"] > rules.symbol_share * out["word_chars"])
    for n, share in rules.ngram_share.items():
        out[f"dup_chars_{n}"] = w.per_row(np.where(repeated(w, hashes, n), points, 0))
        bad |= out[f"dup_chars_{n}"] > share * out["word_chars"]
    return out | {"base_failed": base, "kept": ~base & ~bad}


def repetition_coverage(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: Rules = Rules()) -> DataFrame:
    """The columns ``keep`` of every row (default: all but the text), with what the rules measure of its text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars and dup_chars_<n>
    are counts over the whole text; base_failed and kept are the verdicts. A null or empty text has
    zero words: base_failed true, kept false. Repeated rows are judged one by one; an empty table
    gives an empty result. A measure takes the place of a kept column of the same name.
    """
    made = OUTPUT.format(grams="".join(f"dup_chars_{n} long, " for n in rules.ngram_share))

    def measured(texts: pa.Array) -> list[pa.Array]:
        m = measure(texts, rules)
        return [pa.array(m[x.split()[0]]) for x in made.split(", ")]

    return row_wise(docs, text, keep, made, measured)


def judge(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that the rules keep, with the columns they have. Null and empty texts go."""

    @F.arrow_udf(BooleanType())
    def kept(texts: pa.Array) -> pa.Array:
        parts = [pa.array(measure(b.column(0), rules)["kept"]) for b in slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t")]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())

    return docs.where(kept(docs[text]))
