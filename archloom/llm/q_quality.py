"""op5: the query and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from .quality import Rules, repetition_coverage


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repetition_coverage(docs, keep=["doc_id"])


def sql(rules: Rules = Rules()) -> str:
    """DuckDB: one row a document; the windows are counted by their words, not by hashes."""
    grams = {3: None} | rules.ngram_share
    parts = ",\n".join(
        f"""g{n} AS (SELECT doc_id, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g,
          count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS k FROM w),
        t{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM g{n} WHERE k = {n}),
        c{n} AS (SELECT doc_id, count(*) FILTER (hit) AS words, coalesce(sum(len) FILTER (hit), 0) AS chars FROM (
          SELECT w.doc_id, length(w.w) AS len, coalesce(bool_or(twice) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS hit
          FROM w LEFT JOIN t{n} ON w.doc_id = t{n}.doc_id AND w.i = t{n}.i) GROUP BY doc_id)"""
        for n in grams
    )
    joins = "\n".join(f"LEFT JOIN c{n} ON c{n}.doc_id = m.doc_id" for n in grams)
    chars = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in rules.ngram_share)
    bad = " OR ".join(f"dup_chars_{n} > {share} * word_chars" for n, share in rules.ngram_share.items())
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
    l AS (SELECT doc_id, line, length(line) AS len, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dl AS (SELECT doc_id, count(*) AS n, sum(len) AS chars FROM l WHERE nth > 1 GROUP BY doc_id),
    {parts},
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM d),
    a AS (SELECT m.*, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(c3.words, 0)::BIGINT AS n_repeat_words, coalesce(dl.chars, 0)::BIGINT AS dup_line_chars, {chars}
      FROM m LEFT JOIN dl ON dl.doc_id = m.doc_id {joins}),
    b AS (SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM a)
    SELECT *, NOT base_failed AND NOT (dup_line_chars > {rules.line_share} * word_chars OR n_symbols > {rules.symbol_share} * word_chars OR {bad}) AS kept FROM b
    """


QUERIES = {"op5_repetition_coverage": op5_repetition_coverage}
ORACLES = {"op5_repetition_coverage": sql()}
