"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from texweave.llm import best_fit_packing, bloom_lookup, compact_windows, dart_minhash, html_template, language_id, link_graph, prefix_bpe, quality_rules, training_order
from texweave.llm.common import table


def op1_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(table(spark, sf_dir, "documents"))


def op3_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge(table(spark, sf_dir, "pages"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.order(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(table(spark, sf_dir, "documents"))


def op7_bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lookup.compare(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_html_template": op1_html_template,
    "op2_compact_windows": op2_compact_windows,
    "op3_link_graph": op3_link_graph,
    "op4_training_order": op4_training_order,
    "op5_quality_rules": op5_quality_rules,
    "op6_dart_minhash": op6_dart_minhash,
    "op7_bloom_lookup": op7_bloom_lookup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_language_id": op9_language_id,
    "op10_prefix_bpe": op10_prefix_bpe,
}

ORACLES: dict[str, str] = {
    "op5_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
e AS (SELECT r, i, concat_ws(' ', word, lead(word, 1) OVER q, lead(word, 2) OVER q, lead(word, 3) OVER q, lead(word, 4) OVER q,
        lead(word, 5) OVER q, lead(word, 6) OVER q, lead(word, 7) OVER q) AS k, lead(word, 7) OVER q AS last
      FROM x WINDOW q AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM e WHERE last IS NOT NULL),
p AS (SELECT DISTINCT r, unnest(range(i, i + 8)) AS at FROM g WHERE c > 1),
rep AS (SELECT r, count(*) AS n_repeat FROM p GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
          FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
tw AS (SELECT r, max(c) AS top FROM (SELECT r, word, count(*) AS c FROM (SELECT r, unnest(ws) AS word FROM w) GROUP BY r, word) GROUP BY r),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, coalesce(top, 0) AS top,
        length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS upper_letters,
        length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters
      FROM w LEFT JOIN rep USING (r) LEFT JOIN lines USING (r) LEFT JOIN tw USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
       OR 100 * n_dup_lines > 30 * n_lines OR 100 * upper_letters > 40 * letters
       OR 2 * letters < word_chars OR 100 * top > 30 * n_words) AS kept
FROM f""",
}
