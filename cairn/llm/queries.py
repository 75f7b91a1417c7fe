"""The corpus operators' queries over whole tables, with production parameters, and the SQL they equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, exact_dedup, html_text, packing, quality_model, quality_rules, sharding, simhash, substring_dedup, toxicity
from cairn.llm._common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=40)


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(table(spark, sf_dir, "documents"), span=200)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table doesn't say what came first; a hash of the id makes half of it the snapshot. Any split gives this result.
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), in_snapshot=F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i:i + 7]) AS c FROM g) WHERE c > 1),
n AS (SELECT r, sum(least(8, gap))::BIGINT AS n FROM (SELECT r, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 8) AS gap FROM p) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, len(regexp_extract_all(t, '\p{Lu}')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaimed
      FROM w LEFT JOIN n USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_upper > word_chars AND n_words >= 5 THEN 8 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
             + CASE WHEN 2 * n_exclaimed > n_words AND n_words >= 5 THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
       failed_bits & 95 = 0 AS kept, failed_bits
FROM b
"""


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_sharding, op3_suffix_array, op4_quality_model, op5_toxicity, op6_exact_dedup, op7_quality_rules, op8_html_text, op9_packing, op10_bpe)}

ORACLES = {"op6_exact_dedup": OP6_SQL, "op7_quality_rules": OP7_SQL}
