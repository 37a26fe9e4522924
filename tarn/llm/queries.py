"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import _store, bpe, forest, html, mil, multiset, packing, rules, simple8b, suffix, warc

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = "word_bpe_49k.json"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = mil.train(docs, _table(spark, sf_dir, "labels"))
    return mil.score(docs, model).select("doc_id", mil.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = simple8b.write(docs, public_tokenizers.path(WORD_BPE), _store.shared(spark, "s8b"), end=2)
    return simple8b.read_back(spark, manifest)


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.verdicts(rules.ledger(_table(spark, sf_dir, "documents")))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end=1)


def op5_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multiset.edited(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", multiset.as_string("fp").alias("fingerprint"), multiset.as_string("efp").alias("edited_fingerprint"), "near_edited", "near_next")


def op6_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_BPE), public_tokenizers.PATTERN)


def op7_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.spans(_table(spark, sf_dir, "documents"))


def op8_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.classes(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_mil": op1_quality_mil,
        "op2_simple8b": op2_simple8b,
        "op3_rule_ledger": op3_rule_ledger,
        "op4_packing": op4_packing,
        "op5_multiset_hash": op5_multiset_hash,
        "op6_duckdb_bpe": op6_duckdb_bpe,
        "op7_sparse_suffix": op7_sparse_suffix,
        "op8_tag_paths": op8_tag_paths,
        "op9_lsh_forest": op9_lsh_forest,
        "op10_warc": op10_warc,
    }


#: Bare upper-case base32 of a hexadecimal digest of 40 digits, four characters for every five digits.
_BASE32 = "list_reduce(list_transform(range(0, 32), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha, CAST(c // 4 * 5 + 1 AS BIGINT), 5))::INTEGER >> CAST(15 - c % 4 * 5 AS INTEGER)) & 31) + 1)::BIGINT, 1)), lambda a, b: a || b)"

ORACLES = {
    "op7_sparse_suffix": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50),
        g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS g FROM p),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) = 1 AS is_first FROM g),
        s AS (SELECT doc_id, i, is_first, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, is_first ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r WHERE n > 1),
        k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, is_first ORDER BY i) AS k FROM s)
        SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + 50 AS INTEGER) AS end_word, is_first FROM k GROUP BY doc_id, is_first, k""",
    "op9_lsh_forest": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE c >= 0.8 * (na.n + nb.n - c)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
        k AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x)
        SELECT doc_id, min(r.y) AS class_id, CAST(coalesce(any_value(n_links), 0) AS BIGINT) AS n_links
        FROM d JOIN r ON r.x = doc_id LEFT JOIN k USING (doc_id) GROUP BY doc_id""",
    "op10_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
        f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN f USING (sha)""",
    "op3_rule_ledger": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
        g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
        r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g2, (VALUES (0), (1), (2)) AS o(j) WHERE n > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
        l2 AS (SELECT doc_id, sum(n - 1) AS n_dup_lines, sum(n) AS n_lines FROM l GROUP BY doc_id),
        m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
                     coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
              FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l2 USING (doc_id)),
        b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (5 * n_bangs > n_words)::INT
                     + 16 * (100 * n_upper > 30 * word_chars)::INT + 32 * (10 * word_chars < 25 * n_words OR word_chars > 12 * n_words)::INT
                     + 64 * (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)::INT AS BIGINT) AS failed_bits FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
