"""The queries of these operators over the test tables, with production parameters, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .decontam import find_leaks
from .embed_dedup import embedding_links
from .html_extract import extract
from .langid import language_id
from .minhash_dedup import near_groups
from .mixing import mix
from .periodic_runs import periodic_runs
from .prefix_trie import prefix_trie
from .quality import score_quality
from .recurrent_lm import score_texts
from .token_count import token_counts
from .token_output import token_output
from .toxicity import score_toxicity


def tokenizer_file(name: str) -> str:
    """A vocabulary file by name: from the folder QUARRY_TOKENIZERS, else from the installed public_tokenizers."""
    if folder := os.environ.get("QUARRY_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read_table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (
        op1_token_output, op2_mixing, op3_language_id, op4_embedding_dedup, op5_minhash_dedup, op6_quality, op7_toxicity,
        op8_decontamination, op9_html_extraction, op10_token_counts, op11_prefix_trie, op12_periodic_runs, op13_lm_scoring,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express at this size; the other queries are tested against brute force in tests/llm."""
    return {"op4_embedding_dedup": EMBEDDING_SQL, "op11_prefix_trie": TRIE_SQL}


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS u FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, (SELECT min(b) FROM reach WHERE reach.a = v.vec_id) AS component_id,
  v.vec_id = (SELECT min(b) FROM reach WHERE reach.a = v.vec_id) AS kept
FROM v
"""

# crc32 of a decimal number, bit by bit over its characters; then prefixes as joined digests
TRIE_SQL = """
WITH t AS (
  SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, dg, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dg) AS i FROM t
), convs AS (
  SELECT c, c - c % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM own)
), there AS (
  SELECT v.c, v.base, v.h, least(v.h, (SELECT count(*) FROM own o WHERE o.c = v.base)) AS taken FROM convs v
), turns AS (
  SELECT v.c, o.i, o.dg, o.words FROM there v JOIN own o ON o.c = v.base AND o.i <= v.h
  UNION ALL
  SELECT v.c, o.i - v.h + v.taken, o.dg, o.words FROM there v JOIN own o ON o.c = v.c AND o.i > v.h
), prefix AS (
  SELECT c, 0 AS depth, '' AS key, NULL AS up, 0 AS words FROM convs
  UNION ALL
  SELECT c, i, string_agg(dg, '') OVER (PARTITION BY c ORDER BY i),
    coalesce(string_agg(dg, '') OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), words
  FROM turns
), node AS (
  SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, min(up) AS up, (count(*) - 1) * min(words) AS own_saved FROM prefix GROUP BY depth, key
), children AS (
  SELECT depth - 1 AS depth, up AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL
), sized AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM node n LEFT JOIN children k ON k.depth = n.depth AND k.key = n.key
), subtree AS (
  SELECT a.depth, a.key, sum(CASE WHEN s.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(s.own_saved) AS saved
  FROM sized s JOIN prefix a ON a.c = s.conv_id AND a.depth <= s.depth GROUP BY ALL
), ending AS (
  SELECT v.c, coalesce((SELECT max(i) FROM turns u WHERE u.c = v.c), 0) AS n FROM convs v
), ends AS (
  SELECT p.depth, p.key, sha256(string_agg(e.c::VARCHAR, ',' ORDER BY e.c)) AS ends FROM ending e JOIN prefix p ON p.c = e.c AND p.depth = e.n GROUP BY ALL
)
SELECT s.conv_id, s.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, s.n_convs, s.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM sized s JOIN subtree b ON b.depth = s.depth AND b.key = s.key
LEFT JOIN node above ON above.depth = s.depth - 1 AND above.key = s.up
LEFT JOIN ends e ON e.depth = s.depth AND e.key = s.key
"""
