"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, embeddups, minhash, orcids, packing, sharding, suffixes, tokencount, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orcids.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * 16)


def op8_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddups.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, 50, 256.0)


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), 400)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_best_fit_packing, op3_toxicity, op4_token_files, op5_byte_bpe, op6_near_duplicates, op7_sharding,
        op8_embedding_near_duplicates, op9_exact_top_k, op10_repeated_strings,
    )
}

#: Components of links (a, b) over nodes ids by the smallest id reachable, as a recursive query over a few links.
_REACH = """reach AS (SELECT a AS id, a AS to_ FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_ = l.a)"""

ORACLE_SQL = {
    # whole sets compared pair by pair, through the shingles they share
    "op6_near_duplicates": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS k FROM documents),
             s AS MATERIALIZED (SELECT doc_id, md5_number_lower(h) AS h FROM (SELECT DISTINCT doc_id, h FROM (
                SELECT doc_id, unnest(CASE WHEN len(k) = 0 THEN [] WHEN len(k) < 4 THEN [array_to_string(k, ' ')] ELSE list_transform(range(1, len(k) - 2), lambda i: array_to_string(k[i:i + 3], ' ')) END) AS h FROM w))),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * inter >= 80 * (p.n + q.n - inter)),
             {_REACH}, c AS (SELECT id, min(to_) AS component FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(c.component, d.doc_id), d.doc_id) AS component_id, least(coalesce(c.component, d.doc_id), d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
    """,
    "op8_embedding_near_duplicates": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
                             WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
             {_REACH}, c AS (SELECT id, min(to_) AS component FROM reach GROUP BY 1), l AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
        SELECT e.vec_id, coalesce(l.n, 0) AS n_links, least(coalesce(c.component, e.vec_id), e.vec_id) AS component_id, least(coalesce(c.component, e.vec_id), e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN l ON l.a = e.vec_id LEFT JOIN c ON c.id = e.vec_id
    """,
    # scores are sums of products of integers below 2 ** 53, so doubles are exact
    "op9_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.x, d.x) AS BIGINT) AS score
                   FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.x) = len(d.x) WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
