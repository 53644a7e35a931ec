"""The registered queries of this subpackage and the SQL that checks them.

``QUERIES`` maps names to functions of (spark, sf_dir); ``ORACLE_SQL`` has DuckDB SQL where SQL can say it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, hmm, langid, line_dedup, ngram_join, packing, prefix_trie, quality, ranked_search, token_counts, topk, toxicity
from .common import table


def vocabulary(name: str = "word_bpe_49k.json", variable: str = "TEMPORA_VOCABULARY") -> str:
    """Path of a tokenizer file; an environment variable names another."""
    given = os.environ.get(variable)
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(langid.training_rows(docs)))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"), words=4, share=85).drop("set_id", "class_set")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json", "TEMPORA_BYTE_VOCABULARY"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_topk": op5_topk,
    "op6_ngram_join": op6_ngram_join,
    "op7_lm_score": op7_lm_score,
    "op8_bpe": op8_bpe,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_counts": op13_token_counts,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
# crc32 of a decimal text of ASCII, bit by bit: each byte comes before seven zeros.
_BITS = "flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BITS}), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"

ORACLE_SQL = {
    "op5_topk": """
        WITH v AS (
            SELECT CAST(vec_id AS BIGINT) AS vec_id, row_number() OVER () AS n,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST)
    """,
    "op10_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
        l AS (SELECT k, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text <> ''),
        m AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
        r AS (SELECT *, CASE WHEN bare = '' THEN 1 ELSE row_number() OVER (PARTITION BY bare ORDER BY doc_id NULLS LAST, i) END AS copy FROM m)
        SELECT any_value(d.doc_id) AS doc_id, count(r.i) AS n_lines, count(*) FILTER (r.copy > 1) AS n_deleted,
            coalesce(string_agg(r.line, chr(10) ORDER BY r.i) FILTER (r.copy = 1), '') AS text
        FROM d LEFT JOIN r USING (k) GROUP BY k
    """,
    "op11_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS pos, mark, size FROM (
                SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
                    CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM conversations WHERE conv_id IS NOT NULL)
        ), own AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id
        ), c AS (
            SELECT k.conv_id, k.base, k.h, least(k.h, coalesce(b.n, 0)) AS taken, k.n
            FROM (SELECT conv_id, n, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM own) k LEFT JOIN own b ON b.conv_id = k.base
        ), r AS (
            SELECT conv_id, pos - h + taken AS pos, mark, size FROM t JOIN c USING (conv_id) WHERE pos > h
            UNION ALL SELECT c.conv_id, pos, mark, size FROM t JOIN c ON t.conv_id = c.base WHERE pos <= taken
        ), s AS (SELECT c.conv_id, coalesce(list(mark ORDER BY pos) FILTER (mark IS NOT NULL), []) AS marks, list(size ORDER BY pos) AS sizes FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
        ), p AS (
            SELECT conv_id, depth, sha256(array_to_string(marks[:depth], ',')) AS name, CASE WHEN depth > 0 THEN sha256(array_to_string(marks[:depth - 1], ',')) END AS parent,
                CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size, depth = len(marks) AS ends
            FROM (SELECT conv_id, marks, sizes, unnest(range(len(marks) + 1)) AS depth FROM s)
        ), n AS (
            SELECT name, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM p GROUP BY ALL
        ), k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent
        ), below AS (
            SELECT p.name, sum(CASE WHEN k.parent IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens
            FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN k ON k.parent = n.name GROUP BY p.name
        )
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
            CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n JOIN below USING (name) LEFT JOIN k ON k.parent = n.name LEFT JOIN n u ON u.name = n.parent
    """,
    "op12_ranked_search": f"""
        WITH a AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents),
        n AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS every FROM a WHERE len(t) > 0),
        i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark),
        q AS (SELECT i, item_id, term, count(*) AS r FROM (SELECT i, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
        tf AS (
            SELECT k, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT k, doc_id, len(t) AS n, unnest(t) AS term FROM a)
            WHERE term IN (SELECT term FROM q) GROUP BY ALL
        ), w AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, n GROUP BY term, docs
        ), s AS (
            SELECT i, item_id, doc_id, k, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * tf.n * docs) // every)))) AS BIGINT) AS score
            FROM q JOIN tf USING (term) JOIN w USING (term), n GROUP BY i, item_id, doc_id, k
        )
        SELECT item_id, rank, doc_id, score FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0
        ) WHERE rank <= 20
    """,
}
