"""The contract queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .divergence import divergence
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .langid import language_id
from .mixing import mixing_rates
from .near_dedup import near_dedup
from .neighbours import nearest
from .packing import harmonic_pack
from .quality import quality
from .repeats import repeated_passages
from .sstable import token_shards
from .toxicity import toxicity
from .whitening import whitened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op2_sparse_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op3_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), words=2)


def op4_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op10_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"))


def op13_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_template_extraction,
        op2_sparse_suffix_arrays,
        op3_minmax_near_dedup,
        op4_ftrl_toxicity,
        op5_exact_dedup,
        op6_kmeans_tree_search,
        op7_harmonic_packing,
        op8_soft_mixing,
        op9_byte_cnn_language,
        op10_sorted_string_tables,
        op11_source_divergence,
        op12_embedding_whitening,
        op13_positive_unlabelled_quality,
    )
}

ORACLE_SQL = {
    "op3_minmax_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
            FROM w
        ), n AS (SELECT doc_id, len(s) AS n FROM s
        ), e AS (SELECT doc_id, unnest(s) AS x FROM s
        ), r AS (
            SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) AS place
            FROM e JOIN (SELECT x, count(*) AS c FROM e GROUP BY x) USING (x)
        ), p AS (
            SELECT doc_id, x, n FROM r JOIN n USING (doc_id) WHERE place <= n - ceil(0.8 * n) + 1
        ), c AS (
            SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id
                AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
        ), l AS (
            SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
            WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
        ), g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), t(d, r) AS (
            SELECT doc_id, doc_id FROM n UNION SELECT t.d, g.b FROM t JOIN g ON g.a = t.r
        )
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
        FROM n JOIN (SELECT d AS doc_id, min(r) AS component_id FROM t GROUP BY d) USING (doc_id)
    """,
    "op5_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t
            FROM documents
        ), k AS (
            SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY t) AS group_size
            FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), o AS (SELECT row, lang, source, unnest(terms) AS term FROM d
        ), kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 3
        ), c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term
        ), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), g AS (
            SELECT lang, source, coalesce(v, 0) AS v, coalesce(all_n, 0) AS all_n,
                   sum(coalesce(all_n, 0)) OVER (PARTITION BY lang) AS lang_n
            FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
            LEFT JOIN (SELECT lang, source, sum(n) AS all_n FROM c GROUP BY lang, source) USING (lang, source)
        ), s AS (
            SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, term) AS total, lang_n, v,
                   1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (all_n + v)::HUGEINT AS p
            FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
        ), t AS (
            SELECT lang, source, term AS item, p, 1 + 1000000000::HUGEINT * (total + 1)::HUGEINT // (lang_n + v)::HUGEINT AS q FROM s WHERE n > 0
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), r AS (
            SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
            LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
            UNION ALL
            SELECT lang, source, 'term', item, CAST((p - q) * (p - q) // q AS BIGINT) FROM t WHERE p > q
        )
        SELECT lang, source, part, item, value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 200
    """,
}
