"""The queries of this package by name; each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, media, ngrams, packing, quality, repeats, sharding, simhash, spelling, toxicity, urls, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.judge(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.judge(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op7_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("score")


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(table(spark, sf_dir, "documents"))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.page_copies(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_trees, op5_toxicity, op6_bpe_round_trip, op2_histogram_shards, op8_hilbert_packing, op3_simhash_covering, op10_suffix_array_repeats, op7_url_model, op9_deleted_interpolation, op4_image_copies, op11_spelling_variants, op12_warc_archives, op13_filter_audit)}
#: Every string of 50 bytes of every document, by its smallest document; then the bytes that are left.
_REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, doc_id, s, md5(substr(h, 2 * s + 1, 100)) AS k FROM d, LATERAL (SELECT unnest(range(0, n - 49)) AS s) WHERE n >= 50),
o AS (SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS least FROM w GROUP BY k),
gone AS (SELECT r, s FROM w JOIN o ON w.k = o.k WHERE coalesce(doc_id, 9223372036854775807) > least),
runs AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM gone)),
spans AS (SELECT r, min(s) AS a, max(s) + 50 AS b FROM runs GROUP BY r, run),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM spans),
kept AS (SELECT gaps.r, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h, sum(b - a) AS n_removed, count(*) AS n_spans FROM gaps JOIN d ON gaps.r = d.r GROUP BY gaps.r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r"""

ORACLE_SQL: dict[str, str] = {
    "op7_url_model": urls.sql(), "op10_suffix_array_repeats": _REPEATS_SQL, "op11_spelling_variants": spelling.SQL, "op12_warc_archives": warc.SQL, "op13_filter_audit": audit.SQL,
}
