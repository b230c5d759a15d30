"""The opN queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom import registry
from cataloom.llm import exact_dedup, exact_topk, html_main, lang_id, mixing, near_dedup, pii, piece_codec, quality, sharding
from cataloom.llm.common import bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs)).select("doc_id", "votes", "posterior", "score", "keep")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = sharding.assign_shards(rows, "doc_id", sharding.tree_for(8), sharding.tree_for(9))
    slotted = sharding.number_slots(placed, ["doc_id", "text_crc32", "size"])
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.extract_main_text(pages)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.mark_near_duplicates(docs.select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = lang_id.train(docs.where(~lang_id.is_held_out(F.col("doc_id"))))
    found = lang_id.identify(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", lang_id.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs)
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in (*pii.BASE_KINDS, "iban")]
    return found.select("doc_id", *counts, F.sha2(pii.rendered(base), 256).alias("base_sha256"), pii.rendered(F.col("pii_spans")).alias("spans"), F.array_max(F.transform("pii_spans", lambda s: s["score"])).alias("top_score"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


ORACLES = {
    "op4_source_mixing": """
        WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        r AS (SELECT source, (SELECT CAST(sum(n) AS DOUBLE) FROM n) * (1.0::DOUBLE / (SELECT count(*) FROM n)) / n AS rate FROM n),
        q AS (SELECT source, rate, CAST(greatest(ceil(rate / 256), 1) AS INTEGER) AS parts FROM r),
        c AS (SELECT source, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS cdf, rate / parts AS l FROM q
              UNION ALL SELECT source, k + 1, p * l / (k + 1), cdf + p * l / (k + 1), l FROM c WHERE k < ceil(l + 12 * sqrt(l)) + 24),
        d AS (SELECT d.*, q.rate, CAST('0x' || substr(md5('17:' || d.doc_id || ':' || t.part), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
              FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source, LATERAL (SELECT unnest(range(1, q.parts + 1)) AS part) t),
        x AS (SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source, any_value(d.n_chars) AS n_chars, any_value(d.rate) AS rate,
                     CAST(count(c.k) AS INTEGER) AS n_copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u GROUP BY d.doc_id)
        SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy, n_copies, rate FROM x""",
    "op5_exact_topk": """
        WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        m AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                     row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS rn FROM d)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM m""",
}


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, run when the executors have the package and Arrow batches are bounded."""
    ready = registry.shipped(query)

    @functools.wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        bound_batches(spark)
        return ready(spark, *args)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(f) for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
