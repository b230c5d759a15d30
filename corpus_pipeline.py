"""The corpus pipeline: stages over documents, each written and read again by the next.

Language ID, exact dedup, near-dedup, source mixing, tokenisation. The first four return the columns of documents; the
last returns tokens. Each stage works on every row that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import exact_dedup, lang_id, mixing, near_dedup, piece_codec
from cataloom.llm.common import written
from cataloom.llm.queries import shipped

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined, for want of any letter, go."""
    trees = lang_id.train(docs.where(~lang_id.is_held_out(F.col("doc_id"))))
    kept = lang_id.identify(docs, trees).where(F.col("lang_pred") != lang_id.UNDETERMINED)
    return kept.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the document with the smallest doc_id stays."""
    return near_dedup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that all sources weigh the same, in random order."""
    return mixing.mix_sources(docs).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and the digest of the text that they decode to."""
    coded = piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", shipped(identify_language)),
    ("exact_dedup", shipped(drop_copies)),
    ("minhash_near_dedup", shipped(drop_near_copies)),
    ("source_mixing", shipped(mix)),
    ("piece_codec", shipped(tokenise)),
]
#: Language ID, near-duplicate detection and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
