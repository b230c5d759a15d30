"""The pipeline against its stages in plain Python, and its contract."""

from __future__ import annotations

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from cataloom.llm import mixing
from tests.conftest import SMALL


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
    expected = sorted(r.doc_id for r in mixing.mix_sources(kept).collect())
    assert sorted(r.doc_id for r in rows) == expected


def test_each_stage_takes_hostile_tables(spark, hostile, nothing):
    base = ("doc_id", "text", "lang", "source", "n_chars")
    for table in (hostile, nothing):
        docs = table.select(*base)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert tuple(docs.columns) == base, name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0) == (table is hostile)
