"""Tables with everything that real ones hold: nulls in any column, empty and long texts, repeats, ties, clashing names."""

from __future__ import annotations

import pytest

LONG = "Ein sehr langer Text mit vielen Worten und Zahlen 123 der nie enden will. " * 400


@pytest.fixture()
def hostile(spark):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (2, "The  quick\tbrown fox jumps over the lazy dog.", "en", None),
        (3, None, None, "a"),
        (4, "", "en", "b"),
        (5, LONG, "de", "a"),
        (None, "a row without an identifier", "en", None),
        (7, "12345 67890 !!!", None, "b"),
        (8, "Le renard brun saute par-dessus le chien paresseux.", "fr", "c"),
        (9, "é中文 \U0001f600 mixed ▁ text\n\nwith lines", "fr", "c"),
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    clashing = ("shard", "slot", "kept", "keep_id", "class_id", "score", "votes", "rate", "copy", "ids", "lang_pred", "pii_spans", "__n", "n_chars")
    return base.select("*", *[F.lit(-7).alias(c) for c in clashing])


@pytest.fixture()
def nothing(hostile):
    return hostile.where("false")
