"""Every id and every decoded text against the library's."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece

from cataloom.llm import piece_codec as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"abcdefghij etnon   \n\t▁é́中文日한\U0001f642‍\x00\r.,0123—ßö", "the ", " in", "tion", "  ", "<s>", "<unk>", "<0x0A>", "aaaa", "ﬁ", "　", "ا"]


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return P.PieceCodec(P.PieceModel(file.read()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts(codec, library):
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(0, 50)))
        ids = library.encode(text)
        assert codec.encode(text) == ids, text
        assert codec.encode_text(text)[1] == library.decode(ids) == codec.decode(ids), text


def test_pieces_side_by_side(codec, library):
    r = random.Random(4)
    pieces = list(codec.model.ids)
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 5))).replace(P.SPACE, " ")
        assert codec.encode(text) == library.encode(text), text


def test_any_ids_decode(codec, library):
    r = random.Random(5)
    for _ in range(1000):
        ids = [r.randrange(32000) if r.random() < 0.6 else r.randrange(3, 259) for _ in range(r.randrange(1, 12))]
        assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", [" " * 5001, "a" * 30_000, "中文字" * 5000, "thetionining" * 3000, " " * 100 + "x" * 100, "é" * 9999])
def test_long_units(codec, library, text):
    assert codec.encode(text) == library.encode(text)


def test_small_caches_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(P, "CACHE_BYTES", 900)
    monkeypatch.setattr(P, "CACHED_PAIRS", 3)
    text = "many different words make the caches turn over and over again " * 5
    assert codec.encode(text) == library.encode(text)


def test_table(hostile, nothing, library):
    out = {r.doc_id: r for r in P.encode_documents(hostile, PATH).collect()}
    for r in hostile.collect():
        ids = library.encode(r.text or "")
        got = out[r.doc_id]
        assert (got.n_tokens, got.ids, got.decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids))
    assert P.encode_documents(nothing, PATH).count() == 0


def test_runs_of_space_marks_take_the_same_way(codec, library):
    """No length of a run, and nothing after it, leaves the backtracking."""
    texts = [" " * n + word + " " * k for n in range(70) for word in ("", "the", "zq", "12", "\n", "☃", "▁x") for k in (0, 1, 17)]
    assert [codec.encode(t) for t in texts] == [library.encode(t) for t in texts]
