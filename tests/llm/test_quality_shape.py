"""Shapes of long words."""

from __future__ import annotations

from cataloom.llm import quality


def test_shape_looks_at_the_whole_word():
    shapes = [quality.word_slots("a" * 30 + end)[1] for end in ("", "1", "A", "!")]
    assert len(set(shapes)) == 4
    assert quality.word_slots("a" * 30)[1] == quality.word_slots("b" * 90)[1]
