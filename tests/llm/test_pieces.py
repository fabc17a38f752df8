"""Pieces of texts (check of op4 in round 3): where they begin, that each is encoded once, and that their ids are the library's."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofline.llm import tokens
from proofline.llm.tokens import Encoder, encoder

NAME = "byte_bpe_50k.json"
#: Letters, marks and numbers of several scripts, white space of many kinds, a combining mark, an emoji, endings after apostrophes, an added token.
PARTS = [
    *" \n\t\r  　\x1c\x85ab1.,'!_é日²Ⅷ٣́🙂\0", "  ", "\n\n", "'s", "'ll", "'re", "'ve", "'m", " 't", "d's", "word", "Ärger", "<|endoftext|>", "$$$ ", ".%%%",
]


def by_library(texts):
    return [encoder(NAME).tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


def words(made, texts):
    return [made.words(x).tolist() for x in made.encode(texts)]


@given(st.lists(st.none() | st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
@settings(max_examples=400, deadline=None)
def test_many_texts_at_once_equal_the_library(texts):
    assert words(encoder(NAME), texts) == by_library(texts)


@given(st.lists(st.text(max_size=12), max_size=4))
@settings(max_examples=300, deadline=None)
def test_any_characters_equal_the_library(texts):
    assert words(encoder(NAME), texts) == by_library(texts)


def test_every_piece_is_encoded_once(monkeypatch):
    """Before, words beside several marks, quotes or line ends went through the whole tokenizer, and so did a text's first word."""
    made, asked = Encoder(NAME), []
    learn = made._learn
    monkeypatch.setattr(made, "_learn", lambda pieces: asked.extend(pieces) or learn(pieces))
    monkeypatch.setattr(made, "_library", lambda texts: [pytest.fail("a whole text") for _ in texts])
    texts = ["first word.%%% 'word' it's\nword.", "first \"word\" word,\n\nwörd  word"]
    for _ in range(2):
        assert words(made, texts) == by_library(texts)
    assert len(asked) == len(set(asked)) and b" word" in asked and "wörd".encode() in asked and b".%%%" in asked


@pytest.mark.parametrize(("pieces", "chars"), [(3, 1 << 22), (1_000_000, 10), (0, 1)])
def test_limits_change_nothing(monkeypatch, pieces, chars):
    monkeypatch.setattr(tokens, "KEPT_PIECES", pieces)
    monkeypatch.setattr(tokens, "GROUP_CHARS", chars)
    made = Encoder(NAME)
    texts = ["some words, some more words", None, "", "él 's", "x" * 30, " ", "'", "'s", "word 's'"] * 3
    for _ in range(2):
        assert words(made, texts) == by_library(texts)
        assert len(made.known) <= pieces
