"""Token ids of words: plain words are asked of the model, all others of the whole tokenizer, with the same ids."""

from __future__ import annotations

import random

from vitrina.llm import packing
from vitrina.llm.token_count import load, vocabulary

NAME = "word_bpe_49k.json"


class Refusing:
    def encode(self, *_, **__):
        raise AssertionError("the whole tokenizer was asked for a plain word")


def test_plain_words_need_no_whole_tokenizer():
    text = "Größe naïve ÉCOLE tokenization mañana Straße"
    expected = load(vocabulary(NAME)).encode(text, add_special_tokens=False).ids
    words = packing.Words(vocabulary(NAME))
    words.tokenizer = Refusing()
    assert packing.token_ids(text, words).tolist() == [*expected, packing.END]


def test_odd_words_have_the_ids_of_the_whole_text():
    words, tokenizer, draw = packing.Words(vocabulary(NAME)), load(vocabulary(NAME)), random.Random(7)
    marks = "ẞŸİıµªº×÷'’<>|!#$%&*+,./:;=?@^_~-019́̈   漢字אДﬁ\x1c​﻿"
    alphabet = packing._LETTERS + packing._CAPITALS + marks
    for _ in range(4000):
        text = draw.choice(["", "", "don't", "I'LL", "<|endoftext|>", "naïve,"]) + "".join(draw.choices(alphabet, k=draw.randint(1, 9)))
        assert packing.token_ids(text, words).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END], repr(text)
