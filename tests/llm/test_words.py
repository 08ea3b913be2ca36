"""Words of the word encoder: marks and case make no words of their own."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from twinlens.llm.binary import WordEncoder

MODEL = public_tokenizers.path("word_bpe_49k.json")


def test_marks_and_case_make_no_new_words():
    own = WordEncoder(MODEL)
    own.encode(["Über, über. ÜBER! the (über)...", "The, THE. über"])
    assert sorted(own.new) == sorted(w.encode() for w in ["über", "the", ",", ".", "!", "(über", ")..."])


def test_texts_of_odd_characters_equal_the_library():
    own, library, draw = WordEncoder(MODEL), Tokenizer.from_file(MODEL), random.Random(3)
    latin = [*"aBÉßÿÞ19'._- \t", "'s", "'LL", "...", "``", "Å", "don't"]
    odd = [*latin, *"×÷½²µª«·\xa0\x85\xad\x1c\x0b\x00œİΣςé漢", "́", "<|", "|>", "<|endoftext|>"]
    texts = ["".join(draw.choice(some) for _ in range(draw.randint(0, 14))) for some in (latin, odd) for _ in range(3000)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.width).tolist() == library.encode(t, add_special_tokens=False).ids, t
