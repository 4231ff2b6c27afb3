"""Stretches of text are cut as the tokenizer cuts them, common ones without its slow steps."""

import random

import numpy as np
import tokenizers

from tablewright.llm import packing
from tablewright.llm.queries import tokenizer_path


class Counted:
    """A tokenizer that counts how often its own cutting is asked for."""

    def __init__(self, inner):
        self.inner, self.calls, self.model, self.normalizer, self.pre_tokenizer, self.encode = inner, 0, inner.model, inner.normalizer, self, inner.encode

    def pre_tokenize_str(self, text):
        self.calls += 1
        return self.inner.pre_tokenizer.pre_tokenize_str(text)


def test_latin_letters_are_cut_like_the_tokenizer_does(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    real = tokenizers.Tokenizer.from_file(path)
    counted = Counted(real)
    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_file": staticmethod(lambda _: counted)}))
    ids_of, draw = packing.word_ids(path), random.Random(3)
    before = counted.calls
    letters = [chr(c) for c in range(0xC0, 0x17F) if c not in (0xD7, 0xF7, 0x130)] + list("abcXYZ019'!.,-")
    words = ["Élève,", "l'été", "œuvre", "Straße!", "ça'll", "čeština12", *letters]
    words += ["".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(2000)]
    for word in words:
        assert np.frombuffer(ids_of[word], "<u4").tolist() == real.encode(word, add_special_tokens=False).ids
    assert counted.calls == before
    # Anything else still takes the tokenizer's own steps.
    for word in ["İstanbul", "ſo", "été", "3×4", "日本", "Ωmega", "a\x01b", "ŉ́"]:
        assert np.frombuffer(ids_of[word], "<u4").tolist() == real.encode(word, add_special_tokens=False).ids
    assert counted.calls > before
