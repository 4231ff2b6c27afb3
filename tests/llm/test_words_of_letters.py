"""Words of letters alone are one part and need no pattern."""

import random
import re

import numpy as np
import tokenizers

from tablewright.llm import packing
from tablewright.llm.queries import tokenizer_path


def test_words_of_letters_need_no_pattern(monkeypatch):
    path, cuts, draw = tokenizer_path("word_bpe_49k.json"), [], random.Random(5)
    real = tokenizers.Tokenizer.from_file(path)

    class Seen:
        def __init__(self, pattern):
            self.inner = re.compile(pattern)
            self.fullmatch = self.inner.fullmatch

        def findall(self, text):
            cuts.append(text)
            return self.inner.findall(text)

    monkeypatch.setattr(packing, "re", type("R", (), {"compile": staticmethod(Seen)}))
    ids_of = packing.word_ids(path)
    letters = "abcdefgXYZ" + "".join(chr(c) for c in range(0xC0, 0x17F) if c not in (0xD7, 0xF7, 0x130))
    words = ["Hello", "ÉCOLE", "straße", "x", *letters, *("".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(500))]
    for word in words:
        assert np.frombuffer(ids_of[word], "<u4").tolist() == real.encode(word, add_special_tokens=False).ids
    assert not cuts
    assert np.frombuffer(ids_of["don't!"], "<u4").tolist() == real.encode("don't!", add_special_tokens=False).ids
    assert cuts
