"""Toxicity by a weighted lexicon.

Texts are folded (look-alike letters, accents, digits and signs that stand for
letters) and searched by an Aho-Corasick automaton for words and word beginnings.
Weights are learned from labelled rows, phrases in which an entry is harmless take
it back, and the total is normalised by the text's length.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tablewright.llm.tables import fit_sample, labelled_sample, with_columns

SAMPLE, LONGEST = 6000, 20_000
THRESHOLD = 0.3
FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

# Entries known beforehand, phrases that take them back, letters that look alike, signs for letters.
SEED = ("idiot", "stupid", "moron", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "clown")
HARMLESS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "circus clown")
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏвкмнтαεορτυικνχ", "aeopcyxijsdhlbkmhtaeoptuiknx"))
SIGNS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "l"}
LIKE_ONE = {"l": "i"}
INVISIBLE = "­​‌‍⁠﻿"
PREFIXES = range(4, 8)


class Folding(dict):
    """Folds a character when it is first seen: lower case, no accent, one letter for look-alikes, a space for the rest."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = "" if c in INVISIBLE else "".join(self._letter(x) for x in unicodedata.normalize("NFKD", c.lower()))
        if len(self) < 100_000:
            self[code] = out
        return out

    @staticmethod
    def _letter(c: str) -> str:
        if unicodedata.combining(c):
            return ""
        c = SIGNS.get(c, c)
        c = LOOKALIKES.get(c, c)
        c = LIKE_ONE.get(c, c)
        return c if c.isalnum() else " "


def fold(text: str, folding: Folding) -> str:
    """The text with a space at each end, so that an entry can ask for the beginning or end of a word."""
    return f" {text.translate(folding)} "


class Lexicon:
    """Weighted entries, harmless phrases and the logistic curve from total weight and length to a score."""

    def __init__(self) -> None:
        self.folding = Folding()
        as_entry = lambda w: fold(w, self.folding)
        self.weights = {as_entry(w): 3.0 for w in SEED}
        self.harmless = {as_entry(p) for p in HARMLESS}
        self.curve = np.array([-2.0, 1.5, 0.0])

    def learn(self, rows: list[tuple[str, int, int]]) -> None:
        """Adds the words and word beginnings that mark toxic rows, harmless phrases, and fits the curve."""
        texts = [fold(r[0], self.folding) for r in rows]
        bad = [bool(r[2]) for r in rows]
        toxic, clean = sum(bad), len(bad) - sum(bad)
        if not toxic or not clean:
            return
        # In how many rows each word stands, then the same for the forms of the words.
        words = {b: Counter(w for t, x in zip(texts, bad) if x == b for w in set(t.split())) for b in (True, False)}
        most, other = (self._forms(words[b]) for b in (True, False))
        ratio = {f: math.log((n + 0.5) / (toxic + 1)) - math.log((other[f] + 0.5) / (clean + 1))
                 for f, n in most.items() if n >= max(5, toxic // 100)}
        # Shorter entries first: an entry that only lengthens a chosen one adds nothing.
        for f in sorted((f for f in ratio if ratio[f] > 4), key=lambda f: (len(f), f)):
            if not any(f[:k] in self.weights for k in range(2, len(f))):
                self.weights[f] = min(ratio[f], 6.0)
        self._learn_harmless(texts, bad)
        self._fit_curve(texts, np.array(bad, float))

    @staticmethod
    def _forms(words: Counter) -> Counter:
        found: Counter = Counter()
        for w, n in words.items():
            found[f" {w} "] += n
            for k in PREFIXES:
                if len(w) >= k:
                    found[f" {w[:k]}"] += n
        return found

    def _learn_harmless(self, texts: list[str], bad: list[bool]) -> None:
        """Two-word phrases around an entry that stand in three clean rows and in no toxic row."""
        around: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for text, b in zip(texts, bad):
            words = text.split()
            found = set()
            for i, w in enumerate(words):
                if f" {w} " in self.weights or any(f" {w[:k]}" in self.weights for k in PREFIXES):
                    found |= {f" {' '.join(words[j:j + 2])} " for j in (i - 1, i) if j >= 0 and len(words[j:j + 2]) == 2}
            around[b].update(found)
        self.harmless |= {p for p, n in around[False].items() if n >= 3 and not around[True][p]}

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in self.harmless:
            found.add_word(phrase, (len(phrase), 0.0))
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        found.make_automaton()
        return found

    def measure(self, folded: str, automaton) -> tuple[float, float]:
        """Logarithm of the total weight, and weight per 100 words."""
        hits = list(automaton.iter(folded))
        if not hits:
            return 0.0, 0.0
        spans = [(end - size, end) for end, (size, weight) in hits if not weight]
        total = sum(w for end, (size, w) in hits if w and not any(a <= end - size and end <= b for a, b in spans))
        return math.log1p(total), math.log1p(100 * total / (folded.count(" ") + 1))

    def _fit_curve(self, texts: list[str], target: np.ndarray) -> None:
        automaton = self.automaton()
        x = np.array([(1.0, *self.measure(t, automaton)) for t in texts])
        curve = np.zeros(3)
        for _ in range(30):  # Newton's method with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            slope = x.T @ (p - target) + 1e-2 * curve
            bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
            curve -= np.linalg.solve(bend, slope)
        self.curve = curve

    def score(self, text: str, automaton) -> float:
        margin = float(np.dot(self.curve, (1.0, *self.measure(fold(text, self.folding), automaton))))
        return 1 / (1 + math.exp(-max(min(margin, 50), -50)))


def learned(rows: list[tuple[str, int, int]]) -> tuple[dict, set, np.ndarray]:
    """Weights, harmless phrases and curve of the lexicon that has learned the rows."""
    lexicon = Lexicon()
    lexicon.learn(rows)
    return lexicon.weights, lexicon.harmless, lexicon.curve


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted.

    Learns from at most ``sample`` labelled rows of at most ``longest`` characters
    outside the held-out fold; without both labels among them the entries known
    beforehand stand alone. Null texts count as empty and have the score of a text
    without an entry. Null ids and repeated rows are scored like others; columns named
    score or predicted are replaced. An empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_sample(labelled_sample(docs, labels, "toxic", sample, longest), learned))

    def work():
        known = Lexicon()
        known.weights, known.harmless, known.curve = model.value
        automaton = known.automaton()

        def run(array: pa.Array) -> dict[str, np.ndarray]:
            found = np.array([known.score(t.as_py() or "", automaton) for t in array], float)
            return {"score": found, "predicted": (found >= threshold).astype(np.int32)}
        return run

    return with_columns(docs, "text", FIELDS, work)
