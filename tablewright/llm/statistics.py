"""Statistics of whole texts that the quality rules and the quality classifier share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tablewright.llm import text as tx

# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbols", "bars", "shouts", "capitals", "word_length", "repeats", "same_again", "dup_lines", "digits", "stops")


def _flags(characters: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[[ord(c) for c in characters]] = True
    return flags


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts by name, and a matrix of the shares, one row for each text.

    n_repeat_words counts the words inside 8-word windows found twice or more in their
    text, the first included; n_dup_lines the lines with a word that equal an earlier line.
    """
    n = len(offsets) - 1
    starts, ends, rows = tx.words(data, offsets)
    sums = tx.prefix_sums(data)
    hashes = tx.span_hashes(sums, starts, ends)
    count = np.bincount(rows, minlength=n)
    solid = ~tx.IS_SPACE[data]
    counts = {"n_words": count, "word_chars": tx.sums_of(solid & ((data & 0xC0) != 0x80), offsets),
              "n_symbols": tx.sums_of(_flags(SYMBOLS)[data], offsets)}
    line_starts, line_ends, line_rows = tx.lines(data, offsets)
    solids = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=solids[1:])
    full = solids[line_ends] > solids[line_starts]
    line_rows = line_rows[full]
    _, again = tx.repeats(tx.span_hashes(sums, line_starts[full], line_ends[full]), line_rows)
    counts["n_dup_lines"] = np.bincount(line_rows[again], minlength=n)
    windows, at = tx.ngrams(hashes, rows, WINDOW)
    more, _ = tx.repeats(windows, rows[at])
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, at[more], 1)
    np.add.at(cover, at[more] + WINDOW, -1)
    counts["n_repeat_words"] = np.bincount(rows[np.cumsum(cover)[:-1] > 0], minlength=n)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])) + 1
    per_word, letters = np.maximum(count, 1), np.maximum(tx.sums_of(((data | 32) >= 97) & ((data | 32) <= 122), offsets), 1)
    lines = np.maximum(np.bincount(line_rows, minlength=n), 1)
    shares = np.stack([
        counts["n_symbols"] / per_word, tx.sums_of(data == ord("|"), offsets) / per_word,
        tx.sums_of(_flags("!?")[data], offsets) / per_word, tx.sums_of((data >= 65) & (data <= 90), offsets) / letters,
        counts["word_chars"] / per_word / 10, counts["n_repeat_words"] / per_word, np.bincount(rows[same], minlength=n) / per_word,
        counts["n_dup_lines"] / lines, tx.sums_of((data >= 48) & (data <= 57), offsets) / per_word,
        tx.sums_of(_flags(".,;:")[data], offsets) / per_word], axis=1)
    return counts, np.sqrt(shares)


def of_texts(array: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """:func:`statistics` of an Arrow column; nulls count as empty."""
    parts = [statistics(data, offsets) for _, _, data, offsets in tx.byte_chunks(array, 1 << 18)]
    if not parts:
        return {c: np.zeros(0, np.int64) for c in COUNTS}, np.zeros((0, len(SHARES)))
    return {c: np.concatenate([p[0][c] for p in parts]) for c in COUNTS}, np.concatenate([p[1] for p in parts])
