"""Words, lines and hashes of many texts at once, on the bytes of an Arrow column.

A text column arrives as one byte buffer with offsets. Everything here works on
arrays over such a buffer, a few megabytes at a time, without a Python object
per word. Null texts count as empty. Hashes are 64 bits wide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The white space that separates words (space, and 9 to 13).
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20_240_607).integers(1, 2**64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}
#: The lowest bytes of a word, by how many.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_chunks(array: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text is a run alone."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    n = len(array)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, where, values = array.buffers()
    offsets = np.frombuffer(where, width)[array.offset:array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that every bit depends on every bit."""
    # In place from the first step on: a long array would be made and thrown away for each.
    y = x >> np.uint64(30)
    y ^= x
    y *= _MIX_A
    y ^= y >> np.uint64(27)
    y *= _MIX_B
    y ^= y >> np.uint64(31)
    return y


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of ``x`` in order, each once; of a few hundred numbers much sooner than np.unique, which hashes them first."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[:len(x)]]


def _power(name: str, base: int, n: int) -> np.ndarray:
    kept = _powers.get(name)
    if kept is None or len(kept) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        kept = _powers[name] = np.multiply.accumulate(steps)
    return kept[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span of ``data`` follows; see :func:`span_hashes`."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that depend on the bytes in them only."""
    down = _power("down", pow(_BASE, -1, 2**64), len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each byte span, as two words: up to 15 bytes are their own name, with their number; longer spans have a digest."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    # Eight bytes from any place on, first byte lowest.
    wide = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))
    low = wide[starts] & _FIRST[np.minimum(size, 8)]
    high = (wide[starts + 8 * (size > 8)] & _FIRST[np.clip(size - 8, 0, 7)]) | (np.minimum(size, 15).astype(np.uint64) << np.uint64(56))
    long_ = np.flatnonzero(size > 15)
    if len(long_):
        view = memoryview(padded)
        digests = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts[long_].tolist(), ends[long_].tolist())])
        halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
        low[long_], high[long_] = halves[:, 0], halves[:, 1] | np.uint64(1 << 63)
    return high, low


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words: runs of bytes that are not white space."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the lines between line feeds; a text has one line at least."""
    feeds = np.flatnonzero(data == 0x0A)
    rows = np.searchsorted(offsets, feeds, "right") - 1
    n = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    ends = np.concatenate([feeds, offsets[1:]])
    row_of_start = np.concatenate([np.arange(n), rows])
    row_of_end = np.concatenate([rows, np.arange(n)])
    by_start, by_end = np.lexsort((starts, row_of_start)), np.lexsort((ends, row_of_end))
    return starts[by_start], ends[by_end], row_of_start[by_start]


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` successive values of one row, and where each begins."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    end = len(hashes) - n + 1
    at = np.flatnonzero(rows[:end] == rows[n - 1:])
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = mix(total * _ODD + hashes[at + k])
    return total, at


def sums_of(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row, how many of its bytes are flagged."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeats(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of values seen twice or more in their row, and of those that repeat an earlier one."""
    keys = mix(hashes + rows.astype(np.uint64) * _ODD)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    more, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    return more, again
