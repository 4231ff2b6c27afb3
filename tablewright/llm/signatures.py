"""MinHash signatures and bands, on arrays of 64-bit set members."""

from __future__ import annotations

import numpy as np

from tablewright.llm import text as tx


def universal(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` multiply-shift hash functions."""
    drawn = np.random.default_rng(seed).integers(0, 2**64, (2, n), dtype=np.uint64)
    return drawn[0] | np.uint64(1), drawn[1]


def signatures(members: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima, as rows of uint32, for each run of ``members`` that begins at ``starts``."""
    factors, summands = universal(n)
    out = np.empty((len(starts), n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((members * factors[k] + summands[k]) >> np.uint64(32), starts)
    return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each signature: a hash of ``rows`` of its minima, chosen for each band."""
    keys = np.empty((len(signature), bands), np.uint64)
    draw = np.random.default_rng(13)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for k in draw.choice(signature.shape[1], rows, replace=False):
            key = key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k]
        keys[:, b] = tx.mix(key)
    return keys.view(np.int64)


def fast_signatures(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Like :func:`signatures` with 32-bit hash functions, which are enough for the sets of one line."""
    factors, summands = (x >> np.uint64(32) for x in universal(n))
    factors, summands = factors.astype(np.uint32) | np.uint32(1), summands.astype(np.uint32)
    base = (shingles >> np.uint64(32)).astype(np.uint32)
    # Each minimum in a row of its own, from one buffer.
    out, hashed = np.empty((n, len(starts)), np.uint32), np.empty_like(base)
    for k in range(n):
        np.multiply(base, factors[k], out=hashed)
        np.add(hashed, summands[k], out=hashed)
        np.minimum.reduceat(hashed, starts, out=out[k])
    return out.T
