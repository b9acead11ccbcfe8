"""Vectorised rolling hashes over bytes and words (numpy, modulo 2**64)."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n; kept and grown by doubling."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, _INV)]
    return _powers[0][: n + 1], _powers[1][: n + 1]


def forget() -> None:
    """Drop the powers kept for the longest text so far."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed hash of values[start:end] for each span."""
    n = len(values)
    up, down = powers(n)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:n], dtype=np.uint64)])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values."""
    starts = np.arange(max(0, len(values) - k + 1))
    return span_hashes(values, starts, starts + k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Byte classes of words: runs without white space, and runs of digits,
#: letters a-z and whatever is not ASCII (after lower-casing A-Z).
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words_of(text: str | None, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the starts and ends of the words in them."""
    data = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.concatenate([[False], kind[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return data, edges[::2], edges[1::2]


def word_hashes(text: str | None, kind: np.ndarray) -> np.ndarray:
    data, starts, ends = words_of(text, kind)
    return span_hashes(byte_values(data), starts, ends)
