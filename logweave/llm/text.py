"""Words, word hashes and k-gram hashes of UTF-8 texts, for use inside Arrow tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: Maps A-Z to a-z and every ASCII character that is no letter or digit to a space; bytes of non-ASCII characters stay.
_ALNUM = bytes((c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20) for c in range(256))
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE = 0xD6E8FEB86659FD93


def alnum_text(text: bytes | None) -> bytes:
    """A text of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with spaces between, after lower-casing A-Z; null is empty."""
    return text.translate(_ALNUM) if text else b""


def alnum_words(text: bytes | None) -> list[bytes]:
    """The words of ``alnum_text``."""
    return alnum_text(text).split()


def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged; null has none."""
    return text.split() if text else []


def lowered_space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; null has none."""
    return text.lower().split() if text else []


class _Powers:
    """Powers of the odd multiplier and of its inverse modulo 2^64, as far as texts have needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 14)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, m, dtype=np.uint64)])) for m in (np.uint64(_BYTE), np.uint64(pow(_BYTE, -1, 1 << 64))))
        return self.up, self.down


_POWERS = _Powers()
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Longer texts are hashed in parts that end at white space.
_PART = 1 << 18


def hashed_words(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``: polynomials of their bytes from one running sum, scrambled."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    codes = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(codes) + 2, dtype=bool)
    np.logical_not(_SPACES[codes], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(codes) <= _PART:
        return _polynomials(codes, starts, ends)
    out, first = [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _PART, side="right")))
        a, b = starts[first], ends[last - 1]
        out.append(_polynomials(codes[a:b], starts[first:last] - a, ends[first:last] - a))
        first = last
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _polynomials(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _POWERS.to(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values = values * np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes; empty when there are fewer. Runs are joined by doubling."""
    if len(words) < k:
        return np.empty(0, dtype=np.uint64)
    run, size, out, done = words, 1, None, 0
    while True:
        if k & size:
            tail = run[done : len(words) - size + 1] if done else run
            out = tail if out is None else out[: len(words) - done - size + 1] * _power(size) + tail
            done += size
        if done == k:
            return mixed(out)
        run = run[: len(run) - size] * _power(size) + run[size:]
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MULTIPLIER, n, 1 << 64))


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` consecutive values, by doubling."""
    n = len(values) - span + 1
    if n <= 0:
        return values[:0]
    size = 1
    while 2 * size <= span:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[span - size : span - size + n])


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed longs."""
    return np.ascontiguousarray(values).view(np.int64)


def free_memory() -> None:
    """Give freed memory back to the system, where the C library can: workers wait for their next task with it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
