"""64-bit hashes of words and word windows, whole batches at a time.

A word is a run of bytes that are not ASCII white space.  A word's hash is a sum
of byte codes times powers of an odd number modulo 2^64; running sums give all
words of a batch without making word objects.  A window's hash is such a sum
over its words, and the hash of twice the length comes from two hashes of the
single length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20_240_501))
_CODES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
_STEP = int(_rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    """Powers for one chunk, made on first use in each process."""

    size = 0

    @classmethod
    def upto(cls, n: int) -> None:
        if cls.size < n:
            cls.size = max(n, CHUNK_BYTES + 1)
            cls.up = _powers(_BASE, cls.size)
            cls.down = _powers(pow(_BASE, -1, 1 << 64), cls.size)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff((~_WHITE[data]).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    _Tables.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _Tables.up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _Tables.down[starts]), starts


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at white space so that no word is split."""
    at = 0
    while len(raw) - at > CHUNK_BYTES:
        cut = max(raw.rfind(c, at, at + CHUNK_BYTES) for c in (b" ", b"\n", b"\t", b"\r"))
        if cut <= at:
            later = [p for p in (raw.find(c, at + CHUNK_BYTES) for c in (b" ", b"\n", b"\t", b"\r")) if p >= 0]
            cut = min(later, default=len(raw))
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def text_hashes(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """One array of word hashes per text, in order.

    Short texts share a chunk; a long one is hashed in parts.
    """
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if group:
            hashes, starts = _hashes(b"\n".join(group))
            borders = np.cumsum([len(g) + 1 for g in group])[:-1]
            yield from np.split(hashes, np.searchsorted(starts, borders))

    for text in texts:
        raw = text.encode()
        if size + len(raw) > CHUNK_BYTES:
            yield from flush()
            group, size = [], 0
        if len(raw) > CHUNK_BYTES:
            yield np.concatenate([_hashes(p)[0] for p in _pieces(raw)])
        else:
            group.append(raw)
            size += len(raw) + 1
    yield from flush()


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words: doubled from shorter ones, bit by bit of the length."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    done, done_length, power, size = None, 0, words, 1
    left = length
    while left:
        if left & 1:
            shift = np.uint64(pow(_STEP, done_length, 1 << 64))
            done = power if done is None else done[: len(power) - done_length] + power[done_length:] * shift
            done_length += size
            n = len(words) - done_length + 1
            done = done[:n]
        left >>= 1
        if left:
            power = doubled(power, size)
            size *= 2
    return done


def doubled(single: np.ndarray, length: int) -> np.ndarray:
    """Hashes of windows of twice the length from those of the single length."""
    return single[:-length] + single[length:] * np.uint64(pow(_STEP, length, 1 << 64))
