"""Vectorised hashing of words and bytes for tasks. Hashes are 64 bits and equal in every process."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multiplier of all polynomials modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes A-Z to a-z; all others stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of uint64 values."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


class Powers:
    """Tables of the multiplier's powers, grown on demand and kept between batches."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up) - 1:
            n = max(n, 2 * PIECE)
            self.up, self.down = powers(n, BASE), powers(n, INVERSE)
        return self.up, self.down


class Bytes:
    """Hash of any stretch of one byte array."""

    table = mix(np.arange(1, 257, dtype=U) * U(BASE))

    def __init__(self, data: np.ndarray, tables: Powers) -> None:
        up, self.down = tables.to(len(data))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: bytes, tables: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words between U+0020 and U+0009 to U+000D; long input goes piece by piece, cut at white space."""
    raw = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:
            ahead = np.flatnonzero(_SPACE[raw[end : end + PIECE]])
            end = end + int(ahead[0]) if len(ahead) else min(len(raw), end + PIECE)
        part = raw[at:end]
        space = np.ones(len(part) + 2, bool)
        space[1:-1] = _SPACE[part]
        edges = np.flatnonzero(space[1:] != space[:-1])
        a, b = edges[::2], edges[1::2]
        starts.append(a + at)
        hashes.append(Bytes(part, tables).of(a, b))
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, U))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for k in range(n):
        out = out * U(BASE) + mix(h[k : k + len(out)] + U(k + 1))
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of every ``n`` consecutive ones, in two passes over blocks of ``n``."""
    m = len(x) - n + 1
    if m <= 0:
        return np.zeros(0, x.dtype)
    full = np.concatenate([x, np.full(-len(x) % n, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, n)
    before = np.minimum.accumulate(full, axis=1).ravel()
    after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[n - 1 : n - 1 + m])
