"""Hashes of words and word windows of a whole text, in numpy without a loop over words.

A text's words are joined by single blanks; ``prefix`` holds a polynomial hash of every
prefix modulo 2**64, so any stretch of bytes has its hash by one subtraction and one
product. A final mixing step spreads the bits.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 20
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, 2 * len(_powers), 1 << 16)
        for name, base in (("_powers", _P), ("_inverses", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of a text split at ASCII white space, A-Z lower-cased; place i spans bytes starts[i]:ends[i] of ``joined``."""

    def __init__(self, text: str | None):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        self.n = len(words)
        self.joined = b" ".join(words)
        self._raw = np.frombuffer(self.joined, np.uint8)
        gaps = np.flatnonzero(self._raw == 32)
        self.starts = np.concatenate([[0], gaps + 1]).astype(np.int64)[: self.n]
        self.ends = np.concatenate([gaps, [len(self._raw)]]).astype(np.int64)[: self.n]

    def windows(self, k: int) -> np.ndarray:
        """Hash of each k-word window, by place; fewer words make one window, none make none."""
        if not self.n:
            return np.zeros(0, np.uint64)
        k = min(k, self.n)
        lo, hi = self.starts[: self.n - k + 1], self.ends[k - 1 :]
        out = np.empty(len(lo), np.uint64)
        at = 0
        while at < len(lo):  # a long text by stretches, which share no more than their ends
            end = max(at + 1, int(np.searchsorted(hi, lo[at] + STRETCH, "right")))
            own = self._raw[lo[at] : hi[end - 1]]
            _grow(len(own))
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[own] * _powers[: len(own)], dtype=np.uint64)])
            x, y = lo[at:end] - lo[at], hi[at:end] - lo[at]
            out[at:end] = mix((prefix[y] - prefix[x]) * _inverses[x] + (y - x).astype(np.uint64))
            at = end
        return out
