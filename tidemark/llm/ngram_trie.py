"""Elias-Fano coded trie of bigrams in memory-mapped levels, queried in numpy for many keys at once."""

from __future__ import annotations

import tempfile

import numpy as np

#: Bits of a follower's hash that the second level keeps.
FOLLOWER_BITS = 40
#: A probability p is kept as round(-log2(p) * STEPS); NONE stands for 0.
STEPS, NONE = 2000, 65535
#: Keys that are searched at a time.
STEP = 1 << 17


def quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log2(np.maximum(p, 2.0**-32)) * STEPS), NONE - 1).astype(np.uint16)


#: The value of each code.
VALUES = np.append(2.0 ** (-np.arange(NONE) / STEPS), 0.0)


class EliasFano:
    """A monotone sequence below ``universe``: of each value the low bits, packed without gaps, and the high bits in unary.

    In the unary bits value i is a one behind as many zeros as its high part; so the i-th one
    gives its high part, and the values of a high part stand between two zeros. ``ranks``
    counts the ones before each 64-bit word; a select finds the word there, then the bit in
    the word. ``write`` gives named arrays; the object itself reads such arrays, mapped or not.
    """

    @staticmethod
    def write(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64)
        size = n + (max(0, universe - 1) >> bits) + 2
        unary = np.zeros(-(-size // 64) * 64, bool)
        unary[high + np.arange(n)] = True
        words = np.packbits(unary, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return {"head": np.array([n, bits, size], np.uint64), "unary": words, "ranks": ranks.astype(np.uint32), "low": _packed(values, bits)}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self._bits, self._size = (int(x) for x in arrays["head"])
        self._unary, self._ranks, self._low = arrays["unary"], arrays["ranks"], arrays["low"]
        self._mask = np.uint64((1 << self._bits) - 1)

    def _select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Places of the i-th ones, or zeros, of the unary bits."""
        before = self._ranks if one else np.arange(len(self._ranks), dtype=np.int64) * 64 - self._ranks
        word = np.searchsorted(before, i, "right") - 1
        rest = i - before[word].astype(np.int64)
        bits = self._unary[word] if one else ~self._unary[word]
        place = np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the half of the word that holds it
            low = bits & np.uint64((1 << half) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            upper = rest >= count
            rest = np.where(upper, rest - count, rest)
            place += np.where(upper, half, 0)
            bits = np.where(upper, bits >> np.uint64(half), low)
        return word * 64 + place

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self._bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self._bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self._low[word] >> off
        over = np.flatnonzero(off + np.uint64(self._bits) > 64)
        out[over] |= self._low[word[over] + 1] << (np.uint64(64) - off[over])
        return out & self._mask

    def values(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self._bits) | self._low_at(i)

    def find(self, x: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value within its range of places, -1 where absent: its successor among the values of the same high part, compared."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        for at in range(0, len(x), STEP):
            part = slice(at, at + STEP)
            out[part] = self._find(x[part], *(None if r is None else r[part] for r in (start, end)))
        return out

    def _find(self, x: np.ndarray, start: np.ndarray | None, end: np.ndarray | None) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        high = (x >> np.uint64(self._bits)).astype(np.int64)
        low = x & self._mask
        inside = high < self._size - self.n
        h = np.where(inside, high, 0)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        hi = self._select(h, False) - h
        if start is not None:
            lo, hi = np.maximum(lo, start), np.minimum(hi, end)
        last, todo = hi.copy(), np.flatnonzero(inside & (lo < hi))
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low_at(mid) < low[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        there = np.flatnonzero(inside & (lo < last))
        there = there[self._low_at(lo[there]) == low[there]]
        out[there] = lo[there]
        return out


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, one after the other, in 64-bit words."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if not bits or not len(values):
        return out
    low = values & np.uint64((1 << bits) - 1)
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
    word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    heads = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    out[word[heads]] = np.bitwise_or.reduceat(low << off, heads)
    over = np.flatnonzero(off + np.uint64(bits) > 64)  # one a word at most
    out[word[over] + 1] |= low[over] >> (np.uint64(64) - off[over])
    return out


class Trie:
    """Level 1: word hashes with their counts and back-off weights, and pointers to where each word's followers begin in level 2. Level 2: the followers of each word.

    Words, pointers and followers are Elias-Fano sequences. So that the second level grows
    throughout, a follower's hash stands behind the place of its word (context-relative);
    it is searched from one pointer to the next. ``followers`` has (place of the word <<
    FOLLOWER_BITS) + hash.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, followers: np.ndarray, follower_counts: np.ndarray, pull: float):
        place = (followers >> np.uint64(FOLLOWER_BITS)).astype(np.int64)
        pointers = np.searchsorted(place, np.arange(len(words) + 1)).astype(np.uint64)
        levels = {f"words.{k}": a for k, a in EliasFano.write(words, 1 << 64).items()}
        levels |= {f"pointers.{k}": a for k, a in EliasFano.write(pointers, len(followers) + 1).items()}
        levels |= {f"followers.{k}": a for k, a in EliasFano.write(followers, max(1, len(words)) << FOLLOWER_BITS).items()}
        levels["counts"] = counts.astype(np.int64)
        levels["backoff"] = quantise(pull / (counts + pull))
        levels["value"] = quantise(follower_counts / (counts[place] + pull))
        self._file = tempfile.TemporaryFile()  # the task's own, gone with the object
        self._levels, at = {}, []
        for a in levels.values():
            self._file.write(b"\0" * (-self._file.tell() % 8))
            at.append(self._file.tell())
            self._file.write(a.tobytes())
        self._file.flush()
        for (name, a), start in zip(levels.items(), at):
            self._levels[name] = np.memmap(self._file, a.dtype, "r", start, a.shape) if a.size else a
        part = lambda head: EliasFano({k[len(head) :]: a for k, a in self._levels.items() if k.startswith(head)})
        self._words, self._pointers, self._followers = part("words."), part("pointers."), part("followers.")

    def find_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (-1: absent), counts and codes of the back-off weights."""
        at = self._words.find(words)
        known = at >= 0
        counts, backoff = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint16)  # code 0: weight 1
        counts[known], backoff[known] = self._levels["counts"][at[known]], self._levels["backoff"][at[known]]
        return at, counts, backoff

    def find_followers(self, places: np.ndarray, each: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Codes of the smoothed probabilities of ``hashes``, of which the first ``each[0]`` follow the word at ``places[0]`` and so on; NONE where the pair is absent."""
        out = np.full(len(hashes), NONE, np.uint16)
        if not self._words.n:
            return out
        known = np.maximum(places, 0)
        start, end = (np.repeat(self._pointers.values(known + i).astype(np.int64), each) for i in (0, 1))
        whose = np.repeat(places, each)
        some = np.flatnonzero(whose >= 0)
        at = self._followers.find((whose[some].astype(np.uint64) << np.uint64(FOLLOWER_BITS)) | hashes[some], start[some], end[some])
        out[some[at >= 0]] = self._levels["value"][at[at >= 0]]
        return out
