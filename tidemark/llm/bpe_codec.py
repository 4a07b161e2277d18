"""BPE encoding by backtracking, and decoding by an offset table.

Encoding takes, place by place, the longest token that an Aho-Corasick automaton found to
start there, and keeps it if merging would leave it beside the token before it. Pair
compatibility: as long as nothing merges across the border, both tokens form as they would
alone. What stands left of the border meanwhile are the tokens of the left one's right edge, each
from its own merge until the next one swallows it; likewise right of it. So a pair
fits unless one of the left edge and one of the right edge have a merge that comes before both are swallowed. A token that does not fit gives way to its longest
proper prefix in the vocabulary, and if none is left, the token before it is taken back.
Each place is given up once at most, so the work is linear in the text, and the result is
exactly that of ordered merging.

Decoding gathers stretches of one byte array by an offset table. No shuffle: each text is
encoded where it is read. Null text is empty: no ids, empty decoded text. A very long text is
encoded as a whole; a worker holds its pre-tokens at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PreTokens, Vocabulary
from .common import held, python_tasks

#: Most bytes of pre-tokens with their ids, and of token pairs, that a worker remembers; beyond it starts anew.
PIECE_BYTES, PAIR_BYTES = 64 << 20, 24 << 20
#: What a dictionary entry with its two objects takes besides their contents, and what an entry of two small objects takes.
ENTRY, SMALL_ENTRY = 210, 140


class Codec:
    def __init__(self, v: Vocabulary):
        self._v, self._split_text = v, PreTokens(v.added)
        self._length = [len(t) for t in v.tokens]
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        number = {t: i for i, t in enumerate(v.tokens)}
        for t, i in number.items():
            self._automaton.add_word(t.decode("latin-1"), i)
        self._automaton.make_automaton()
        # the longest proper prefix of each token that is a token, -1 if none
        self._shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in v.tokens]
        self._fits: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._piece_bytes = 0
        self._ids = np.array(v.ids, "<u4")
        by_id = dict(zip(v.ids, v.tokens)) | {i: s.encode() for s, i in v.added.items()}
        size = max(by_id) + 1
        self._offsets = np.concatenate([[0], np.cumsum([len(by_id.get(i, b"")) for i in range(size)])]).astype(np.int64)
        self._bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token, its left (0) or right (1) part, that part's part and so on to a byte; each with the number of the merge that swallows it."""
        out, until = [], 1 << 62
        while True:
            out.append((token, until))
            if token < 256:
                return out
            token, until = self._v.split[token][side], token

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a border between tokens a and b."""
        key = a << 32 | b
        if (known := self._fits.get(key)) is not None:
            return known
        merge = self._v.pairs.get
        fits = True
        for x, x_until in self._edge(a, 1):
            for y, y_until in self._edge(b, 0):
                # a merge's number grows with its rank; of equal pairs the leftmost merges first
                if (m := merge((x, y))) is not None and m < x_until and m <= y_until:
                    fits = False
        if len(self._fits) * SMALL_ENTRY > PAIR_BYTES:
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        """Own token numbers of one pre-token."""
        length, n = self._length, len(piece)
        longest = [-1] * (n + 1)
        for end, token in self._automaton.iter(piece.decode("latin-1")):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        open_at, out, at, token = bytearray(b"\1" * (n + 1)), [], 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if open_at[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                if self._shorter[token] >= 0:
                    token = self._shorter[token]
                    continue
                open_at[at] = 0
                out.pop()
                at, token = at - length[last], last
                break
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        memo = self._pieces
        pieces = self._split_text(text)
        found = list(map(memo.get, pieces))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    p = pieces[i]
                    if (x := memo.get(p)) is None:
                        x = np.uint32(self._v.added[p]).tobytes() if p in self._v.added else self._ids[self.encode_piece(p.encode("utf-8", "surrogatepass"))].tobytes()
                        if self._piece_bytes > PIECE_BYTES:
                            memo.clear()
                            self._piece_bytes = 0
                        memo[p] = x
                        self._piece_bytes += ENTRY + 4 * len(p) + len(x)
                    found[i] = x
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        x = np.frombuffer(ids, "<u4")
        lo, n = self._offsets[x], self._offsets[x + 1] - self._offsets[x]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(x) else np.zeros(0, np.int64)
        return self._bytes[at].tobytes().decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return held(("codec", path), lambda: Codec(Vocabulary(path)))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All other columns of ``docs`` and ``ids`` (binary: little-endian unsigned 32-bit integers), in place of one of that name."""
    python_tasks(docs.sparkSession)

    @F.pandas_udf("binary")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for texts in parts:
            yield pd.Series([c.encode(t) for t in texts], dtype=object)

    return docs.withColumn("ids", ids(F.coalesce(F.col(text), F.lit(""))))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All other columns of ``docs``, ``ids`` as :func:`encode` gives them and ``decoded`` as :func:`decode` does, by one pass and one codec a worker."""
    python_tasks(docs.sparkSession)

    @F.pandas_udf("ids binary, decoded string")
    def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for texts in parts:
            ids = [c.encode(t) for t in texts]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([c.decode(x) for x in ids], dtype=object)})

    out = docs.withColumn("coded", both(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumns({"ids": F.col("coded.ids"), "decoded": F.col("coded.decoded")}).drop("coded")


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All other columns and the decoded text, in place of a column ``out``; null ids are empty."""
    python_tasks(encoded.sparkSession)

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for x in parts:
            yield pd.Series([c.decode(bytes(b)) for b in x], dtype=object)

    return encoded.withColumn(out, text(F.coalesce(F.col(ids), F.lit(b""))))
