"""Token counts with the whole-token shortcut.

Once per vocabulary, on the driver, every token string is merged alone; those that come out
as one token are proven whole. In the texts a pre-token that equals a whole token counts 1
without merging; only the rest is merged, with a bounded memo of what was merged before.
No shuffle: each text is counted where it is read.

Null text is empty (0 tokens). Strings of added tokens inside a text count as that token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PreTokens, Vocabulary
from .common import held, python_tasks, unclashed

#: Most bytes of pre-tokens that a worker remembers besides the whole tokens, and what an entry takes besides its text.
MEMO_BYTES, ENTRY = 64 << 20, 190


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token. Strings that are no valid UTF-8 can't be a pre-token."""
    v = Vocabulary(path)
    out = set()
    for t in v.tokens:
        if len(v.merge(t)) == 1:
            try:
                out.add(t.decode())
            except UnicodeDecodeError:
                pass
    return frozenset(out | v.added.keys())


class Counter:
    def __init__(self, path: str, whole: frozenset[str]):
        self._v, self._whole, self._memo = Vocabulary(path), dict.fromkeys(whole, 1), {}
        self._memo.update(self._whole)
        self._bytes = 0
        self._split = PreTokens(self._v.added)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        memo, n = self._memo, 0
        pieces = self._split(text)
        for p, c in zip(pieces, map(memo.get, pieces)):
            if c is None and (c := memo.get(p)) is None:
                c = len(self._v.merge(p.encode("utf-8", "surrogatepass")))
                if self._bytes > MEMO_BYTES:
                    memo.clear()
                    memo.update(self._whole)
                    self._bytes = 0
                memo[p] = c
                self._bytes += ENTRY + 4 * len(p)
            n += c
        return n


def apply(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of ``keep``, ``n_bytes`` and ``n_tokens`` of each whole text. ``path``: a byte-level BPE file that executors can read."""
    spark = docs.sparkSession
    python_tasks(spark)
    whole = spark.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = held(("counter", path), lambda: Counter(path, whole.value))
        for texts in parts:
            yield pd.Series([counter(t) for t in texts], dtype="int64")

    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*unclashed(keep, "n_bytes", "n_tokens"), F.octet_length(t).cast("long").alias("n_bytes"), count(t).alias("n_tokens"))
