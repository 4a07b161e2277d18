"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Normalising lower-cases A-Z and keeps words of letters, digits and all non-ASCII
characters. The automaton runs over word numbers, so one step a word scans a text once;
its keys are all windows of ``window`` consecutive item words (a shorter item is one
window). Hits are mapped back to code points of the original text.

The items are held in blocks of about ``block_words`` words, a bound on what is broadcast and
on a worker's automaton. A larger benchmark adds passes over the texts, one block after
the other; between passes the texts and their hits so far are written to the shared folder. No shuffle.

Null or empty texts have no words; null items and items without words have no window; items
with a null id mark words but are not listed. Equal windows of several items list each. A very
long text is scanned as a whole; a worker holds its word numbers at once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, held, lower_ascii, materialize, python_tasks, unclashed, words_of

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Separators become blanks, A-Z lower case; bytes of non-ASCII characters stay.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Windows:
    def __init__(self, items: Sequence[tuple[str | None, str]], window: int):
        self._number: dict[bytes, int] = {}
        keys: dict[tuple[int, ...], list[str | None]] = {}
        for item, text in items:
            words = [self._number.setdefault(w, len(self._number) + 1) for w in normalised(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                keys.setdefault(tuple(words[i : i + window]), []).append(item)
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, found in keys.items():
            self._automaton.add_word(key, (len(key), frozenset(found)))
        self._any = bool(keys)
        if keys:
            self._automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged stretches of hit words (first, behind the last), and the items."""
        stretches: list[tuple[int, int]] = []
        items: set[str | None] = set()
        if not self._any or not words:
            return stretches, items
        of = self._number.get
        for last, (n, found) in self._automaton.iter(tuple([of(w, 0) for w in words])):
            lo = last + 1 - n
            while stretches and stretches[-1][1] >= lo:
                lo = min(lo, stretches.pop()[0])
            stretches.append((lo, last + 1))
            items |= found
        return stretches, items


def apply(docs: DataFrame, items: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """Columns of ``keep``, ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted) and ``spans`` (start, end in code points of the original, by place).

    A column of ``keep`` with the name of one of these is replaced by it.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    own = items.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    n_words = own.agg(F.sum(F.size(words_of(lower_ascii(F.col("text")), NON_WORD)))).first()[0] or 0
    n_blocks = n_words // block_words + 1
    own = own.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)))
    keep = unclashed(keep, "n_words", "n_hit", "items", "spans")
    found = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast(_FOUND).alias("found"))
    for b in range(n_blocks):
        if b:
            found = materialize(found, f"hits-{b - 1}")
        block = [(r["item"], r["text"]) for r in own.where(F.col("block") == b).toLocalIterator()]
        found = found.withColumn("found", _scan(spark.sparkContext.broadcast(block), window)("text", "found"))
    return found.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "found.n_words", "found.n_hit", "found.items", "found.spans")


_FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>,hit:array<int>>"


def _scan(block: Broadcast, window: int):
    """UDF of a text and what earlier blocks found."""
    name = uuid.uuid4().hex

    @F.pandas_udf(_FOUND)
    def scan(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        windows = held(("windows", name), lambda: Windows(block.value, window))
        for texts, before in parts:
            rows = []
            for t, old_items, old_hit in zip(texts, before["items"], before["hit"]):
                words = normalised(t)
                stretches, ids = windows.find(words)
                hit = {i for lo, hi in stretches for i in range(lo, hi)}.union(old_hit if old_hit is not None else ())
                found = sorted({x for x in ids if x is not None}.union(old_items if old_items is not None else ()))
                order = sorted(hit)
                rows.append((len(words), len(hit), found, _places(t, order) if hit else [], order))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans", "hit"])

    return scan


def _places(text: str, hit: list[int]) -> list[dict[str, int]]:
    """Stretches of neighbouring hit words as places in the original text."""
    words = [m.span() for m in _WORD.finditer(text)]
    out: list[dict[str, int]] = []
    for i, j in zip([None, *hit], hit):
        if i is not None and j == i + 1:
            out[-1]["end"] = words[j][1]
        else:
            out.append({"start": words[j][0], "end": words[j][1]})
    return out
