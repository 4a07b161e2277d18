"""How text filters overlap: what each removes in every order of application, from sorted posting lists.

A posting list holds, for one part of the corpus and one filter, the documents that fail it,
as sorted places in the part's sorted ids. Ids are dealt into ranges (``block_ids`` of them at
most), so no part, however large, is one list: a range's lists are one row of :func:`postings`.
Unions and differences of lists are formed within a range by galloping, each list's ids being
searched for in the union built so far, filter by filter; sizes add up over ranges.

Filters (failure conditions), words being runs of bytes without ASCII white space:
A under 200 words, B 100 * distinct words < 50 * words, C 100 * letters A-Z > 2 * code points,
D holds one of ``#$%&*|``, E same text as a document with a smaller id, in whichever part.

Null text is empty. A null part is the empty string's. Rows without an id come after all ids:
they fail E where some row with an id has their text, and never make another fail. Rows that
share an id are counted each for itself and are no copies of one another. No rows give no rows.
Labels are looked up by id: a document is good (toxic) if any of its label rows says so.
A very long text is read as a whole, alone in its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, let_go, materialize, python_tasks

FILTERS = "ABCDE"
#: Bounds of the filters (fixed values of the contract).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
#: Most ids of a range, and so most places of a posting list.
BLOCK_IDS = 65_536
_ALL = (1 << len(FILTERS)) - 1
_LISTS = (*[f"fails_{f}" for f in FILTERS], "good", "toxic")


def fails(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # of bytes: parts at blank, tab, LF, VT, FF, CR
    n, capitals = len(words), len(text) - len(text.translate(None, UPPER.encode()))
    checks = (n < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * n_chars, len(text.translate(None, MARKS)) < len(text))
    return sum(failed << i for i, failed in enumerate(checks))


def facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id, part, fails`` (bits A to D) and ``digest`` (SHA-256 of the text) of each row, in one pass over the texts."""
    python_tasks(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.length(t).alias("n_chars"), t.cast("binary").alias("t"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            texts = [x.as_py() for x in b["t"]]
            bits = [fails(x, n) for x, n in zip(texts, b["n_chars"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["part"], pa.array(bits, pa.int32()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())], ["doc_id", "part", "fails", "digest"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, part string, fails int, digest binary")


def postings(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row a range of ids of a part: ``part``, sorted ``ids``, ``weights`` (rows of each entry) and the sorted places of those that fail each filter, are good, are toxic.

    Equal rows are one entry with a weight; rows that share an id but differ are entries of their own.
    """
    told = materialize(facts(docs, doc_id, text, part), "facts")
    first = told.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")  # counted map-side: a text of many copies is one row a task
    copy = F.coalesce((F.col("first") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("first").isNotNull()), F.lit(False))
    judged = told.join(first, "digest", "left").select("doc_id", "part", (F.col("fails") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("fails"))
    entries = judged.groupBy("part", "doc_id", "fails").agg(F.count("*").alias("weight"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    entries = entries.join(marks, "doc_id", "left").select("part", "doc_id", "fails", "weight", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # ids tell the rows of one part apart, so a hot part is dealt over many ranges
    spread = entries.repartitionByRange(F.col("part"), F.col("doc_id").asc_nulls_last(), F.col("fails")).sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_last(), F.col("fails"))
    kind = entries.schema["doc_id"].dataType.simpleString()
    schema = f"part string, ids array<{kind}>, weights array<bigint>, " + ", ".join(f"{x} array<int>" for x in _LISTS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            names = batch["part"].to_numpy(zero_copy_only=False)
            borders = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(borders, borders[1:]):
                while lo < hi:
                    if held and (held[0]["part"][0] != batch["part"][lo] or sum(map(len, held)) == block_ids):
                        yield _range(held)
                        held = []
                    some = batch.slice(lo, min(hi - lo, block_ids - sum(map(len, held))))
                    held.append(some)
                    lo += len(some)
        if held:
            yield _range(held)

    return spread.mapInArrow(cut, schema)


def _range(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    bits = t["fails"].to_numpy()
    places = [np.flatnonzero(bits >> i & 1) for i in range(len(FILTERS))] + [np.flatnonzero(t[x].to_numpy()) for x in ("good", "toxic")]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    arrays = [t["part"].chunk(0).slice(0, 1), one(t["doc_id"].chunk(0)), one(t["weight"].chunk(0)), *[one(pa.array(p, pa.int32())) for p in places]]
    return pa.RecordBatch.from_arrays(arrays, ["part", "ids", "weights", *_LISTS])


def absent(these: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which of the sorted ``these`` are missing from the sorted ``those``, by galloping: the other list is cut to the range of ids that both cover, then the shorter list's ids are searched for in the longer one, each search starting from the last one's place."""
    out = np.ones(len(these), bool)
    if len(these) and len(those):
        those = those[np.searchsorted(those, these[0]) : np.searchsorted(those, these[-1], "right")]
        if len(those) < len(these):
            at = np.searchsorted(these, those)
            out[at[these[at] == those]] = False
        else:
            at = np.searchsorted(those, these)
            within = at < len(those)
            out[within] = those[at[within]] != these[within]
    return out


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted places of any of the sorted ``lists``: each list's ids that the others lack so far go in where they belong."""
    out = lists[0]
    for x in lists[1:]:
        new = x[absent(x, out)]
        out = np.insert(out, np.searchsorted(out, new), new)
    return out


def combined(lists: list[np.ndarray], weights: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, ...]]:
    """For each set of earlier filters (bits) and each filter outside it: what it removes from what they left.

    Yields ``prior, filter, n, gone`` (by all of them) ``, removed, failing, unique_fails, good_lost, toxic_lost, shapley``.
    """
    n, size = int(weights.sum()), lambda places: int(weights[places].sum())
    whole = {0: np.zeros(0, lists[0].dtype)}
    for prior in range(1, _ALL + 1):
        k = prior.bit_length() - 1
        whole[prior] = union([whole[prior & ~(1 << k)], lists[k]])
    gone = {prior: size(x) for prior, x in whole.items()}
    left = {(prior, k): lists[k][absent(lists[k], whole[prior])] for prior in whole if prior != _ALL for k in range(len(FILTERS)) if not prior >> k & 1}
    removed = {at: size(x) for at, x in left.items()}
    shares = [sum(factorial(s := prior.bit_count()) * factorial(len(FILTERS) - 1 - s) * r for (prior, j), r in removed.items() if j == k) for k in range(len(FILTERS))]
    for (prior, k), x in left.items():
        lost = (size(x[~absent(x, marked)]) for marked in (good, toxic))
        yield prior, k, n, gone[prior | 1 << k], removed[prior, k], gone[1 << k], removed[_ALL & ~(1 << k), k], *lost, shares[k]


_SUMS = ("n", "gone", "removed", "failing", "unique_fails", "good_lost", "toxic_lost", "shapley")


def overlaps(lists: DataFrame) -> DataFrame:
    """Per part, set of earlier ``prior`` filters (bits) and ``filter`` (number) the sums of :func:`combined` over the ranges of :func:`postings`."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                own = [b[x][i].values.to_numpy() for x in ("weights", *_LISTS)]
                rows = list(zip(*combined(own[1 : 1 + len(FILTERS)], own[0], *own[1 + len(FILTERS) :])))
                yield pa.RecordBatch.from_arrays([pa.array([b["part"][i].as_py()] * len(rows[0])), *[pa.array(x, pa.int32()) for x in rows[:2]], *[pa.array(x, pa.int64()) for x in rows[2:]]], ["part", "prior", "filter", *_SUMS])

    out = lists.mapInArrow(merge, "part string, prior int, filter int, " + ", ".join(f"{x} long" for x in _SUMS))
    return out.groupBy("part", "prior", "filter").agg(*[F.sum(x).alias(x) for x in _SUMS])


def orders() -> list[tuple[str, int, int, int]]:
    """All orders of the filters, step by step: order, step (from 1), bits of the earlier filters, number of the step's filter."""
    out = []
    for order in permutations(range(len(FILTERS))):
        prior = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, prior, k))
            prior |= 1 << k
    return out


def apply(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row a part, order and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    sums = overlaps(materialize(postings(docs, labels, doc_id, text, part, block_ids), "postings"))
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, prior int, filter int")
    out = sums.join(F.broadcast(steps), ["prior", "filter"])  # 600 rows
    return out.select("part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
