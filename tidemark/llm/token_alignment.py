"""How the tokens of two tokenizers cover the same bytes: links between them, and how often each pair of ids is linked.

Equal texts are brought together first: one shuffle by the whole text, counted map-side. Each distinct text is
tokenised and aligned once; its links count as often as the text occurs. The measures come back
to the rows by a digest of the text.

Alignment. Both tokenizers cut the same bytes into stretches. Where tokens of both end, a
group ends. Between two neighbouring cuts of either lies the overlap of one token of each:
that is a link. So marking the cuts of both on the text's bytes gives groups and links at once.

Counts of a corpus-wide id pair are summed inside each task before they are shuffled. They come
back to the texts in one of two ways with the same result: up to ``PAIRS`` different pairs as one
sorted table sent to all tasks, beyond that by a join of the texts' distinct pairs with the counts.

A null or empty text, and one whose tokens of either side do not join to the blank-led text
(a normalising tokenizer changed it), has no tokens: zeros and an empty ``groups_sha256``. Equal
rows, rows that share an id and rows without one are counted each. An empty table gives no rows. Very
long texts are aligned as a whole, alone in their batch. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PRE_TOKENS, PreTokens, Vocabulary
from .common import held, let_go, materialize, python_tasks

#: Most id pairs whose counts are sent to every task (12 bytes each).
PAIRS = 4_000_000
#: Different pairs that a task gathers before it passes their counts on.
GATHERED = 2_000_000
#: Room for ids of the second tokenizer in a pair's number, which is a * SPAN + b.
SPAN = 1 << 16
BLANK_MARK = "▁"
#: Most bytes of parts that a worker remembers with their alignments, what an entry takes besides its texts, and the longest part that is remembered.
KEPT_BYTES, ENTRY, LONGEST_KEPT = 40 << 20, 330, 40
#: Most characters of texts that are cut at once.
CUT_CHARS = 500_000
#: Parts from this length on are merged by a heap, in n log n.
LONGEST_RANKED = 2000
NEW = object()


class Aligner:
    """Ids of a text by both tokenizers, and how they cover its bytes.

    The text is cut before every blank that follows a character which is no white space. Neither
    tokenizer has a token across such a place: the pre-token pattern of the first ends
    there, and no piece of the second holds a blank behind another character (checked here).
    So the parts between are tokenised alone, and each different part once as long as it is remembered.

    Parts go through a library that merges the two neighbours whose *joined bytes* have the lowest
    rank, where the file merges *pairs*. That is the same wherever every token's own bytes merge to that
    token (``whole``, proven offline): when the bytes of token T are next, all merges below T's rank
    are done, none crossed the ends of T's bytes, so inside they went as they go for T alone; that
    leaves T's own pair. Otherwise the file's merges are applied one by one.
    """

    def __init__(self, path_a: str, path_b: str, whole: bool):
        import sentencepiece
        import tiktoken

        vocabulary = Vocabulary(path_a)
        self._bytes_a = dict(zip(vocabulary.ids, vocabulary.tokens))
        number = {t: i for i, t in zip(vocabulary.ids, vocabulary.tokens)}
        if whole:
            ranked = tiktoken.Encoding("ranked", pat_str=PRE_TOKENS, mergeable_ranks={t: i for i, t in enumerate(vocabulary.tokens)}, special_tokens={})
            self._merge = lambda part: [vocabulary.ids[x] for x in ranked.encode_ordinary(part)]
        self._apart, self._exact = whole, lambda part: [vocabulary.ids[x] for p in split(part) for x in vocabulary.merge(p.encode())]
        split = PreTokens({})  # strings of special tokens are plain text
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(BLANK_MARK, " ").encode() for i, p in enumerate(pieces)]
        if max(number.values()) >= SPAN or len(pieces) > SPAN:
            raise ValueError(f"ids of {SPAN} and more are not supported")
        self._cut = re.compile(r"(?<=\S)(?= )") if not any(re.search(f"[^{BLANK_MARK}]{BLANK_MARK}", p) for p in pieces) else None
        self._known: dict[str, tuple[bytes, bytes] | None] = {}
        self._bytes = 0
        self._length_a = np.zeros(max(self._bytes_a) + 1, np.int64)
        self._length_a[list(self._bytes_a)] = [len(x) for x in self._bytes_a.values()]
        self._length_b = np.array([len(x) for x in self._bytes_b], np.int64)
        # each id's digits with the sign behind it: inside a group's list, at the end of a list of the first, of the second
        self._step = max(len(self._length_a), len(pieces))
        self._digits = [f"{i}{sign}" for sign in ",|;" for i in range(self._step)]

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Per text its ids by both; None where they stand for other bytes than the blank-led text."""
        run, size = [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size > CUT_CHARS:
                yield from self._ids(run)
                run, size = [], 0
        yield from self._ids(run)

    def _ids(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        cut = [self._cut.split(" " + t) if self._cut else [" " + t] for t in texts]
        known, here = self._known, {}
        new = list({p for parts in cut for p in parts if p not in known})
        for part, b in zip(new, self._pieces(new)):
            a = (self._merge if self._apart and len(part) < LONGEST_RANKED else self._exact)(part)  # of bytes: they always join to the part
            here[part] = out = (array("I", a).tobytes(), array("I", b).tobytes()) if b"".join(map(self._bytes_b.__getitem__, b)) == part.encode() else None
            if len(part) <= LONGEST_KEPT:
                self._bytes += ENTRY + 4 * len(part) + (len(out[0]) + len(out[1]) if out else 0)
        for parts in cut:
            found = [here[p] if x is NEW else x for p, x in zip(parts, map(known.get, parts, repeat(NEW)))]
            if None in found:
                yield None
            else:
                a, b = zip(*found)
                yield np.frombuffer(b"".join(a), np.uint32), np.frombuffer(b"".join(b), np.uint32)
        if self._bytes > KEPT_BYTES:
            known.clear()
            self._bytes = 0
        else:
            known.update((p, x) for p, x in here.items() if len(p) <= LONGEST_KEPT)

    def _pieces(self, parts: list[str]) -> list[list[int]]:
        """Ids of the second tokenizer; it adds the leading blank itself, but not to an empty text."""
        blank = [self._b.piece_to_id(BLANK_MARK)]
        return [b if len(p) > 1 else blank for p, b in zip(parts, self._b.encode([p[1:] for p in parts], num_threads=1))] if parts else []

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, str]:
        """Number of groups, the links (a * SPAN + b) in order, and the groups as text."""
        cuts_a, cuts_b = np.cumsum(self._length_a[a]), np.cumsum(self._length_b[b])
        ends = np.zeros(cuts_a[-1] + 1, np.int8)  # by byte: 1 where a token of a ends, 2 of b, 3 of both
        ends[cuts_a] = 1
        ends[cuts_b] += 2
        ends = ends[np.flatnonzero(ends)]
        # between two neighbouring cuts lies the overlap of one token of each: those that end next
        of_a, of_b = ends & 1, ends >> 1
        links = a[np.cumsum(of_a, dtype=np.int64) - of_a].astype(np.int64) * SPAN + b[np.cumsum(of_b, dtype=np.int64) - of_b]
        last_a, last_b = ends[of_a == 1] == 3, ends[of_b == 1] == 3  # of a group
        # as text: a group's tokens of a stand behind all tokens of earlier groups, its tokens of b behind those
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate([[0], np.flatnonzero(last_b) + 1])[np.cumsum(last_a) - last_a]] = a + self._step * last_a
        code[np.arange(len(b)) + (np.flatnonzero(last_a) + 1)[np.cumsum(last_b) - last_b]] = b + 2 * self._step * last_b
        return int(last_a.sum()), links, "".join(map(self._digits.__getitem__, code.tolist()))[:-1]


_ALIGNED = "digest binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """One row a distinct text: ``digest`` (SHA-256), ``n`` (rows that hold it), counts, ``groups_sha256``, its distinct ``pairs`` (sorted, little-endian 64 bits) and how many ``times`` each is linked (32 bits)."""
    python_tasks(docs.sparkSession)
    distinct = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    vocabulary = Vocabulary(path_a)
    whole = all(len(vocabulary.merge(t)) == 1 for t in vocabulary.tokens)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = held(("alignment", path_a, path_b), lambda: Aligner(path_a, path_b, whole))
        for batch in batches:
            rows, texts = [], batch["t"].to_pylist()
            for x, n, ids in zip(texts, batch["n"].to_pylist(), tokens(texts)):
                digest = hashlib.sha256(x.encode()).digest()
                if not x or ids is None:
                    rows.append((digest, n, 0, 0, 0, 0, "", b"", b""))
                    continue
                n_groups, links, groups = tokens.align(*ids)
                pairs, times = np.unique(links, return_counts=True)
                rows.append((digest, n, len(ids[0]), len(ids[1]), n_groups, len(links), hashlib.sha256(groups.encode()).hexdigest(), pairs.astype("<i8").tobytes(), times.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()))], [c.split()[0] for c in _ALIGNED.split(", ")])

    return distinct.mapInArrow(each, _ALIGNED)


def pair_counts(texts: DataFrame) -> DataFrame:
    """``pair, b, count, best`` of each id pair of :func:`aligned` texts, with their multiplicity: ``best`` where no pair of the same ``b`` has a higher count."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        pairs, counts, new = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        open_ = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([pairs, *[p for p, _ in new]])
            one, at = np.unique(every, return_inverse=True)
            sums = np.zeros(len(one), np.int64)
            np.add.at(sums, at, np.concatenate([counts, *[c for _, c in new]]))
            return one, sums

        for batch in batches:
            for p, c, n in zip(batch["pairs"], batch["times"], batch["n"].to_pylist()):
                new.append((np.frombuffer(p.as_py(), "<i8"), np.frombuffer(c.as_py(), "<i4") * np.int64(n)))
                open_ += len(new[-1][0])
                if open_ > GATHERED:
                    pairs, counts = merged()
                    new, open_ = [], 0
                    if len(pairs) > GATHERED:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "count"])
                        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "count"])

    sums = texts.select("n", "pairs", "times").mapInArrow(gather, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    sums = materialize(sums.withColumn("b", F.col("pair") % SPAN), "pairs")
    return sums.join(sums.groupBy("b").agg(F.max("count").alias("most")), "b").select("pair", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _by_table(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Measures from a sorted table of all pairs that every task gets; at most PAIRS rows pass the driver."""
    table = counts.select("pair", "count", "best").toArrow().sort_by("pair")
    shared = texts.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(), table["count"].to_numpy(), table["best"].to_numpy(zero_copy_only=False)))
    plain = [c for c in texts.columns if c not in ("pairs", "times")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known, count, best = shared.value
        for batch in batches:
            pairs = [np.frombuffer(x.as_py(), "<i8") for x in batch["pairs"]]
            times = [np.frombuffer(x.as_py(), "<i4") for x in batch["times"]]
            at = np.searchsorted(known, np.concatenate(pairs))
            every = np.concatenate(times).astype(np.int64)
            ends = np.cumsum([len(p) for p in pairs])
            total = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in plain], pa.array(total(every * best[at])), pa.array(total(every * count[at]))], [*plain, "n_best", "count_sum"])

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    return texts.mapInArrow(measure, ", ".join(f"{c} {kinds[c]}" for c in plain) + ", n_best long, count_sum long")


def _by_join(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by joining every text's distinct pairs with the counts; rows of a text meet again after sums in each task."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for digest, p, c in zip(batch["digest"].to_pylist(), batch["pairs"], batch["times"]):
                pairs = np.frombuffer(p.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(pairs), pa.binary()), pa.array(pairs), pa.array(np.frombuffer(c.as_py(), "<i4"))], ["digest", "pair", "times"])

    found = texts.select("digest", "pairs", "times").mapInArrow(unfold, "digest binary, pair long, times int").join(counts, "pair")
    sums = found.groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return texts.drop("pairs", "times").join(sums, "digest", "left").na.fill(0, ["n_best", "count_sum"])


def apply(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", most_pairs: int = PAIRS) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``path_a``: a byte-level BPE file, ``path_b``: a SentencePiece model, both to be read by
    executors. ``n_best``: links whose count is the highest of their second id, ties included.
    """
    texts = materialize(aligned(docs, path_a, path_b, text), "aligned")
    counts = pair_counts(texts)
    measured = (_by_table if counts.limit(most_pairs + 1).count() <= most_pairs else _by_join)(texts, counts)
    measured = materialize(measured.select("digest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "measured")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))
    return rows.join(measured, "digest").drop("digest")
