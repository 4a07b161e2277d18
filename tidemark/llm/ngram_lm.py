"""Language-model scores of whole texts from a sharded Elias-Fano n-gram trie.

Texts are dealt into blocks by a hash. A block lists its distinct words and bigrams, in the
order of their hashes, with their counts in its training texts, and sends each shard (by the
first word's hash) its part. A shard adds the blocks' counts up, builds its trie of the
corpus's words and bigrams in memory-mapped levels, and answers every block in the order it
asked: counts, back-off weights and quantised smoothed probabilities. The block's second
visit scores its texts from the answers. Nothing passes the driver, a shard holds its share
of the distinct bigrams, and words and texts never meet one row at a time.

P(w | c) = n(c, w) / (n(c) + pull) + pull / (n(c) + pull) * P(w), and
P(w) = (n(w) + 1) / (N + V + 1), so every context's probabilities sum to 1.

Null and empty texts hold only the end token. Without training texts N = V = 0 and every
known count is 0. Repeated rows count as often as they stand there and score alike. A very
long text is scored as a whole, in its block.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, python_tasks, unclashed
from .ngram_trie import FOLLOWER_BITS, NONE, VALUES, Trie
from .rolling import Words

#: Hashes of the marks before and behind a text; no word's hash is taken from the empty word.
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0x0FEDCBA987654321)
#: Bytes of text in a block, on average at most.
BLOCK_BYTES = 8 << 20
_FOLLOWER = np.uint64((1 << FOLLOWER_BITS) - 1)


class Block:
    """Tokens of a block's texts, its distinct words (by hash) and bigrams (by place of the first word, then of the second)."""

    def __init__(self, texts: Sequence[str | None], trains: Sequence[bool]):
        hashes = [np.append(Words(t).windows(1), END) for t in texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        hashes.append(np.array([BEGIN]))
        tokens = np.concatenate(hashes)
        del hashes
        train = np.repeat(np.array(trains, bool), self.sizes)
        self.heads = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.words, place = np.unique(tokens, return_inverse=True)
        del tokens
        self.token = place[:-1].astype(np.int32)  # places of tokens, of their contexts and of pairs in a block fit in 32 bits
        del place
        first = np.searchsorted(self.words, BEGIN)
        context = np.empty(len(self.token), np.int32)
        context[1:] = self.token[:-1]
        context[self.heads] = first
        pairs, pair = np.unique(context.astype(np.int64) * len(self.words) + self.token, return_inverse=True)
        self.pair = pair.astype(np.int32)
        del pair
        self.pair_context, self.pair_word = np.divmod(pairs, len(self.words))
        self.counts = np.bincount(self.token[train], minlength=len(self.words))
        self.counts[first] = sum(map(bool, trains))
        self.pair_counts = np.bincount(self.pair[train], minlength=len(pairs))
        self.context = context

    def shards(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        word = (self.words % np.uint64(n)).astype(np.int64)
        return word, word[self.pair_context]


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([struct.pack("<I", len(arrays)), *[struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays], *[a.tobytes() for a in arrays]])


def _unpack(data: bytes) -> list[np.ndarray]:
    n, at = struct.unpack_from("<I", data)[0], 4
    heads = [struct.unpack_from("<2sQ", data, at + 10 * i) for i in range(n)]
    at, out = at + 10 * n, []
    for kind, size in heads:
        d = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(data, d, size, at))
        at += size * d.itemsize
    return out


def _narrow(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 256 else np.uint32 if top < 1 << 32 else np.uint64)


_SENT = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])


def _ask(n_shards: int):
    def ask(table: pa.Table) -> pa.Table:
        let_go()
        b = Block(table["text"].to_pylist(), table["train"].to_pylist())
        word, pair = b.shards(n_shards)
        by_word, by_pair = np.argsort(word, kind="stable"), np.argsort(pair, kind="stable")
        word_ends = np.searchsorted(word[by_word], np.arange(n_shards + 1))
        pair_ends = np.searchsorted(pair[by_pair], np.arange(n_shards + 1))
        follower = b.words[b.pair_word] & _FOLLOWER
        out = []
        for s in range(n_shards):
            w, p = by_word[word_ends[s] : word_ends[s + 1]], by_pair[pair_ends[s] : pair_ends[s + 1]]
            n = np.bincount(np.searchsorted(w, b.pair_context[p]), minlength=len(w))
            f = follower[p]
            out.append(_pack(b.words[w], _narrow(b.counts[w]), _narrow(n), f.astype(np.uint32), (f >> np.uint64(32)).astype(np.uint8), _narrow(b.pair_counts[p])))
        block = table["block"][0].as_py()
        return pa.table([[block] * n_shards, list(range(n_shards)), out], schema=_SENT)

    return ask


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, counts, len(distinct)).astype(np.int64)
    return distinct[total > 0], total[total > 0]


def _answer(pull: float):
    def answer(table: pa.Table) -> pa.Table:
        let_go()
        asked = [_unpack(x) for x in table["data"].to_pylist()]
        words, counts = _summed(np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked]).astype(np.float64))
        keys, key_counts = [], []
        for a in asked:
            at = np.searchsorted(words, np.repeat(a[0], a[2]))
            keep = a[5] > 0  # a counted pair has a counted first word
            keys.append((at[keep].astype(np.uint64) << np.uint64(FOLLOWER_BITS)) | (a[4][keep].astype(np.uint64) << np.uint64(32)) | a[3][keep])
            key_counts.append(a[5][keep].astype(np.float64))
        trie = Trie(words, counts, *_summed(np.concatenate(keys), np.concatenate(key_counts)), pull)
        real = words != BEGIN
        total, distinct = int(counts[real].sum()), int(real.sum())
        out = []
        for a in asked:
            place, count, backoff = trie.find_words(a[0])
            codes = trie.find_followers(place, a[2], (a[4].astype(np.uint64) << np.uint64(32)) | a[3])
            out.append(_pack(_narrow(count), backoff, codes, np.array([total, distinct], np.int64)))
        return pa.table([table["block"].to_pylist(), table["shard"].to_pylist(), out], schema=_SENT)

    return answer


def _score(n_shards: int, n_keep: int):
    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        let_go()
        b = Block(texts["text"].to_pylist(), texts["train"].to_pylist())
        word, pair = b.shards(n_shards)
        counts, backoff, codes = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.uint16), np.full(len(pair), NONE, np.uint16)
        total = distinct = 0
        by_word, by_pair = np.argsort(word, kind="stable"), np.argsort(pair, kind="stable")
        word_ends = np.searchsorted(word[by_word], np.arange(n_shards + 1))
        pair_ends = np.searchsorted(pair[by_pair], np.arange(n_shards + 1))
        for s, data in zip(answers["shard"].to_pylist(), answers["data"].to_pylist()):
            c, w, q, sums = _unpack(data)
            own = by_word[word_ends[s] : word_ends[s + 1]]
            counts[own], backoff[own] = c, w
            codes[by_pair[pair_ends[s] : pair_ends[s + 1]]] = q
            total, distinct = total + int(sums[0]), distinct + int(sums[1])
        single = (counts + 1) / (total + distinct + 1)
        add = lambda x: np.add.reduceat(x, b.heads)
        p = VALUES[codes[b.pair]] + VALUES[backoff[b.context]] * single[b.token]
        n = len(b.sizes)
        return pa.table(
            {f"k_{i}": texts[f"k_{i}"] for i in range(n_keep)}
            | {
                "n_tokens": b.sizes, "n_known": add((counts[b.token] > 0).astype(np.int64)),
                "train_tokens": np.full(n, total), "base_score": add(np.log10(single[b.token])), "score": add(np.log10(p)),
            }
        )

    return score


def apply(docs: DataFrame, train: Column, text: str = "text", keep: Sequence[str] = ("doc_id",), pull: float = 20.0, n_blocks: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns of ``keep``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one unigrams) and ``score`` (bigrams), both log10.

    ``train`` marks the texts that the counts come from; a text is trained on where it is true, not
    where it is NULL. A column of ``keep`` with the name of an output is replaced by it. ``n_blocks``
    (if not given the session's number of shuffle partitions, or more, so that blocks have
    ``block_bytes`` of text on average) bounds what a task holds: texts / n_blocks, and what all
    blocks ask / n_blocks. There are n_blocks ** 2 messages, so terabytes need larger blocks.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    keep = unclashed(keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    n = n_blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // block_bytes))
    own = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.pmod(F.xxhash64(*keep, text), F.lit(n)).cast("long").alias("block"))
    sent = "block long, shard long, data binary"
    asked = own.groupBy("block").applyInArrow(_ask(n), sent)
    answered = asked.groupBy("shard").applyInArrow(_answer(pull), sent)
    kept = "".join(f"k_{i} {own.schema[f'k_{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    scored = own.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score(n, len(keep)), kept + "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", "train_tokens", "base_score", "score")
