"""Exact n-gram Jaccard join by token-combination prefixes, and the components of its links.

A text's set holds the distinct 64-bit hashes of its k-word shingles. Texts with equal sets
are one class, and only classes are compared. A set of n shingles can miss at most
``n - ceil(t * n)`` of them in any partner.

Sample. All shingles below a fixed hash value (``SAMPLE`` of all) are shuffled with their
class; a class that has more of them for itself than it may miss has no partner and is out.
Texts of unrelated content end here, at the price of a third of their shingles.

Counts. The shingles of the other classes are counted exactly, over all these classes. The
global order is by count, then by hash. Both shuffles add up each task's rows first, so a
shingle costs as many rows as there are chunks of texts that hold it, not as there are texts.

Signatures. The first shared shingle of two linked sets stands within the prefix of each
that it may miss, plus one. Rare shingles of the prefix are signatures alone. Where
rare ones don't suffice, the prefix is extended into the frequent ones, which stand behind
them: those of the middle class are signed in pairs, the hottest in triples. They are
dealt into subclasses, and as a subclass of c shingles is sure of a shared combination of k
only once k are shared, it counts c - k + 1. The number of subclasses follows the size of
the set, in bands a factor 1/t apart; a set signs in its own band, and for larger partners in the
next one, so that any two sets that can link have a band in common. Of two linked sets the
smaller shares so much of itself that its signature stands in a shorter prefix (``index``); only such
signatures meet others. So sets with much of their own beside a common passage meet nothing.

Candidates. Classes that share a signature are candidates unless sizes, or what stands
behind the signature, leave too little to share. A few classes of each signature are its
hubs, and each class is compared with the hubs that it meets most often and those of its
rarest signatures; linked classes become one component, and
only signatures that still join different components go on: around other hubs while these
find links, and at last all pairs of different components. So a group of near copies costs its size, not its
square, and every link between components is tested, on the whole sets.

The only errors possible are clashes of 64-bit hashes. Null and empty texts have the empty
set, no links, and are their own component. Documents that repeat a doc_id count as
documents; a null doc_id is the component's id only if all are null. A text is hashed
as a whole whatever its length; one text's set is the least unit of memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, materialize, python_tasks
from .components import components
from .rolling import Words, mix

#: Shingle hashes below this value are the sample: 35 in 100.
SAMPLE = int(0.35 * 2**64)
#: Shingles that a task adds up at a time.
CHUNK = 1 << 19
#: Above so many classes a shingle is frequent (pairs), and above so many hot (triples).
FREQUENT = (64, 1024)
#: Sides of at most so many rows of a few numbers are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Hubs of a signature in a round, and of a class by either order.
HUBS = 4
#: After a round of hubs that links a smaller share of what it compared, all pairs left are compared.
LINKS = 0.02


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(Words(text).windows(k))


def class_key(s: np.ndarray) -> int | None:
    """Key of the set; None for the empty set."""
    if not len(s):
        return None
    one, two = mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(s))), mix(s ^ np.uint64(len(s)))
    return int(mix(np.array([one.sum()]) ^ mix(np.array([two.sum()]))).astype(np.int64)[0])


def least_shared(n: int, percent: int) -> int:
    """How many shingles a set of n shares at least with any partner."""
    return -(-percent * n // 100)


def least_of_smaller(n: int, percent: int) -> int:
    """How many it shares at least with a partner that is not smaller."""
    return -(-2 * percent * n // (100 + percent))


def band_of(n: int, percent: int) -> int:
    """Linked sets are of one band or of neighbouring ones."""
    return int(log(n) / log(100 / percent) + 1e-9)


def subclasses(band: int, percent: int) -> int:
    """Into how many subclasses a band deals pairs, and triples; 0: its sets are so small that every shingle is signed alone."""
    smallest = (percent / 100) * (100 / percent) ** band * 0.999999  # a smaller partner may be of the band below
    return max(0, ceil(2 * percent / (100 + percent) * smallest) - 1) // 3


def _combined(own: np.ndarray, count: np.ndarray, misses: int, band: int, percent: int, frequent: tuple[int, int]) -> np.ndarray:
    """Signatures of a band over frequent shingles in global order, of which any partner lacks ``misses`` at most."""
    parts = subclasses(band, percent)
    if not parts:
        return mix(own[: misses + 1] ^ np.uint64(band + 1))
    hot = count > frequent[1]
    part = (mix(own ^ np.uint64(band)) % np.uint64(parts)).astype(np.int64) + parts * hot
    order = np.argsort(part, kind="stable")
    heads = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1])
    rank = np.empty(len(own), np.int64)  # place within the subclass
    rank[order] = np.arange(len(own)) - np.repeat(heads, np.diff(np.append(heads, len(own))))
    size = int(np.searchsorted(np.cumsum(rank >= 1 + hot), misses + 1)) + 1
    out = []
    part, own = part[:size], own[:size]
    for p in np.unique(part):
        k = 3 if p >= parts else 2
        places = np.array(list(combinations(range(int((part == p).sum())), k)), np.int64).reshape(-1, k)
        key = np.full(len(places), band * 4 + k, np.uint64)
        for column in places.T:
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + own[part == p][column])
        out.append(key)
    return np.unique(np.concatenate(out)) if out else own[:0]


def signatures(s: np.ndarray, counts: np.ndarray, percent: int, frequent: tuple[int, int] = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set whose shingles occur in ``counts`` sets; how many shingles a pair that first meets by it can share at most; whether it may be the smaller set's."""
    n = len(s)
    shared, smaller = least_shared(n, percent), least_of_smaller(n, percent)
    order = np.lexsort((s, counts))
    s, counts = s[order], counts[order]
    n_rare = int(np.searchsorted(counts, frequent[0], "right"))
    alone = int(np.searchsorted(counts, 1, "right"))
    sigs, rests = [s[alone : min(n_rare, n - shared + 1)]], [n - np.arange(alone, max(alone, min(n_rare, n - shared + 1)))]
    often = n - n_rare
    for band, least in ((band_of(n, percent), shared), (band_of(n, percent) + 1, smaller)):
        if often >= least:  # else a partner shares a rare shingle
            sigs.append(_combined(s[n_rare:], counts[n_rare:], often - least, band, percent, frequent))
            rests.append(np.full(len(sigs[-1]), often))
    rest = np.concatenate(rests)
    return np.concatenate(sigs), rest, rest >= smaller


def _census(k: int):
    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            nodes, sizes, sampled = [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), k)
                nodes.append(class_key(s))
                sizes.append(len(s))
                sampled.append(int(np.searchsorted(s, np.uint64(SAMPLE))))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sampled, pa.int64())], ["doc_id", "row", "node", "n", "m"])

    return census


def _sampled(k: int):
    """(sig, node, met): sampled shingles, of each at most two classes in a chunk; how many more of a class's were met in the chunk stands under the class's own key."""

    def added(sets: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        all_, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(all_, kind="stable")
        all_, own = all_[order], own[order]
        third = np.zeros(len(all_), bool)
        third[2:] = all_[2:] == all_[:-2]
        met = np.bincount(own[third], minlength=len(nodes))
        keys, some = np.array(nodes, np.int64), np.flatnonzero(met)
        sig = np.concatenate([all_[~third].astype(np.int64), keys[some]])
        node = np.concatenate([keys[own[~third]], keys[some]])
        more = np.concatenate([np.zeros(len(all_) - third.sum(), np.int64), met[some]])
        return pa.record_batch([pa.array(sig), pa.array(node), pa.array(more)], ["sig", "node", "met"])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen, sets, nodes, size = set(), [], [], 0
        for batch in batches:
            for t in batch.column(0):
                s = shingles(t.as_py(), k)
                node = class_key(s)
                if len(s) > 1 and node not in seen:  # a set of one shingle links with its copies only
                    seen.add(node)
                    sets.append(s[: np.searchsorted(s, np.uint64(SAMPLE))])
                    nodes.append(node)
                    size += len(sets[-1])
                    if size > CHUNK:
                        yield added(sets, nodes)
                        sets, nodes, size = [], [], 0
        if nodes:
            yield added(sets, nodes)

    return sampled


def _sets(k: int):
    """(chunk, node, data): whole sets, in chunks of a task."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen, chunk, size = set(), TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            chunks, nodes, data = [], [], []
            for t in batch.column(0):
                s = shingles(t.as_py(), k)
                node = class_key(s)
                if node is not None and node not in seen:
                    seen.add(node)
                    if size > CHUNK:
                        chunk, size = chunk + 1, 0
                    size += len(s)
                    chunks.append(chunk)
                    nodes.append(node)
                    data.append(s.astype("<u8").tobytes())
            yield pa.record_batch([pa.array(chunks, pa.int64()), pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], ["chunk", "node", "data"])

    return sets


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, chunk, count): how many sets of the chunk have a shingle."""

    def added(chunk: int, data: list[bytes]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.frombuffer(b"".join(data), "<u8"), return_counts=True)
        return pa.record_batch([pa.array(tokens.astype(np.int64)), pa.array(np.full(len(tokens), chunk, np.int64)), pa.array(counts.astype(np.int64))], ["token", "chunk", "count"])

    now, data = None, []
    for batch in batches:
        for chunk, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            if chunk != now and data:
                yield added(now, data)
                data = []
            now = chunk
            data.append(x.as_py())
    if data:
        yield added(now, data)


def _signed(percent: int, frequent: tuple[int, int]):
    def signed(sets: pa.Table, counted: pa.Table) -> pa.Table:
        let_go()
        tokens, totals = counted["token"].to_numpy().astype(np.uint64), counted["total"].to_numpy()
        order = np.argsort(tokens)
        tokens, totals = np.append(tokens[order], np.uint64(2**64 - 1)), np.append(totals[order], 1)
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]]
        for node, x in zip(sets["node"].to_pylist(), sets["data"]):
            s = np.frombuffer(x.as_py(), "<u8").astype(np.uint64)
            at = np.searchsorted(tokens, s)
            sigs, rest, index = signatures(s, np.where(tokens[at] == s, totals[at], 1), percent, frequent)
            for c, v in zip(columns, (sigs.astype(np.int64), np.full(len(sigs), node), np.full(len(sigs), len(s)), rest, index)):
                c.append(v)
        return pa.table([np.concatenate(c) for c in columns], names=["sig", "node", "n", "rest", "index"])

    return signed


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (a, b))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return linked


def _may_link(n: Column, rest: Column, n_b: Column, rest_b: Column, percent: int) -> Column:
    """Whether the smaller set is large enough, and enough can be shared from the signature on in both."""
    return (100 * F.least(n, n_b) >= percent * F.greatest(n, n_b)) & (F.least(rest, rest_b) * (100 + percent) >= percent * (n + n_b))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def apply(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 75, frequent: tuple[int, int] = FREQUENT, rounds: int = 8) -> DataFrame:
    """One row a document: ``doc_id``, ``n_shingles`` and ``component_id`` (the least doc_id reachable by links). ``percent`` is below 100."""
    if not 0 < percent < 100:
        raise ValueError("percent must be from 1 to 99")
    python_tasks(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = materialize(own.mapInArrow(_census(k), f"doc_id {kind}, row long, node long, n long, m long"), "census")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), F.max("n").alias("n"), F.max("m").alias("m"))

    sampled = own.select("text").mapInArrow(_sampled(k), "sig long, node long, met long")
    same = Window.partitionBy("sig")
    sampled = sampled.withColumn("met", F.col("met") + (F.min("node").over(same) < F.max("node").over(same)).cast("long"))
    met = sampled.where("met > 0").groupBy("node").agg(F.sum("met").alias("met"))
    misses = F.col("n") - F.ceil(percent * F.col("n") / 100)
    open_ = nodes.where("n > 1").join(met, "node", "left").where(F.col("m") - F.coalesce("met", F.lit(0)) <= misses)
    open_ = materialize(open_.select("node", "row"), "open")

    whole = own.join(_small(open_.select("row"), open_.count()), "row", "left_semi").select("text")
    sets = materialize(whole.mapInArrow(_sets(k), "chunk long, node long, data binary"), "sets")
    counted = sets.select("chunk", "data").mapInArrow(_tally, "token long, chunk long, count long")
    counted = counted.withColumn("total", F.sum("count").over(Window.partitionBy("token"))).where("total > 1").select("chunk", "token", "total")
    signed = sets.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_signed(percent, frequent), "sig long, node long, n long, rest long, index boolean")

    labels = _linked_classes(materialize(signed, "signatures"), sets.select("node", "data"), percent, rounds)
    roots = nodes.select("node", "low").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = roots.join(roots.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the written pairs (a, b) whose sets link."""
    few = _small(pairs, pairs.count())
    x = sets.select(F.col("node").alias("a"), F.col("data").alias("x")).join(few, "a")
    hubs = sets.join(_small(pairs.select(F.col("b").alias("node")), pairs.count()), "node", "left_semi").dropDuplicates(["node"])
    both = x.join(hubs.select(F.col("node").alias("b"), F.col("data").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long").distinct(), "verified")


def _linked_classes(signed: DataFrame, sets: DataFrame, percent: int, rounds: int) -> DataFrame:
    """``(node, root)`` of the classes that have a verified link."""
    labels, found, tested = signed.sparkSession.createDataFrame([], "node long, root long"), 1, 1
    for turn in range(rounds + 1):
        labelled = signed.select("sig", "node", "n", "rest", "index").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # first those with the least of their own before the signature, as an original among its copies; then any
        central = [F.col("n") - F.col("rest"), F.floor((F.col("n") - F.col("rest")) / 4), *[F.lit(0)] * (HUBS - 2)]
        hubs = [F.min(F.struct(~F.col("index"), own.alias("own"), F.xxhash64("node", F.lit(turn * HUBS + i)).alias("order"), "node", "n", "rest", "root")).alias(f"hub{i}") for i, own in enumerate(central)]
        parts = labelled.groupBy("sig", "root").agg(F.count("*").alias("size"), F.count_if("index").alias("few"), *hubs)
        hubs = F.array_distinct(F.transform(F.array(*[F.min(f"hub{i}") for i in range(HUBS)]), lambda h: F.struct(h["node"].alias("node"), h["n"].alias("n"), h["rest"].alias("rest"), h["root"].alias("root"))))
        groups = parts.groupBy("sig").agg((F.sum("few") * F.sum("size") - F.sum(F.col("few") * F.col("size"))).alias("pairs"), F.sum("size").alias("size"), hubs.alias("hubs"))
        # a signature whose classes are one component stays so
        signed = materialize(labelled.join(groups.where("pairs > 0").select("sig", "size", (F.col("pairs") / F.col("size")).alias("share"), "hubs"), "sig"), "open")
        n_rows, pairs = signed.agg(F.count("*"), F.coalesce(F.sum("share"), F.lit(0.0))).first()
        if not n_rows:
            break
        last = turn == rounds or pairs <= n_rows or found < LINKS * tested
        if last:
            x = signed.where("index").select("sig", F.col("node").alias("a"), "n", "rest", "root")
            y = signed.select(F.col("sig").alias("sig_b"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("root").alias("root_b"))
            smaller = (F.col("n") < F.col("n_b")) | (F.col("n") == F.col("n_b")) & (F.col("a") < F.col("b"))
            near = x.join(y, (F.col("sig") == F.col("sig_b")) & (F.col("root") != F.col("root_b")) & smaller & _may_link(F.col("n"), F.col("rest"), F.col("n_b"), F.col("rest_b"), percent)).select("a", "b").distinct()
        else:
            near = signed.withColumn("hub", F.explode("hubs")).where((F.col("root") != F.col("hub.root")) & _may_link(F.col("n"), F.col("rest"), F.col("hub.n"), F.col("hub.rest"), percent))
            near = near.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b")).agg(F.count("*").alias("met"), F.min("size").alias("size"))
            # a class meets at most HUBS hubs a signature
            first = lambda *by: F.transform(F.slice(F.sort_array(F.collect_list(F.struct(*by, "b"))), 1, HUBS), lambda x: x["b"])
            near = near.groupBy("a").agg(F.array_union(first(-F.col("met")), first("size", -F.col("met"))).alias("b")).withColumn("b", F.explode("b"))
        near = materialize(near, "pairs")
        new = _verified(near, sets, percent)
        tested, found = near.count(), new.count()
        if found:
            labels = components(labels.where("node <> root").unionByName(new.toDF("node", "root")))
        if last:
            break
    return labels
