"""Full-text index over compared records, kept as lists of records by term (inventory Q8, Q9).

Records are numbered where they are written and stand in blocks of 2 ** BITS numbers. A list tells,
for a term, a field and a block, the records that hold the term equally often in fields of equal
length. A task makes the lists of its own blocks, sorted by term, so the index needs no shuffle, and a
search for a prefix reads the pages whose range of terms holds it: the filter on the term reaches the
scan. A list is scored once; scores add up by record, inside the record's block.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.snapshot import Snapshot, settled

#: Searched parts of a record and their weights (fixed values).
FIELDS = {"recordKey": 3.0, "title": 2.0, "bidStatus": 1.0, "bidType": 1.0, "bidUrl": 0.5, "changedFields": 1.0, "qualityText": 0.5, "documentText": 0.5}
#: Parts that a policy takes from a source field of the record.
FROM_SOURCE = {"title": "title", "bidStatus": "status", "bidType": "type", "bidUrl": "url"}
#: BM25+ with this module's own parameters, and the weight of a term that the query is only a prefix of.
K, B, DELTA, PREFIX = 1.2, 0.7, 0.5, 0.375
#: What parts words (fixed value): line breaks, separators and punctuation of Unicode.
SEPARATORS = r"[\n\r\p{Z}\p{P}]+"
#: A block has 2 ** BITS record numbers; a task inverts at most about BYTES of text at once, then begins other lists of the same block.
BITS, BYTES = 16, 16 << 20


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _both_sides(surviving: Column, source: str) -> Column:
    """The text that survives in the latest (else the baseline) record, and what a change of the field wiped."""
    now = F.coalesce(V.text_of(F.when(surviving != V.NULL_JSON, surviving)), F.lit(""))
    wiped = F.get("befores", F.array_position("paths", source).cast("int") - 1)  # mentioned often: a filter's lambda would be run at each mention
    was = F.coalesce(V.text_of(F.when(wiped != V.NULL_JSON, wiped)), F.lit(""))
    return F.when((was == "") | (was == now), now).otherwise(F.concat_ws(" ", now, was))


def documents(diff: DataFrame, paired: DataFrame | None, baseline: Snapshot, latest: Snapshot, identity: tuple[str, ...], sources: Mapping[str, str], issues: DataFrame, document_text: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Q8: one row a record: ``id``, ``label`` and a text column for each of FIELDS.

    ``diff``: compared records with ``changes`` and ``issue_ids``; ``paired``: both sides' records by id (None: ``diff`` kept them);
    ``issues``: a row an issue with ``id, title, description``; ``document_text`` (id, text): words of changed documents;
    ``keep``: columns of ``diff`` that stay, by which an index's records can be narrowed.
    """
    whose = lambda f: F.when(F.col("l").isNotNull(), latest.col(f, "l")).otherwise(baseline.col(f, "b"))
    label = F.when(F.col("l").isNotNull(), V.record_label(latest.identity(identity, "l"))).otherwise(V.record_label(baseline.identity(identity, "b")))
    label = F.when(F.col("id").startswith("$unkeyed:"), F.col("id")).otherwise(label)
    parts = [_both_sides(whose(sources[s]), sources[s]).alias(name) if s in sources else F.lit("").alias(name) for name, s in FROM_SOURCE.items()]
    told = issues.agg(F.map_from_entries(F.collect_list(F.struct("id", F.concat_ws(" ", "title", "description")))).alias("told"))  # a row an issue
    both = diff if paired is None else diff.join(paired, "id")
    of = lambda name: F.transform("changes", lambda c: c[name]).alias(f"{name}s")
    out = settled(both.select("id", "issue_ids", "b", "l", of("path"), of("before"), *keep)).join(F.broadcast(told))
    quality = F.array_join(F.transform("issue_ids", lambda i: F.coalesce(F.try_element_at("told", i), F.lit(""))), " ")
    out = settled(out.select("id", label.alias("label"), *parts, F.array_join("paths", " ").alias("changedFields"), quality.alias("qualityText"), *keep))
    if document_text is None:
        return out.withColumns({"recordKey": F.col("label"), "documentText": F.lit("")})
    return out.join(document_text.select("id", F.col("text").alias("documentText")), "id", "left").withColumn("recordKey", F.col("label"))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("at", F.monotonically_increasing_id())


#: SEPARATORS in ASCII.
_ASCII = re.escape("".join(c for c in map(chr, range(128)) if c in "\n\r" or unicodedata.category(c)[0] in "ZP"))


def lists(numbered: DataFrame) -> DataFrame:
    """``term, field, tf, length, n, block, ats``: which ``n`` records of a block hold a term ``tf`` times in a field of ``length`` terms. No shuffle."""

    def text(f: str) -> Column:
        """Lower-case text that ASCII separators cut into the terms of the field: itself if it is ASCII, else its terms."""
        low = F.lower(F.coalesce(F.col(f), F.lit("")))
        return F.when(F.length(low) == F.octet_length(low), low).otherwise(F.array_join(terms_of(F.col(f)), " "))

    return numbered.select("at", *[text(f).alias(f) for f in FIELDS]).mapInArrow(_lists, "term string, field string, tf int, length int, n int, block long, ats array<int>")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one block and of at most about BYTES of text are inverted together."""
    held: list[pa.RecordBatch] = []
    now, n = None, 0
    for batch in batches:
        blocks = batch.column("at").to_numpy() >> BITS
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and (blocks[a] != now or n + part.nbytes > BYTES):
                yield from _inverted(held, now)
                held, n = [], 0
            held.append(part)
            now, n = int(blocks[a]), n + part.nbytes
    if held:
        yield from _inverted(held, now)


def _runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, n[i] numbers each."""
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)


def _inverted(parts: list[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The lists of one block's records, in order of term, field, frequency and length. Texts that repeat are cut once."""
    names = list(FIELDS)
    rows = np.concatenate([p.column("at").to_numpy() for p in parts]) & (1 << BITS) - 1
    words, spans = [], []
    for f in names:
        texts = pa.chunked_array([p.column(f) for p in parts]).combine_chunks().dictionary_encode()
        cut = pc.split_pattern_regex(texts.dictionary, f"[{_ASCII}]+")
        word, of = cut.flatten(), pc.list_parent_indices(cut).to_numpy()
        full = pc.not_equal(word, "")
        word, of = word.filter(full), of[full.to_numpy(zero_copy_only=False)]
        words.append(word)
        spans.append((texts.indices.to_numpy(), of, np.bincount(of, minlength=len(texts.dictionary))))
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    if not len(coded):
        return
    order = pc.sort_indices(coded.dictionary).to_numpy()
    terms = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = np.split(rank[coded.indices.to_numpy()], np.cumsum([len(w) for w in words])[:-1])
    facts, own = [], []
    for i, (text, of, length) in enumerate(spans):
        # a text's different terms, each with its frequency, then these for every record that has the text
        first = np.lexsort((codes[i], of))
        of, code = of[first], codes[i][first]
        new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (code[1:] != code[:-1]))) if len(of) else np.zeros(0, np.int64)
        tf, of, code = np.diff(np.append(new, len(of))), of[new], code[new]
        n = np.bincount(of, minlength=len(length))
        take = _runs((np.cumsum(n) - n)[text], n[text])
        facts.append(np.stack([code, np.full(len(of), i), tf, length[of]], axis=1))
        own.append((take, np.repeat(rows, n[text])))
    # (term, field, tf, length) by number, so that one sort of longs puts lists and their records in order
    at = np.cumsum([0, *[len(x) for x in facts]])
    every = np.concatenate(facts)
    order = np.lexsort(every.T[::-1])
    new = np.append(True, (np.diff(every[order], axis=0) != 0).any(axis=1))
    number = np.empty(len(every), np.int64)
    number[order] = np.cumsum(new) - 1
    every = every[order[new]]
    cells = np.sort(np.concatenate([number[take + at[i]] << BITS | row for i, (take, row) in enumerate(own)]))
    first = np.flatnonzero(np.diff(cells >> BITS, prepend=-1))
    ints = lambda x: pa.array(x, pa.int32())
    columns = [terms.take(pa.array(every[:, 0])), pa.array(names).take(pa.array(every[:, 1])), ints(every[:, 2]), ints(every[:, 3]), ints(np.diff(first, append=len(cells))), pa.array(np.full(len(first), block))]
    ats = pa.ListArray.from_arrays(ints(np.append(first, len(cells))), ints(cells & (1 << BITS) - 1))
    out = pa.RecordBatch.from_arrays([*columns, ats], ["term", "field", "tf", "length", "n", "block", "ats"])
    for a in range(0, len(first), 20_000):
        yield out.slice(a, 20_000)


def _flat(lists: DataFrame, *more) -> DataFrame:
    """A row a record of a list, told by its number ``at``."""
    return lists.select("block", F.explode("ats").alias("off"), *more).select(F.shiftleft("block", BITS).bitwiseOR(F.col("off").cast("long")).alias("at"), *more)


def postings(docs: DataFrame) -> DataFrame:
    """``at, term, field, tf, length``: how often a record's field holds a term, and how many terms it has."""
    return _flat(lists(_numbered(docs)), "term", "field", "tf", "length")


@dataclass(frozen=True)
class Index:
    """A written index: the folder ``path`` holds ``records`` (with their numbers ``at`` and sort keys ``natural``: a sort works expressions out at every comparison), ``lists`` and ``fields`` (field, records, terms)."""

    spark: SparkSession
    path: str

    @property
    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    @property
    def fields(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/fields")

    @property
    def postings(self) -> DataFrame:
        return _flat(self.lists, "term", "field", "tf", "length").join(self.records.select("at", "id", "label"), "at").drop("at")


def build(docs: DataFrame, path: str) -> Index:
    """Writes the index. Records get their numbers where they are written, so a number stays when a task is run again."""
    index = Index(docs.sparkSession, path)
    _numbered(docs).withColumn("natural", V.natural_key(F.col("label"))).write.parquet(f"{path}/records")
    lists(index.records).write.parquet(f"{path}/lists")
    sums = index.lists.agg(*[F.coalesce(F.sum(F.when(F.col("field") == f, F.col("tf").cast("long") * F.col("n"))), F.lit(0).cast("long")).alias(f) for f in FIELDS])
    sums = sums.join(F.broadcast(index.records.agg(F.count("*").alias("records"))))  # one row beside one row
    sums.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), "records", F.col(f).alias("terms")) for f in FIELDS]))).write.parquet(f"{path}/fields")
    return index


def query_terms(query: str) -> list[str]:
    """The query's terms as :func:`terms_of` cuts them."""
    parts = re.split(r"\s+", "".join(" " if c in "\n\r" or unicodedata.category(c)[0] in "ZP" else c for c in query.lower()))
    return list(dict.fromkeys(p for p in parts if p))


def search(index: Index, query: str, candidates: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """Q9: ``id, tier, score`` of the records of which any term starts with any term of the query, in order of tier, score, key.

    Tier 3: the record's key is the query, 2: starts with it, 1: contains it, else 0. ``candidates``
    (id) keeps the order among them. A blank query finds nothing.
    """
    wanted = query_terms(query)
    if not wanted:
        return index.records.select("id", F.lit(0).alias("tier"), F.lit(0.0).alias("score")).limit(0)
    prefixes = F.lit(False)
    for t in wanted:
        prefixes = prefixes | F.col("term").startswith(t)  # reaches the scan as a range of terms
    found = index.lists.where(prefixes)
    known = index.lists.where(prefixes).groupBy("term", "field").agg(F.sum("n").alias("holding"))
    named = index.records.select("at", "id", "label", "natural")
    if candidates is not None:
        named = named.join(candidates.select("id").distinct(), "id", "left_semi")
    weight = F.create_map(*[F.lit(x) for f, w in FIELDS.items() for x in (f, w)])
    length = F.length("term")
    # a query term that is the whole term counts 1, a prefix the less the more it leaves open
    nearness = sum([F.when(F.col("term") == t, 1.0).when(F.col("term").startswith(t), PREFIX * length / (length + 0.3 * (length - len(t)))).otherwise(0.0) for t in wanted], F.lit(0.0))
    idf = F.log(1 + (F.col("all") - F.col("holding") + 0.5) / (F.col("holding") + 0.5))
    mean = F.greatest(F.col("every") / F.greatest("all", F.lit(1)), F.lit(1e-9))
    bm = idf * (DELTA + F.col("tf") * (K + 1) / (F.col("tf") + K * (1 - B + B * F.col("length") / mean)))
    fields = index.fields.select("field", F.col("records").alias("all"), F.col("terms").alias("every"))  # eight rows
    scored = found.join(known, ["term", "field"]).join(F.broadcast(fields), "field")
    # a list moves whole to its block, where its score goes to its records
    told = scored.select("block", "ats", (F.element_at(weight, F.col("field")) * nearness * bm).alias("score")).repartition("block")
    sums = told.select("block", F.explode("ats").alias("off"), "score").groupBy("block", "off").agg(F.sum("score").alias("score"))
    hits = sums.select(F.shiftleft("block", BITS).bitwiseOR(F.col("off").cast("long")).alias("at"), "score").join(named, "at")
    key, q = F.lower("label"), query.strip().lower()
    tier = F.when(key == q, 3).when(key.startswith(q), 2).when(key.contains(q), 1).otherwise(0)
    out = hits.withColumn("tier", tier).orderBy(F.col("tier").desc(), F.col("score").desc(), "natural")
    return (out.limit(k) if k else out).select("id", "tier", "score")
