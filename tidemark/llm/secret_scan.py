"""Secrets by a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: a disjunction of
conjunctions that every match must satisfy. The inverted index holds a posting (trigram,
text) for each trigram that some query names; postings are intersected per conjunction by
a grouped bit-or, and only candidate (text, rule) pairs are verified with the pattern.
Rules without mandatory trigrams scan every text.

Positions are code points, end exclusive. Null text is the empty text. Equal rows share
their postings and get one output row each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, text_key, unclashed

try:  # the parser's public name changed in Python 3.11
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """A match counts if group ``group`` has ``least`` characters or more. The pattern must read alike in Python and Java and never match the empty string."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The contract's kinds, in its order, then kinds of this module.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN[A-Z\x20]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: Most strings that a set of exact strings may hold while a pattern is read.
EXACT = 64


def _cross(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= EXACT else None


def _exact(items) -> set[str] | None:
    """The lower-cased strings that the items match, if they are few."""
    out: set[str] = {""}
    for op, arg in items:
        part = _exact_one(op, arg)
        if part is None or (out := _cross(out, part)) is None:
            return None
    return out


def _exact_one(op, arg) -> set[str] | None:
    if op is sre.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return {chr(a).lower() if a < 128 else chr(a) for _, a in arg}
    if op is sre.SUBPATTERN:
        return _exact(arg[-1])
    if op is sre.BRANCH:
        parts = [_exact(x) for x in arg[1]]
        return None if None in parts or sum(map(len, parts)) > EXACT else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 8:
        one = _exact(arg[2])
        if one is None:
            return None
        out, power = set(), {""}
        for n in range(arg[1] + 1):
            out |= power if n >= arg[0] else set()
            if (power := _cross(power, one)) is None or len(out) > EXACT:
                return None
        return out
    return None


def _and(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    return _lean({x | y for x in a for y in b})


def _lean(q: set[frozenset]) -> set[frozenset]:
    """Drops conjunctions that a weaker one makes needless."""
    return {x for x in q if not any(y < x for y in q)}


def _trigrams(strings: set[str]) -> set[frozenset]:
    return _lean({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _query(items) -> set[frozenset]:
    query, run = {frozenset()}, {""}
    for op, arg in [*items, (None, None)]:
        part = _exact_one(op, arg) if op is not None else None
        if part is not None and (longer := _cross(run, part)) is not None:
            run = longer
            continue
        query, run = _and(query, _trigrams(run)), part or {""}
        if part is None and op is not None:
            query = _and(query, _deeper(op, arg))
    return query


def _deeper(op, arg) -> set[frozenset]:
    if op is sre.SUBPATTERN:
        return _query(arg[-1])
    if op is sre.BRANCH:
        return _lean(set().union(*[_query(x) for x in arg[1]]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
        return _query(arg[2])
    return {frozenset()}


#: Matches that are walked along at a time.
PART = 256


def trigram_query(pattern: str) -> list[list[str]]:
    """Sorted disjunction of conjunctions of lower-case trigrams; [] if the pattern has no mandatory trigram.

    Trigrams are kept only where they are ASCII, since only A-Z is lower-cased.
    """
    query = {frozenset(t for t in c if t.isascii()) for c in _query(sre_parse.parse(pattern))}
    return [] if frozenset() in query else sorted(sorted(c) for c in _lean(query))


def candidates(docs: DataFrame, rules: Sequence[Rule], key: str = "key", text: str = "text") -> DataFrame:
    """``(key, rules)``: numbers of the rules whose trigram query the text's postings satisfy; texts without one are absent."""
    spark = docs.sparkSession
    clauses = [(n, c) for n, r in enumerate(rules) for c in trigram_query(r.pattern)]
    named = sorted({t for _, c in clauses for t in c})
    terms = spark.createDataFrame([(t, k, 1 << i, (1 << len(c)) - 1, n) for k, (n, c) in enumerate(clauses) for i, t in enumerate(c)], "trigram string, clause int, bit long, whole long, rule int")
    if not named:
        return docs.select(F.col(key), F.array().cast("array<int>").alias("rules")).limit(0)
    low = docs.select(F.col(key).alias("key"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    postings = low.select("key", F.explode(F.filter(F.array(*map(F.lit, named)), lambda t: F.col("low").contains(t))).alias("trigram"))
    met = postings.join(F.broadcast(terms), "trigram").groupBy("key", "rule", "clause", "whole").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = whole").groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def _spans(text: Column, n: int, rule: Rule) -> Column:
    """Array of (start, kind, end): the gaps that split() leaves and the matches between them give the places."""
    found, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.zip_with(F.arrays_zip(found.alias("m"), held.alias("h")), gaps, lambda x, g: F.struct(F.length(g).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["h"]).alias("held")))
    steps = F.filter(steps, lambda x: x["len"].isNotNull())  # the gap behind the last match
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    one = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(n).alias("kind"), (at + x["gap"] + x["len"]).alias("end"))
    walked = lambda part, at: F.aggregate(
        part,
        F.struct(at.alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.when(x["held"] >= rule.least, F.concat(acc["out"], F.array(one(acc["at"], x)))).otherwise(acc["out"]).alias("out")),
    )["out"]
    parts = _parts(steps)
    widths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x["gap"] + x["len"]))
    heads = F.aggregate(widths, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    out = F.flatten(F.zip_with(parts, F.slice(heads, 1, F.size(parts)), walked))
    return F.when(text.rlike(rule.pattern), out).otherwise(none)


def _parts(items: Column) -> Column:
    """An array in stretches of PART: what is appended to while walking along stays short, however many matches a text has."""
    return F.when(F.size(items) == 0, F.transform(F.array(F.lit(0)), lambda i: items)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(PART)), lambda i: F.slice(items, i, PART)))


def apply(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, columns of ``keep``, ``text`` (never null) and ``spans``: array of (start, kind, end) by start, then rule; kind is the rule's number."""
    keep = unclashed(keep, "doc_id", "text", "spans")
    own = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"k_{c}") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("key", text_key(F.col("doc_id"), F.col("text")))
    found = own.join(candidates(own, rules), "key", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = []
    for n, rule in enumerate(rules):
        spans = _spans(F.col("text"), n, rule)
        parts.append(F.when(F.array_contains("rules", n), spans).otherwise(none) if trigram_query(rule.pattern) else spans)
    return found.select("doc_id", *[F.col(f"k_{c}").alias(c) for c in keep], "text", F.array_sort(F.concat(*parts)).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span replaced by ``mark``; overlapping spans become one."""
    piece = lambda part, at: F.aggregate(
        part,
        F.struct(at.alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    parts = _parts(spans)
    ends = F.transform(parts, lambda p: F.coalesce(F.array_max(F.transform(p, lambda s: s["end"])), F.lit(0)))
    heads = F.aggregate(ends, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e))))
    pieces = F.array_join(F.zip_with(parts, F.slice(heads, 1, F.size(parts)), piece), "")
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(pieces, F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))))


def joined(spans: Column, rules: Sequence[Rule], only: int | None = None) -> Column:
    """``kind:start:end`` of each span, comma-joined; of the first ``only`` rules if given."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    wanted = F.filter(spans, lambda s: s["kind"] < only) if only is not None else spans
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def python_matches(text: str, rules: Sequence[Rule]) -> list[tuple[int, int, int]]:
    """The brute-force reading of the same rules, for tests."""
    return sorted((m.start(), n, m.end()) for n, r in enumerate(rules) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least)
