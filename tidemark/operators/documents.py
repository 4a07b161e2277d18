"""Diff of document lists nested in records (inventory N1-N6), inside each record's row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.snapshot import settled

DOCUMENTS = "array<struct<title:string,url:string,hash:string>>"


def decoded(json: Column) -> Column:
    """A list that was itself written as a JSON string is taken out of it."""
    text = V.string_of(json)
    return F.when(text.startswith("["), text).otherwise(json)


#: A value in JSON that is neither a text nor null (or looks like one inside a text).
_OTHER_VALUE = r'"\s*:\s*[^"\sn]'


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _part(text: Column) -> Column:
    """The trimmed text, NULL if blank. Trimming walks the text; most have no blank at either end."""
    printed = lambda c: F.ascii(c).between(33, 126)
    kept = lambda t: F.when(printed(t) & printed(F.substring(t, -1, 1)), t).otherwise(_bound(V.js_trim(t), lambda x: F.when(x != "", x)))
    return _bound(text, kept)


def _plain(text: Column) -> Column:
    """N2 for lists whose items are objects of texts with no name told twice in any case, by one parsing; NULL for all others, whose values only a variant tells as canonical text."""
    maps = F.from_json(text, "array<map<string,string>>")
    items = F.transform(maps, lambda m: F.struct(F.transform(F.map_keys(m), F.lower).alias("k"), F.map_values(m).alias("v")))
    once = lambda x: F.size(F.array_distinct(x["k"])) == F.size(x["k"])
    item = lambda x: F.struct(*[_part(F.get(x["v"], (F.array_position(x["k"], name) - 1).cast("int"))).alias(name) for name in ("title", "url", "hash")])
    return F.when(~text.rlike(_OTHER_VALUE), _bound(items, lambda own: F.when(F.forall(own, once), F.transform(own, item))))


def normalised(json: Column) -> Column:
    """Array of (title, url, hash); names in any case, trimmed, blank becomes NULL; other items are dropped."""
    items = F.from_json(decoded(json), "array<variant>")
    maps = F.transform(F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT")), lambda v: F.from_json(F.to_json(v), "map<string,string>"))
    part = lambda m, name: _part(F.get(F.map_values(F.map_filter(m, lambda k, v: F.lower(k) == name)), F.lit(0)))
    out = F.transform(maps, lambda m: F.struct(part(m, "title").alias("title"), part(m, "url").alias("url"), part(m, "hash").alias("hash")))
    return F.coalesce(_plain(decoded(json)), out, F.array().cast(DOCUMENTS))


def hash_list(json: Column) -> Column:
    """Hashes of a plain list."""
    out = F.filter(F.transform(F.from_json(decoded(json), "array<string>"), V.js_trim), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(out, F.array().cast("array<string>"))


def _by_hash(docs: Column) -> Column:
    """Map from hash to document; of equal hashes in one list the last counts. Only lists that repeat a hash are sorted."""
    held = F.filter(docs, lambda d: d["hash"].isNotNull())

    def last(own: Column) -> Column:
        rows = F.array_sort(F.transform(own, lambda d, i: F.struct(d["hash"].alias("hash"), i.alias("at"), d.alias("d"))))  # equal ones stand side by side, the last of them last
        return _bound(rows, lambda r: F.filter(r, lambda x, i: ~F.coalesce(F.get(r, i + 1)["hash"] == x["hash"], F.lit(False)))["d"])

    once = lambda own: F.size(F.array_distinct(own["hash"])) == F.size(own)
    kept = _bound(held, lambda own: F.when(once(own), own).otherwise(last(own)))
    return _bound(kept, lambda own: F.map_from_arrays(own["hash"], own))


def changes(before: Column, after: Column) -> Column:
    """N3 inside the row: array of (hash, state, before, after) of each hash that was added, removed or modified, and of hash-less documents as incomplete."""
    no = F.lit(None).cast(DOCUMENTS[6:-1])

    def state(d: Column) -> Column:
        b, a = d["value"]["before"], d["value"]["after"]
        differ = ~(b["title"].eqNullSafe(a["title"]) & b["url"].eqNullSafe(a["url"]))
        kind = F.when(b.isNull(), "added").when(a.isNull(), "removed").when(differ, "modified")
        return F.struct(d["key"].alias("hash"), kind.alias("state"), b.alias("before"), a.alias("after"))

    both = F.map_zip_with(_by_hash(before), _by_hash(after), lambda _, b, a: F.struct(b.alias("before"), a.alias("after")))
    known = F.filter(F.transform(F.map_entries(both), state), lambda c: c["state"].isNotNull())
    bare = lambda docs, b, a: F.transform(F.filter(docs, lambda d: d["hash"].isNull()), lambda d: F.struct(F.lit(None).cast("string").alias("hash"), F.lit("incomplete").alias("state"), (d if b else no).alias("before"), (d if a else no).alias("after")))
    return F.concat(known, bare(before, True, False), bare(after, False, True))


def compared(rows: DataFrame, before: str, after: str) -> DataFrame:
    """``rows`` with ``document_changes``, once worked out for all that follows."""
    return settled(rows.withColumn("document_changes", changes(F.col(before), F.col(after))))


def compare(rows: DataFrame, key: str) -> DataFrame:
    """One row a change of :func:`compared` rows: ``key, hash, state, before, after``."""
    return rows.select(F.col(key).alias("key"), F.inline("document_changes"))


def _health(before: str, after: str, lists: tuple[str, str]) -> dict[str, Column]:
    docs = F.concat(before, after)
    hashes = lambda c: F.filter(F.transform(c, lambda d: d["hash"]), lambda h: h.isNotNull())
    listed = F.array_union(*lists)
    missing = lambda name: F.size(F.filter(docs, lambda d: d[name].isNull()))

    def repeated(side: str) -> Column:
        own = F.array_sort(hashes(F.col(side)))  # equal ones stand side by side
        return F.get(F.transform(F.array(own), lambda o: F.filter(o, lambda h, i: (i > 0) & (h == F.get(o, i - 1)))), F.lit(0))

    return {
        "missing_hash": missing("hash"), "missing_title": missing("title"), "missing_url": missing("url"), "duplicates": F.array_sort(F.array_union(repeated(before), repeated(after))),
        "not_listed": F.array_sort(F.array_except(hashes(docs), listed)), "dangling": F.array_sort(F.array_except(listed, hashes(docs))),
    }


def _summary(before: str, after: str) -> dict[str, Column]:
    count = lambda state: F.size(F.filter("document_changes", lambda c: c["state"] == state))
    n = {state: count(state) for state in ("added", "removed", "modified", "incomplete")}
    hashes = F.least(*[F.size(F.array_distinct(F.filter(F.transform(side, lambda d: d["hash"]), lambda h: h.isNotNull()))) for side in (before, after)])
    return {"n_before": F.size(before), "n_after": F.size(after), **n, "unchanged_exact": F.size(F.array_intersect(F.col(before), F.col(after))), "unchanged": F.greatest(hashes - n["modified"], F.lit(0))}


def _columns(rows: DataFrame, key: str, of: dict[str, Column]) -> DataFrame:
    return rows.select(F.col(key).alias("key"), *[c.alias(name) for name, c in of.items()])


def health(rows: DataFrame, key: str, before: str, after: str, lists: tuple[str, str]) -> DataFrame:
    """Per record the missing parts of both sides, hashes repeated inside a side, and hashes missing from or dangling in the plain lists of both sides."""
    return _columns(rows, key, _health(before, after, lists))


def summary(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Counts a record of :func:`compared` rows; ``unchanged`` is the least number of distinct hashes of a side less the modified ones, at least 0, ``unchanged_exact`` the true intersection's."""
    return _columns(rows, key, _summary(before, after))


def states(rows: DataFrame, key: str, before: str, after: str, lists: tuple[str, str]) -> DataFrame:
    """State flags a record of :func:`compared` rows: ``companion`` (N6: a hash repeats, dangles or is in no list) and the document states of the filter index (Q1), whose ``hash_mismatch`` an incomplete document sets too."""
    facts = settled(_columns(rows, key, _summary(before, after) | _health(before, after, lists)))
    companion = (F.size("dangling") > 0) | (F.size("not_listed") > 0) | (F.size("duplicates") > 0)
    flags = {s: F.col(s) > 0 for s in ("added", "removed", "modified", "incomplete")}
    return facts.select("key", *[c.alias(s) for s, c in flags.items()], companion.alias("companion"), (companion | flags["incomplete"]).alias("hash_mismatch"), (F.col("n_after") < F.col("n_before")).alias("decreased"))
