"""Drift between a baseline and a latest snapshot (inventory J1, J2, J8, D1-D4, D6, A1-A10)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.policy import EmptyRule, Quality
from ..sources.scratch import written
from ..sources.snapshot import Snapshot, settled, union_fields

KINDS = ("string", "number", "boolean", "object", "array")
#: Fields whose flags share one long.
_BITS = 60


def _rule(quality: Quality, field: str) -> tuple[tuple[str, ...], bool]:
    r = quality.empty_rules.get(field, EmptyRule())
    return r.placeholders, r.allow_empty_array


def empty(side: Snapshot, field: str, quality: Quality, of: str | None = None) -> Column:
    return side.col(field, of).isNull() if isinstance(side, Flags) else V.is_empty(side.col(field, of), *_rule(quality, field))


def _keyed(side: Snapshot, identity: Sequence[str], name: str, label: str) -> DataFrame:
    """Records under their id; a record without a key gets one of its own."""
    key = F.coalesce(side.key(identity), F.concat(F.lit(f"$unkeyed:{label}:"), F.col("idx")))
    return side.df.select(key.alias("id"), side.record().alias(name))


def _last(keyed: DataFrame, name: str) -> DataFrame:
    """Of records that share an id the last, added up map-side."""
    return keyed.groupBy("id").agg(F.max_by(name, F.col(f"{name}.idx")).alias(name))


def paired(baseline: Snapshot, latest: Snapshot, identity: Sequence[str]) -> DataFrame:
    """Full outer match by id, last record of an id wins: ``id``, ``b``, ``l`` (NULL where a side has none)."""
    return _last(_keyed(baseline, identity, "b", "baseline"), "b").join(_last(_keyed(latest, identity, "l", "latest"), "l"), "id", "full_outer")


def compared(baseline: Snapshot, latest: Snapshot, identity: Sequence[str], quality: Quality, keep: bool = False) -> DataFrame:
    """``id``, ``status``, ``changes`` (path, kind, before, after), ``n_changed``, ``severity``.

    Two objects are compared field by field down to the deepest (``a.b.c``), inside the record's
    row: as many steps as both sides' objects are deep at most, none where cells hold no objects.
    ``keep``: both records (``b``, ``l``) stay beside their changes.
    """
    both = paired(baseline, latest, identity)
    levels = min(nesting(baseline), nesting(latest)) if baseline.nested and latest.nested else 0
    one = []
    for f in union_fields(baseline, latest):
        b, a = baseline.col(f, "b"), latest.col(f, "l")
        kind = V.change_kind(b, a, *_rule(quality, f))
        one.append(F.when(kind.isNotNull(), F.array(F.struct(F.lit(f).alias("path"), kind.alias("kind"), b.alias("before"), a.alias("after")))).otherwise(F.array().cast("array<struct<path:string,kind:string,before:string,after:string>>")))
    fields = F.flatten(F.array(*one))  # a filter's lambda would have all of it interpreted
    whole = lambda kind: F.array(F.struct(F.lit("$record").alias("path"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    # settled at each level: filters on the changes stay above it, where they would else be pushed below as copies of all levels' expressions
    out = both.select("id", F.when(F.col("b").isNull(), "added").when(F.col("l").isNull(), "removed").alias("side"), F.when(F.col("b").isNull(), whole("added")).when(F.col("l").isNull(), whole("removed")).otherwise(fields).alias("changes"), *(("b", "l") if keep else ()))
    for _ in range(levels):
        out = settled(out).withColumn("changes", F.when(F.exists("changes", lambda c: _objects(c["before"], c["after"])), _taken_apart(F.col("changes"), quality)).otherwise(F.col("changes")))
    out = settled(out)
    out = out.withColumn("status", F.coalesce("side", F.when(F.size("changes") > 0, "changed").otherwise("unchanged"))).drop("side")
    return _weighed(out, quality)


def changes(diff: DataFrame) -> DataFrame:
    """One row a change: id, path, kind, before, after."""
    return diff.select("id", F.inline("changes"))


def nesting(side: Snapshot) -> int:
    """How deep objects of a side's cells are nested at most, 0 if no cell holds one; one map-side aggregation. Braces inside strings don't count."""
    if not side.nested:
        return 0

    def depth(cell: Column) -> Column:
        braces = F.regexp_replace(F.regexp_replace(cell, r'"(?:[^"\\]|\\.)*"', ""), "[^{}]", "")
        steps = F.aggregate(F.split(braces, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, c: F.when(c == "{", F.struct((s["now"] + 1).alias("now"), F.greatest(s["most"], s["now"] + 1).alias("most"))).when(c == "}", F.struct((s["now"] - 1).alias("now"), s["most"].alias("most"))).otherwise(s))
        return F.when(cell.startswith("{"), steps["most"]).otherwise(0)

    return side.df.agg(F.coalesce(F.max(F.greatest(F.lit(0), *[depth(side.col(f)) for f in side.fields])), F.lit(0)).alias("n")).first()["n"]


def _taken_apart(changes: Column, quality: Quality) -> Column:
    """One level of D1: a change between two objects gives way to the changes of their fields, inside the row."""
    fields = lambda c: F.from_json(c, "map<string,variant>")
    part = lambda m, k: V.json_of_variant(F.try_element_at(m, k))

    def kind(path: Column, b: Column, a: Column) -> Column:
        out = V.change_kind(b, a)
        for name in quality.empty_rules:
            out = F.when(path == name, V.change_kind(b, a, *_rule(quality, name))).otherwise(out) if "." in name else out
        return out

    def inner(c: Column) -> Column:
        both = F.array(F.struct(c["path"].alias("path"), fields(c["before"]).alias("b"), fields(c["after"]).alias("a")))  # parsed once, bound by the lambda
        cells = lambda m: F.transform(F.array_union(F.map_keys(m["b"]), F.map_keys(m["a"])), lambda k: F.struct(F.concat_ws(".", m["path"], k).alias("path"), part(m["b"], k).alias("before"), part(m["a"], k).alias("after")))
        told = F.transform(F.flatten(F.transform(both, cells)), lambda x: F.struct(x["path"].alias("path"), kind(x["path"], x["before"], x["after"]).alias("kind"), x["before"].alias("before"), x["after"].alias("after")))
        return F.filter(told, lambda x: x["kind"].isNotNull())

    return F.flatten(F.transform(changes, lambda c: F.when(_objects(c["before"], c["after"]), inner(c)).otherwise(F.array(c))))


def _objects(before: Column, after: Column) -> Column:
    return F.coalesce(before.startswith("{") & after.startswith("{"), F.lit(False))


def _weighed(diff: DataFrame, quality: Quality) -> DataFrame:
    """Adds ``n_changed`` and ``severity``."""
    required = list(quality.required)
    lost = F.exists("changes", lambda c: c["path"].isin(required) & c["kind"].isin("emptied", "removed")) if required else F.lit(False)
    severity = F.when(lost, "critical").when(F.exists("changes", lambda c: c["kind"] == "emptied"), "high").when(F.size("changes") > 0, "warning").otherwise("pass")
    return diff.select("id", "status", "changes", F.size("changes").alias("n_changed"), severity.alias("severity"), *[c for c in ("b", "l") if c in diff.columns])


def _rows_of(counts: DataFrame, fields: Sequence[str], names: Sequence[str], prefix: str = "") -> DataFrame:
    rows = [F.struct(F.lit(f).alias("field"), *[F.col(f"{n}{i}").alias(f"{prefix}{n}") for n in names]) for i, f in enumerate(fields)]
    return counts.select(F.inline(F.array(*rows)), *[c for c in counts.columns if c == "n_records"])


def _side_stats(side: Snapshot, fields: Sequence[str], quality: Quality, prefix: str) -> DataFrame:
    """One pass over a side: per field its present count and type counts."""
    told = settled(side.df.select(*[x for i, f in enumerate(fields) for x in ((~empty(side, f, quality)).alias(f"p{i}"), V.kind_of(side.col(f)).alias(f"t{i}"))]))
    sums = [F.count("*").alias("n_records")]
    for i in range(len(fields)):
        sums += [F.count_if(f"p{i}").alias(f"present{i}"), *[F.count_if(F.col(f"t{i}") == k).alias(f"{k}{i}") for k in KINDS]]
    out = _rows_of(told.agg(*sums), fields, ("present", *KINDS), prefix)
    types = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*[F.col(prefix + k) for k in KINDS])), lambda k, v: v > 0)
    return out.select("field", F.col("n_records").alias(f"{prefix}records"), f"{prefix}present", types.alias(f"{prefix}types"))


@dataclass(frozen=True)
class Flags(Snapshot):
    """A side whose cells only tell whether they hold something (``1``) or not (NULL), beside the record's ``key``."""

    def key(self, fields: Sequence[str], of: str | None = None) -> Column:
        return F.col(f"{of}.key" if of else "key")


def flags(side: Snapshot, identity: Sequence[str], quality: Quality) -> Flags:
    """What counting presence, repeated keys and issues needs of a side, worked out and written once. Types of cells are lost."""
    cells = [F.when(~empty(side, f, quality), "1").alias(f"f{i}") for i, f in enumerate(side.fields)]
    return Flags(written(side.df.select("idx", side.key(identity).alias("key"), *cells), "flags"), side.fields)


def field_stats(baseline: Snapshot, latest: Snapshot, identity: Sequence[str], quality: Quality) -> DataFrame:
    """A1, A2: presence counts and rates a side, change of the rate, emptied records among pairs, types, severity.

    Three map-side aggregations, none of which explodes records into cells.
    """
    fields = union_fields(baseline, latest)
    b, a = _side_stats(baseline, fields, quality, "baseline_"), _side_stats(latest, fields, quality, "latest_")
    # Every baseline record that shares a key counts, the last latest one answers
    bits = lambda s, n: [sum([F.when(empty(s, f, quality), F.lit(1 << i).cast("long")).otherwise(0) for i, f in enumerate(fields[j : j + _BITS])], F.lit(0).cast("long")).alias(f"{n}{j // _BITS}") for j in range(0, len(fields), _BITS)]  # noqa: E731  only flags move
    longs = range(-(-len(fields) // _BITS))
    left = baseline.df.select(baseline.key(identity).alias("id"), *bits(baseline, "b")).where("id is not null")
    right = latest.df.select(latest.key(identity).alias("id"), "idx", *bits(latest, "l")).where("id is not null").groupBy("id").agg(F.max("idx").alias("idx"), *[F.max_by(f"l{j}", "idx").alias(f"l{j}") for j in longs])
    bit = lambda side, i: F.col(f"{side}{i // _BITS}").bitwiseAND(F.lit(1 << i % _BITS).cast("long"))
    lost = left.join(right, "id").agg(*[F.count_if((bit("b", i) == 0) & (bit("l", i) != 0)).alias(f"emptied{i}") for i in range(len(fields))])
    out = b.join(F.broadcast(a), "field").join(F.broadcast(_rows_of(lost, fields, ("emptied",))), "field")  # a row a field
    rate = lambda s: F.when(F.col(f"{s}records") > 0, F.col(f"{s}present") / F.greatest(F.col(f"{s}records"), F.lit(1))).otherwise(F.lit(0.0))
    out = out.withColumns({"baseline_rate": rate("baseline_"), "latest_rate": rate("latest_")}).withColumn("rate_change", F.col("latest_rate") - F.col("baseline_rate"))
    drop = F.col("baseline_rate") - F.col("latest_rate")
    severity = (
        F.when(F.col("field").isin(*quality.required) & (F.col("latest_rate") <= 0.05) if quality.required else F.lit(False), "critical")
        .when((F.col("baseline_rate") >= 0.8) & (F.col("latest_rate") <= 0.2) & (F.col("emptied") >= 25), "critical")
        .when((drop >= 0.3) & (F.col("emptied") >= 25), "high")
        .when(drop >= 0.1, "warning")
        .otherwise("pass")
    )
    return out.withColumn("severity", severity)


def duplicate_keys(baseline: Snapshot, latest: Snapshot, identity: Sequence[str]) -> DataFrame:
    """A4: keys that repeat inside a side."""
    own = lambda s: s.df.select(s.key(identity).alias("key")).where("key is not null").groupBy("key").count().where("count > 1").select("key")
    return own(baseline).unionByName(own(latest)).distinct()


def change_rollup(diff: DataFrame, stats: DataFrame) -> DataFrame:
    """Per field its changes by kind."""
    kinds = changes(diff).where("path <> '$record'").groupBy(F.col("path").alias("field")).agg(F.count("*").alias("changed"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("emptied", "restored", "modified")])
    out = stats.select("field").join(kinds, "field", "left")
    return out.na.fill(0)


def worst_regressions(stats: DataFrame, n: int = 5) -> DataFrame:
    """A10: the fields whose rate fell most."""
    return stats.where("rate_change < 0").orderBy("rate_change", "field").limit(n)


def group_incidents(stats: DataFrame, quality: Quality) -> DataFrame:
    """Field groups of which enough fields fell far enough."""
    spark = stats.sparkSession
    rows = [(g.id, g.name, f, g.threshold_drop, g.min_affected, g.severity, g.narrative) for g in quality.groups for f in g.fields]
    groups = spark.createDataFrame(rows, "id string, name string, field string, threshold double, least int, severity string, narrative string")
    hit = stats.select("field", (F.col("baseline_rate") - F.col("latest_rate")).alias("drop")).join(F.broadcast(groups), "field").where("drop >= threshold")
    return hit.groupBy("id", "name", "severity", "narrative", "least").agg(F.sort_array(F.collect_list("field")).alias("fields")).where(F.size("fields") >= F.col("least")).drop("least")


def change_counts(baseline: Snapshot, latest: Snapshot, identity: Sequence[str], quality: Quality) -> DataFrame:
    """A5, counted: per field the paired records in which it changed as a whole (changes inside two objects have paths of their own) (``changed``), and all records by id (``records``); one map-side aggregation over the pairs."""
    fields = union_fields(baseline, latest)
    both = F.col("b").isNotNull() & F.col("l").isNotNull()
    sums = [F.count_if(both & ~_objects(baseline.col(f, "b"), latest.col(f, "l")) & V.change_kind(baseline.col(f, "b"), latest.col(f, "l"), *_rule(quality, f)).isNotNull()).alias(f"changed{i}") for i, f in enumerate(fields)]
    return _rows_of(paired(baseline, latest, identity).agg(F.count("*").alias("n_records"), *sums), fields, ("changed",)).withColumnRenamed("n_records", "records")


def changed_records(diff: DataFrame) -> DataFrame:
    """A5: path and id of every change."""
    return diff.select(F.explode(F.array_distinct(F.transform("changes", lambda c: c["path"]))).alias("path"), "id")


#: Texts of issues (fixed values).
ISSUE_TEXTS = {
    "empty": ("No records found in either file", "The collection path matched no records in either file. Check the collection path setting — a wrong path selects nothing and the comparison is meaningless."),
    "unkeyed": " record(s) have missing or blank identity values and cannot be matched across runs; they are shown as added/removed.",
}


def quality_issues(baseline: Snapshot, latest: Snapshot, identity: Sequence[str], quality: Quality, stats: DataFrame | None = None, related: bool = True, repeated: DataFrame | None = None) -> DataFrame:
    """A3: ``ord``, ``id``, ``kind``, ``severity``, ``fields``, ``n`` (records concerned), ``title``, ``description``, in the fixed order of kinds.

    A field's issue concerns the records in which the field changed, a group's all records.
    ``related``: whether these are counted, for which records are paired; else their ``n`` is NULL. ``stats``, ``repeated``: what
    :func:`field_stats` and :func:`duplicate_keys` gave, where that is written.
    """
    stats = field_stats(baseline, latest, identity, quality) if stats is None else stats
    counts = change_counts(baseline, latest, identity, quality) if related else stats.select("field", F.lit(None).cast("long").alias("changed"), F.lit(None).cast("long").alias("records"))
    key = lambda s: s.df.agg(F.count("*").alias("n"), F.count_if(s.key(identity).isNull()).alias("unkeyed"))
    sides = key(baseline).select(F.col("n").alias("bn"), F.col("unkeyed").alias("bu")).join(F.broadcast(key(latest).select(F.col("n").alias("ln"), F.col("unkeyed").alias("lu"))))  # one row beside one row
    some = lambda *f: F.array(*map(F.lit, f)).cast("array<string>")
    said = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    def row(ord_: int, kind: str, severity: Column, n: Column, title: Column, description: Column, *f: str) -> Column:
        return F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("id"), F.lit(kind).alias("kind"), severity.alias("severity"), some(*f).alias("fields"), n.cast("long").alias("n"), title.alias("title"), description.alias("description"))

    unkeyed, total = F.col("bu") + F.col("lu"), F.col("bn") + F.col("ln")
    none = unkeyed == total
    first = sides.select(
        F.inline(
            F.filter(
                F.array(
                    F.when(total == 0, row(0, "empty-collection", F.lit("critical"), F.lit(0), *map(F.lit, ISSUE_TEXTS["empty"]))),
                    F.when(
                        unkeyed > 0,
                        row(
                            1, "unkeyed-records", F.when(none, "critical").otherwise("warning"), unkeyed, F.when(none, "No record could be identity-keyed").otherwise("Records missing identity values"),
                            F.when(none, said("None of the ", unkeyed, f" records produced an identity key from [{', '.join(identity)}] — check the identity field names.")).otherwise(said(unkeyed, ISSUE_TEXTS["unkeyed"])), *identity,
                        ),
                    ),
                    F.when(F.col("ln") < F.col("bn"), row(2, "record-count-reduction", F.lit("warning"), F.lit(0), F.lit("Record count reduced"), said("Latest records dropped from ", F.col("bn"), " to ", F.col("ln")))),
                ),
                lambda x: x.isNotNull(),
            )
        )
    )
    columns = ("ord", "id", "kind", "severity", "fields", "n", "title", "description")
    repeated = (duplicate_keys(baseline, latest, identity) if repeated is None else repeated).agg(F.count("*").alias("keys")).where("keys > 0")
    repeated = repeated.select(F.inline(F.array(row(3, "duplicate-record-keys", F.lit("critical"), F.col("keys"), F.lit("Duplicate record identity keys"), said("Found ", F.col("keys"), " duplicate record keys"), *quality.identity))))
    percent = lambda c: F.format_string("%.1f", F.col(c) * 100)
    fell = stats.where("severity <> 'pass'").join(F.broadcast(counts), "field").select(  # a row a field
        F.lit(4).alias("ord"), F.concat(F.lit("field-population-"), "field").alias("id"), F.lit("field-population").alias("kind"), "severity", F.array("field").alias("fields"), F.col("changed").alias("n"), said(F.col("field"), " population regression").alias("title"),
        said(F.col("field"), " fill rate changed from ", percent("baseline_rate"), "% to ", percent("latest_rate"), "% (", percent("rate_change"), "pp)").alias("description"),
    )
    out = first.unionByName(repeated).unionByName(fell)
    if not quality.groups:
        return out
    groups = group_incidents(stats, quality).join(F.broadcast(counts.agg(F.max("records").alias("n"))))
    return out.unionByName(groups.select(F.lit(5).alias("ord"), F.concat(F.lit("group-"), "id").alias("id"), F.lit("field-group-incident").alias("kind"), "severity", "fields", "n", said(F.col("name"), " incident").alias("title"), F.col("narrative").alias("description")).select(*columns))


def gate(issues: DataFrame) -> DataFrame:
    """``Quarantined`` with a critical issue, ``Warning`` with a high one or a warning, else ``Pass``."""
    sums = issues.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity").isin("high", "warning")).alias("lesser"))
    return sums.withColumn("gate", F.when(F.col("critical") > 0, "Quarantined").when(F.col("lesser") > 0, "Warning").otherwise("Pass"))


def summary(diff: DataFrame) -> DataFrame:
    """Records by status."""
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")])


#: What the narrative looks at, and its texts (fixed values).
HEADER_GROUP = "group-header-metadata"
DOCUMENT_FIELDS = ("BidDocuments", "BidDocumentHashes", "AddendumDocuments", "BidTabulations", "AwardDocuments")
URL_FIELDS = ("BidURL", "ResourceURL")
NO_PATTERN = "No major extraction incident pattern detected."
HEADER_ONLY = "Bid header metadata experienced a completeness collapse while document extraction remains healthy. This indicates a summary/header parser regression rather than a complete source collection failure."
HEADER_FAILURE = "Likely bid summary/header extraction failure."


def narrative(issues: DataFrame, stats: DataFrame) -> str:
    """One sentence; a header incident is a parser's fault where document and URL fields kept their population. Both inputs have a row a field or issue at most."""
    if issues.where(F.col("id") == HEADER_GROUP).isEmpty():
        return NO_PATTERN
    fell = stats.where(F.col("field").isin(*DOCUMENT_FIELDS, *URL_FIELDS) & (F.col("baseline_rate") - F.col("latest_rate") >= 0.1))
    return HEADER_ONLY if fell.isEmpty() else HEADER_FAILURE


def promoted(diff: DataFrame, issues: DataFrame, repeated: DataFrame) -> DataFrame:
    """``issue_ids`` of each record, and critical severity where one of them is critical.

    A group incident relates to every record, a field's issue to those where the field changed,
    the issue of repeated keys to the records under those keys (``repeated``: :func:`duplicate_keys`),
    that of unkeyed records to those without a key. The other two relate to none.
    """
    own = issues.agg(F.sort_array(F.collect_list(F.struct("ord", "id", "severity", "fields"))).alias("issues"))  # a row an issue
    twice = repeated.select(F.col("key").alias("id"), F.lit(True).alias("twice"))

    def relates(i: Column) -> Column:
        changed = F.exists("changes", lambda c: F.array_contains(i["fields"], c["path"]))
        return F.when(i["ord"] == 5, True).when(i["ord"] == 4, changed).when(i["ord"] == 3, F.col("twice").isNotNull()).when(i["ord"] == 1, F.col("id").startswith("$unkeyed:")).otherwise(False)

    out = diff.join(twice, "id", "left").join(F.broadcast(own)).withColumn("hit", F.filter("issues", relates))
    return out.withColumns({"issue_ids": F.transform("hit", lambda i: i["id"]), "severity": F.when(F.exists("hit", lambda i: i["severity"] == "critical"), "critical").otherwise(F.col("severity"))}).drop("issues", "hit", "twice")
