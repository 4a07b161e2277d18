"""Read models: distributions, groups with samples, filters, sorts, corroboration (inventory A11-A12, A18-A24, Q1-Q7, §2.15)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.policy import Policy
from ..sources.scratch import written
from ..sources.snapshot import Snapshot
from .qa import CATEGORIES

#: Fixed values of the features.
TRACKED_VALUES, GROUPABLE, SAMPLES, EXAMPLES = 64, 25, 5, 3


def distribution(side: Snapshot, field: str) -> DataFrame:
    """Exact counts of the populated values, by count, then value."""
    v = side.col(field)
    return side.df.where(~V.is_blank(v)).groupBy(V.text_of(v).alias("value")).count()


def tracked_values(rows: DataFrame, value: Column, order: Column) -> DataFrame:
    """A11 with the feature's cap: ``value, count, first`` of the first TRACKED_VALUES distinct populated values of ``rows``, by ``order``.

    Each row has the facts of all values beside it: ``populated``, ``distinct`` values as far as they are
    tracked, whether that is a ``lower_bound``, whether the field is ``groupable``, and ``estimate``, a sketch's count of all
    distinct values. A task passes on its own first values only: whichever is among the first of
    all is among the first of the task that holds its first row. Their counts are then summed
    map-side beside a table of these few. So no task shuffles more rows than are tracked.
    """
    told = rows.where(~V.is_blank(value)).select(V.text_of(value).alias("value"), order.cast("long").alias("at"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            for v, at in zip(b["value"].to_pylist(), b["at"].to_pylist()):
                if at < seen.get(v, 1 << 63):
                    seen[v] = at
            if len(seen) > TRACKED_VALUES + 1:  # one more tells whether there are more
                seen = dict(sorted(seen.items(), key=lambda x: x[1])[: TRACKED_VALUES + 1])
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["value", "first"])

    every = told.mapInArrow(first, "value string, first long").groupBy("value").agg(F.min("first").alias("first")).orderBy("first").limit(TRACKED_VALUES + 1)
    every = written(every, "tracked")
    kept = every.orderBy("first").limit(TRACKED_VALUES)
    counts = told.join(F.broadcast(kept), "value").groupBy("value", "first").agg(F.count("*").alias("count"))
    whole = told.agg(F.count("*").alias("all"), F.hll_sketch_estimate(F.hll_sketch_agg("value")).alias("estimate"))
    facts = every.agg(F.count("*").alias("n")).select(F.least("n", F.lit(TRACKED_VALUES)).alias("distinct"), (F.col("n") > TRACKED_VALUES).alias("lower_bound"), F.col("n").between(1, GROUPABLE).alias("groupable"))
    return counts.join(F.broadcast(whole)).join(F.broadcast(facts)).withColumnRenamed("all", "populated")


def evidence(matched: DataFrame, reference: Snapshot, candidate: Snapshot, fields: Sequence[str]) -> DataFrame:
    """Per field the eligible (reference populated, candidate blank), comparable and conflicting pairs."""
    sums = []
    for i, f in enumerate(fields):
        r, c = reference.col(f, "r"), candidate.col(f, "c")
        both = ~V.is_blank(r) & ~V.is_blank(c)
        sums += [F.count_if(~V.is_blank(r) & V.is_blank(c)).alias(f"e{i}"), F.count_if(both).alias(f"b{i}"), F.count_if(both & ~V.same_value(r, c)).alias(f"c{i}")]
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"e{i}").alias("eligible"), F.col(f"b{i}").alias("comparable"), F.col(f"c{i}").alias("conflicts")) for i, f in enumerate(fields)]
    return matched.agg(*sums).select(F.inline(F.array(*rows))).withColumn("volatility_unmeasurable", F.col("comparable") == 0)


def _first(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def backfill_groups(provenance: DataFrame) -> DataFrame:
    """Per field the backfills, distinct values, the first samples and example keys; samples are ranked, never collected whole."""
    values = provenance.groupBy("field", "output").agg(F.min("candidate_idx").alias("at"), F.count("*").alias("c"))
    sizes = values.groupBy("field").agg(F.sum("c").alias("backfills"), F.count("*").alias("distinct_values"))
    samples = _first(values, ["field"], ["at"], SAMPLES).groupBy("field").agg(F.array_sort(F.collect_list(F.struct("n", "output"))).alias("s"))
    examples = _first(provenance, ["field"], ["candidate_idx"], EXAMPLES).groupBy("field").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("e"))
    return sizes.join(samples, "field").join(examples, "field").select("field", "backfills", "distinct_values", F.array_join("s.output", "|").alias("samples"), F.array_join("e.key", "|").alias("examples"))


def exclusion_groups(exclusions: DataFrame) -> DataFrame:
    """A19."""
    sizes = exclusions.groupBy("reason").agg(F.count("*").alias("records"))
    examples = _first(exclusions, ["reason"], ["candidate_idx"], EXAMPLES).groupBy("reason").agg(F.array_sort(F.collect_list("candidate_idx")).alias("examples"))
    return sizes.join(examples, "reason")


def changed_records(recovered: DataFrame) -> DataFrame:
    """Recovered records with changes, most first."""
    n = F.size(F.array_union("backfilled", "overridden"))
    return recovered.where("excluded is null").select("key", "candidate_idx", n.alias("n_changed")).where("n_changed > 0").orderBy(F.col("n_changed").desc(), "candidate_idx")


def tiles(match_summary: DataFrame, recovery_summary: DataFrame, dedupe_summary: DataFrame, counts: DataFrame, policy: Policy) -> DataFrame:
    """``ord, id, label, value, detail, tone`` (good, neutral, warn, bad) of the five tiles (fixed texts); every input has one row (counts: a few)."""
    named = lambda dimension, name: F.max(F.when((F.col("dimension") == dimension) & (F.col("name") == name), F.col("n"))).alias(name)
    found = counts.agg(named("severity", "critical"), named("total", "total"))
    one = match_summary.join(F.broadcast(recovery_summary.select("backfilled_fields", "records_with_backfill", F.col("excluded").alias("out")))).join(F.broadcast(dedupe_summary.select("removed", "duplicate_groups"))).join(F.broadcast(found))
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    text = lambda c: F.col(c).cast("string")
    some = lambda c, yes, no: F.when(F.col(c) > 0, yes).otherwise(no)
    matched = (F.col("matched_primary") + F.col("matched_fallback")).cast("string")
    rows = (
        ("match-rate", "Match rate", said(F.format_string("%.2f", F.col("match_rate") * 100), "%"), said(matched, " of ", text("candidates"), " candidate records"), F.when(F.col("meets_minimum"), "good").otherwise("bad")),
        ("values-recovered", "Values recovered", text("backfilled_fields"), said("across ", text("records_with_backfill"), " records") if policy.backfillable()[0] else F.lit("no field is approved for backfill"), some("backfilled_fields", "good", "neutral")),
        ("records-excluded", "Records excluded", text("out"), some("out", "see exclusions below", "none"), some("out", "warn", "good")),
        ("duplicates-removed", "Duplicates removed", text("removed"), said(text("duplicate_groups"), " duplicate group(s)"), some("removed", "warn", "good")),
        ("critical-findings", "Critical findings", text("critical"), said(text("total"), " findings in total"), some("critical", "bad", "good")),
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("id"), F.lit(b).alias("label"), v.alias("value"), d.alias("detail"), t.alias("tone")) for i, (a, b, v, d, t) in enumerate(rows)])))


def options(findings: DataFrame) -> DataFrame:
    """Values present for each filter, one row each."""
    cols = ("severity", "category", "action", "field")
    rows = findings.groupBy(*cols).count().select(F.inline(F.array(*[F.struct(F.lit(c).alias("filter"), F.col(c).alias("value")) for c in cols])))
    return rows.where("value is not null").distinct()


def ticket_groups(findings: DataFrame) -> DataFrame:
    """Findings by category and field with the most severe severity."""
    rank = F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.col("severity"))
    return findings.groupBy("category", "field").agg(F.count("*").alias("findings"), F.min_by("severity", rank).alias("severity"))


def ticket_fields(groups: DataFrame) -> DataFrame:
    """One row a field: its largest group's category and count (of equal ones the earlier category), and its other categories, sorted."""
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    w = groups.where("field is not null").groupBy("field").agg(F.max_by(F.struct("category", "findings"), F.struct("findings", -order)).alias("main"), F.collect_set("category").alias("all"))
    return w.select("field", F.col("main.category").alias("main"), F.col("main.findings").alias("findings"), F.array_join(F.array_sort(F.array_except("all", F.array("main.category"))), ",").alias("others"))


def holds(statuses: Sequence[str] = (), fields: Sequence[str] = (), kinds: Sequence[str] = (), severities: Sequence[str] = ()) -> Column:
    """Q1, Q2: whether all given filters hold of a compared record; no index beyond the columns."""
    out = F.lit(True)
    if statuses:
        out = out & F.col("status").isin(*statuses)
    if severities:
        out = out & F.col("severity").isin(*severities)
    if fields:
        out = out & F.exists("changes", lambda c: c["path"].isin(*fields))
    if kinds:
        out = out & F.exists("changes", lambda c: c["kind"].isin(*kinds))
    return out


def filtered(diff: DataFrame, statuses: Sequence[str] = (), fields: Sequence[str] = (), kinds: Sequence[str] = (), severities: Sequence[str] = ()) -> DataFrame:
    """The compared records of which :func:`holds` is true."""
    return diff.where(holds(statuses, fields, kinds, severities))


def path_changed(changes: Column, field: str) -> Column:
    """Whether a change is the field's or lies below it."""
    return F.exists(changes, lambda c: (c["path"] == field) | c["path"].startswith(field + "."))


def column_text(json: Column, blank: str = "") -> Column:
    """A record's value in a table column; absent, null and empty texts show as ``blank``."""
    text = F.when(json != V.NULL_JSON, V.text_of(json))
    return F.coalesce(F.when(text != "", text), F.lit(blank))


def documents_text(added: Column, removed: Column, modified: Column) -> Column:
    """A document list's changes in words; ``-`` where there is no list."""
    return F.coalesce(F.concat(added.cast("string"), F.lit(" added · "), removed.cast("string"), F.lit(" removed · "), modified.cast("string"), F.lit(" modified")), F.lit("-"))


SEVERITY_RANK = {"critical": 4, "high": 3, "warning": 2, "info": 1, "pass": 0}


def severity_rank() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), F.col("severity"))


#: Columns of the record table and of the field-change table by which they sort.
RECORD_SORTS = ("status", "key", "title", "changes", "documents", "severity", "published", "due")
FIELD_SORTS = {"field": None, "changed": "changed", "emptied": "emptied", "restored": "restored", "modified": "modified", "baseline": "baseline_rate", "latest": "latest_rate", "change": "rate_change", "severity": None}


def sorted_records(diff: DataFrame, by: str = "key", descending: bool = False, label: str = "id") -> DataFrame:
    """Q3, Q4: ties by key (numeric-aware) in the same direction, but for dates, whose ties keep the key's order and whose blanks come last both ways.

    ``title``, ``published``, ``due`` and ``documents`` (the number of changed documents, NULL without a list) are columns of ``diff`` where the sort asks for them.
    """
    key = V.natural_key(F.col(label))
    way = lambda c: c.desc_nulls_last() if descending else c.asc_nulls_first()
    if by in ("published", "due"):
        text = F.when(F.coalesce(F.col(by), F.lit("")) != "", F.col(by))
        return diff.orderBy(text.isNull(), text.desc() if descending else text.asc(), key)
    first = {"key": [], "status": [F.col("status")], "severity": [severity_rank()], "changes": [F.col("n_changed")]}.get(by)
    if first is None:
        first = [V.natural_key(F.coalesce("title", F.lit("")))] if by == "title" else [F.coalesce("documents", F.lit(-1))] if by == "documents" else None
    if first is None:
        raise ValueError(f"unknown column {by!r}; known are {', '.join(RECORD_SORTS)}")
    return diff.orderBy(*[way(c) for c in [*first, key]])


def sorted_fields(rollup: DataFrame, by: str = "field", descending: bool = False) -> DataFrame:
    """Q5: field-change rows by one of FIELD_SORTS, ties by field name, in the same direction."""
    if by not in FIELD_SORTS:
        raise ValueError(f"unknown column {by!r}; known are {', '.join(FIELD_SORTS)}")
    first = [severity_rank()] if by == "severity" else [F.col(FIELD_SORTS[by])] if FIELD_SORTS[by] else []
    return rollup.orderBy(*[c.desc() if descending else c.asc() for c in [*first, V.natural_key(F.col("field"))]])


#: Columns by which the cell table sorts.
CELL_SORTS = ("key", "situation", "candidate", "reference", "lane")


def filtered_cells(cells: DataFrame, situations: Sequence[str] = (), value: str | None = None, text: str = "", verdict: str | None = None) -> DataFrame:
    """Q6: cells of one field by situation, reference value as shown, a substring of key or shown values (letters in any case), and corroboration verdict."""
    out = cells
    if situations:
        out = out.where(F.col("situation").isin(*situations))
    if value is not None:
        out = out.where(V.cell_text(F.col("reference")) == value)
    if text.strip():
        shown = F.concat_ws("\n", "key", V.cell_text(F.col("candidate")), V.cell_text(F.col("reference")))
        out = out.where(F.lower(shown).contains(text.strip().lower()))
    return out.where(F.col("verdict") == verdict) if verdict else out


def sorted_cells(cells: DataFrame, by: str = "key", descending: bool = False) -> DataFrame:
    """Q6: by key, situation, shown value or lane (cells without a lane last), ties by key, in the same direction."""
    if by not in CELL_SORTS:
        raise ValueError(f"unknown column {by!r}; known are {', '.join(CELL_SORTS)}")
    first = {"key": [], "situation": [F.col("situation")], "lane": [F.coalesce("lane", F.lit("\uffff"))]}.get(by)
    first = [V.natural_key(V.cell_text(F.col(by)))] if first is None else first
    return cells.orderBy(*[c.desc() if descending else c.asc() for c in [*first, V.natural_key(F.col("key"))]])


def matching_findings(findings: DataFrame, text: str = "", **equal: str) -> DataFrame:
    """Q7: equal columns, and a substring of message, key and field joined by blanks, letters in any case; the searched text is trimmed."""
    out = findings
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    shown = F.concat(F.coalesce("message", F.lit("")), F.lit(" "), F.coalesce("key", F.lit("")), F.lit(" "), F.coalesce("field", F.lit("")))
    return out.where(F.lower(shown).contains(text.strip().lower())) if text.strip() else out


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Characters between a cue and its date, and the share of agreement that makes a field trustworthy: this module's own choices.
CUE_REACH, TRUSTED = 60, 0.8


def date_point(text: Column) -> Column:
    """Month and day of a date text as struct, else NULL."""
    d = V.parse_date(V.js_trim(text))
    return F.when(d.isNotNull(), F.struct(F.month(d).alias("month"), F.dayofmonth(d).alias("day")))


def corroboration(cells: DataFrame, text: str, value: str, cues: Sequence[str]) -> DataFrame:
    """§2.15: adds ``quote`` and ``verdict`` (corroborated, not_corroborated, no_signal): whether the text's date behind a cue is the value's month and day."""
    cue = "|".join(r"\b" + c.replace(" ", r"\s+") for c in sorted(cues, key=len, reverse=True))
    month = "|".join(m[:3] + f"(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS)
    pattern = rf"(?i)(?:{cue}).{{0,{CUE_REACH}}}?(?:({month})\.?\s+(\d{{1,2}})|(\d{{1,2}})/(\d{{1,2}}))"
    part = lambda i: F.regexp_extract(text, pattern, i)
    name = F.lower(F.substring(part(1), 1, 3))
    number = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name).cast("int")
    found_month, found_day = F.when(part(1) != "", number).otherwise(F.expr("try_cast(m3 as int)")), F.expr("try_cast(coalesce(nullif(m2, ''), m4) as int)")
    out = cells.withColumns({"quote": part(0), "m2": part(2), "m3": part(3), "m4": part(4)}).withColumns({"fm": found_month, "fd": found_day, "point": date_point(F.col(value))})
    verdict = F.when((F.col("quote") == "") | F.col("point").isNull() | F.col("quote").isNull(), "no_signal").when((F.col("fm") == F.col("point.month")) & (F.col("fd") == F.col("point.day")), "corroborated").otherwise("not_corroborated")
    return out.withColumn("verdict", verdict).drop("m2", "m3", "m4", "fm", "fd", "point")


def trustworthy(verdicts: DataFrame, by: str = "field") -> DataFrame:
    """Fields and their agreement where the text speaks; trustworthy from TRUSTED on."""
    sums = verdicts.groupBy(by).agg(F.count_if(F.col("verdict") == "corroborated").alias("agree"), F.count_if(F.col("verdict") == "not_corroborated").alias("disagree"))
    rate = F.try_divide(F.col("agree"), F.col("agree") + F.col("disagree"))
    return sums.withColumn("trustworthy", F.coalesce(rate >= TRUSTED, F.lit(False)))
