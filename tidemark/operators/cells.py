"""Cells of a comparison as both sides hold them, classified for decisions (inventory J10, J11, L10-L13, A12, A13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.policy import Policy
from ..sources.snapshot import Snapshot, settled, union_fields
from . import drift
from .decisions import LANE_TEXTS

SITUATIONS = ("record_added", "record_removed", "unchanged", "candidate_blank", "reference_blank", "conflict")
#: Distinct values that a summary tracks.
TRACKED = 64
#: Why a cell has no lane, in the order of the checks (fixed texts).
BLOCKERS = {
    "record_removed": "This record exists only in the reference file; there is no candidate record to write into.",
    "record_added": "This record exists only in the candidate file; there is no reference to recover from.",
    "excluded": "Excluded from comparison by this profile; recovery may not act on it.",
    "unkeyed": "This record's identity fields are blank or missing, so no decision can be attributed to it.",
    "duplicate": "Another record shares this identity key; a decision would ambiguously cover both rows.",
    "disputed": "The comparison and the recovery review did not pair this record with the same reference row; no decision is offered on a disputed pairing.",
    "unchanged": "Both files agree on this value; there is nothing to decide.",
}
#: What a policy says of a field (fixed texts).
POLICY_TEXTS = {
    "excluded": "Excluded from comparison by the profile; never compared, never recovered.",
    "safe_dated": "Approved for automatic backfill, with the rule-6 date-sensitive approval on record.",
    "safe": "Approved for automatic backfill when the candidate value is blank.",
    "dated": "Rule-6 date-sensitive: requires explicit per-source approval before automatic backfill. Review only.",
    "manual": "Manual review only: the profile does not approve automatic backfill.",
    "none": "No profile ruling; not approved for automatic backfill.",
}


def situation(status: Column, candidate: Column, reference: Column) -> Column:
    """L10. Values are compared strictly: two objects or lists are never the same value."""
    c, r = V.is_blank(candidate), V.is_blank(reference)
    same = (candidate == reference) & ~V.kind_of(candidate).isin("object", "array")
    return (
        F.when(status == "added", "record_added")
        .when(status == "removed", "record_removed")
        .when(c & r, "unchanged")
        .when(c, "candidate_blank")
        .when(r, "reference_blank")
        .when(same, "unchanged")
        .otherwise("conflict")
    )


def field_policy(policy: Policy, field: str) -> dict[str, bool | str]:
    """L12."""
    safe, manual, out, dated = (field in x for x in (policy.safe_backfill, policy.manual_review, policy.excluded, policy.date_sensitive))
    said = "excluded" if out else "safe_dated" if safe and dated else "safe" if safe else "dated" if dated else "manual" if manual else "none"
    return {"safe_backfill": safe, "manual_review": manual, "excluded": out, "date_sensitive": dated, "description": POLICY_TEXTS[said]}


def _auto(provenance: DataFrame) -> DataFrame:
    """Per key the fields that were backfilled: at most those of a record."""
    return provenance.where("key is not null").groupBy("key").agg(F.collect_set("field").alias("auto_fields"))


def records(baseline: Snapshot, latest: Snapshot, identity: Sequence[str], policy: Policy, matches: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """The compared records with ``status``, decision ``key``, whether the key repeats, and whether the review paired the same reference record.

    With ``provenance`` also ``auto_fields``, joined in the same shuffle by key.
    """
    both = drift.paired(baseline, latest, identity)
    status = F.when(F.col("b").isNull(), "added").when(F.col("l").isNull(), "removed").otherwise("paired")
    key = F.when(F.col("l").isNotNull(), latest.key(policy.primary_key, "l")).otherwise(baseline.key(policy.primary_key, "b"))
    both = both.withColumns({"status": status, "key": key})
    repeated = both.where("key is not null").groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("repeated"))
    pairs = matches.where("method is not null and candidate_key is not null and reference_key is not null").groupBy(F.col("candidate_key").alias("key")).agg(F.max_by("reference_key", "candidate_idx").alias("paired_with"))
    out = both.join(repeated, "key", "left").join(pairs, "key", "left")
    told = []
    if provenance is not None:
        out, told = out.join(_auto(provenance), "key", "left"), ["auto_fields"]
    ok = (F.col("status") != "paired") | F.col("key").isNull() | F.coalesce(baseline.key(policy.primary_key, "b") == F.col("paired_with"), F.lit(False))
    return out.select("id", "status", "key", F.coalesce("repeated", F.lit(False)).alias("repeated"), ok.alias("verified"), *told, "b", "l")


def _held(baseline: Snapshot, latest: Snapshot, names: Sequence[str]) -> Column:
    """The cells of a record of :func:`records` with ``auto_fields``: ``field, candidate, reference``, and whether it was backfilled (``auto``)."""
    auto = lambda f: F.coalesce(F.array_contains("auto_fields", f), F.lit(False))
    return F.array(*[F.struct(F.lit(f).alias("field"), latest.col(f, "l").alias("candidate"), baseline.col(f, "b").alias("reference"), auto(f).alias("auto")) for f in names])


def _blocker(field: Column, situation: Column, policy: Policy, unavailable: str | None = None) -> Column:
    """Why a cell of a record of :func:`records` has no lane, else NULL."""
    return (
        F.when(F.lit(unavailable).cast("string").isNotNull(), F.lit(unavailable))
        .when(situation.isin("record_removed", "record_added"), F.when(F.col("status") == "removed", BLOCKERS["record_removed"]).otherwise(BLOCKERS["record_added"]))
        .when(field.isin(*policy.excluded) if policy.excluded else F.lit(False), BLOCKERS["excluded"])
        .when(F.col("key").isNull(), BLOCKERS["unkeyed"])
        .when(F.col("repeated"), BLOCKERS["duplicate"])
        .when(~F.col("verified"), BLOCKERS["disputed"])
        .when(situation == "unchanged", BLOCKERS["unchanged"])
    )


def _lane(blocker: Column, reference: Column, auto: Column) -> Column:
    gone = reference.isNull() | (reference == V.NULL_JSON)
    return F.when(blocker.isNull(), F.when(gone, "ineligible").when(auto, "auto").otherwise("review"))


def classified(rows: DataFrame, baseline: Snapshot, latest: Snapshot, policy: Policy, provenance: DataFrame, fields: Sequence[str] | None = None, unavailable: str | None = None) -> DataFrame:
    """One row a record of ``rows`` (of :func:`records`) and field: ``id, key, field, candidate, reference, situation, lane, reason, manual`` (whether a value may be typed).

    ``unavailable``: why no decisions are to be had; then no cell has a lane. Fewer ``fields``, or fewer ``rows``, give the detail of a field or a record.
    """
    names = union_fields(baseline, latest) if fields is None else fields
    rows = rows if "auto_fields" in rows.columns else rows.join(_auto(provenance), "key", "left")  # records meet it, not their cells
    out = rows.select("id", "status", "key", "repeated", "verified", F.inline(_held(baseline, latest, names)))
    out = settled(out.withColumn("situation", situation(F.col("status"), F.col("candidate"), F.col("reference"))))
    isin = lambda given: F.col("field").isin(*given) if given else F.lit(False)
    blank = V.is_blank(F.col("candidate"))
    blocker = _blocker(F.col("field"), F.col("situation"), policy, unavailable)
    lane = _lane(F.col("blocker"), F.col("reference"), F.col("auto"))
    reason = (
        F.when(F.col("blocker").isNotNull(), F.col("blocker"))
        .when(F.col("lane") == "auto", LANE_TEXTS["auto"])
        .when(F.col("lane") == "ineligible", LANE_TEXTS["ineligible"])
        .when(~blank, F.when(F.col("situation") == "conflict", LANE_TEXTS["conflict"]).otherwise(LANE_TEXTS["filled"]))
        .when(isin(policy.safe_backfill), LANE_TEXTS["permitted"])
        .otherwise(LANE_TEXTS["unapproved"])
    )
    manual = F.lit(unavailable is None) & F.col("key").isNotNull() & ~F.col("repeated") & F.col("verified") & (F.col("situation") != "record_removed") & ~isin(policy.excluded)
    out = settled(settled(out.withColumn("blocker", blocker)).withColumn("lane", lane))
    return out.select("id", "key", "field", "candidate", "reference", "situation", "lane", reason.alias("reason"), manual.alias("manual"))


def field_evidence(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """Per field the eligible, conflicting and comparable cells, whether none is comparable, and the fill rates."""
    both = ~V.is_blank(F.col("candidate")) & ~V.is_blank(F.col("reference"))
    sums = cells.groupBy("field").agg(F.count_if(F.col("situation") == "candidate_blank").alias("eligible"), F.count_if(F.col("situation") == "conflict").alias("conflicts"), F.count_if(both).alias("comparable"))
    return sums.withColumn("volatility_unmeasurable", F.col("comparable") == 0).join(F.broadcast(stats.select("field", "baseline_rate", "latest_rate")), "field")  # a row a field


def field_summaries(cells: DataFrame, stats: DataFrame, changed: DataFrame) -> DataFrame:
    """Per field the rates and severity of ``stats``, changed records, tracked distinct reference values, and cells by lane; ``unchanged`` counts those without a lane on which both sides agree."""
    tallies = cells.groupBy("field").agg(*[F.count_if(F.col("lane") == x).alias(x) for x in ("auto", "review", "ineligible")], F.count_if(F.col("lane").isNull() & (F.col("situation") == "unchanged")).alias("unchanged"))
    values = cells.where(~V.is_blank(F.col("reference"))).select("field", V.cell_text(F.col("reference")).alias("v")).distinct().groupBy("field").agg(F.count("*").alias("n"))
    out = stats.select("field", "baseline_rate", "latest_rate", "rate_change", "severity").join(tallies, "field", "left").join(values, "field", "left").join(changed.select("field", "changed"), "field", "left")
    out = out.na.fill(0, ["auto", "review", "ineligible", "unchanged", "n", "changed"])
    return out.withColumns({"distinct_values": F.least("n", F.lit(TRACKED)), "lower_bound": F.col("n") > TRACKED}).drop("n")


def record_sums(rows: DataFrame, baseline: Snapshot, latest: Snapshot, policy: Policy, provenance: DataFrame) -> DataFrame:
    """Per record of :func:`records` its ``id``, ``key``, cells by lane, ``unchanged`` ones without a lane, and the fields for review and those recovered by themselves, in order: what :func:`classified` gives, counted inside the record's row, so that its cells are never shuffled."""
    rows = rows if "auto_fields" in rows.columns else rows.join(_auto(provenance), "key", "left")
    out = settled(rows.select("id", "status", "key", "repeated", "verified", _held(baseline, latest, union_fields(baseline, latest)).alias("cells")))
    step = lambda c, **more: F.struct(*[c[x].alias(x) for x in ("field", "reference", "auto")], *[v.alias(k) for k, v in more.items()])
    out = out.withColumn("cells", F.transform("cells", lambda c: step(c, situation=situation(F.col("status"), c["candidate"], c["reference"]))))
    out = settled(out.withColumn("cells", F.transform("cells", lambda c: step(c, situation=c["situation"], blocker=_blocker(c["field"], c["situation"], policy)))))
    out = settled(out.select("id", "key", F.transform("cells", lambda c: F.struct(c["field"].alias("field"), c["situation"].alias("situation"), _lane(c["blocker"], c["reference"], c["auto"]).alias("lane"))).alias("cells")))
    of = lambda lane: F.filter("cells", lambda c: c["lane"] == lane)
    names = lambda lane: F.array_sort(F.transform(of(lane), lambda c: c["field"])).alias(f"{lane}_fields")
    count = lambda found: F.size(found).cast("long")
    still = F.filter("cells", lambda c: c["lane"].isNull() & (c["situation"] == "unchanged"))
    return out.select("id", "key", *[count(of(x)).alias(x) for x in ("auto", "review", "ineligible")], count(still).alias("unchanged"), names("review"), names("auto"))


def record_summaries(sums: DataFrame, diff: DataFrame) -> DataFrame:
    """Per compared record ``id, label, key`` (of decisions, NULL where there is none), ``status, severity, n_changed`` of ``diff`` and what :func:`record_sums` counted. Every record has a row."""
    parts = F.from_json("id", "array<string>")
    label = F.when(F.col("id").startswith("$unkeyed:"), F.col("id")).otherwise(F.array_join(parts, "::"))
    return diff.select("id", label.alias("label"), "status", "severity", "n_changed").join(sums, "id")


def in_order(summaries: DataFrame) -> DataFrame:
    """The queue's order: labels, numeric-aware."""
    return summaries.orderBy(V.natural_key(F.col("label")), "id")


#: The reason where a record is in no list of recovery (fixed values).
NOT_RECOVERED = ("not_recovered", "This record is not in the recovery output; decisions on it cannot reach the exported artifact.")


def situations(rows: DataFrame, baseline: Snapshot, latest: Snapshot, *keep: str) -> DataFrame:
    """``situation`` and ``cells``: one row a record of :func:`records` and situation with the number of its cells, counted inside the record's row; the columns ``keep`` go along."""
    names = union_fields(baseline, latest)
    own = settled(rows.select(*keep, F.array(*[situation(F.col("status"), latest.col(f, "l"), baseline.col(f, "b")) for f in names]).alias("own")))
    told = F.transform(F.array_distinct("own"), lambda s: F.struct(s.alias("situation"), F.size(F.filter("own", lambda x: x == s)).alias("cells")))
    return own.select(*keep, F.inline(told))


def record_detail(cells: DataFrame, recovered: DataFrame) -> DataFrame:
    """Cells (or the records of :func:`records`) with ``excluded``: why the record is not in the recovery output (NULL if it is, or without a key)."""
    state = recovered.where("record_key is not null").groupBy(F.col("record_key").alias("key")).agg(F.bool_or(F.col("excluded").isNull()).alias("kept"), F.min("excluded").alias("why"))
    out = cells.join(state, "key", "left")
    return out.withColumn("excluded", F.when(F.col("key").isNull() | F.coalesce("kept", F.lit(False)), None).otherwise(F.coalesce("why", F.lit(NOT_RECOVERED[0])))).drop("kept", "why")
