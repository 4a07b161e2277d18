"""Lanes, the append-only decision log and what follows from it (inventory L1-L9, L14, A13-A17)."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.policy import Policy
from ..sources.scratch import written

ACTIONS = ("backfill", "keep_candidate", "use_custom")
LANES = ("auto", "review", "ineligible")
#: Reasons of lanes (fixed texts).
LANE_TEXTS = {
    "auto": "Recovered automatically: the profile permits this field and the candidate value was blank.",
    "ineligible": "No reference value was recorded for this cell, so there is nothing to decide between.",
    "conflict": "Both sides hold a value and they differ. Automation may not overwrite a populated value; a person must choose.",
    "filled": "The candidate value is not blank, so automation may not replace it.",
    "permitted": "The profile permits this field, but recovery did not apply it — check the match status for this record.",
    "unapproved": "The profile does not approve this field for automatic backfill.",
}
_LOG = ("id", "key", "field", "action", "value", "reason", "ts", "sequence")


def lanes(findings: DataFrame, provenance: DataFrame, policy: Policy) -> DataFrame:
    """L1, L2: lane and reason of every regressed or conflicting cell."""
    cells = findings.where("key is not null and field is not null").where(F.col("category").isin("field_regression", "field_conflict"))
    auto = provenance.select("key", "field").distinct().withColumn("auto", F.lit(True))
    cells = cells.select("key", "field", "category", "candidate_value", "reference_value", "candidate_idx").join(auto, ["key", "field"], "left")
    gone = F.col("reference_value").isNull() | (F.col("reference_value") == V.NULL_JSON)
    blank, permitted = V.is_blank(F.col("candidate_value")), F.col("field").isin(*policy.safe_backfill) if policy.safe_backfill else F.lit(False)
    lane = F.when(gone, "ineligible").when(F.col("auto"), "auto").otherwise("review")
    reason = (
        F.when(F.col("lane") == "auto", LANE_TEXTS["auto"])
        .when(F.col("lane") == "ineligible", LANE_TEXTS["ineligible"])
        .when(~blank, F.when(F.col("category") == "field_conflict", LANE_TEXTS["conflict"]).otherwise(LANE_TEXTS["filled"]))
        .when(permitted, LANE_TEXTS["permitted"])
        .otherwise(LANE_TEXTS["unapproved"])
    )
    return cells.withColumn("lane", lane).withColumn("reason", reason).drop("auto").withColumn("blank", blank)


def lane_counts(cells: DataFrame) -> DataFrame:
    """A17."""
    return cells.agg(*[F.count_if(F.col("lane") == x).alias(x) for x in LANES])


def ordered(log: DataFrame) -> DataFrame:
    """L4: by sequence, then time, then id."""
    return log.orderBy("sequence", "ts", "id")


def latest(log: DataFrame) -> DataFrame:
    """L4: the last decision of each cell."""
    w = Window.partitionBy("key", "field").orderBy(F.col("sequence").desc(), F.col("ts").desc(), F.col("id").desc())
    return log.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def decision_id(key: Column, field: Column, action: Column, ts: Column, sequence: Column) -> Column:
    """Over a JSON list whose last item, the sequence, is a number."""
    texts = V.json_list(key, field, action, ts)
    return F.concat(F.lit("decision:"), V.fnv1a32(F.concat(F.substring(texts, F.lit(1), F.length(texts) - 1), F.lit(","), sequence.cast("string"), F.lit("]"))))


def history(log: DataFrame, key: str, field: str) -> DataFrame:
    """L4: every entry of one cell, oldest first."""
    return ordered(log.where((F.col("key") == key) & (F.col("field") == field)))


def create(wanted: DataFrame, cells: DataFrame, ts: str, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """L3: decisions from ``wanted`` (key, field, action, reason, value for own values), and refused ones with ``refusal``.

    A reason is needed; a cell without a reference value takes only an own value; an own value must be given.
    """
    facts = cells.select("key", "field", "lane", "candidate_value", "reference_value").dropDuplicates(["key", "field"])
    own = F.col("action") == "use_custom"
    refusal = (
        F.when(V.js_trim(F.coalesce("reason", F.lit(""))) == "", _cell_text("Decision for ", " has no reason; a reason is required for the audit trail."))
        .when(~F.col("action").isin(*ACTIONS), F.lit("unknown action"))
        .when((F.coalesce("lane", F.lit("ineligible")) == "ineligible") & ~own, _cell_text("Cannot decide on ", ": no reference value was recorded for this cell. A typed value can still be entered."))
        .when(own & F.col("value").isNull(), _cell_text("Custom decision for ", " carries no value."))
    )
    judged = wanted.join(facts, ["key", "field"], "left").withColumn("refusal", refusal)
    value = F.when(F.col("action") == "backfill", F.col("reference_value")).when(own, F.col("value")).otherwise(F.col("candidate_value"))
    good = judged.where("refusal is null").select("key", "field", "action", value.alias("value"), V.js_trim("reason").alias("reason"), F.lit(ts).alias("ts"))
    return numbered(good, ["key", "field", "action"], first), judged.where("refusal is not null").select(*wanted.columns, "refusal")


def _cell_text(before: str, after: str) -> Column:
    return F.concat(F.lit(before), F.col("field"), F.lit(after))


def overrides(log: DataFrame, provenance: DataFrame) -> DataFrame:
    """The latest decisions as overrides; keeping the candidate's value counts only where it undoes a backfill."""
    auto = provenance.select("key", "field").distinct().withColumn("auto", F.lit(True))
    return latest(log).join(auto, ["key", "field"], "left").where("action <> 'keep_candidate' or auto").select("key", "field", "action", "value", "reason", F.col("sequence").alias("ord"))


def log_summary(log: DataFrame) -> DataFrame:
    """A16."""
    cells = log.groupBy("key", "field").agg(F.count("*").alias("n"), F.max_by("action", F.struct("sequence", "ts", "id")).alias("action"))
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count("*").alias("cells"), F.count_if(F.col("n") > 1).alias("revised"), *[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])


def _judged(cells: DataFrame, policy: Policy) -> DataFrame:
    date = F.col("field").isin(*policy.date_sensitive) if policy.date_sensitive else F.lit(False)
    return cells.withColumn("eligible", F.col("lane") != "ineligible").withColumn("date_sensitive", date)


def bulk_impact(cells: DataFrame, policy: Policy) -> DataFrame:
    """L6."""
    c = _judged(cells, policy)
    return c.agg(
        F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("ineligible"), F.count_if(F.col("eligible") & F.col("blank")).alias("fills"),
        F.count_if(F.col("eligible") & ~F.col("blank")).alias("overwrites"), F.count_if(F.col("eligible") & F.col("date_sensitive")).alias("date_sensitive"), F.count_distinct(F.when(F.col("eligible"), F.col("field"))).alias("fields"),
    )


def bulk(cells: DataFrame, policy: Policy, action: str, reason: str, ts: str, first: int = 0, acknowledged: bool = False) -> DataFrame:
    """One decision a cell with its own reference (or candidate) value, sequences from ``first`` on in order of key and field.

    Date-sensitive cells are left out of a backfill over several fields unless acknowledged.
    """
    if action not in ("backfill", "keep_candidate"):
        raise ValueError("no custom value can be decided in bulk")
    if not reason.strip():
        raise ValueError("a decision needs a reason")
    c = _judged(cells, policy).where("eligible").dropDuplicates(["key", "field"])
    if action == "backfill" and not acknowledged:
        many = c.agg(F.count_distinct("field").alias("n"))
        c = c.join(F.broadcast(many)).where("n = 1 or not date_sensitive").drop("n")
    value = F.col("reference_value" if action == "backfill" else "candidate_value")
    return numbered(c.select("key", "field", F.lit(action).alias("action"), value.alias("value"), F.lit(reason).alias("reason"), F.lit(ts).alias("ts")), ["key", "field"], first)


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``at``: the row's place in the order of ``by``. The range-sorted rows are written once, so that their partitions' sizes and places are of the same rows; only the sizes meet in one window."""
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).withColumn("mono", F.monotonically_increasing_id())
    sorted_ = written(sorted_, "sorted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sorted_.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return sorted_.join(F.broadcast(starts), "part").withColumn("at", F.col("mono") - F.col("part").cast("long") * F.lit(1 << 33) + F.col("start")).drop("part", "mono", "start")


def numbered(df: DataFrame, by: list[str], first: int = 0) -> DataFrame:
    """Consecutive ``sequence`` in the order of ``by``, and the decision's ``id``."""
    out = _ranked(df, by).withColumn("sequence", F.col("at") + first)
    return out.withColumn("id", decision_id(F.col("key"), F.col("field"), F.col("action"), F.col("ts"), F.col("sequence"))).select(*_LOG)


#: Keys of a transfer file and of its context, and what a decision in it must hold (fixed values).
TRANSFER_KEYS = ("formatVersion", "exportedAt", "context", "decisions")
CONTEXT_KEYS = ("profileId", "profileVersion", "policyHash", "overrideRevision", "generatedAt", "sourceRun", "referenceRun", "inputHashes")
TRANSFER_TEXTS = ("id", "recordKey", "field", "reason", "timestamp")


def transfer_problems(head: Mapping[str, Any]) -> list[str]:
    """Faults of a transfer file's head (all but its decisions); unknown keys are faults."""
    out = [f'Unknown key "{k}".' for k in head if k not in TRANSFER_KEYS]
    if head.get("formatVersion") != 1:
        out.append(f"formatVersion must be 1, got {json.dumps(head.get('formatVersion'))}.")
    if not isinstance(head.get("exportedAt"), str):
        out.append("exportedAt must be a string.")
    context = head.get("context")
    if not isinstance(context, Mapping):
        return [*out, "context must be an object."]
    out += [f'Unknown context key "{k}".' for k in context if k not in CONTEXT_KEYS]
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    checks = (
        (isinstance(context.get("profileId"), str), "context.profileId must be a string."), (number(context.get("profileVersion")), "context.profileVersion must be a number."),
        ("policyHash" in context and (context["policyHash"] is None or isinstance(context["policyHash"], str)), "context.policyHash must be a string or null."),
        (isinstance(context.get("generatedAt"), str), "context.generatedAt must be a string."), (isinstance(context.get("inputHashes"), list), "context.inputHashes must be an array."),
    )
    return out + [text for ok, text in checks if not ok]


def transfer_row_problems(rows: DataFrame) -> DataFrame:
    """``at, problem`` of each fault in a transfer file's decisions. ``rows``: ``at`` (place in the file) and ``d`` (VARIANT)."""
    kind = lambda k: F.schema_of_variant(F.try_variant_get("d", f"$.{k}", "variant"))
    text = lambda k: F.when(kind(k) == "STRING", F.try_variant_get("d", f"$.{k}", "string"))
    told = lambda ok, k, what: F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("decisions["), F.col("at"), F.lit(f"].{k} must be {what}.")))
    faults = [
        *[told(text(k) != "", k, "a non-empty string") for k in TRANSFER_TEXTS], told(text("action").isin(*ACTIONS), "action", f"one of {', '.join(ACTIONS)}"),
        told(text("actor").isin("user", "auto"), "actor", '"user" or "auto"'), told(kind("sequence").rlike("^(BIGINT|DOUBLE|DECIMAL)"), "sequence", "a number"),
    ]
    found = F.when(~F.schema_of_variant("d").startswith("OBJECT"), F.array(F.concat(F.lit("decisions["), F.col("at"), F.lit("] is not an object.")))).otherwise(F.filter(F.array(*faults), lambda x: x.isNotNull()))
    return rows.select("at", F.explode(found).alias("problem"))


def mismatches(context: Mapping[str, Any], review: Mapping[str, Any]) -> list[str]:
    """Why decisions of a transfer's context do not belong to a review (same keys); a missing hash can't be verified."""
    out = []
    if context["profileId"] != review["profileId"]:
        out.append(f'Profile mismatch: file is for "{context["profileId"]}", this review ran under "{review["profileId"]}".')
    if context["profileVersion"] != review["profileVersion"]:
        out.append(f"Profile version mismatch: file v{context['profileVersion']}, this review v{review['profileVersion']}.")
    if None in (context["policyHash"], review["policyHash"]) or context["policyHash"] != review["policyHash"]:
        out.append(f"Policy mismatch: file policy {context['policyHash'] or 'unstamped'}, this review {review['policyHash'] or 'unstamped'}. Decisions transfer only between identical resolved policies.")
    of = lambda c, role: next((h["sha256"] for h in c["inputHashes"] if h["role"] == role), None)
    for role in ("candidate", "reference"):
        theirs, ours = of(context, role), of(review, role)
        if theirs is None or ours is None:
            out.append(f"The {role} file's SHA-256 is unavailable on {'the exported' if theirs is None else 'this'} side, so the inputs cannot be verified as identical.")
        elif theirs != ours:
            out.append(f"The {role} file differs: exported {theirs[:12]}…, this review {ours[:12]}….")
    return out


def rebase(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming decisions that the log does not hold yet, numbered behind its last one; ids stay."""
    top = log.agg(F.coalesce(F.max("sequence"), F.lit(-1))).first()[0]
    new = incoming.join(log.select("id"), "id", "left_anti")
    return _ranked(new, ["sequence", "ts", "id"]).withColumn("sequence", F.col("at") + F.lit(top + 1)).drop("at")


def bridge(stamp: dict, policy: Policy, reviewed: bool, verified: bool, hashes: bool, blocked: bool) -> str | None:
    """The first reason that decisions can't be carried over, in order."""
    checks = (
        (reviewed, "there is no review"), (stamp.get("policy") == policy.id, "the review is of another policy"), (stamp.get("version") == policy.version, "the policy has another version"),
        (stamp.get("hash") == policy.policy_hash, "the policy has other content"), (hashes, "the files differ"), (verified and not blocked, "the pairing is not verified"),
    )
    return next((why for ok, why in checks if not ok), None)


def queue(summaries: DataFrame, log: DataFrame) -> DataFrame:
    """``id, label, key, pending`` (review fields without a decision) and ``resolved`` (there were some, and none is left) of each record of :func:`cells.record_summaries`. A record without a decision key has nothing pending."""
    decided = log.groupBy("key").agg(F.collect_set("field").alias("decided"))  # at most the fields of a record
    out = summaries.join(decided, "key", "left").withColumn("open", F.array_except("review_fields", F.coalesce("decided", F.array().cast("array<string>"))))
    pending = F.when(F.col("key").isNull(), 0).otherwise(F.size("open"))
    return out.select("id", "label", "key", pending.alias("pending"), ((F.size("review_fields") > 0) & (pending == 0)).alias("resolved"))


def progress(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Records that had cells for review (``records_with_pending``), those resolved, and whether nothing is open (``complete``)."""
    asked = summaries.where(F.size("review_fields") > 0).agg(F.count("*").alias("records_with_pending"))
    return rows.agg(F.count_if("resolved").alias("resolved_records"), F.coalesce(F.bool_and(F.col("pending") == 0), F.lit(True)).alias("complete")).join(F.broadcast(asked))


def next_pending(rows: DataFrame) -> DataFrame:
    """Adds ``next``: the id of the next record with something pending in the order of labels, from the first again behind the last; NULL where nothing is pending.

    Records are sorted in ranges and written once. Inside a range each looks ahead: read from the range's end
    that is the last open record before it, a running value, where a frame that reaches forward would be walked anew for every row. Behind its
    last open record stands the first one of a later range, from a table of one row a range.
    """
    by = [V.natural_key(F.col("label")), F.col("id")]
    spread = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "queue")
    open_ = F.when(F.col("pending") > 0, F.col("id"))
    ahead = Window.partitionBy("part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = spread.where("pending > 0").groupBy("part").agg(F.min_by("id", "at").alias("first"))
    parts = spread.select("part").distinct().join(firsts, "part", "left")
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # a row a range
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.first("first", ignorenulls=True).over(later), F.first("first", ignorenulls=True).over(whole)).alias("later"))
    found = spread.withColumn("next", F.last(open_, ignorenulls=True).over(ahead)).join(F.broadcast(parts), "part")
    return found.select(*rows.columns, F.coalesce("next", "later").alias("next"))


def field_summaries(cells: DataFrame) -> DataFrame:
    """A13 over the findings' cells alone; :func:`cells.field_summaries` classifies every cell."""
    return cells.groupBy("field").agg(F.count("*").alias("cells"), *[F.count_if(F.col("lane") == x).alias(x) for x in LANES])
