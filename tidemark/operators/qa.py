"""QA findings of a candidate against a reference (inventory F1-F13, A15).

Each category is one DataFrame of the same columns: ``ord`` (category order), ``category``,
``severity``, ``field``, ``key`` (record key), ``discriminator``, ``action``,
``candidate_value``, ``reference_value`` (JSON text), ``candidate_idx``, ``reference_idx``,
``message`` (fixed texts of the feature).
``finding_id`` is added at the end, in the same code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.policy import Policy
from ..sources.scratch import written
from ..sources.snapshot import Snapshot, settled, union_fields
from . import matching

CATEGORIES = (
    "record_count_anomaly", "identity_match_issue", "schema_field_missing", "schema_field_added", "field_type_change", "duplicate_identity_key",
    "record_missing_from_candidate", "required_field_missing", "field_validation_failure", "field_conflict", "field_regression", "systemic_field_regression",
)
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: Records that a field lost in all matched pairs is shown by.
EXEMPLARS = 500


def _frame(df: DataFrame, category: str, severity, action, field=None, key=None, discriminator="", candidate=None, reference=None, candidate_idx=None, reference_idx=None, message=None) -> DataFrame:
    text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return df.select(
        F.lit(CATEGORIES.index(category)).alias("ord"), F.lit(category).alias("category"), text(severity).alias("severity"), text(field).alias("field"), text(key).alias("key"), text(discriminator).alias("discriminator"),
        text(action).alias("action"), text(candidate).alias("candidate_value"), text(reference).alias("reference_value"), number(candidate_idx).alias("candidate_idx"), number(reference_idx).alias("reference_idx"), text(message).alias("message"),
    )


def _said(*parts) -> Column:
    """Columns and texts as one message; NULL stands as ``null``."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _quoted(field) -> tuple:
    return 'Field "', field, '"'


def _action(policy: Policy, field: str, blank: Column) -> Column:
    yes, no = policy.action(field, True), policy.action(field, False)
    return F.lit(yes) if yes == no else F.when(blank, yes).otherwise(no)


def count_anomaly(reference: Snapshot, candidate: Snapshot, policy: Policy) -> DataFrame:
    """F1."""
    sizes = reference.df.agg(F.count("*").alias("r")).join(F.broadcast(candidate.df.agg(F.count("*").alias("c")))).where("r <> c")
    drift = F.when(F.col("r") == 0, F.lit(1.0)).otherwise(F.abs(F.col("c") - F.col("r")) / F.greatest("r", F.lit(1)))
    severity = "info" if policy.record_count_tolerance is None else F.when(drift > policy.record_count_tolerance, "high").otherwise("info")
    return _frame(sizes, "record_count_anomaly", severity, "report_only", candidate=F.col("c"), reference=F.col("r"), message=_said("Candidate holds ", F.col("c"), " records against the reference's ", F.col("r"), " (", F.when(F.col("c") > F.col("r"), "+").otherwise(""), F.col("c") - F.col("r"), ")."))


def match_rate(matches: DataFrame, policy: Policy) -> DataFrame:
    """F2."""
    low = matching.summary(matches, policy).where(~F.col("meets_minimum"))
    return _frame(low, "identity_match_issue", "high", "manual_review", discriminator="match_rate_below_minimum", candidate=F.col("match_rate"), reference=F.lit(policy.minimum_match_rate), message=_said("Match rate ", F.format_string("%.4f", "match_rate"), f" is below the profile minimum {policy.minimum_match_rate:g}."))


def _present_fields(side: Snapshot) -> DataFrame:
    """Fields that some record of the side has."""
    if not side.fields:
        return side.df.select(F.lit("").alias("field")).limit(0)
    seen = side.df.agg(*[F.bool_or(side.col(f).isNotNull()).alias(f"s{i}") for i, f in enumerate(side.fields)])
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"s{i}").alias("seen")) for i, f in enumerate(side.fields)]
    return seen.select(F.inline(F.array(*rows))).where("seen").select("field")


def _by_field(policy: Policy, default: str, required: str | None = None) -> Column:
    out = F.lit(default)
    if required and policy.hard_required:
        out = F.when(F.col("field").isin(*policy.hard_required), required).otherwise(out)
    return F.when(F.col("field").isin(*policy.excluded), "info").otherwise(out) if policy.excluded else out


def _action_by_field(policy: Policy, fields: Sequence[str]) -> Column:
    actions = F.create_map(*[F.lit(x) for f in fields for x in (f, policy.action(f, False))]) if fields else None
    return F.lit("report_only") if actions is None else F.coalesce(F.try_element_at(actions, F.col("field")), F.lit("report_only"))


def schema_changes(reference: Snapshot, candidate: Snapshot, policy: Policy) -> DataFrame:
    """F3, F4."""
    r, c = _present_fields(reference), _present_fields(candidate)
    act = _action_by_field(policy, union_fields(reference, candidate))
    gone = _frame(r.join(c, "field", "left_anti"), "schema_field_missing", _by_field(policy, "high"), act, field=F.col("field"), message=_said(*_quoted(F.col("field")), " appears in the reference schema but in no candidate record."))
    return gone.unionByName(_frame(c.join(r, "field", "left_anti"), "schema_field_added", _by_field(policy, "medium"), act, field=F.col("field"), message=_said(*_quoted(F.col("field")), " appears in the candidate schema but in no reference record.")))


def _dominant(side: Snapshot, name: str) -> DataFrame:
    kinds = ("array", "boolean", "number", "object", "string")
    told = settled(side.df.select(*[F.when(~V.is_empty(side.col(f)), V.kind_of(side.col(f))).alias(f"t{i}") for i, f in enumerate(side.fields)]))
    sums = [F.count_if(F.col(f"t{i}") == k).alias(f"{k}{i}") for i in range(len(side.fields)) for k in kinds]
    rows = []
    for i, f in enumerate(side.fields):
        top = F.array_max(F.array(*[F.struct(F.col(f"{k}{i}").alias("n"), F.lit(-j).alias("o")) for j, k in enumerate(kinds)]))
        rows.append(F.struct(F.lit(f).alias("field"), F.when(top["n"] > 0, F.get(F.array(*map(F.lit, kinds)), -top["o"])).alias(name)))
    return told.agg(*sums).select(F.inline(F.array(*rows))).where(f"{name} is not null")


def type_changes(reference: Snapshot, candidate: Snapshot, policy: Policy) -> DataFrame:
    """of equally frequent types the alphabetically first is dominant."""
    both = _dominant(reference, "was").join(_dominant(candidate, "now"), "field").where("was <> now")
    return _frame(both, "field_type_change", _by_field(policy, "medium", "high"), _action_by_field(policy, union_fields(reference, candidate)), field=F.col("field"), candidate=F.col("now"), reference=F.col("was"), message=_said(*_quoted(F.col("field")), " changed dominant type: ", F.col("was"), " in the reference, ", F.col("now"), " in the candidate."))


def duplicate_identities(reference: Snapshot, candidate: Snapshot, policy: Policy) -> DataFrame:
    """F6."""
    out = None
    definitions = {"primaryKey": policy.primary_key} | ({"dedupeKey": policy.dedupe_key} if policy.dedupe_key and policy.dedupe_key != policy.primary_key else {})
    for name, fields in definitions.items():
        for side, own in (("candidate", candidate), ("reference", reference)):
            n = own.df.select(own.key(fields).alias("key")).where("key is not null").groupBy("key").count().where("count > 1")
            one = _frame(n, "duplicate_identity_key", "high", "manual_review", field=",".join(fields), key=F.col("key"), discriminator=f"{name}:{side}", **{side: F.col("count")}, message=_said(F.col("count"), f" {side} records share the same {name} ({', '.join(fields)})."))
            out = one if out is None else out.unionByName(one)
    return out


def match_issues(matches: DataFrame, policy: Policy) -> DataFrame:
    """F7."""
    bad = matches.where(F.col("status").isin("ambiguous_primary", "ambiguous_fallback", "invalid_identity"))
    side = F.when(F.col("candidate_idx").isNotNull(), "candidate").otherwise("reference")
    keys = F.array(*[F.lit(",".join(k)) for k in (policy.primary_key, *[k for k in policy.fallback_keys if k])])
    said = F.when(F.col("status") == "invalid_identity", _said("A ", side, " record cannot be keyed on ", F.replace(F.get(keys, F.col("pass")), F.lit(","), F.lit(", ")), ".")).otherwise(_said("A ", side, " record could not be matched unambiguously (", F.col("status"), ")."))
    return _frame(
        bad, "identity_match_issue", "high", F.when(F.col("status") == "invalid_identity", "exclude").otherwise("manual_review"), field=F.get(keys, F.col("pass")), key=F.coalesce("candidate_key", "reference_key"),
        discriminator=F.concat_ws(":", "status", side, F.coalesce("candidate_idx", "reference_idx")), candidate=F.col("candidate_idx"), reference=F.col("reference_idx"), candidate_idx=F.col("candidate_idx"), reference_idx=F.col("reference_idx"), message=said,
    )


def missing_records(matches: DataFrame) -> DataFrame:
    """F8."""
    gone = matches.where("status = 'reference_only'")
    return _frame(gone, "record_missing_from_candidate", "high", "report_only", key=F.col("reference_key"), discriminator=F.col("reference_idx"), reference=F.col("reference_key"), reference_idx=F.col("reference_idx"), message=_said("A record present in the reference export (key ", F.col("reference_key"), ") is absent from the candidate export."))


def _exploded(df: DataFrame, rows: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Non-null structs of ``rows``, one output row each."""
    return df.select(*keep, F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))


def _candidates(candidate: Snapshot, policy: Policy) -> DataFrame:
    return candidate.df.withColumn("key", candidate.key(policy.primary_key))


def required_missing(candidate: Snapshot, policy: Policy) -> DataFrame:
    """F9."""
    rows = []
    for f in policy.hard_required:
        v = candidate.col(f)
        rows.append(F.when(V.is_empty(v), F.struct(F.lit(f).alias("field"), v.alias("value"), _action(policy, f, V.is_blank(v)).alias("action"))))
    if not rows:
        return _frame(candidate.df.limit(0), "required_field_missing", "critical", "report_only")
    found = _exploded(_candidates(candidate, policy), rows, ["idx", "key"])
    return _frame(found, "required_field_missing", "critical", F.col("action"), field=F.col("field"), key=F.col("key"), discriminator=F.col("idx"), candidate=F.col("value"), candidate_idx=F.col("idx"), message=_said('Required field "', F.col("field"), F.when(F.col("value").isNull(), '" is absent from the record.').otherwise('" is present but unpopulated.')))


def validation_failures(candidate: Snapshot, policy: Policy) -> DataFrame:
    """F10."""
    rows = []
    for rule, fields in policy.validation.items():
        for f in fields:
            v = candidate.col(f)
            text = V.string_of(v)
            bad = ~V.is_empty(v) & (~V.is_string(v) | V.failure(text, rule).isNotNull())
            kind = F.when(V.kind_of(v) == "array", "object").otherwise(V.kind_of(v))
            said = F.when(~V.is_string(v), _said(*_quoted(f), f" is configured as {rule}Fields but holds a ", kind, ".")).otherwise(_said(*_quoted(f), f" failed {rule}Fields validation: ", V.failure(text, rule), "."))
            rows.append(F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(rule).alias("rule"), v.alias("value"), said.alias("message"), F.lit(V.validation_severity(rule, f in policy.hard_required)).alias("severity"), F.lit(policy.action(f, False)).alias("action"))))
    if not rows:
        return _frame(candidate.df.limit(0), "field_validation_failure", "low", "report_only")
    found = _exploded(_candidates(candidate, policy), rows, ["idx", "key"])
    return _frame(found, "field_validation_failure", F.col("severity"), F.col("action"), field=F.col("field"), key=F.col("key"), discriminator=F.concat_ws(":", "rule", "idx"), candidate=F.col("value"), candidate_idx=F.col("idx"), message=F.col("message"))


def compared_cells(matched: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy) -> DataFrame:
    """One row a matched, non-excluded cell whose reference is populated and whose candidate is empty or differs."""
    rows = []
    for f in union_fields(reference, candidate):
        if f in policy.excluded:
            continue
        r, c = reference.col(f, "r"), candidate.col(f, "c")
        lost = V.is_empty(c)
        hit = ~V.is_empty(r) & (lost | ~V.same_value(r, c))
        rows.append(F.when(hit, F.struct(F.lit(f).alias("field"), r.alias("rv"), c.alias("cv"), lost.alias("lost"), _action(policy, f, V.is_blank(c)).alias("action"))))
    return _exploded(matched, rows, ["key", "candidate_idx", "reference_idx"])


def conflicts(matched: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy, cells: DataFrame | None = None) -> DataFrame:
    """F11. ``cells``: what :func:`compared_cells` gave."""
    cells = (compared_cells(matched, reference, candidate, policy) if cells is None else cells).where("not lost")
    return _frame(cells, "field_conflict", "medium", "manual_review", field=F.col("field"), key=F.col("key"), discriminator=F.col("candidate_idx"), candidate=F.col("cv"), reference=F.col("rv"), candidate_idx=F.col("candidate_idx"), reference_idx=F.col("reference_idx"), message=_said(*_quoted(F.col("field")), " holds different non-blank values in the reference and the candidate."))


def field_loss(matched: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy) -> DataFrame:
    """Per field over matched pairs: ``populated`` in the reference, ``regressed`` of them. One map-side aggregation."""
    fields = [f for f in union_fields(reference, candidate) if f not in policy.excluded]
    sums = []
    for i, f in enumerate(fields):
        held = ~V.is_empty(reference.col(f, "r"))
        sums += [F.count_if(held).alias(f"p{i}"), F.count_if(held & V.is_empty(candidate.col(f, "c"))).alias(f"l{i}")]
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"p{i}").alias("populated"), F.col(f"l{i}").alias("regressed")) for i, f in enumerate(fields)]
    return matched.agg(*sums).select(F.inline(F.array(*rows)))


#: Fields whose flags share one long.
_BITS = 60


def field_loss_of(matches: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy) -> DataFrame:
    """:func:`field_loss` without the pairs' records: each record is told as one bit a field (the reference holds it, the candidate lacks it), and only these longs meet."""
    fields = [f for f in union_fields(reference, candidate) if f not in policy.excluded]
    longs = range(-(-len(fields) // _BITS))

    def bits(flag, name: str) -> list[Column]:
        return [sum([F.when(flag(f), F.lit(1 << i).cast("long")).otherwise(0) for i, f in enumerate(fields[j * _BITS : (j + 1) * _BITS])], F.lit(0).cast("long")).alias(f"{name}{j}") for j in longs]

    n = matching.parts(matches, matching.NARROW)
    r = reference.df.select(F.col("idx").alias("reference_idx"), *bits(lambda f: ~V.is_empty(reference.col(f)), "held"))
    c = candidate.df.select(F.col("idx").alias("candidate_idx"), *bits(lambda f: V.is_empty(candidate.col(f)), "lost"))
    pairs = matches.where("method is not null").select("candidate_idx", "reference_idx")
    both = pairs.repartition(n, "reference_idx").join(r, "reference_idx").select("candidate_idx", *[f"held{j}" for j in longs]).repartition(n, "candidate_idx").join(c, "candidate_idx")
    sums, rows = [], []
    for i, f in enumerate(fields):
        held, lost, bit = F.col(f"held{i // _BITS}"), F.col(f"lost{i // _BITS}"), F.lit(1 << i % _BITS).cast("long")
        sums += [F.count_if(held.bitwiseAND(bit) != 0).alias(f"p{i}"), F.count_if(held.bitwiseAND(lost).bitwiseAND(bit) != 0).alias(f"l{i}")]
        rows.append(F.struct(F.lit(f).alias("field"), F.col(f"p{i}").alias("populated"), F.col(f"l{i}").alias("regressed")))
    return both.agg(*sums).select(F.inline(F.array(*rows)))


def regressions(matched: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy, loss: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """fields lost in every pair are shown by the first EXEMPLARS pairs in candidate order, others by all."""
    loss = field_loss(matched, reference, candidate, policy) if loss is None else loss
    cells = (compared_cells(matched, reference, candidate, policy) if cells is None else cells).where("lost").join(F.broadcast(loss), "field")  # a row a field
    systemic = F.col("populated") == F.col("regressed")
    first = Window.partitionBy("field").orderBy("candidate_idx")
    shown = cells.where(systemic).withColumn("n", F.row_number().over(first)).where(F.col("n") <= EXEMPLARS).drop("n").unionByName(cells.where(~systemic))
    severity = F.when(F.col("field").isin(*policy.hard_required), "critical").otherwise("high") if policy.hard_required else "high"
    return _frame(shown, "field_regression", severity, F.col("action"), field=F.col("field"), key=F.col("key"), discriminator=F.col("candidate_idx"), candidate=F.col("cv"), reference=F.col("rv"), candidate_idx=F.col("candidate_idx"), reference_idx=F.col("reference_idx"), message=_said(*_quoted(F.col("field")), " held a value in the reference and is unpopulated in the candidate."))


def systemic(matched: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy, loss: DataFrame | None = None) -> DataFrame:
    """F13."""
    loss = field_loss(matched, reference, candidate, policy) if loss is None else loss
    said = _said(*_quoted(F.col("field")), " is unpopulated in the candidate for all ", F.col("populated"), " matched record(s) where the reference held a value — total loss.")
    said = F.when(F.col("regressed") > EXEMPLARS, F.concat(said, F.lit(f" Per-record findings are sampled to {EXEMPLARS} exemplar(s); this count is exact."))).otherwise(said)
    return _frame(loss.where("populated > 0 and populated = regressed"), "systemic_field_regression", "high", "report_only", field=F.col("field"), reference=F.col("populated"), message=said)


def findings(reference: Snapshot, candidate: Snapshot, policy: Policy, matches: DataFrame | None = None, matched: DataFrame | None = None, loss: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """All findings, each with its stable ``id``. Matched pairs, field losses and compared cells are written once where they aren't given."""
    matches = written(matching.match(reference, candidate, policy), "matches") if matches is None else matches
    matched = written(matching.matched(matches, reference, candidate, policy), "matched") if matched is None else matched
    loss = written(field_loss(matched, reference, candidate, policy), "loss") if loss is None else loss
    cells = written(compared_cells(matched, reference, candidate, policy), "cells") if cells is None else cells
    parts = [
        count_anomaly(reference, candidate, policy), match_rate(matches, policy), schema_changes(reference, candidate, policy), type_changes(reference, candidate, policy), duplicate_identities(reference, candidate, policy),
        match_issues(matches, policy), missing_records(matches), required_missing(candidate, policy), validation_failures(candidate, policy), conflicts(matched, reference, candidate, policy, cells),
        regressions(matched, reference, candidate, policy, loss, cells), systemic(matched, reference, candidate, policy, loss),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_ids(out)


def with_ids(found: DataFrame) -> DataFrame:
    return found.withColumn("id", V.finding_id(F.col("category"), F.col("key"), F.col("field"), F.col("discriminator")))


#: Where a caller sets it, evidence lists so many record numbers at most; else all. The true number stands beside them either way.
LISTED: int | None = None
#: Records beside which one copy of an ambiguous key's lists stands; the records of larger groups are dealt out over several copies.
BESIDE = 1_000


def _listed(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Per group its number of records and their ordinals in order."""
    lists = F.array_sort(F.collect_list("idx")).alias(f"{name}_indexes")
    if LISTED is None:
        return rows.groupBy(*by).agg(F.count("*").alias(f"{name}_count"), lists)
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("idx"))).where(F.col("nth") <= LISTED)
    return rows.groupBy(*by).agg(F.count("*").alias(f"{name}_count")).join(first.groupBy(*by).agg(lists), list(by))


def _beside_lists(bad: DataFrame, lists: DataFrame) -> DataFrame:
    """Every ambiguous record beside its key's lists. What comes out grows with the square of a group, so a large group's records are dealt out and no task holds them all."""
    shares = F.ceil(F.greatest(F.coalesce("candidate_count", F.lit(1)), F.coalesce("reference_count", F.lit(1))) / BESIDE).cast("int")
    sized = lists.select("pass", "key", shares.alias("shares"))
    dealt = bad.join(sized, ["pass", "key"], "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("candidate_idx", "reference_idx"), F.col("shares")).cast("int"), F.lit(0))).drop("shares")
    return dealt.join(lists.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))), ["pass", "key", "share"], "left")


def evidence(reference: Snapshot, candidate: Snapshot, policy: Policy, matches: DataFrame, loss: DataFrame) -> DataFrame:
    """``id`` and ``evidence`` (VARIANT) of the findings about record counts, the match rate, repeated keys, ambiguous records and total losses.

    Lists of record numbers are whole, unless LISTED is set; ``...Count`` tells how many there are.
    """
    told = lambda df, category, key, field, discriminator, **facts: df.select(
        V.finding_id(F.lit(category), *[(c if isinstance(c, Column) else F.lit(c)).cast("string") for c in (key, field, discriminator)]).alias("id"),
        F.to_variant_object(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in facts.items()])).alias("evidence"),
    )
    sizes = reference.df.agg(F.count("*").alias("r")).join(F.broadcast(candidate.df.agg(F.count("*").alias("c")))).where("r <> c")
    drift = F.when(F.col("r") == 0, F.lit(1.0)).otherwise(F.abs(F.col("c") - F.col("r")) / F.greatest("r", F.lit(1)))
    known = policy.record_count_tolerance
    out = told(sizes, "record_count_anomaly", None, None, "", candidateCount=F.col("c"), referenceCount=F.col("r"), delta=F.col("c") - F.col("r"), drift=drift, tolerance=F.lit(known).cast("double"), exceedsTolerance=F.coalesce(drift > F.lit(known).cast("double"), F.lit(False)), toleranceConfigured=known is not None)
    low = matching.summary(matches, policy).where(~F.col("meets_minimum"))
    out = out.unionByName(told(low, "identity_match_issue", None, None, "match_rate_below_minimum", matchRate=F.col("match_rate"), minimumMatchRate=policy.minimum_match_rate, counts=F.struct(*matching.STATUSES)))
    definitions = {"primaryKey": policy.primary_key} | ({"dedupeKey": policy.dedupe_key} if policy.dedupe_key and policy.dedupe_key != policy.primary_key else {})
    for name, fields in definitions.items():
        for side, own in (("candidate", candidate), ("reference", reference)):
            keyed = own.df.select("idx", own.key(fields).alias("key")).where("key is not null")
            twice = keyed.groupBy("key").count().where("count > 1").select("key")
            group = _listed(keyed.join(twice, "key", "left_semi"), ["key"], "record")
            out = out.unionByName(told(group, "duplicate_identity_key", F.col("key"), ",".join(fields), f"{name}:{side}", side=side, keyDefinition=name, keyFields=F.array(*map(F.lit, fields)), keyValue=F.col("key"), recordIndexes=F.col("record_indexes"), recordCount=F.col("record_count")))
    # ambiguous records: all open candidates of a key are ambiguous together, references are those that hold the key
    keys = [policy.primary_key, *[k for k in policy.fallback_keys if k]]
    bad = matches.where(F.col("status").startswith("ambiguous")).withColumn("key", F.coalesce("candidate_key", "reference_key"))
    cand = _listed(bad.where("candidate_idx is not null").select("pass", "key", F.col("candidate_idx").alias("idx")), ["pass", "key"], "candidate")
    held = bad.select("pass", "key").distinct()
    every = reference.df.select("idx", F.explode(F.array(*[F.struct(F.lit(n).alias("pass"), reference.key(k).alias("key")) for n, k in enumerate(keys)])).alias("k")).select("idx", "k.pass", "k.key").where("key is not null")
    ref = _listed(every.join(held, ["pass", "key"], "left_semi"), ["pass", "key"], "reference")
    none = lambda c: F.coalesce(c, F.lit(0))
    side = F.when((none("reference_count") > 1) & (none("candidate_count") > 1), "both").when(none("reference_count") > 1, "reference").otherwise("candidate")
    empty = F.array().cast("array<bigint>")
    names = F.array(*[F.array(*map(F.lit, k)) for k in keys])
    told_of = F.struct(
        F.get(names, F.col("pass")).alias("keyFields"), F.col("key").alias("keyValue"), F.coalesce("reference_indexes", empty).alias("referenceIndexes"), none("reference_count").alias("referenceCount"),
        F.coalesce("candidate_indexes", empty).alias("candidateIndexes"), none("candidate_count").alias("candidateCount"), side.alias("side"),
    )
    both = _beside_lists(bad, written(cand.join(ref, ["pass", "key"], "full_outer"), "ambiguous"))
    whose = F.when(F.col("candidate_idx").isNotNull(), "candidate").otherwise("reference")
    out = out.unionByName(told(both, "identity_match_issue", F.col("key"), F.array_join(F.get(names, F.col("pass")), ","), F.concat_ws(":", "status", whose, F.coalesce("candidate_idx", "reference_idx")), status=F.col("status"), side=whose, candidateIndex=F.col("candidate_idx"), referenceIndex=F.col("reference_idx"), ambiguity=told_of))
    pairs = matches.agg(F.count_if(F.col("method").isNotNull()).alias("pairs"))
    lost = loss.where("populated > 0 and populated = regressed").join(F.broadcast(pairs))
    return out.unionByName(told(lost, "systemic_field_regression", None, F.col("field"), "", referencePopulated=F.col("populated"), regressed=F.col("regressed"), lossRate=F.lit(1), matchedPairCount=F.col("pairs"), perRecordFindingCount=F.least("regressed", F.lit(EXEMPLARS))))


def counts(found: DataFrame) -> DataFrame:
    """Findings by severity and by category, with zeros, and in total."""
    spark = found.sparkSession
    names = spark.createDataFrame([("severity", s) for s in SEVERITIES] + [("category", c) for c in CATEGORIES] + [("total", "total")], "dimension string, name string")
    sums = found.groupBy("category", "severity").count()  # 60 rows at most
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("name"), F.col("count").alias("n")) for d, v in (("severity", F.col("severity")), ("category", F.col("category")), ("total", F.lit("total")))])))
    return names.join(rows.groupBy("dimension", "name").agg(F.sum("n").alias("n")), ["dimension", "name"], "left").na.fill(0, ["n"])
