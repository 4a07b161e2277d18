"""Policy-driven backfill with provenance, exclusions and overrides (inventory R1-R13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.policy import Policy
from ..sources.scratch import written
from ..sources.snapshot import Snapshot, settled
from . import matching

ACTIONS = {"backfill": "manual_reference_accept", "keep_candidate": "manual_veto", "use_custom": "manual_custom_value"}
REASONS = ("invalid_identity", "ambiguous_identity", "candidate_only_policy", "hard_required_field_missing")


def _joined(matches: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy, matched: DataFrame | None = None) -> DataFrame:
    """Each candidate record with its outcome, its reference record (NULL unless matched) and its record key. ``matched``: the matched pairs with both records, if they are at hand."""
    matched = matching.matched(matches, reference, candidate, policy) if matched is None else matched
    rest = matches.where("candidate_idx is not null and method is null").join(candidate.df.select(F.col("idx").alias("candidate_idx"), candidate.record().alias("c")), "candidate_idx")
    rest = rest.withColumns({"r": F.lit(None).cast(matched.schema["r"].dataType), "key": candidate.key(policy.primary_key, "c")})
    out = matched.unionByName(rest.select(*matched.columns)).withColumnRenamed("key", "record_key")
    return out.withColumn("key", F.coalesce("record_key", F.concat(F.lit("candidate:"), "candidate_idx")))


def _backfills(policy: Policy, reference: Snapshot, candidate: Snapshot) -> dict[str, Column]:
    """Per allowed field whether the reference's value is copied."""
    allowed, _, _ = policy.backfillable()
    usable = F.col("method").isNotNull()
    return {f: F.coalesce(usable & reference.col(f, "r").isNotNull() & V.is_blank(candidate.col(f, "c")) & ~V.is_empty(reference.col(f, "r")), F.lit(False)) for f in sorted(allowed)}


def recover(matches: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy, overrides: DataFrame | None = None, matched: DataFrame | None = None) -> DataFrame:
    """R2-R6 as one row a candidate record.

    ``key, record_key, matched_key`` (of the pass that decided) ``, candidate_idx, reference_idx, status, excluded`` (reason or NULL),
    ``missing`` (fields still lacking), ``backfilled``, ``overridden`` (arrays of names),
    ``derived`` (holds reference values) and the output record ``v`` (struct f0, f1, ...).
    ``overrides`` (key, field, value as JSON text, ord) replace any value, the last one wins.
    """
    rows = _joined(matches, reference, candidate, policy, matched)
    fills = _backfills(policy, reference, candidate)
    if overrides is not None:
        last = overrides.groupBy("key", "field").agg(F.max_by("value", "ord").alias("value"))
        rows = rows.join(last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("given")), "key", "left")
    else:
        rows = rows.withColumn("given", F.lit(None).cast("map<string,string>"))
    names = [*candidate.fields, *[f for f in fills if f not in candidate.fields]]
    own = lambda f: F.when(fills[f], reference.col(f, "r")).otherwise(candidate.col(f, "c")) if f in fills else candidate.col(f, "c")
    value = lambda f: F.when(F.map_contains_key("given", f), F.element_at("given", f)).otherwise(own(f))
    rows = rows.withColumn("v", F.struct(*[F.when(F.col("given").isNull(), own(f)).otherwise(value(f)).alias(f"f{i}") for i, f in enumerate(names)]))
    done = Snapshot(candidate.df, tuple(names), candidate.normalise)
    lacking = F.filter(F.array(*[F.when(V.is_empty(done.col(f, "v")), F.lit(f)) for f in policy.hard_required]), lambda x: x.isNotNull()) if policy.hard_required else F.array().cast("array<string>")
    filled = F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in fills.items()]), lambda x: x.isNotNull()) if fills else F.array().cast("array<string>")
    rows = rows.withColumns({"missing": lacking, "backfilled": filled, "overridden": F.coalesce(F.array_sort(F.map_keys("given")), F.array().cast("array<string>"))})
    excluded = (
        F.when(F.col("status") == "invalid_identity", "invalid_identity")
        .when(F.col("status").startswith("ambiguous"), "ambiguous_identity")
        .when((F.col("status") == "candidate_only") & F.lit(policy.candidate_only == "exclude"), "candidate_only_policy")
        .when(F.size("missing") > 0, "hard_required_field_missing")
    )
    return rows.select("key", "record_key", F.col("candidate_key").alias("matched_key"), "candidate_idx", "reference_idx", "status", excluded.alias("excluded"), "missing", "backfilled", "overridden", (F.size("backfilled") > 0).alias("derived"), "v")


def output(recovered: DataFrame, candidate: Snapshot, policy: Policy) -> Snapshot:
    """The recovered records as a snapshot; ``derived`` and ``key`` go along in its frame."""
    names = [*candidate.fields, *[f for f in sorted(policy.backfillable()[0]) if f not in candidate.fields]]
    return Snapshot(recovered.where("excluded is null").select(F.col("candidate_idx").alias("idx"), "key", "derived", "v.*"), tuple(names), candidate.normalise)


def _rule(policy: Policy, field: str) -> str:
    return f"{policy.id}@{policy.version}:safeBackfillFields" + "+rule6" * (field in policy.backfillable()[2])


def provenance(matches: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy, matched: DataFrame | None = None) -> DataFrame:
    """One row a backfilled cell, also of records excluded later."""
    fills = _backfills(policy, reference, candidate)
    cells = [F.when(c, F.struct(F.lit(f).alias("field"), candidate.col(f, "c").alias("original"), reference.col(f, "r").alias("output"), F.lit(_rule(policy, f)).alias("rule_id"))) for f, c in fills.items()]
    rows = matching.matched(matches, reference, candidate, policy) if matched is None else matched
    rows = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("candidate:"), "candidate_idx")))
    if not cells:
        cells = [F.lit(None).cast("struct<field:string,original:string,output:string,rule_id:string>")]
    out = rows.select("key", "candidate_idx", "reference_idx", "status", F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
    stamp = {"source": "reference_backfill", "actor": "auto", "policy": policy.id, "version": policy.version, "policy_hash": policy.policy_hash, "override_revision": policy.override_revision}
    return out.withColumns({k: F.lit(v).cast("int" if isinstance(v, int) else "string") for k, v in stamp.items()})


def _usable(policy: Policy) -> Column:
    """Whether overrides reach a candidate: its match status decides, not what it lacks. Such a candidate has a primary key, which no other one shares."""
    out = (F.col("status") != "invalid_identity") & ~F.col("status").startswith("ambiguous")
    return out & (F.col("status") != "candidate_only") if policy.candidate_only == "exclude" else out


def _touched(matches: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy, given: DataFrame) -> DataFrame:
    """The usable candidates with their overrides: ``key, candidate_idx, reference_idx, status``, the record ``c``, in ``r`` the reference's fields that may be backfilled, ``b0``, ``b1``, ... whether they are, and the columns of ``given`` (by ``key``).

    Nothing else of either side moves. A record has a row for each of its rows in ``given``, or one. Joins are sorted ones, as compressed
    files would let Spark take a whole side for small.
    """
    n = matching.parts(matches, matching.WIDE)
    usable = matches.where(F.col("candidate_idx").isNotNull() & _usable(policy)).select("candidate_idx", "reference_idx", "status", "method")
    allowed = [f"f{reference.fields.index(f)}" for f in sorted(policy.backfillable()[0]) if f in reference.fields]
    r, c = reference.df.select(F.col("idx").alias("reference_idx"), F.struct("idx", *allowed).alias("r")), candidate.df.select(F.col("idx").alias("candidate_idx"), candidate.record().alias("c"))
    pairs = usable.where("method is not null").repartition(n, "reference_idx").join(r.hint("merge"), "reference_idx")
    rest = usable.where("method is null").withColumn("r", F.lit(None).cast(r.schema["r"].dataType))  # their NULLs would all meet in one task
    rows = pairs.unionByName(rest).repartition(n, "candidate_idx").join(c.hint("merge"), "candidate_idx")
    values = settled(candidate.df.select(F.col("idx").alias("candidate_idx"), *[v.alias(f"v{i}") for i, v in enumerate(candidate.identity(policy.primary_key))]))
    keyed = settled(values.select("candidate_idx", V.identity_key([F.col(f"v{i}") for i in range(len(policy.primary_key))]).alias("key")))
    rows = rows.join(keyed.hint("merge").join(given, "key").drop("key"), "candidate_idx", "left").withColumn("key", candidate.key(policy.primary_key, "c"))
    fills = [c.alias(f"b{i}") for i, c in enumerate(_backfills(policy, reference, candidate).values())]
    return rows.select("*", F.inline(F.array(F.struct(*fills)))) if fills else rows  # worked out once, as in settled


def _own(candidate: Snapshot) -> Column:
    """The candidate's value of the field that the column ``field`` names; NULL where it has no such field."""
    return F.coalesce(*[F.when(F.col("field") == f, candidate.col(f, "c")) for f in candidate.fields], F.lit(None).cast("string"))


def _told(rows: DataFrame, cells: list[Column]) -> DataFrame:
    """The cells of rows that :func:`_touched` gave, without those that are NULL."""
    return rows.select("key", "candidate_idx", "reference_idx", "status", F.inline(F.array(*cells))).where("source is not null")


def _struct(**columns: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in columns.items()])


def events(matches: DataFrame, reference: Snapshot, candidate: Snapshot, overrides: DataFrame, policy: Policy) -> DataFrame:
    """Everything that happened to cells, in order: backfills first, then each override of a usable record by ``ord``.

    ``key, candidate_idx, reference_idx, status, field, original, output, rule_id, source, reason, actor, ord``. The
    original value is what the cell held just before: the candidate's value, a backfilled one, or an earlier override's;
    JSON null where the record had no such field. Overrides have ``key, field, value, reason, ord``. Only overrides are put in
    order, before they meet records; a record tells its backfills beside its first one.
    """
    check_overrides(overrides)
    cell, record = Window.partitionBy("key", "field").orderBy("ord"), Window.partitionBy("key").orderBy("ord")
    given = overrides.select("key", "field", F.col("value").alias("given"), "reason", F.col("ord").cast("long").alias("ord")).repartition("key")
    given = given.withColumns({"earlier": F.lag("given").over(cell), "revision": F.row_number().over(cell)}).withColumn("nth", F.row_number().over(record))
    rows, fields = _touched(matches, reference, candidate, policy, given), list(_backfills(policy, reference, candidate))
    first, text = F.coalesce("nth", F.lit(1)) == 1, lambda t: F.lit(t).cast("string")
    filled = [
        F.when(first & F.col(f"b{i}"), _struct(field=F.lit(f), original=candidate.col(f, "c"), output=reference.col(f, "r"), rule_id=F.lit(_rule(policy, f)), source=F.lit("reference_backfill"), reason=text(None), actor=F.lit("auto"), ord=F.lit(-1).cast("long")))
        for i, f in enumerate(fields)
    ]
    backfilled = [F.when((F.col("revision") == 1) & (F.col("field") == f) & F.col(f"b{i}"), reference.col(f, "r")) for i, f in enumerate(fields)]
    before = F.coalesce("earlier", *backfilled, _own(candidate), F.lit(V.NULL_JSON))
    mine = _struct(field=F.col("field"), original=before, output=F.col("given"), rule_id=F.lit(f"{policy.id}@{policy.version}:manual_override"), source=F.lit("manual_override"), reason=F.col("reason"), actor=F.lit("user"), ord=F.col("ord"))
    return _told(rows, [*filled, F.when(F.col("nth").isNotNull(), mine)])


def outcomes(matches: DataFrame, reference: Snapshot, candidate: Snapshot, overrides: DataFrame, policy: Policy) -> DataFrame:
    """What each touched cell holds in the end and where from, as :func:`events` would tell: the last event's ``output`` and ``source``, the first one's ``original``, and their number ``events``.

    Only overrides are grouped; the cells of a record are told inside its row and never shuffled.
    """
    check_overrides(overrides)
    last = overrides.repartition("key").groupBy("key", "field").agg(F.max_by("value", "ord").alias("given"), F.count("*").alias("n"))
    fields_of = last.groupBy("key").agg(F.collect_list(F.struct("field", "given", "n")).alias("all"))  # at most a record's fields
    given = fields_of.select("key", F.col("all.field").alias("revised"), F.posexplode("all").alias("nth", "one")).select("key", "revised", "nth", "one.*")
    rows, fields = _touched(matches, reference, candidate, policy, given), list(_backfills(policy, reference, candidate))
    first, also = F.coalesce("nth", F.lit(0)) == 0, F.lit(False)
    filled = []
    for i, f in enumerate(fields):
        unrevised = ~F.coalesce(F.array_contains("revised", f), F.lit(False))
        filled.append(F.when(first & F.col(f"b{i}") & unrevised, _struct(field=F.lit(f), original=candidate.col(f, "c"), output=reference.col(f, "r"), source=F.lit("reference_backfill"), events=F.lit(1).cast("long"))))
        also = also | (F.col("field").eqNullSafe(f) & F.col(f"b{i}"))
    own = _own(candidate)
    mine = _struct(field=F.col("field"), original=F.when(also, own).otherwise(F.coalesce(own, F.lit(V.NULL_JSON))), output=F.col("given"), source=F.lit("manual_override"), events=F.col("n") + also.cast("long"))
    return _told(rows, [*filled, F.when(F.col("nth").isNotNull(), mine)])


def unapplied(recovered: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides whose record key is no usable candidate's."""
    seen = recovered.where("excluded is null or excluded = 'hard_required_field_missing'").select("key")  # an anti join needs no distinct keys, whose tables would fill each task's memory
    return overrides.join(seen, "key", "left_anti")


def check_overrides(overrides: DataFrame) -> None:
    """Every override needs a reason; raises with the first that has none."""
    if bad := overrides.where(V.js_trim(F.coalesce("reason", F.lit(""))) == "").select("key", "field").first():
        raise ValueError(f"the override of {bad['key']}.{bad['field']} has no reason")


def apply_overrides(result: Snapshot, overrides: DataFrame, policy: Policy, stamped: tuple[str, int, str | None]) -> tuple[Snapshot, DataFrame, DataFrame]:
    """Overrides on a finished result; the result's stamp (policy, version, hash) must be the policy's.

    Returns the new snapshot, provenance rows, and refused overrides with ``refusal``.
    """
    if stamped != (policy.id, policy.version, policy.policy_hash):
        raise ValueError("the result was made under another policy")
    check_overrides(overrides)
    known = result.df.select("key", F.lit(True).alias("known"))
    blanks = F.col("field").isin(*policy.hard_required) & V.is_empty(F.col("value")) if policy.hard_required else F.lit(False)
    judged = overrides.join(known, "key", "left").withColumn("refusal", F.when(F.col("known").isNull(), "unknown record").when(F.col("field").isin(*policy.excluded) if policy.excluded else F.lit(False), "excluded field").when(blanks, "blanks a required field")).drop("known")
    good = judged.where("refusal is null")
    last = good.groupBy("key", "field").agg(F.max_by("value", "ord").alias("value")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("given"))
    rows = result.df.join(last, "key", "left")
    cols = [F.when(F.map_contains_key("given", f), F.element_at("given", f)).otherwise(result.col(f)).alias(f"f{i}") for i, f in enumerate(result.fields)]
    ids = F.create_map(*[F.lit(x) for a, b in ACTIONS.items() for x in (a, f"{policy.id}@{policy.version}:{b}")])
    trail = good.select("key", "field", F.col("value").alias("output"), F.element_at(ids, F.col("action")).alias("rule_id"), "reason", F.lit("manual_override").alias("source"), "ord")
    return Snapshot(rows.select("idx", "key", "derived", *cols), result.fields, result.normalise), trail, judged.where("refusal is not null")


def field_sources(recovered: DataFrame, candidate: Snapshot, policy: Policy) -> DataFrame:
    """A source for every field of every recovered record; an override comes after a backfill."""
    names = [*candidate.fields, *[f for f in sorted(policy.backfillable()[0]) if f not in candidate.fields]]
    source = lambda f: F.when(F.array_contains("overridden", f), "manual_override").when(F.array_contains("backfilled", f), "reference_backfill").otherwise("candidate")
    return recovered.where("excluded is null").select("key", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), source(f).alias("source")) for f in names])))


def inspection(recovered: DataFrame, reference: Snapshot, candidate: Snapshot, policy: Policy, key: str | None = None) -> DataFrame:
    """Every field of the records of ``recovered`` with its candidate, reference and output value side by side; ``key`` picks one record."""
    names = (*candidate.fields, *[f for f in sorted(policy.backfillable()[0]) if f not in candidate.fields])
    out = Snapshot(candidate.df, names, candidate.normalise)
    rows = recovered if key is None else recovered.where(F.col("key") == key)
    rows = rows.join(candidate.df.select(F.col("idx").alias("candidate_idx"), candidate.record().alias("c")), "candidate_idx").join(reference.df.select(F.col("idx").alias("reference_idx"), reference.record().alias("r")), "reference_idx", "left")
    cell = lambda f: F.struct(F.lit(f).alias("field"), candidate.col(f, "c").alias("candidate"), reference.col(f, "r").alias("reference"), out.col(f, "v").alias("output"))
    return rows.select("key", "candidate_idx", "excluded", F.inline(F.array(*[cell(f) for f in names])))


def exclusions(recovered: DataFrame, policy: Policy) -> DataFrame:
    """Excluded candidate records with their reason and the fields at fault."""
    fields = F.when(F.col("excluded") == "hard_required_field_missing", F.col("missing")).otherwise(F.array().cast("array<string>"))
    return recovered.where("excluded is not null").select("record_key", "candidate_idx", F.col("excluded").alias("reason"), fields.alias("fields"))


def summary(recovered: DataFrame) -> DataFrame:
    """Only recovered records' backfills count."""
    kept = F.col("excluded").isNull()
    sums = [F.count_if(F.col("excluded") == r).alias(f"excluded_{r}") for r in REASONS]
    zero = lambda c: F.coalesce(F.sum(F.when(kept, F.size(c))), F.lit(0)).cast("long")
    return recovered.agg(
        F.count("*").alias("candidates"), F.count_if(kept).alias("recovered"), F.count_if(~kept).alias("excluded"), F.count_if(F.col("status") == "candidate_only").alias("candidate_only"),
        zero("backfilled").alias("backfilled_fields"), zero("overridden").alias("overridden_fields"), F.count_if(kept & F.col("derived")).alias("records_with_backfill"), *sums,
    )


def record_findings(recovered: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each candidate record by any of its keys (the record's own, and the one under which it was matched or found ambiguous), or by its ordinal where it has none; ids in order."""
    keys = F.array_compact(F.array_distinct(F.array("record_key", "matched_key")))
    told = recovered.select("candidate_idx", keys.alias("keys"))
    keyed = told.select("candidate_idx", F.explode("keys").alias("key")).join(findings.where("key is not null").select("key", "ord", "id"), "key").select("candidate_idx", "ord", "id")
    bare = told.where(F.size("keys") == 0).join(findings.where("key is null and candidate_idx is not null").select("candidate_idx", "ord", "id"), "candidate_idx")
    return keyed.unionByName(bare.select("candidate_idx", "ord", "id")).distinct()


def justified(recovered: DataFrame, findings: DataFrame, policy: Policy) -> DataFrame:
    """R2: exclusions with the ids of their findings, in the order of categories."""
    own = record_findings(recovered.where("excluded is not null"), findings).groupBy("candidate_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("finding_ids"))
    return exclusions(recovered, policy).join(own, "candidate_idx", "left").withColumn("finding_ids", F.coalesce("finding_ids", F.array().cast("array<string>")))


def retained(recovered: DataFrame, deduped: DataFrame) -> DataFrame:
    """The recovered records that the export holds: valid ones that dedupe retained."""
    return recovered.join(deduped.where("outcome = 'retained' and valid").select("candidate_idx"), "candidate_idx", "left_semi")


def dedupe(recovered: DataFrame, candidate: Snapshot, policy: Policy) -> DataFrame:
    """One row a participant: ``dedupe_key, candidate_idx, valid, derived, required, participants`` (of the key) ``, outcome`` and the removal's ``reason`` and ``winner_idx``.

    Recovered records take part with their output values, excluded ones with the candidate's.
    """
    names = (*candidate.fields, *[f for f in sorted(policy.backfillable()[0]) if f not in candidate.fields])
    out = Snapshot(candidate.df, names, candidate.normalise)
    used = list(dict.fromkeys((*policy.dedupe_key, *policy.hard_required)))
    raw = candidate.df.select(F.col("idx").alias("candidate_idx"), *[candidate.col(f).alias(f"u{i}") for i, f in enumerate(used)])
    valid = recovered.where("excluded is null").select("candidate_idx", "derived", F.lit(True).alias("valid"), *[out.col(f, "v").alias(f"u{i}") for i, f in enumerate(used)])
    spoilt = recovered.where("excluded is not null").select("candidate_idx", "derived", F.lit(False).alias("valid")).join(raw, "candidate_idx")  # the others need no join
    rows, pick = valid.unionByName(spoilt), lambda f: F.col(f"u{used.index(f)}")
    parts = [V.identity_value(pick(f), candidate.normalise).alias(f"k{i}") for i, f in enumerate(policy.dedupe_key)]
    held = sum([F.when(V.is_empty(pick(f)), 0).otherwise(1) for f in policy.hard_required], F.lit(0))
    rows = settled(rows.select("candidate_idx", "valid", "derived", held.alias("required"), *parts))
    key = V.identity_key([F.col(f"k{i}") for i in range(len(policy.dedupe_key))])
    rows = written(rows.select(key.alias("dedupe_key"), "candidate_idx", "valid", "derived", "required"), "participants")  # narrow, and read twice below
    # the best of each key by a map-side minimum; AQE splits the join of a key that many rows repeat
    me = F.struct((~F.col("valid")).alias("spoilt"), "derived", (-F.col("required")).alias("lacking"), "candidate_idx")
    best = rows.where("dedupe_key is not null").groupBy("dedupe_key").agg(F.min(me).alias("first"), F.count("*").alias("participants"))
    ranked = rows.join(best, "dedupe_key", "left").withColumn("first", F.struct((~F.col("first.spoilt")).alias("valid"), F.col("first.derived").alias("derived"), (-F.col("first.lacking")).alias("required"), F.col("first.candidate_idx").alias("candidate_idx")))
    lost = F.coalesce(F.col("first.candidate_idx") != F.col("candidate_idx"), F.lit(False))
    reason = (
        F.when(F.col("first.valid") != F.col("valid"), "duplicate_lost_to_valid_record")
        .when(F.col("first.derived") != F.col("derived"), "duplicate_lost_to_candidate_sourced_record")
        .when(F.col("first.required") != F.col("required"), "duplicate_lost_to_more_complete_record")
        .otherwise("duplicate_lost_to_earlier_record")
    )
    return ranked.select("dedupe_key", "candidate_idx", "valid", "derived", "required", F.coalesce("participants", F.lit(1)).alias("participants"), F.when(lost, "removed").when(F.col("valid"), "retained").otherwise("carried_excluded").alias("outcome"), F.when(lost, reason).alias("reason"), F.when(lost, F.col("first.candidate_idx")).alias("winner_idx"))


def dedupe_summary(deduped: DataFrame) -> DataFrame:
    """W4."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    out = deduped.agg(F.count("*").alias("participants"), is_("retained").alias("retained"), is_("removed").alias("removed"), is_("carried_excluded").alias("carried_excluded"), F.count_if(F.col("dedupe_key").isNull()).alias("unkeyable"), F.count_if((F.col("participants") > 1) & (F.col("outcome") != "removed")).alias("duplicate_groups"))
    return out.withColumn("accounted_for", F.col("retained") + F.col("removed") + F.col("carried_excluded") == F.col("participants"))
