"""Export gate and artifacts (inventory X1-X7, X9, X10, X12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.policy import Policy, canonical
from ..sources.snapshot import Snapshot, settled

#: Columns of the findings file and the findings' columns that fill them (fixed values).
CSV_COLUMNS = {"id": "id", "severity": "severity", "category": "category", "fieldPath": "field", "recordKey": "key", "candidateValue": "candidate_value", "referenceValue": "reference_value", "recommendedAction": "action", "message": "message"}
#: Cached results that are kept (a fixed value of the feature).
KEPT_RESULTS = 20


def gate(match_summary: DataFrame, counts: DataFrame, policy: Policy, block_on_rate: bool = True, block_on_critical: bool = True) -> DataFrame:
    """``allowed``, the ``reasons`` against (fixed texts) and the number of ``critical`` findings."""
    critical = counts.where("dimension = 'severity' and name = 'critical'").select(F.col("n").alias("critical"))
    both = match_summary.join(F.broadcast(critical))
    rate = F.concat(F.lit("Match rate "), F.format_string("%.4f", "match_rate"), F.lit(f" is below the profile minimum {policy.minimum_match_rate:g}."))
    unresolved = F.concat(F.col("critical").cast("string"), F.lit(" critical finding(s) are unresolved."))
    reasons = F.filter(F.array(F.when(F.lit(block_on_rate) & ~F.col("meets_minimum"), rate), F.when(F.lit(block_on_critical) & (F.col("critical") > 0), unresolved)), lambda r: r.isNotNull())
    return both.select(reasons.alias("reasons"), "critical").withColumn("allowed", F.size("reasons") == 0)


def refuse_secrets(lines: DataFrame, name: str, column: str = "value") -> None:
    """Raises if any key in an artifact's JSON text, at any depth, names a secret."""
    if bad := lines.where(F.col(column).rlike(V.SECRET_KEY)).select(F.regexp_extract(column, V.SECRET_KEY, 0).alias("k")).first():
        raise ValueError(f"Refusing to export {name}: content contains a secret-like key ({bad['k'].strip()})")


def json_lines(result: Snapshot, sources: DataFrame | None = None) -> DataFrame:
    """X2 at scale: one JSON object a record (absent fields left out), with the sources of its fields under ``_provenance``."""
    members = [F.when(result.col(f).isNotNull(), F.concat(F.to_json(F.array(F.lit(f))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(f)))) - 2), F.lit(":"), result.col(f))) for f in result.fields]
    rows = result.df.withColumn("members", F.filter(F.array(*members), lambda m: m.isNotNull()))
    if sources is not None:
        own = sources.groupBy("key").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "source"))))).alias("p"))
        rows = rows.join(own, "key", "left").withColumn("members", F.when(F.col("p").isNull(), F.col("members")).otherwise(F.concat("members", F.array(F.concat(F.lit('"_provenance":'), F.col("p"))))))
    return rows.select("idx", F.concat(F.lit("{"), F.array_join("members", ","), F.lit("}")).alias("value"))


def write_recovered(result: Snapshot, path: str, sources: DataFrame | None = None) -> None:
    lines = json_lines(result, sources).select("value")
    refuse_secrets(lines, "recovered")
    lines.write.mode("overwrite").text(path)


def csv_lines(findings: DataFrame) -> DataFrame:
    """RFC 4180 lines without the header; every text is capped and defused. JSON null and absent values are empty cells."""
    value = lambda c: V.text_of(F.when(F.col(c) != V.NULL_JSON, F.col(c))) if c.endswith("_value") else F.col(c).cast("string")
    # each step's texts are finished before the next one mentions them several times
    cells = settled(findings.select(*[F.coalesce(value(c), F.lit("")).alias(c) for c in CSV_COLUMNS.values()]))
    for step in (V.csv_capped, V.csv_defused):
        cells = settled(cells.select(*[step(F.col(c)).alias(c) for c in CSV_COLUMNS.values()]))
    return cells.select(F.concat_ws(",", *[V.csv_quoted(F.col(c)) for c in CSV_COLUMNS.values()]).alias("value"))


def write_csv(findings: DataFrame, path: str) -> None:
    """Part files with CRLF line ends; the header stands in a file of its own, which sorts first."""
    spark = findings.sparkSession
    csv_lines(findings).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/rows")
    spark.createDataFrame([(",".join(CSV_COLUMNS),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")


def warnings(match: Mapping[str, Any], critical: int, policy: Policy, hashes: bool, allowed: bool, derived: bool, accounted: bool) -> list[str]:
    """The report's warnings, in their fixed order and texts."""
    told = (
        (match["match_rate"] < policy.minimum_match_rate, f"MATCH RATE BELOW MINIMUM: {match['match_rate']:.4f} against a required {policy.minimum_match_rate:g}. Record pairing is not trustworthy."),
        (critical > 0, f"CRITICAL FINDINGS: {critical} unresolved. Review before using this data."),
        (not hashes, "INPUT HASHES UNAVAILABLE: this run cannot prove which files it read."),
        (not allowed, "RECOVERED DATA EXPORT BLOCKED by the profile safety gate. Report and audit remain available."),
        (policy.collection_path == "$" and derived, "RECOVERED ARTIFACT HAS A ROOT ARRAY, so it carries no inline provenance marker. Reference-derived values are listed in the recovery audit."),
        (not accounted, "DEDUPE ACCOUNTING MISMATCH: retained + removed + carried does not equal the participant count."),
    )
    return [text for holds, text in told if holds]


#: Artifacts of a bundle, in order (fixed values).
ARTIFACTS = ("recovered", "quality-report", "recovery-audit", "findings", "contractor-ticket")


def bundle(gate_row: Mapping[str, Any]) -> tuple[list[str], list[tuple[str, str]]]:
    """The artifacts to write, and those withheld with the reasons: recovered data only if the gate allows it, the other four always."""
    if gate_row["allowed"]:
        return list(ARTIFACTS), []
    return list(ARTIFACTS[1:]), [(ARTIFACTS[0], " ".join(gate_row["reasons"]))]


def write_document(result: Snapshot, path: str, policy: Policy, recovery_summary: Mapping[str, Any], generated_at: str, audit: str) -> None:
    """X2 as one document's parts: the records as JSON Lines under ``records``, and beside them ``document`` with the collection's name and the ``_provenance`` marker, which a root array has no place for.

    One file of all records would pass one task; whoever needs it joins the lines with commas.
    """
    write_recovered(result, f"{path}/records")
    marker = {
        "artifact": "recovered", "generatedAt": generated_at, "profileId": policy.id, "profileVersion": policy.version, "profilePolicyHash": policy.policy_hash, "profileOverrideRevision": policy.override_revision,
        "containsReferenceDerivedValues": recovery_summary["backfilled_fields"] > 0, "referenceDerivedValueCount": recovery_summary["backfilled_fields"], "manualOverrideCount": recovery_summary["overridden_fields"],
        "note": "Derived artifact. Values marked reference_backfill in the recovery audit were NOT produced by the candidate scrape.", "auditArtifact": audit,
    }
    body = {"collection": policy.collection_path} | ({} if policy.collection_path == "$" else {"_provenance": marker})
    result.df.sparkSession.createDataFrame([(canonical(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/document")


def report(run: Mapping[str, Any], match: Mapping[str, Any], counts: Sequence[Mapping[str, Any]], policy: Policy, gate_row: Mapping[str, Any]) -> str:
    """The quality report as JSON, from small results; findings themselves are written as a dataset."""
    warnings = [r for r in gate_row["reasons"]] + ([] if match["meets_minimum"] else ["identity is unreliable"])
    return canonical({"run": dict(run), "policy": {"id": policy.id, "version": policy.version, "hash": policy.policy_hash}, "match": dict(match), "counts": [dict(c) for c in counts], "exportAllowed": gate_row["allowed"], "warnings": list(dict.fromkeys(warnings))})


def write_audit(provenance: DataFrame, exclusions: DataFrame, unapplied: DataFrame | None, path: str) -> None:
    """X4."""
    provenance.write.mode("overwrite").json(f"{path}/provenance")
    exclusions.write.mode("overwrite").json(f"{path}/exclusions")
    if unapplied is not None:
        unapplied.write.mode("overwrite").json(f"{path}/unapplied")


def ticket(policy: Policy, fields: Sequence[Mapping[str, Any]], match: Mapping[str, Any], severity: str) -> dict[str, Any]:
    """Title, labels, severity and Markdown of a contractor ticket, from small results; fields without a name are dropped."""
    rows = [f for f in fields if f.get("field")]
    worst = ", ".join(f["field"] for f in rows[:3]) or "no field"
    lines = [f"# {policy.display_name or policy.id}: {worst}", "", f"Policy {policy.id} version {policy.version}. Match rate {match['match_rate']:.4f}.", "", "| Field | Findings | Main category | Others |", "| --- | ---: | --- | --- |"]
    lines += [f"| {f['field']} | {f['findings']} | {f['main']} | {f['others'] or '-'} |" for f in rows]
    return {"title": lines[0][2:], "labels": ["data-quality", f"severity-{severity}", policy.id], "severity": severity, "markdown": "\n".join(lines) + "\n"}


def run_fingerprint(*parts: str) -> str:
    """X11: the fingerprint under which a ticket of the same run is found again."""
    import hashlib

    return hashlib.sha256("::".join(parts).encode()).hexdigest()


def analysis_key(file_hashes: Sequence[str], config: Mapping[str, Any], policy: Policy, schema: int = 1, semantics: int = 1) -> str:
    """The name of a cached result."""
    return run_fingerprint(*file_hashes, canonical(dict(config)), policy.policy_hash or "", str(schema), str(semantics))


def expired_results(cache: DataFrame) -> DataFrame:
    """Cached results beyond the newest KEPT_RESULTS (a list of results, not of records)."""
    w = Window.orderBy(F.col("created_at").desc(), "analysis_key")
    return cache.withColumn("n", F.row_number().over(w)).where(F.col("n") > KEPT_RESULTS).drop("n")


def failures(gate_row: Mapping[str, Any], drift_gate: str) -> list[str]:
    """Why a headless run ends with exit code 1, in order (fixed texts)."""
    out = ["Drift quality gate is Quarantined — critical quality issues are open."] if drift_gate == "Quarantined" else []
    if not gate_row["allowed"]:
        return [*out, f"Recovered data export is blocked: {' '.join(gate_row['reasons'])}"]
    return [*out, *([f"{gate_row['critical']} critical finding(s) are unresolved."] if gate_row["critical"] > 0 else [])]
