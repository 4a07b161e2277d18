"""Source policies (inventory O1-O10, S17): small documents, handled on the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

LISTS = ("safe_backfill", "manual_review", "excluded", "hard_required", "date_sensitive")


@dataclass(frozen=True)
class FieldGroup:
    id: str
    name: str
    fields: tuple[str, ...]
    threshold_drop: float
    min_affected: int
    severity: str
    narrative: str = ""


@dataclass(frozen=True)
class EmptyRule:
    placeholders: tuple[str, ...] = ()
    allow_empty_array: bool = False


@dataclass(frozen=True)
class Quality:
    required: tuple[str, ...] = ()
    optional_empty: tuple[str, ...] = ()
    identity: tuple[str, ...] = ()
    empty_rules: Mapping[str, EmptyRule] = field(default_factory=dict)
    document_pairs: tuple[tuple[str, str], ...] = ()
    search_fields: Mapping[str, str] = field(default_factory=dict)
    groups: tuple[FieldGroup, ...] = ()


@dataclass(frozen=True)
class Policy:
    id: str
    version: int
    primary_key: tuple[str, ...]
    fallback_keys: tuple[tuple[str, ...], ...] = ()
    dedupe_key: tuple[str, ...] = ()
    hard_required: tuple[str, ...] = ()
    safe_backfill: tuple[str, ...] = ()
    manual_review: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    date_sensitive: tuple[str, ...] = ()
    minimum_match_rate: float = 0.95
    record_count_tolerance: float | None = None
    candidate_only: str = "keep"
    validation: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    collection_path: str = "$"
    source_url: str = ""
    display_name: str = ""
    agency: str = ""
    notes: tuple[str, ...] = ()
    corroboration: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    quality: Quality = Quality()
    policy_hash: str | None = None
    override_revision: int = 0

    def backfillable(self) -> tuple[list[str], list[str], list[str]]:
        """Allowed fields, date-sensitive ones withheld, and date-sensitive ones expressly approved."""
        allowed = [f for f in self.safe_backfill if f not in self.excluded]
        return allowed, sorted(set(self.date_sensitive) - set(allowed)), [f for f in allowed if f in self.date_sensitive]

    def action(self, name: str | None, blank: bool) -> str:
        """P11 for one field, with the candidate's blankness known."""
        if name is None:
            return "report_only"
        if name in self.excluded:
            return "exclude"
        if blank and name in self.safe_backfill:
            return "backfill_allowed"
        return "manual_review" if name in self.manual_review or name in self.safe_backfill else "report_only"


def merge(base: Mapping[str, Any], delta: Mapping[str, Any]) -> dict[str, Any]:
    """O1: a delta's keys replace the base's, ``quality`` one level deeper; None in a delta is ignored."""
    given = {k: v for k, v in delta.items() if v is not None}
    out = {**base, **given}
    if "quality" in base and "quality" in given:
        out["quality"] = {**base["quality"], **{k: v for k, v in given["quality"].items() if v is not None}}
    return out


def canonical(document: Any) -> str:
    """Sorted keys, no blanks."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fnv1a64(text: str) -> str:
    """Over UTF-16 code units."""
    h = 0xCBF29CE484222325
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x100000001B3) & (2**64 - 1)
    return f"{h:016x}"


def resolve(document: Mapping[str, Any], override: Mapping[str, Any] | None = None) -> tuple[dict[str, Any], str]:
    """O2: applies an override made for this version, stamps hash and revision. Returns the document and ``applied``, ``stale`` or ``none``."""
    state = "none"
    out = dict(document)
    if override is not None:
        state = "applied" if override.get("baseVersion") == document.get("version") else "stale"
        if state == "applied":
            out = merge(document, override.get("values", {}))
    return out | {"policyHash": fnv1a64(canonical(out)), "overrideRevision": override.get("revision", 0) if state == "applied" else 0}, state


_NAMES = {
    "primaryKey": "primary_key", "dedupeKey": "dedupe_key", "hardRequiredFields": "hard_required", "safeBackfillFields": "safe_backfill",
    "manualReviewFields": "manual_review", "excludedFields": "excluded", "dateSensitiveFields": "date_sensitive", "minimumMatchRate": "minimum_match_rate",
    "recordCountTolerance": "record_count_tolerance", "candidateOnlyPolicy": "candidate_only", "collectionPath": "collection_path", "sourceUrl": "source_url",
    "displayName": "display_name", "agency": "agency", "id": "id", "version": "version", "policyHash": "policy_hash", "overrideRevision": "override_revision", "notes": "notes",
}
_KNOWN = {*_NAMES, "fallbackKeys", "validation", "quality", "corroboration"}
_QUALITY = {"requiredFields", "optionalEmptyFields", "emptyRules", "identityDefault", "documentFieldPairs", "searchSourceFields", "fieldGroups"}


def problems(document: Mapping[str, Any], kind: str = "whole") -> list[str]:
    """Structural faults of a ``whole`` policy, a ``base`` or a ``delta``; unknown keys are faults."""
    out = [f"unknown key {k}" for k in document if k not in _KNOWN]
    need = {"whole": ("id", "version", "primaryKey"), "base": (), "delta": ("id", "sourceUrl", "version", "safeBackfillFields")}[kind]
    out += [f"missing {k}" for k in need if k not in document]
    for k in ("primaryKey", "dedupeKey", "hardRequiredFields", "safeBackfillFields", "manualReviewFields", "excludedFields", "dateSensitiveFields"):
        v = document.get(k, [])
        if not isinstance(v, list) or not all(isinstance(x, str) and x for x in v):
            out.append(f"{k} is no list of names")
    if "version" in document and (not isinstance(document["version"], int) or document["version"] < 1):
        out.append("version is no positive integer")
    if not 0 <= document.get("minimumMatchRate", 1) <= 1:
        out.append("minimumMatchRate is no rate")
    out += [f"unknown key quality.{k}" for k in document.get("quality", {}) if k not in _QUALITY]
    return out


def contradictions(p: Policy) -> list[str]:
    """O6."""
    both = lambda a, b: sorted(set(a) & set(b))
    out = [f"{f} is safe to backfill and for manual review" for f in both(p.safe_backfill, p.manual_review)]
    out += [f"{f} is safe to backfill and excluded" for f in both(p.safe_backfill, p.excluded)]
    out += [f"{f} is required and excluded" for f in both(p.hard_required, p.excluded)]
    out += ["the primary key has no field"] * (not p.primary_key) + ["a fallback key has no field"] * (() in p.fallback_keys)
    out += [f"{f} is date-sensitive and approved for backfill without a note" for f in both(p.safe_backfill, p.date_sensitive) if not any(f in n for n in p.notes)]
    return out


def policy_of(document: Mapping[str, Any]) -> Policy:
    """O3: the typed policy of a valid document."""
    if bad := problems(document):
        raise ValueError("; ".join(bad))
    own = lambda v: tuple(v) if isinstance(v, list) else v
    q = document.get("quality", {})
    quality = Quality(
        own(q.get("requiredFields", [])), own(q.get("optionalEmptyFields", [])), own(q.get("identityDefault", [])),
        {k: EmptyRule(own(v.get("placeholders", [])), bool(v.get("allowEmptyArray"))) for k, v in q.get("emptyRules", {}).items()},
        tuple((d["docs"], d["hashes"]) for d in q.get("documentFieldPairs", [])), q.get("searchSourceFields", {}),
        tuple(FieldGroup(g["id"], g["name"], tuple(g["fields"]), g["thresholdDrop"], g["minAffectedFields"], g["severity"], g.get("narrative", "")) for g in q.get("fieldGroups", [])),
    )
    values = {_NAMES[k]: own(v) for k, v in document.items() if k in _NAMES}
    validation = {k.removesuffix("Fields"): tuple(v) for k, v in document.get("validation", {}).items()}
    corroboration = {k: tuple(v) for k, v in document.get("corroboration", {}).items()}
    return Policy(**values, fallback_keys=tuple(map(tuple, document.get("fallbackKeys", []))), validation=validation, corroboration=corroboration, quality=quality)


def registry(folder: str | Path) -> tuple[dict[str, Policy], dict[str, list[str]]]:
    """Policies of ``base.json`` and ``sources/*.json``; files with faults are set apart with their reasons."""
    root = Path(folder)
    base = json.loads((root / "base.json").read_text())
    good: dict[str, Policy] = {}
    bad: dict[str, list[str]] = {}
    for f in sorted((root / "sources").glob("*.json")):
        try:
            delta = json.loads(f.read_text())
            if faults := problems(delta, "delta"):
                raise ValueError("; ".join(faults))
            document, _ = resolve(merge(base, delta))
            good[document["id"]] = policy_of(document)
        except ValueError as e:
            bad[f.name] = str(e).split("; ")
    return good, bad


def override_diff(p: Policy, q: Policy) -> dict[str, Any]:
    """What an override adds to and removes from lists, and changes elsewhere."""
    out: dict[str, Any] = {}
    for f in fields(Policy):
        a, b = getattr(p, f.name), getattr(q, f.name)
        if a != b and f.name not in ("policy_hash", "override_revision"):
            out[f.name] = {"added": [x for x in b if x not in a], "removed": [x for x in a if x not in b]} if isinstance(a, tuple) else {"from": a, "to": b}
    return out


def manifest_faults(documents: Sequence[Mapping[str, Any]], manifest: Mapping[str, Mapping[str, Any]]) -> list[str]:
    """Policies whose content changed without a new version."""
    return [d["id"] for d in documents if (m := manifest.get(d["id"])) and m["version"] == d["version"] and m["hash"] != fnv1a64(canonical(dict(d)))]


def scaffold(policy_id: str, source_url: str) -> dict[str, Any]:
    """A new delta that approves nothing."""
    return {"id": policy_id, "sourceUrl": source_url, "displayName": policy_id, "agency": "", "version": 1, "safeBackfillFields": [], "notes": []}


def find(policies: Sequence[Policy], query: str) -> list[Policy]:
    """Q10: exact id before prefix before substring before url or agency, by name."""
    q = query.strip().lower()

    def rank(p: Policy) -> int:
        i, n = p.id.lower(), p.display_name.lower()
        return 4 if q in (i, n) else 3 if i.startswith(q) or n.startswith(q) else 2 if q in i or q in n else int(q in p.source_url.lower() or q in p.agency.lower())

    return sorted((p for p in policies if not q or rank(p)), key=lambda p: (-rank(p) if q else 0, p.display_name))


def with_values(p: Policy, **values: Any) -> Policy:
    return replace(p, **values)
