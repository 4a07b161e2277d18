"""Drift, QA, recovery and decisions on small data with results worked out by hand."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators import cells, decisions, documents, drift, export, matching, qa, recovery, search, views
from tidemark.plans import catalog
from tidemark.plans import policy as P
from tidemark.sources import json_array
from tidemark.sources import json_export as J
from tidemark.sources.scratch import written
from tidemark.sources.snapshot import Snapshot

BEFORE = {
    "Refreshed": "2024-01-10T08:00:00Z",
    "Export": [
        {"Code": "A-1", "Title": "Main", "Status": "Open", "Docs": '[{"Title":"x","URL":"u","Hash":"H1"}]', "Meta": {"a": 1, "b": {"c": 2}}},
        {"Code": "B-2", "Title": "Two", "Status": "Closed", "Docs": "[]", "Meta": {}},
        {"Code": "D-4", "Title": "Dup", "Status": "Open"},
        None,
        7,
    ],
}
AFTER = {
    "Refreshed": "2024-02-15T08:00:00Z",
    "Export": [
        {"Code": "A-1", "Title": "   ", "Status": None, "Docs": '[{"Title":"y","URL":"u","Hash":"H1"},{"title":"n"}]', "Meta": {"b": {"c": 3}, "a": 1}},
        {"Code": "C-3", "Title": "New", "Status": "n/a"},
        {"Code": "D-4", "Title": "Dup", "Status": "Open"},
        {"Code": "D-4", "Title": "Dup 2", "Status": "Open"},
        {"Code": " ", "Title": "No key"},
    ],
}
POLICY = P.Policy("p", 2, ("Code",), (("Title",),), ("Code",), hard_required=("Code",), safe_backfill=("Title", "Status"), date_sensitive=("Status",), excluded=(), policy_hash="h", quality=P.Quality(required=("Title",), identity=("Code",)))


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pair")
    for name, data, mark in (("before", BEFORE, "﻿"), ("after", AFTER, "")):
        (root / f"{name}.json").write_text(mark + json.dumps(data), encoding="utf-8")
    (root / "bad.json").write_text("{nope")
    return root


@pytest.fixture(scope="module")
def sides(spark, pair):
    return J.load(spark, str(pair / "before.json"), "Export"), J.load(spark, str(pair / "after.json"), "Export")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def j(value):
    return F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def test_emptiness(spark):
    cases = [(None, 1, 1), ("", 1, 1), ("   ", 1, 1), ("N/A", 0, 1), (" none ", 0, 1), ("x", 0, 0), ([], 0, 1), ({}, 0, 0), (0, 0, 0), (False, 0, 0)]
    got = spark.range(1).select(*[f(j(v)).alias(f"x{i}{n}") for i, (v, _, _) in enumerate(cases) for n, f in enumerate((V.is_blank, V.is_empty))]).first()
    assert list(got) == [bool(x) for _, *want in cases for x in want]
    assert one(spark, V.is_blank(F.lit(None).cast("string"))) and not one(spark, V.is_empty(j([]), allow_empty_array=True)) and one(spark, V.is_empty(j("TBD"), placeholders=("tbd",)))


def test_identity(spark):
    norm = lambda v: one(spark, V.identity_value(j(v)))
    assert [norm(v) for v in (" a ", 5, None, [], "HTTP://Ex.COM:80", "https://x.org/A b?q", "é")] == ["a", "5", None, None, "http://ex.com/", "https://x.org/A%20b?q", "é"]
    assert one(spark, V.identity_key([F.lit('a"b'), F.lit("c")])) == '["a\\"b","c"]' and one(spark, V.identity_key([F.lit("a"), F.lit(None).cast("string")])) is None


def test_hashes(spark):
    assert one(spark, V.fnv1a32(F.lit("a"))) == "e40c292c" and one(spark, V.fnv1a32(F.lit(""))) == "811c9dc5"
    assert P.fnv1a64("") == "cbf29ce484222325"
    assert one(spark, V.finding_id(F.lit("c"), F.lit(None).cast("string"), F.lit("f"), F.lit(""))).startswith("c:")


def test_csv_cells(spark):
    cases = {"=1+1": "'=1+1", 'a"b': '"a""b"', "a,b": '"a,b"', None: "", "x" * 501: "x" * 500 + "…[truncated 1 chars]", "plain": "plain", "-": "'-"}
    assert all(one(spark, V.csv_cell(F.lit(k).cast("string"))) == v for k, v in cases.items())


def test_validators(spark):
    bad = lambda t, r: one(spark, V.failure(F.lit(t), r)) is not None
    assert [bad("null", "json"), bad("{", "json"), bad("https://a.b/c", "url"), bad("ftp://a", "url"), bad("a.b", "url"), bad("8/4/2026 11:00 AM", "date"), bad("soon", "date"), bad("a@b.c", "email"), bad("a@b@c", "email"), bad("(1) 2", "phone"), bad("x", "phone")] == [False, True, False, True, True, False, True, False, True, False, True]
    with pytest.raises(ValueError):
        V.failure(F.lit(""), "shape")


def test_natural_order(spark):
    df = spark.createDataFrame([("b10",), ("B9",), ("a2",)], "id string")
    assert [r["id"] for r in df.orderBy(V.natural_key(F.col("id"))).collect()] == ["a2", "B9", "b10"]


def test_loading(spark, pair, sides):
    parsed = J.parse(J.read_text(spark, str(pair)))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in parsed.collect()}
    assert rows["before.json"]["bom"] and not rows["after.json"]["bom"] and rows["bad.json"]["error"] and not rows["after.json"]["error"]
    assert sides[0].df.count() == 3 and sides[0].fields == ("Code", "Docs", "Meta", "Status", "Title")
    assert J.records(parsed, "Nothing").count() == 0 and {r["key"] for r in J.root_keys(parsed).collect()} == {"Export", "Refreshed"}
    dates = {(r["path"].rsplit("/", 1)[1], r["field"]): r["value"] for r in J.dates(parsed, J.records(parsed, "Export")).collect()}
    assert dates["before.json", "Refreshed"] == "2024-01-10T08:00:00Z" and dates["after.json", "Created"] is None
    order = lambda a, b: one(spark, J.date_order(F.lit(a), F.lit(b)))
    assert [order("2024-01-10", "2024-02-15"), order("2/1/2024", "1/1/2024"), order("x", "2024-01-01")] == ["correct", "reversed", "unverified"]


def test_drift(spark, sides):
    b, a = sides
    diff = written(drift.compared(b, a, ("Code",), POLICY.quality), "diff")
    rows = {r["id"]: r for r in diff.collect()}
    assert {k: r["status"] for k, r in rows.items()} == {'["A-1"]': "changed", '["B-2"]': "removed", '["C-3"]': "added", '["D-4"]': "changed", "$unkeyed:latest:4": "added"}
    kinds = {c["path"]: c["kind"] for c in rows['["A-1"]']["changes"]}
    assert kinds == {"Title": "emptied", "Status": "emptied", "Docs": "modified", "Meta.b.c": "modified"} and rows['["A-1"]']["severity"] == "critical"
    assert rows['["D-4"]']["changes"][0]["after"] == '"Dup 2"'  # the last of a repeated key wins
    inner = {r["path"]: (r["before"], r["after"]) for r in drift.changes(diff).where("id like '%A-1%'").collect()}
    assert inner["Meta.b.c"] == ("2", "3") and "Meta" not in inner and "Meta.a" not in inner
    stats = {r["field"]: r for r in drift.field_stats(b, a, ("Code",), POLICY.quality).collect()}
    assert (stats["Title"]["baseline_present"], stats["Title"]["latest_present"], stats["Title"]["emptied"]) == (3, 4, 1)
    assert stats["Meta"]["latest_types"] == {"object": 1} and stats["Status"]["latest_types"] == {"string": 3, "object": 1}
    kinds = {r["kind"]: r["severity"] for r in drift.quality_issues(b, a, ("Code",), POLICY.quality).collect()}
    assert kinds["duplicate-record-keys"] == "critical" and kinds["unkeyed-records"] == "warning"
    issues = written(drift.quality_issues(b, a, ("Code",), POLICY.quality), "issues")
    repeated = drift.duplicate_keys(b, a, ("Code",))
    assert drift.gate(issues).first()["gate"] == "Quarantined" and drift.promoted(diff, issues, repeated).count() == 5
    marked = {r["id"]: (r["severity"], r["issue_ids"]) for r in drift.promoted(diff, issues, repeated).collect()}
    assert marked['["D-4"]'][0] == "critical" and "duplicate-record-keys" in marked['["D-4"]'][1] and "unkeyed-records" in marked["$unkeyed:latest:4"][1]
    told = {r["id"]: r["description"] for r in issues.collect()}
    assert told["duplicate-record-keys"] == "Found 1 duplicate record keys" and told["unkeyed-records"].startswith("1 record(s) have missing") and told["field-population-Docs"] == "Docs fill rate changed from 66.7% to 20.0% (-46.7pp)"
    fields = {r["id"]: set(r["fields"]) for r in issues.where("ord = 4").collect()}
    assert set(marked['["A-1"]'][1]) == {i for i, f in fields.items() if f & {"Title", "Status", "Docs"}} and marked['["B-2"]'] == ("warning", [])


def test_changes_are_taken_apart_to_any_depth(spark):
    nest = lambda v: "{" + "".join(f'"k{i}":{{' for i in range(12)) + f'"x":{v},"same":1' + "}" * 13
    side = lambda x, *more: Snapshot(spark.createDataFrame([(0, '"r"', x, *more)], "idx long, f0 string, f1 string, f2 string"), ("Code", "F", "G"), nested=True)
    b, a = side(nest(1), '{"x":{"{":"}"},"y":[{"z":1}],"w":{},"v":{"q":"set"}}'), side(nest(2), '{"x":{"{":"}"},"y":[{"z":2}],"w":{"n":1},"v":{"q":" "}}')
    assert (drift.nesting(b), drift.nesting(a)) == (13, 13)
    diff = drift.compared(b, a, ("Code",), P.Quality(required=("G.v.q",))).first()
    got = {c["path"]: (c["kind"], c["before"], c["after"]) for c in diff["changes"]}
    assert got == {"F." + ".".join(f"k{i}" for i in range(12)) + ".x": ("modified", "1", "2"), "G.w.n": ("added", None, "1"), "G.y": ("modified", '[{"z":1}]', '[{"z":2}]'), "G.v.q": ("emptied", '"set"', '" "')}
    assert (diff["n_changed"], diff["severity"]) == (4, "critical")


def test_empty_sides(spark, sides):
    b, a = sides
    none = Snapshot(b.df.limit(0), b.fields, b.normalise)
    ids = lambda x, y: {r["id"] for r in drift.quality_issues(x, y, ("Code",), POLICY.quality).collect()}
    assert "empty-collection" in ids(none, none) and "empty-collection" not in ids(b, none) | ids(none, a)


def test_narrative(spark):
    issues = lambda *i: spark.createDataFrame([(x,) for x in i], "id string")
    stats = lambda drop: spark.createDataFrame([("BidURL", 1.0, 1.0 - drop)], "field string, baseline_rate double, latest_rate double")
    assert drift.narrative(issues(), stats(0.5)) == drift.NO_PATTERN
    assert drift.narrative(issues("group-header-metadata"), stats(0.05)) == drift.HEADER_ONLY and drift.narrative(issues("group-header-metadata"), stats(0.5)) == drift.HEADER_FAILURE


def test_matching_and_recovery(spark, sides):
    ref, cand = sides
    m = written(matching.match(ref, cand, POLICY), "m")
    got = {(r["candidate_idx"], r["reference_idx"]): r["status"] for r in m.collect()}
    assert got == {(0, 0): "matched_primary", (1, None): "candidate_only", (2, None): "ambiguous_primary", (3, None): "ambiguous_primary", (4, None): "invalid_identity", (None, 1): "reference_only", (None, 2): "ambiguous_primary"}
    s = matching.summary(m, POLICY).first()
    assert s["match_rate"] == pytest.approx(0.2) and not s["meets_minimum"]
    found = written(qa.findings(ref, cand, POLICY, m), "found")
    by = {}
    for r in found.collect():
        by.setdefault(r["category"], []).append(r)
    assert {c: len(v) for c, v in by.items()} == {"record_count_anomaly": 1, "identity_match_issue": 5, "duplicate_identity_key": 1, "record_missing_from_candidate": 1, "required_field_missing": 1, "field_conflict": 2, "field_regression": 2, "systemic_field_regression": 2}
    assert {r["action"] for r in by["field_regression"]} == {"backfill_allowed"} and len({r["id"] for v in by.values() for r in v}) == found.count()
    counts = {(r["dimension"], r["name"]): r["n"] for r in qa.counts(found).collect()}
    assert counts["total", "total"] == found.count() and counts["severity", "low"] == 0
    rec = written(recovery.recover(m, ref, cand, POLICY), "rec")
    rows = {r["candidate_idx"]: r for r in rec.collect()}
    assert rows[0]["backfilled"] == ["Status", "Title"] and [rows[i]["excluded"] for i in (0, 1, 2, 4)] == [None, None, "ambiguous_identity", "invalid_identity"]
    out = recovery.output(rec, cand, POLICY)
    assert {r["t"] for r in out.df.select(out.col("Title").alias("t")).collect()} == {'"Main"', '"New"'}
    prov = recovery.provenance(m, ref, cand, POLICY)
    assert {(r["field"], r["rule_id"]) for r in prov.collect()} == {("Title", "p@2:safeBackfillFields"), ("Status", "p@2:safeBackfillFields+rule6")}
    d = recovery.dedupe(rec, cand, POLICY)
    assert {r["candidate_idx"]: r["outcome"] for r in d.collect()} == {0: "retained", 1: "retained", 2: "carried_excluded", 3: "removed", 4: "carried_excluded"}
    assert recovery.dedupe_summary(d).first()["accounted_for"]
    cells = written(decisions.lanes(found, prov, POLICY), "cells")
    assert decisions.lane_counts(cells).first().asDict() == {"auto": 2, "review": 2, "ineligible": 0}
    log = decisions.bulk(cells, POLICY, "backfill", "looked at", "t", first=5, acknowledged=True)
    assert sorted(r["sequence"] for r in log.collect()) == [5, 6, 7, 8]
    assert decisions.rebase(log, log).count() == 0
    with pytest.raises(ValueError):
        decisions.bulk(cells, POLICY, "use_custom", "x", "t")
    over = spark.createDataFrame([('["A-1"]', "Title", '"Mine"', "why", "use_custom", 1), ('["Z"]', "Title", '"Q"', "why", "use_custom", 2), ('["A-1"]', "Code", '""', "why", "use_custom", 3)], "key string, field string, value string, reason string, action string, ord long")
    fixed, trail, refused = recovery.apply_overrides(out, over, POLICY, ("p", 2, "h"))
    assert fixed.df.where("key like '%A-1%'").select(fixed.col("Title").alias("t")).first()["t"] == '"Mine"' and trail.count() == 1 and {r["refusal"] for r in refused.collect()} == {"unknown record", "blanks a required field"}
    with pytest.raises(ValueError):
        recovery.apply_overrides(out, over, POLICY, ("p", 3, "h"))
    line = json.loads(export.json_lines(out, recovery.field_sources(rec, cand, POLICY)).where("idx = 0").first()["value"])
    assert line["Title"] == "Main" and line["_provenance"]["Title"] == "reference_backfill" and line["_provenance"]["Code"] == "candidate"
    g = export.gate(matching.summary(m, POLICY), qa.counts(found), POLICY).first()
    assert not g["allowed"] and g["reasons"][0] == "Match rate 0.2000 is below the profile minimum 0.95." and g["reasons"][1].endswith(" critical finding(s) are unresolved.")
    assert export.failures(g, "Quarantined") == ["Drift quality gate is Quarantined — critical quality issues are open.", f"Recovered data export is blocked: {' '.join(g['reasons'])}"] and export.failures({"allowed": True, "reasons": [], "critical": 0}, "Pass") == []
    assert views.corroboration(spark.createDataFrame([("Bids are due no later than August 4th.", "8/4/2026", "f"), ("due by 7/1", "8/4/2026", "f"), ("nothing", "8/4/2026", "f")], "text string, value string, field string"), "text", "value", ("no later than", "due by")).select("verdict").collect() == [("corroborated",), ("not_corroborated",), ("no_signal",)]


def test_fallback_judges_ambiguity_on_all_references(spark):
    def side(rows):
        return J.snapshot(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "idx long, b string").select("idx", F.parse_json("b").alias("body")))

    ref = side([{"Code": "1", "Title": "t"}, {"Code": "2", "Title": "t"}, {"Code": "3", "Title": "u"}, {"Code": "4", "Title": "w"}])
    cand = side([{"Code": "1", "Title": "t"}, {"Code": "9", "Title": "t"}, {"Code": "8", "Title": "u"}, {"Code": "4", "Title": "w"}, {"Code": "7", "Title": "w"}])
    got = {r["candidate_idx"]: r["status"] for r in matching.match(ref, cand, POLICY).where("candidate_idx is not null").collect()}
    assert got == {0: "matched_primary", 1: "ambiguous_fallback", 2: "matched_fallback", 3: "matched_primary", 4: "candidate_only"}


def test_documents(spark, sides):
    b, a = sides
    rows = b.df.where("idx = 0").select(F.lit(1).alias("key"), documents.normalised(b.col("Docs")).alias("before")).join(a.df.where("idx = 0").select(F.lit(1).alias("key"), documents.normalised(a.col("Docs")).alias("after")), "key")
    rows = documents.compared(rows, "before", "after")
    cmp = documents.compare(rows, "key")
    assert {(r["hash"], r["state"]) for r in cmp.collect()} == {("H1", "modified"), (None, "incomplete")}
    s = documents.summary(rows, "key", "before", "after").first()
    assert (s["n_before"], s["n_after"], s["modified"], s["incomplete"], s["unchanged"]) == (1, 2, 1, 1, 0)
    rows = rows.withColumn("listed", F.array(F.lit("HX")))
    h = documents.health(rows, "key", "before", "after", ("listed", "listed"))
    assert (h.first()["missing_hash"], h.first()["not_listed"], h.first()["dangling"]) == (1, ["H1"], ["HX"])
    assert documents.states(rows, "key", "before", "after", ("listed", "listed")).first()["companion"]
    assert "Exchange" not in documents.states(rows.where("key > 0"), "key", "before", "after", ("listed", "listed"))._jdf.queryExecution().executedPlan().toString().split("Join")[0]


def test_document_lists_count_both_sides(spark):
    doc = lambda h, t="t": {"title": t, "url": "u", "hash": h}
    before, after = [doc("A"), doc("A"), doc("B"), doc(None), doc(" ")], [doc("A"), doc("A"), doc("A"), doc("B", "new"), doc(None), {"hash": "C"}]
    rows = spark.createDataFrame([(1, json.dumps(before), json.dumps(after))], "key long, b string, a string")
    rows = rows.select("key", documents.normalised(F.col("b")).alias("before"), documents.normalised(F.col("a")).alias("after"), F.array(F.lit("A"), F.lit("Z")).alias("listed"))
    rows = documents.compared(rows, "before", "after")
    cmp = documents.compare(rows, "key")
    assert sorted((r["hash"] or "", r["state"], r["before"] is None, r["after"] is None) for r in cmp.collect()) == [("", "incomplete", False, True)] * 2 + [("", "incomplete", True, False), ("B", "modified", False, False), ("C", "added", True, False)]
    s = documents.summary(rows, "key", "before", "after").first()
    assert (s["n_before"], s["n_after"], s["modified"], s["incomplete"], s["unchanged"]) == (5, 6, 1, 3, 1)  # 2 and 3 distinct hashes
    h = documents.health(rows, "key", "before", "after", ("listed", "listed")).first()
    assert (h["missing_hash"], h["missing_title"], h["missing_url"], h["duplicates"], h["not_listed"], h["dangling"]) == (3, 1, 1, ["A"], ["B", "C"], ["Z"])
    bare = rows.withColumns({"listed": F.array(F.lit("B")), "before": documents.normalised(F.lit(json.dumps([doc("B"), doc(None)]))), "after": documents.normalised(F.lit(json.dumps([doc("B")])))})
    states = documents.states(documents.compared(bare, "before", "after"), "key", "before", "after", ("listed", "listed")).first()
    assert states["incomplete"] and states["hash_mismatch"] and not states["companion"] and states["decreased"]  # the index counts an incomplete list as a mismatch


def test_policies(tmp_path):
    base = {"primaryKey": ["Code"], "minimumMatchRate": 0.9, "quality": {"requiredFields": ["Code"], "identityDefault": ["Code"]}}
    (tmp_path / "sources").mkdir()
    (tmp_path / "base.json").write_text(json.dumps(base))
    delta = {"id": "s", "sourceUrl": "https://s.example", "version": 1, "safeBackfillFields": ["A"], "quality": {"requiredFields": ["A"]}}
    (tmp_path / "sources/s.json").write_text(json.dumps(delta))
    (tmp_path / "sources/t.json").write_text(json.dumps({"id": "t", "odd": 1}))
    good, bad = P.registry(tmp_path)
    assert good["s"].quality.required == ("A",) and good["s"].quality.identity == ("Code",) and "unknown key odd" in bad["t.json"]
    assert P.resolve(delta, {"baseVersion": 2, "values": {}})[1] == "stale" and P.resolve(delta, {"baseVersion": 1, "values": {"version": 1}, "revision": 4})[0]["overrideRevision"] == 4
    odd = P.with_values(good["s"], manual_review=("A",), excluded=("A",))
    assert len(P.contradictions(odd)) == 2 and P.override_diff(good["s"], odd)["excluded"]["added"] == ["A"]
    assert P.manifest_faults([delta], {"s": {"version": 1, "hash": "other"}}) == ["s"] and P.find([good["s"]], "S")[0].id == "s" and P.problems(P.scaffold("x", "u"), "delta") == []
    assert good["s"].backfillable() == (["A"], [], []) and [good["s"].action(f, b) for f, b in (("A", True), ("A", False), ("B", True), (None, True))] == ["backfill_allowed", "manual_review", "report_only", "report_only"]


@pytest.fixture(scope="module")
def index(spark, sides, tmp_path_factory):
    b, a = sides
    issues = written(drift.quality_issues(b, a, ("Code",), POLICY.quality), "issues")
    diff = drift.promoted(drift.compared(b, a, ("Code",), POLICY.quality), issues, drift.duplicate_keys(b, a, ("Code",)))
    words = spark.createDataFrame([('["A-1"]', "H1 handbook " * 20)], "id string, text string")
    docs = search.documents(diff, drift.paired(b, a, ("Code",)), b, a, ("Code",), {"title": "Title", "status": "Status"}, issues, words)
    return search.build(docs, str(tmp_path_factory.mktemp("index") / "i"))


def test_search(spark, index):
    ids = lambda q, **how: [r["id"] for r in search.search(index, q, **how).collect()]
    assert ids("mai") == ['["A-1"]'] and set(ids("Open")) == {'["A-1"]', '["D-4"]'}  # a wiped title and state are still found
    assert ids("new") == ['["C-3"]'] and ids("  ") == ids(". ,") == ids("nothing here") == [] and ids("HANDBOOK") == ['["A-1"]']
    assert set(ids("2")) >= {'["B-2"]', '["D-4"]'}  # by its key and by its title
    tiers = {r["id"]: r["tier"] for r in search.search(index, "A-1").collect()}
    assert tiers['["A-1"]'] == 3 and ids("d-4 dup", k=1) == ['["D-4"]'] and {r["tier"] for r in search.search(index, "d-").collect()} >= {2}
    assert '["D-4"]' in ids("duplicate") and '["B-2"]' not in ids("duplicate")  # an issue's text belongs to its records
    only = spark.createDataFrame([('["D-4"]',), ('["D-4"]',), ("unknown",)], "id string")
    assert ids("open", candidates=only) == ['["D-4"]'] and len(ids("open")) > 1
    counts = {(r["term"], r["field"]): r["tf"] for r in index.postings.where("id like '%A-1%'").collect()}
    assert counts["handbook", "documentText"] == 20 and counts["main", "title"] == 1


def test_a_search_reads_a_range_of_terms(index):
    plan = search.search(index, "mai")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StringStartsWith(term,mai)") == 2
    assert search.query_terms(" Ab-c\nd\u00a0e, ab") == ["ab", "c", "d", "e"]


def test_secrets_are_refused(spark):
    lines = lambda *t: spark.createDataFrame([(x,) for x in t], "value string")
    for text in ('{"ApiToken":1}', '{"a":{"deep":[{"db_passwd" : 1}]}}', '{"api-key":"x"}', '{"SecretaryName":"kept out as the feature does"}'):
        with pytest.raises(ValueError, match="secret-like key"):
            export.refuse_secrets(lines('{"a":1}', text), "x")
    export.refuse_secrets(lines('{"a":"token"}', '{"cookie":1}'), "x")


def test_shown_texts(spark):
    assert [one(spark, views.column_text(j(v), "-")) for v in ("a", "", None, 5, [1])] == ["a", "-", "-", "5", "[1]"] and one(spark, views.column_text(F.lit(None).cast("string"))) == ""
    n = F.lit(None).cast("int")
    assert one(spark, views.documents_text(F.lit(1), F.lit(2), F.lit(0))) == "1 added · 2 removed · 0 modified" and one(spark, views.documents_text(n, n, n)) == "-"
    changes = F.array(F.struct(F.lit("Meta.b").alias("path")))
    assert one(spark, views.path_changed(changes, "Meta")) and not one(spark, views.path_changed(changes, "Met"))


def test_inspection(spark, sides):
    ref, cand = sides
    m = written(matching.match(ref, cand, POLICY), "m")
    shown = recovery.inspection(recovery.recover(m, ref, cand, POLICY), ref, cand, POLICY, key='["A-1"]')
    got = {r["field"]: (r["candidate"], r["reference"], r["output"]) for r in shown.collect()}
    assert got["Title"] == ('"   "', '"Main"', '"Main"') and got["Code"] == ('"A-1"',) * 3 and set(got) == set(cand.fields)


def test_cells(spark, sides):
    ref, cand = sides
    m = written(matching.match(ref, cand, POLICY), "m")
    rows = written(cells.records(ref, cand, ("Code",), POLICY, m), "records")
    own = cells.classified(rows, ref, cand, POLICY, recovery.provenance(m, ref, cand, POLICY))
    got = {(r["id"], r["field"]): r for r in own.collect()}
    assert got['["A-1"]', "Title"]["lane"] == "auto" and got['["A-1"]', "Title"]["situation"] == "candidate_blank"
    assert got['["A-1"]', "Docs"]["situation"] == "conflict" and got['["A-1"]', "Docs"]["lane"] == "review"
    assert got['["C-3"]', "Title"]["reason"] == cells.BLOCKERS["record_added"] and got['["B-2"]', "Title"]["reason"] == cells.BLOCKERS["record_removed"]
    assert got['["D-4"]', "Title"]["reason"] == cells.BLOCKERS["disputed"] and not got['["D-4"]', "Title"]["manual"]  # a repeated key is no pair for the review
    closed = cells.classified(rows, ref, cand, POLICY, recovery.provenance(m, ref, cand, POLICY), fields=["Title"], unavailable="no review")
    assert {(r["lane"], r["reason"], r["manual"]) for r in closed.collect()} == {(None, "no review", False)}
    said = lambda c, r, s="paired": one(spark, cells.situation(F.lit(s), j(c), j(r)))
    assert [said("", "x"), said("x", ""), said("", None), said("x", "x"), said("x", "y"), said({"a": 1}, {"a": 1}), said("x", "x", "added")] == ["candidate_blank", "reference_blank", "unchanged", "unchanged", "conflict", "conflict", "record_added"]
    assert cells.field_policy(POLICY, "Nothing")["description"] == cells.POLICY_TEXTS["none"]


def test_decisions_are_checked(spark):
    own = spark.createDataFrame([("k", "f", "review", '"c"', '"r"'), ("k", "g", "ineligible", '"c"', None)], "key string, field string, lane string, candidate_value string, reference_value string")
    wanted = spark.createDataFrame([("k", "f", "backfill", " why ", None), ("k", "f", "backfill", " ", None), ("k", "g", "backfill", "why", None), ("k", "g", "use_custom", "why", '"v"'), ("k", "f", "use_custom", "why", None)], "key string, field string, action string, reason string, value string")
    made, refused = decisions.create(wanted, own, "2024-01-01T00:00:00Z", first=3)
    assert sorted((r["field"], r["action"], r["value"], r["reason"], r["sequence"]) for r in made.collect()) == [("f", "backfill", '"r"', "why", 3), ("g", "use_custom", '"v"', "why", 4)]
    assert len({r["refusal"] for r in refused.collect()}) == 3
    text = json.dumps(["k", "f", "backfill", "2024-01-01T00:00:00Z", 3], separators=(",", ":"))
    h = 0x811C9DC5
    for c in text:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    assert made.where("field = 'f'").first()["id"] == f"decision:{h:08x}"


def test_decision_transfer(spark):
    context = {"profileId": "p", "profileVersion": 1, "policyHash": "h", "generatedAt": "t", "inputHashes": [{"role": "candidate", "sha256": "a"}, {"role": "reference", "sha256": "b"}]}
    head = {"formatVersion": 1, "exportedAt": "t", "context": context}
    assert decisions.transfer_problems(head) == [] and decisions.mismatches(context, context) == []
    assert decisions.transfer_problems(head | {"odd": 1, "formatVersion": 2}) == ['Unknown key "odd".', "formatVersion must be 1, got 2."]
    other = context | {"policyHash": None, "inputHashes": [{"role": "candidate", "sha256": "x"}]}
    assert len(decisions.mismatches(other, context)) == 3
    good = {"id": "1", "recordKey": "k", "field": "f", "action": "backfill", "reason": "r", "timestamp": "t", "actor": "user", "sequence": 2}
    rows = spark.createDataFrame([(0, json.dumps(good)), (1, json.dumps(good | {"action": "drop", "sequence": "2"})), (2, "[]")], "at long, j string").select("at", F.parse_json("j").alias("d"))
    assert sorted(r["problem"] for r in decisions.transfer_row_problems(rows).collect()) == ["decisions[1].action must be one of backfill, keep_candidate, use_custom.", "decisions[1].sequence must be a number.", "decisions[2] is not an object."]


def test_sequences_are_those_of_one_sort(spark):
    n = 3000
    df = spark.range(n).selectExpr("concat('k', id % 1000) as key", "concat('f', id) as field", "'backfill' as action", "'v' as value", "'r' as reason", "'t' as ts").repartition(7)
    got = sorted((r["key"], r["field"], r["sequence"]) for r in decisions.numbered(df, ["key", "field"], 10).collect())
    assert [s for _, _, s in got] == list(range(10, 10 + n))


def test_artifacts():
    assert export.bundle({"allowed": True, "reasons": []}) == (list(export.ARTIFACTS), []) and export.bundle({"allowed": False, "reasons": ["a", "b"]}) == (list(export.ARTIFACTS[1:]), [("recovered", "a b")])
    told = export.warnings({"match_rate": 0.5}, 2, POLICY, False, False, True, False)
    assert [w.split(":")[0].split(" by ")[0] for w in told[:2]] == ["MATCH RATE BELOW MINIMUM", "CRITICAL FINDINGS"] and len(told) >= 5
    assert list(export.CSV_COLUMNS) == ["id", "severity", "category", "fieldPath", "recordKey", "candidateValue", "referenceValue", "recommendedAction", "message"]


def test_table_sorts(spark):
    df = spark.createDataFrame([("a10", "2024-01-02", "high", 3), ("a2", "", "pass", 3), ("b1", "2024-01-01", "critical", 1), ("a1", "2024-01-02", "high", 9)], "id string, due string, severity string, n_changed int")
    ids = lambda by, down=False: [r["id"] for r in views.sorted_records(df, by, down).collect()]
    assert ids("key") == ["a1", "a2", "a10", "b1"] and ids("changes", True) == ["a1", "a10", "a2", "b1"] and ids("severity") == ["a2", "a1", "a10", "b1"]
    assert ids("due") == ["b1", "a1", "a10", "a2"] and ids("due", True) == ["a1", "a10", "b1", "a2"]  # blanks last both ways
    with pytest.raises(ValueError):
        views.sorted_records(df, "shape")


FAST = ("blank_vs_empty_census", "field_changes", "match_results", "recovery_summary", "qa_field_regression", "document_diff", "decision_latest", "identity_census", "source_detection")


@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans.catalog import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "pages", "documents"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in cur.fetchall()), key=repr)
    df = QUERIES[name](spark, folder)
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == want


def test_tracked_values_tell_what_they_leave_out(spark, tmp_path):
    (tmp_path / "many.json").write_text(json.dumps([{"v": f"x{i % 70}", "w": f"y{i % 3}"} for i in range(140)] + [{"v": None}]), encoding="utf-8")
    side = J.load(spark, str(tmp_path / "many.json"))
    shown = lambda f: views.tracked_values(side.df.repartition(7), side.col(f), F.col("idx")).collect()
    facts = lambda f: {(r["populated"], r["distinct"], r["lower_bound"], r["groupable"]) for r in shown(f)}
    assert {(r["value"], r["count"], r["first"]) for r in shown("v")} == {(f"x{i}", 2, i) for i in range(64)} and abs(shown("v")[0]["estimate"] - 70) <= 3
    assert facts("v") == {(140, 64, True, False)} and facts("w") == {(140, 3, False, True)}


HARD = [{"a": 'quo"te \\ [{ } ] , \\" ü🙂', "b": [{"c": "]}"}, [1, "{"]]}, 7, None, "text {[", {"": '\\\\"'}, [{"no": "record"}], {"k": {"Export": ["[", {"deep": 1}]}}, {}]
FILES = {"array": json.dumps(HARD), "object": json.dumps({"x": {"Export": [{"not": "this"}]}, "s": 'Export": [{', "Export": HARD, "Later": [{"nor": "this"}]}, ensure_ascii=False, indent=1), "marked": "﻿" + json.dumps(HARD, ensure_ascii=False)}


@pytest.mark.parametrize("name", FILES)
def test_ranges_cut_at_any_byte_give_the_same_records(tmp_path, name):
    """Start states of ranges composed over every cut of the file, and records cut by ranges of every size."""
    data, collection, level = FILES[name].encode(), "Export", 2 if name == "object" else 1
    want = [json.loads(json.dumps(x)) for x in HARD if isinstance(x, dict)]
    for size in [*range(1, 40), 100, len(data)]:
        state, depth, got, opens = json_array.OUTSIDE, 0, [], []
        for lo in range(0, len(data), size):
            part = data[lo : lo + size]
            ends = [json_array.transition(part, s) for s in range(3)]
            b = lambda: json_array._Bytes(Reader(data), lo, lo + len(part), len(data))  # noqa: B023, E731
            got += json_array.cut(b(), state, depth, level)
            opens += json_array.marks(b(), state, depth, collection) if name == "object" else []
            state, depth = ends[state][0], depth + ends[state][1]
        assert (state, depth) == (json_array.OUTSIDE, 0)
        if name == "object":
            start = [at for at, o in opens if o]
            assert len(start) == 1
            end = min(at for at, o in opens if not o and at > start[0])
            got = [(at, t) for at, t in got if start[0] < at < end]
        assert [json.loads(t) for _, t in got] == want


class Reader:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_export_in_ranges_equals_whole_export(spark, tmp_path, size):
    for name, text in FILES.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    for name, text in (("cut.json", FILES["array"][:-9]), ("bad.json", '[{"a": nope}]'), ("deep.json", '[{"a": 1}]]'), ("number.json", "7"), ("empty.json", "")):
        (tmp_path / name).write_text(text)
    plain = lambda df: sorted((r["path"].rsplit("/", 1)[1], r["idx"], r["t"]) for r in df.withColumn("t", V.json_of_variant(F.col("body"))).collect())
    whole = J.parse(J.read_text(spark, str(tmp_path)))
    for collection in ("$", "Export"):
        got, faults = json_array.read(spark, str(tmp_path), collection, size)
        assert plain(got) == plain(J.records(whole.where("error is null and path not like '%deep%'"), collection)) and got.count() >= 4  # what follows a root is no fault for the whole parse
        bad = {r["path"].rsplit("/", 1)[1] for r in faults.collect()}
        assert bad >= {"cut.json", "deep.json", "number.json"} and ("bad.json" in bad) == (collection == "$")


def test_next_pending_looks_ahead_and_wraps(spark):

    r = random.Random(5)
    rows = [(f"id{i}", f"{i}B", f"k{i}", r.choice([0, 0, 0, 2]), False) for i in range(1, 200)]
    for own in (rows, [(a, b, c, 0, e) for a, b, c, _, e in rows], [(a, b, c, int(a == "id7"), e) for a, b, c, _, e in rows]):
        df = spark.createDataFrame(own, "id string, label string, key string, pending int, resolved boolean").repartition(5)
        got = {x["id"]: x["next"] for x in decisions.next_pending(df).collect()}
        ahead = lambda i: next((own[(i + k) % len(own)][0] for k in range(1, len(own) + 1) if own[(i + k) % len(own)][3]), None)  # noqa: B023, E731
        assert got == {x[0]: ahead(i) for i, x in enumerate(own)}
    summaries = spark.createDataFrame([("a", "1", "k", ["x", "y"]), ("b", "2", None, ["x"]), ("c", "3", "l", []), ("d", "4", "m", ["z"])], "id string, label string, key string, review_fields array<string>")
    log = spark.createDataFrame([("k", "x"), ("k", "x"), ("m", "z"), ("n", "z")], "key string, field string")
    assert {tuple(x)[0:1] + tuple(x)[3:] for x in decisions.queue(summaries, log).collect()} == {("a", 1, False), ("b", 0, True), ("c", 0, False), ("d", 0, True)}


def test_ticket_fields_and_finding_search(spark):
    groups = spark.createDataFrame([("field_conflict", "f", 3), ("field_regression", "f", 5), ("systemic_field_regression", "f", 5), ("schema_field_missing", None, 9), ("required_field_missing", "g", 1)], "category string, field string, findings long")
    assert {tuple(r) for r in views.ticket_fields(groups).collect()} == {("f", "field_regression", 5, "field_conflict,systemic_field_regression"), ("g", "required_field_missing", 1, "")}
    found = spark.createDataFrame([("field_conflict", "high", "K1", "Title", "Lost."), ("x", "high", None, None, "said")], "category string, severity string, key string, field string, message string")
    n = lambda *a, **k: views.matching_findings(found, *a, **k).count()
    assert (n(" lost. k1 TITLE "), n("conflict"), n("  "), n("said  "), n("", severity="high"), n("k1", severity="low")) == (1, 0, 2, 1, 2, 0)


def test_evidence_lists_are_bounded_and_tell_their_true_length(spark, monkeypatch):
    monkeypatch.setattr(qa, "LISTED", 3)
    side = lambda codes: Snapshot(spark.createDataFrame([(i, json.dumps(c), '"t"') for i, c in enumerate(codes)], "idx long, f0 string, f1 string").repartition(4), ("Code", "Title"))
    ref, cand = side(["A", "B", "B"]), side(["A"] * 9 + ["C"])
    m = written(matching.match(ref, cand, POLICY), "m")
    found = written(qa.findings(ref, cand, POLICY, m), "found")
    told = {r["id"]: json.loads(r["e"]) for r in qa.evidence(ref, cand, POLICY, m, qa.field_loss(matching.matched(m, ref, cand, POLICY), ref, cand, POLICY)).select("id", F.to_json("evidence").alias("e")).collect()}
    assert told.keys() <= {r["id"] for r in found.collect()}
    by = {(x.get("side"), x.get("keyValue"), x.get("status")): x for x in told.values()}
    assert by["candidate", '["A"]', None]["recordIndexes"] == [0, 1, 2] and by["candidate", '["A"]', None]["recordCount"] == 9
    a = by["candidate", None, "ambiguous_primary"]["ambiguity"]
    assert (a["candidateIndexes"], a["candidateCount"], a["referenceIndexes"], a["side"]) == ([0, 1, 2], 9, [0], "candidate")
    b = by["reference", None, "ambiguous_primary"]["ambiguity"]
    assert (b["referenceIndexes"], b["candidateCount"]) in (([1, 2], 0), ([0], 9))


def test_evidence_lists_are_whole_and_large_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(qa, "BESIDE", 20)
    side = lambda codes: Snapshot(spark.createDataFrame([(i, json.dumps(c), f'"{len(codes)} {i}"') for i, c in enumerate(codes)], "idx long, f0 string, f1 string").repartition(4), ("Code", "Title"))
    ref, cand = side(["A", "B"] + ["C"] * 130), side(["A"] * 120 + ["B", "D"])
    m = written(matching.match(ref, cand, POLICY), "m")
    told = [json.loads(r["e"]) for r in qa.evidence(ref, cand, POLICY, m, qa.field_loss_of(m, ref, cand, POLICY)).select(F.to_json("evidence").alias("e")).collect()]
    twice = {(x["side"], x["keyValue"]): (x["recordIndexes"], x["recordCount"]) for x in told if "keyDefinition" in x}
    assert twice == {("candidate", '["A"]'): ([*range(120)], 120), ("reference", '["C"]'): ([*range(2, 132)], 130)}
    bad = {(x["candidateIndex"], x["referenceIndex"]): x["ambiguity"] for x in told if "ambiguity" in x}
    want = [(r["candidate_idx"], r["reference_idx"]) for r in m.where("status like 'ambiguous%'").collect()]
    assert sorted(bad, key=str) == sorted(want, key=str) and len(want) >= 120
    for a in bad.values():
        held = {'["A"]': ([*range(120)], [0]), '["C"]': ([], [*range(2, 132)])}[a["keyValue"]]
        assert (a["candidateIndexes"], a["referenceIndexes"], a["candidateCount"], a["referenceCount"]) == (*held, *map(len, held))


def test_levels_of_nested_changes_are_not_copied_into_filters(spark):
    nest = lambda v: '{"a":{"b":{"c":{"d":' + str(v) + "}}}}"
    side = lambda v: Snapshot(spark.createDataFrame([(0, '"r"', nest(v))], "idx long, f0 string, f1 string"), ("Code", "F"), nested=True)
    diff = drift.changes(drift.compared(side(1), side(2), ("Code",), P.Quality()))
    assert diff.select("path", "before", "after").collect() == [("F.a.b.c.d", "1", "2")]
    assert diff._jdf.queryExecution().optimizedPlan().toString().count("from_json(MapType") == 2 * 4  # both sides once a level


def test_looking_ahead_is_a_running_value(spark):
    rows = spark.createDataFrame([("a", "1", "k", 1, False)], "id string, label string, key string, pending int, resolved boolean")
    plan = decisions.next_pending(rows)._jdf.queryExecution().executedPlan().toString()
    ranged = [p.split("unbounded")[1].split("$")[0] for p in plan.split("windowspecdefinition(part#")[1:] if p.split("RowFrame")[0].count("at#")]
    assert ranged and all(x.startswith("preceding") for x in ranged)  # a frame up to the end is walked anew for every row


def test_records_and_not_their_cells_are_joined(spark, sides):
    ref, cand = sides
    m = written(matching.match(ref, cand, POLICY), "m")
    prov = recovery.provenance(m, ref, cand, POLICY)
    rows = written(cells.records(ref, cand, ("Code",), POLICY, m, prov), "records")
    own = cells.classified(rows, ref, cand, POLICY, prov)
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for r in own.collect():
        want.setdefault(r["id"], []).append((r["field"], r["lane"], r["situation"]))
    sums = cells.record_sums(rows, ref, cand, POLICY, prov)
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    lane = lambda i, x: sorted(f for f, l, _ in want[i] if l == x)
    assert {r["id"]: (r["review_fields"], r["auto_fields"], r["ineligible"], r["unchanged"]) for r in sums.collect()} == {i: (lane(i, "review"), lane(i, "auto"), len(lane(i, "ineligible")), sum(l is None and s == "unchanged" for _, l, s in w)) for i, w in want.items()}
    told = {(r["id"], r["situation"]): r["cells"] for r in cells.situations(rows, ref, cand, "id").collect()}
    assert told == {(i, s): sum(x[2] == s for x in w) for i, w in want.items() for s in {x[2] for x in w}}


def test_dedupe_joins_only_excluded_records(spark, sides):
    ref, cand = sides
    m = written(matching.match(ref, cand, POLICY), "m")
    plan = recovery.dedupe(written(recovery.recover(m, ref, cand, POLICY), "rec"), cand, POLICY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # each participant meets the best of its key; participants are written once


def test_terms_of_long_fields_are_counted_in_their_row(spark):
    parts = {f: "" for f in search.FIELDS} | {"title": "b a " * 20 + "c"}
    docs = spark.createDataFrame([("1", "l", *parts.values())], "id string, label string, " + ", ".join(f"{f} string" for f in parts))
    found = search.postings(docs)
    assert sorted((r["term"], r["tf"], r["length"]) for r in found.collect()) == [("a", 20, 41), ("b", 20, 41), ("c", 1, 41)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_lists_of_an_index_are_made_without_a_shuffle(spark, tmp_path):
    texts = ["a-b\ta\r\nB", "x\u00a0Y\u2014z x", "$1,5 [k] \u0130", "", None] * 9
    parts = [{f: "" for f in search.FIELDS} | {"title": t, "qualityText": "same text, same"} for t in texts]
    docs = spark.createDataFrame([(str(i), f"l{i}", *p.values()) for i, p in enumerate(parts)], "id string, label string, " + ", ".join(f"{f} string" for f in parts[0]))
    assert "Exchange" not in search.lists(search._numbered(docs))._jdf.queryExecution().executedPlan().toString()
    index = search.build(docs, str(tmp_path / "i"))
    got = sorted((r["id"], r["field"], r["term"], r["tf"], r["length"]) for r in index.postings.collect())
    cut = [(r["id"], f, r[f]) for r in docs.select("id", *[search.terms_of(F.col(f)).alias(f) for f in search.FIELDS]).collect() for f in search.FIELDS]
    assert got == sorted((i, f, t, w.count(t), len(w)) for i, f, w in cut for t in set(w)) and index.lists.agg(F.sum("n")).first()[0] == len(got)
    assert {r["field"]: (r["records"], r["terms"]) for r in index.fields.collect()} == {f: (45, sum(len(w) for _, x, w in cut if x == f)) for f in search.FIELDS}
    rows = [r.asDict() for r in search.search(index, "same").collect()]
    assert [r["id"] for r in rows] == [str(i) for i in range(45)] and len({r["score"] for r in rows}) == 1  # ties in order of the key


def test_records_of_an_index_keep_marks_of_their_comparison(spark, sides, tmp_path):
    b, a = sides
    issues = written(drift.quality_issues(b, a, ("Code",), POLICY.quality), "issues")
    diff = drift.promoted(drift.compared(b, a, ("Code",), POLICY.quality, keep=True), issues, drift.duplicate_keys(b, a, ("Code",)))
    want = {r["id"] for r in views.filtered(diff, fields=("Title",), kinds=("emptied",)).collect()}
    docs = search.documents(diff.withColumn("lost", views.holds(fields=("Title",), kinds=("emptied",))), None, b, a, ("Code",), {"title": "Title", "status": "Status"}, issues, keep=("lost",))
    assert [p for p in docs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join FullOuter" in p].__len__() == 1  # both sides meet once
    index = search.build(docs, str(tmp_path / "i"))
    assert {r["id"] for r in index.records.where("lost").collect()} == want and want


def test_flags_tell_what_issues_need(spark, sides):
    b, a = sides
    fb, fa = (drift.flags(s, ("Code",), POLICY.quality) for s in (b, a))
    rows = lambda df: sorted(map(str, df.drop("baseline_types", "latest_types").collect()))
    assert rows(drift.field_stats(b, a, ("Code",), POLICY.quality)) == rows(drift.field_stats(fb, fa, ("Code",), POLICY.quality))
    assert rows(drift.duplicate_keys(b, a, ("Code",))) == rows(drift.duplicate_keys(fb, fa, ("Code",)))
    issues = drift.quality_issues(fb, fa, ("Code",), POLICY.quality, written(drift.field_stats(fb, fa, ("Code",), POLICY.quality), "stats"), related=False, repeated=written(drift.duplicate_keys(fb, fa, ("Code",)), "twice"))
    assert rows(issues) == rows(drift.quality_issues(b, a, ("Code",), POLICY.quality, related=False))


def test_each_csv_step_mentions_its_text_once_finished(spark):
    found = spark.createDataFrame([("=1+1", *["a,b"] * 8)], ", ".join(f"{c} string" for c in export.CSV_COLUMNS.values()))
    lines = export.csv_lines(found)
    assert lines.first()["value"] == ",".join(["'=1+1", *['"a,b"'] * 8])
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("[truncated") == len(export.CSV_COLUMNS)


def _coded(spark, rows):
    """Records of three nullable codes."""
    return Snapshot(spark.createDataFrame([(i, *[None if v is None else json.dumps(str(v)) for v in r]) for i, r in enumerate(rows)], "idx long, f0 string, f1 string, f2 string").repartition(3), ("x", "y", "z"))


def test_pairs_come_out_of_the_groups(spark, monkeypatch):
    rng = random.Random(13)
    made = lambda n: [[rng.choice([None, *range(m)]) for m in (60, 3, 20)] for _ in range(n)]
    ref, cand = made(40), made(40)
    policy = replace(POLICY, primary_key=("x",), fallback_keys=(("y", "z"), ("z",)))
    want, open_, claimed = [], list(range(40)), set()
    key = lambda r, f: None if any(r["xyz".index(c)] is None for c in f) else json.dumps([str(r["xyz".index(c)]) for c in f], separators=(",", ":"))
    for n, f in enumerate(("x", "yz", "z")):
        kind, of, left, taken = ("fallback" if n else "primary"), {}, [], set(claimed)
        for i in open_:
            of.setdefault(key(cand[i], f), []).append(i)
        for i in open_:
            k = key(cand[i], f)
            refs = [j for j in range(40) if k is not None and key(ref[j], f) == k]
            if k is None:
                want.append(("invalid_identity", i, None, None, None, None, n)) if not n else left.append(i)
            elif len(of[k]) > 1 or len(refs) > 1:
                want.append((f"ambiguous_{kind}", i, None, k, None, None, n))
            elif refs and refs[0] not in taken:
                want.append((f"matched_{kind}", i, refs[0], k, k, kind, n))
                claimed.add(refs[0])
            else:
                left.append(i)
        open_ = left
    want += [("candidate_only", i, None, key(cand[i], "x"), None, None, 0) for i in open_]
    for j in set(range(40)) - claimed:
        k = key(ref[j], "x")
        many = k is not None and (sum(key(r, "x") == k for r in ref) > 1 or sum(key(c, "x") == k for c in cand) > 1)
        want.append(("invalid_identity" if k is None else "ambiguous_primary" if many else "reference_only", None, j, None, k, None, 0))
    names = []
    monkeypatch.setattr(matching, "written", lambda df, name: names.append((name, df.columns)) or written(df, name))
    a, b = _coded(spark, ref), _coded(spark, cand)
    m = written(matching.match(a, b, policy), "m")
    assert sorted(map(str, map(tuple, m.collect()))) == sorted(map(str, want)) and {w[0] for w in want} == set(matching.STATUSES)
    assert ("groups-0", ["k", "ref_n", "ref_at", "cand_n", "cand_at"]) in names  # a row a key, not a row a record
    monkeypatch.setattr(matching, "WIDE", 4)
    pairs = matching.matched(m, a, b, policy)
    assert pairs.rdd.getNumPartitions() == -(-m.count() // 4)  # tasks grow in number, not in size
    assert {(r["candidate_idx"], r["reference_idx"], r["status"], r["method"], r["reference_key"]) for r in pairs.collect()} == {(w[1], w[2], w[0], w[5], w[4]) for w in want if w[5]}


def test_losses_need_no_records_of_pairs(spark):
    names = tuple(f"n{i:02}" for i in range(65))  # more than one long holds
    side = lambda seed: Snapshot(spark.createDataFrame([(i, json.dumps(str(i)), *[random.Random(seed * 9 + i * 71 + j).choice(['"v"', '""', None]) for j in range(65)]) for i in range(20)], "idx long, k string, " + ", ".join(f"{n} string" for n in names)).toDF("idx", *[f"f{i}" for i in range(66)]), ("key", *names))
    policy = replace(POLICY, primary_key=("key",), fallback_keys=(), excluded=("n03",))
    ref, cand = side(1), side(2)
    m = written(matching.match(ref, cand, policy), "m")
    want = {tuple(r) for r in qa.field_loss(matching.matched(m, ref, cand, policy), ref, cand, policy).collect()}
    assert {tuple(r) for r in qa.field_loss_of(m, ref, cand, policy).collect()} == want and len(want) == 65 and any(l for _, _, l in want)
    r = catalog.Review(spark, "/root/testdata/sf0.001")
    assert r.loss.count() == 8 and "matched" not in r.__dict__


def test_plain_document_lists_are_parsed_once(spark, monkeypatch):
    texts = [
        '[{"Title":" a ","URL":"u","Hash":"H"},{"title":"\\u00a0","url":null,"hash":"H\\u3000"},{}]', '[{"title":"b","Title":"a"},{"HASH":"1","Hash":"2","hash":"3"}]', '[{"Title":1.50,"URL":true,"Hash":[1, 2]}]',
        '[{"Title":"x"},7,"t",null,[{"Title":"y"}]]', '[{"Title":"say \\"q\\": {1}","URL":"http://x/y","Hash":"é"}]', '"[{\\"Title\\":\\"in a text\\",\\"Hash\\":\\"\\"}]"', '{"Title":"x"}', "[]", "nope", "", None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(documents.normalised(F.col("t")).alias("d"), documents._plain(documents.decoded(F.col("t"))).isNotNull().alias("plain")).collect()
    assert [r["plain"] for r in got] == [True, False, False, False, False, True, False, True, False, False, False]
    monkeypatch.setattr(documents, "_plain", lambda text: F.lit(None).cast(documents.DOCUMENTS))
    assert [r["d"] for r in got] == [r["d"] for r in rows.select(documents.normalised(F.col("t")).alias("d")).collect()]
    docs = F.from_json(F.lit('[{"title":"1","hash":"b"},{"title":"2","hash":"a"},{"title":"3"},{"title":"4","hash":"b"}]'), documents.DOCUMENTS)
    assert {k: v["title"] for k, v in one(spark, documents._by_hash(docs)).items()} == {"b": "4", "a": "2"}
    plan = catalog._document_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # narrow rows move once


OVERRIDES = [('["A-1"]', "Title", '"T2"', 3), ('["A-1"]', "Title", '"T1"', 1), ('["A-1"]', "Extra", "5", 2), ('["C-3"]', "Status", '"Open"', 4), ('["D-4"]', "Title", '"ambiguous"', 5), ('["Z"]', "Title", '"unknown"', 6)]


def test_events_and_outcomes_of_cells(spark, sides):
    ref, cand = sides
    m = written(matching.match(ref, cand, POLICY), "m")
    over = spark.createDataFrame([(k, f, v, "why", n) for k, f, v, n in OVERRIDES], "key string, field string, value string, reason string, ord long")
    fills = {("Title", '"   "', '"Main"'), ("Status", "null", '"Open"')}
    told = recovery.events(m, ref, cand, over, POLICY).collect()
    assert {(r["key"], r["candidate_idx"], r["field"], r["original"], r["output"], r["ord"]) for r in told} == {('["A-1"]', 0, *x, -1) for x in fills} | {
        ('["A-1"]', 0, "Title", '"Main"', '"T1"', 1), ('["A-1"]', 0, "Title", '"T1"', '"T2"', 3), ('["A-1"]', 0, "Extra", "null", "5", 2), ('["C-3"]', 1, "Status", '"n/a"', '"Open"', 4),
    }
    assert len(told) == 6 and {(r["source"], r["actor"], r["reason"]) for r in told} == {("reference_backfill", "auto", None), ("manual_override", "user", "why")}
    ends = recovery.outcomes(m, ref, cand, over, POLICY).collect()
    assert sorted((r["candidate_idx"], r["field"], r["original"], r["output"], r["source"], r["events"]) for r in ends) == [
        (0, "Extra", "null", "5", "manual_override", 1), (0, "Status", "null", '"Open"', "reference_backfill", 1), (0, "Title", '"   "', '"T2"', "manual_override", 3), (1, "Status", '"n/a"', '"Open"', "manual_override", 1),
    ]
    strict = replace(POLICY, candidate_only="exclude", safe_backfill=())
    assert {(r["candidate_idx"], r["field"], r["original"], r["events"]) for r in recovery.outcomes(m, ref, cand, over, strict).collect()} == {(0, "Title", '"   "', 2), (0, "Extra", "null", 1)}
    assert {(r["candidate_idx"], r["field"]) for r in recovery.events(m, ref, cand, over, strict).collect()} == {(0, "Title"), (0, "Extra")}


def test_cell_outcomes_group_and_sort_no_cells(spark):
    """Neither records nor their cells are grouped; what a record lacks is not worked out, as its match status decides."""
    plan = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    ends, told = plan("cell_outcomes"), plan("override_events")
    assert "Window" not in ends and "Aggregate [key" in ends and "candidate_idx" not in "".join(x for x in ends.split("\n") if "Aggregate" in x)
    assert "windowspecdefinition(key" in told and "windowspecdefinition(candidate_idx" not in told and "ambiguous_identity" not in ends + told
