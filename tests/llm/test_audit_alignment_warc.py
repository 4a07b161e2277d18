"""Filter audit, token alignment and WARC archives against plain readings."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, queries, token_alignment, warc
from tidemark.llm.common import shared_folder

from .conftest import BASE, LONG, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONGER = prose(250, 9)
ROWS = [
    (1, LONGER, "a"), (2, LONGER, "b"), (3, None, None), (4, "", ""), (5, "SHOUTING TEXT " * 120, "a"), (6, prose(210, 4) + " #", "a"), (7, prose(10, 5), "b"),
    (8, LONGER, "a"), (8, LONGER, "a"), (8, BASE, "b"), (None, LONGER, "a"), (None, None, "b"), (None, "alone without id", "a"), (9, LONG, "b"), (10, "Ünïcode 日本語 🙂 " * 80, "a"), (12, "x y\x1cz\x0bw", "b"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (7, 0, 1), (8, 1, 0), (None, 1, 1), (99, 1, 1), (10, None, 1)]


def brute_audit(rows, labels):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    parts = defaultdict(list)
    for d, t, part in rows:
        t = t or ""
        w = WORDS.findall(t)
        first = least.get(t)
        told = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": first is not None and (d is None or first < d)}
        parts[part or ""].append((frozenset(f for f in told if told[f]), d in good and d is not None, d in toxic and d is not None))
    out = set()
    for part, docs in parts.items():
        steps = []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                steps.append((part, "".join(order), step, len(left), len(gone), sum(f in x[0] for x in docs) - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        share = Counter()
        for s in steps:
            share[s[1][s[2] - 1]] += s[4]
        out |= {(*s, share[s[1][s[2] - 1]]) for s in steps}
    return out


@pytest.mark.parametrize("block_ids", [3, 65_536])
def test_audit_equals_brute_force(spark, block_ids):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 as fails", "2 as digest", "3 as t", "'c' as part")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.apply(docs.repartition(3), labels, block_ids=block_ids)
    assert {tuple(r) for r in got.collect()} == brute_audit(ROWS, LABELS) and got.count() == 3 * 600
    assert filter_audit.apply(docs.limit(0), labels).count() == 0


def test_galloping():
    rng = np.random.default_rng(1)
    for n, m in [(0, 5), (5, 0), (1, 1000), (1000, 1), (300, 200)]:
        a, b = (np.unique(rng.integers(0, 1500, k)) for k in (n, m))
        assert a[filter_audit.absent(a, b)].tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert filter_audit.union([a, b, a[:7]]).tolist() == sorted(set(a.tolist()) | set(b.tolist()))


# ---- alignment -----------------------------------------------------------------------

ALIGNED = [(1, BASE), (2, BASE), (2, BASE), (3, None), (4, ""), (5, "<|endoftext|> a</s> b"), (6, "▁mark"), (7, "日本語 🙂  two  blanks\ttab\n"), (None, prose(40, 3)), (8, prose(400, 8)), (9, " "), (10, "a"), (11, LONG)]


def brute_alignment(rows):
    tokenizers, sentencepiece, public = (pytest.importorskip(m) for m in ("tokenizers", "sentencepiece", "public_tokenizers"))
    from tidemark.llm.bpe import byte_characters

    ta = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    of = byte_characters()

    def of_b(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    cells, total = [], Counter()
    for d, t in rows:
        a, b = (ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)) if t else ([], [])
        xa, xb = [bytes(of[c] for c in ta.id_to_token(i)) for i in a], [of_b(i) for i in b]
        if not t or b"".join(xa) != (" " + t).encode() or b"".join(xb) != (" " + t).encode():
            a, b, xa, xb = [], [], [], []
        ca, cb = np.cumsum([0] + [len(x) for x in xa]).tolist(), np.cumsum([0] + [len(x) for x in xb]).tolist()
        links, groups, i, j = [], [[[], []]], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            ends = ca[i + 1], cb[j + 1]
            if ends[0] <= ends[1]:
                groups[-1][0].append(a[i])
                i += 1
            if ends[1] <= ends[0]:
                groups[-1][1].append(b[j])
                j += 1
            if ends[0] == ends[1]:
                groups.append([[], []])
        total.update(links)
        cells.append((d, len(a), len(b), len(groups) - 1, links, ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups[:-1])))
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((d, na, nb, ng, len(x), sum(total[p] == most[p[1]] for p in x), sum(total[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, na, nb, ng, x, g in cells), key=repr)


@pytest.mark.parametrize("most_pairs", [token_alignment.PAIRS, 10])
def test_alignment_equals_brute_force(spark, most_pairs):
    public = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame(ALIGNED, "doc_id long, text string").selectExpr("*", "1 as t", "2 as digest", "3 as n", "4 as pairs")
    paths = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
    got = token_alignment.apply(docs.repartition(3), *paths, most_pairs=most_pairs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_alignment(ALIGNED)
    if most_pairs == 10:
        assert token_alignment.apply(docs.limit(0), *paths).count() == 0


# ---- archives ------------------------------------------------------------------------

SAME = "<p>" + "same " * 40
PAGES = [
    (5, "http://a.example/5", SAME), (3, "http://a.example/3", SAME), (9, None, SAME), (9, "http://b.example/9", SAME), (7, "http://a.example/x y\r\nz", "short"), (8, "http://a.example/8", "short"), (1, "u", None), (2, "", ""),
    (None, "http://a.example/none", SAME), (None, "n", "only without id " * 20), (None, "m", "only without id " * 20), (20, "http://c.example", "日本語 🙂 " * 30), (21, "v", LONG * 2), (4, "w", "\r\n\r\nWARC/1.1\r\n" * 20),
]


def brute_pages(rows):
    groups = defaultdict(list)
    for i, (d, u, t) in enumerate(rows):
        groups[t or ""].append((d is None, d or 0, u is not None, u or "", i))
    out = []
    for t, own in groups.items():
        own.sort()
        first = rows[own[0][-1]][0]
        for n, x in enumerate(own):
            again = n > 0 and len(t.encode()) >= 100
            out.append((rows[x[-1]][0], len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as shard", "2 as payload", "3 as digest", "4 as first", "5 as bounds")


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 500, "roll_bytes": 400}])
def test_archive_equals_brute_force(spark, pages, how):
    got = warc.apply(pages.repartition(3), **how).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_pages(PAGES)
    assert warc.apply(pages.limit(0), **how).count() == 0


def _folder(spark, name):
    return Path(shared_folder(spark).removeprefix("file:")) / name


def test_archives_are_deterministic_and_round_trip(spark, pages, monkeypatch):
    kept = []
    for name, df in (("warc-one", pages.repartition(5)), ("warc-two", pages.orderBy(F.rand(3)).coalesce(1))):
        at = _folder(spark, name)
        warc.write(df, str(at), shard_bytes=500, roll_bytes=900)
        kept.append({f.name: f.read_bytes() for f in at.iterdir()})
        assert not (at / warc.TEMPORARY).exists()
    assert kept[0] == kept[1] and len(kept[0]) > 3
    listed = json.loads(kept[0][warc.MANIFEST])["files"]
    assert {f["name"] for f in listed} == kept[0].keys() - {warc.MANIFEST}
    for f in listed:
        data = kept[0][f["name"]]
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and len(data) == f["bytes"] and (f["records"] == 1 or len(data) <= 900)
    texts = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read(spark, str(_folder(spark, "warc-one"))).where("record_type = 'response'").collect()}
    first = {}
    for d, _, t in sorted(PAGES, key=lambda r: (r[0] is None, r[0] or 0)):
        if len((t or "").encode()) < 100 or t not in first:
            first[t] = texts >= {(None if d is None else str(d), t or "")}
    assert all(first.values())


def test_files_outside_the_manifest_are_not_read_and_corruption_raises(spark, pages):
    at = _folder(spark, "warc-three")
    warc.write(pages, str(at))
    n = warc.read(spark, str(at)).count()
    (at / "00099-00000.warc.gz").write_bytes(b"left behind")
    assert warc.read(spark, str(at)).count() == n == len(PAGES)
    victim = next(f for f in at.iterdir() if f.name == "00000-00000.warc.gz")
    parts, data = [], victim.read_bytes()
    while data:
        one = zlib.decompressobj(31)
        parts.append(one.decompress(data))
        data = one.unused_data
    spoilt = [p.replace(b"short", b"shirt") for p in parts]
    packed = b""
    for p in spoilt:
        out = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed += out.compress(p) + out.flush()
    victim.write_bytes(packed)
    lines = json.loads((at / warc.MANIFEST).read_text())
    next(f for f in lines["files"] if f["name"] == victim.name)["bytes"] = len(packed)
    (at / warc.MANIFEST).write_text(json.dumps(lines))
    with pytest.raises(Exception, match="digest mismatch"):
        warc.read(spark, str(at)).collect()


def test_stretches_of_one_file_feed_many_tasks(spark, pages, monkeypatch):
    at = _folder(spark, "warc-four")
    monkeypatch.setattr(warc, "SPLIT_BYTES", 700)
    out = warc._Roller(str(at), "x", 1 << 30, 6)
    for i in range(60):
        out.add(0, str(i), warc.page_record(str(i), None, prose(60, i).encode(), hashlib.sha256(prose(60, i).encode()).hexdigest(), 0, None, 6))
    out.close()
    writer = warc._Writer({"path": str(at)})
    writer.commit([warc._Written("x", out.files), None])
    reader = warc._Reader({"path": str(at)})
    stretches = reader.partitions()
    assert len(stretches) > 5 and sorted(int(x) for s in stretches for b in reader.read(s) for x in b["page_id"].to_pylist()) == list(range(60))


# ---- queries -------------------------------------------------------------------------


def test_queries(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    at = str(tmp_path)
    audit = queries.op11_filter_audit(spark, at)
    assert {tuple(r) for r in audit.collect()} == brute_audit(ROWS, LABELS) and dict(audit.dtypes)["step"] == "int"
    assert sorted((tuple(r) for r in queries.op13_warc(spark, at).collect()), key=repr) == brute_pages(PAGES)
    pairs = [(d, t) for d, t, _ in ROWS]
    assert sorted((tuple(r) for r in queries.op12_token_alignment(spark, at).collect()), key=repr) == brute_alignment(pairs)
