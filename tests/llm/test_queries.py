"""Each opN query on small tables: every column of its contract against a plain reading."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import pytest

from tidemark.llm import queries, secret_scan

from .conftest import TEXTS, prose
from .test_operators import NORMAL, WORD, brute_components, counted, low, placed

ITEMS = [("7", " ".join(TEXTS[6].split()[5:25])), ("10", "x y z"), ("9", "absent words only here"), ("8", None)]
URLS = [("http://www.example.org/en/2#x", "org/"), ("https://a.example.org/es/x", "example.org/es/"), ("http://EXAMPLE.org/en/1?q", "example.org/en/1"), ("http://b.com/de/", "com/de/"), ("http://b.com/fr/1", "com/fr/"), ("http://b.net/", None), (None, None), ("no scheme", None)]


@pytest.fixture(scope="module")
def pairs():
    good = [(1000 + i, prose(60 + i, 300 + i)) for i in range(30)]
    bad = [(2000 + i, "### buy now " * 30) for i in range(10)]
    return list(enumerate(TEXTS)) + good + bad


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, pairs):
    at = str(tmp_path_factory.mktemp("tables"))
    documents = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, int(d < 2000), 0) for d, _ in pairs if d >= 1000], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, u, "") for i, (u, _) in enumerate(URLS)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


def held(spark, folder, query, *columns):
    return {r[0]: tuple(r)[1:] for r in query(spark, folder).select("doc_id", *columns).collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark, folder, pairs):
    got = held(spark, folder, queries.op1_quality_rules, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, t in pairs:
        facts = counted(t or "")
        failed = facts[0] < 50 or 100 * facts[4] > 50 * facts[0]
        assert got[d][:6] == (*facts, failed) and not (failed and got[d][6])
    assert len(got) == len(pairs) and any(g[6] for g in got.values())


def test_op2_and_op7(spark, folder, pairs):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    counts = held(spark, folder, queries.op2_token_counts, "n_bytes", "n_tokens", "over_limit")
    codes = held(spark, folder, queries.op7_bpe_codec, "n_tokens", "ids_sha256", "decoded_sha256")
    for d, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert counts[d] == (len((t or "").encode()), len(ids), len(ids) > 1024)
        assert codes[d] == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False)))


def test_op3(spark, folder, pairs):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    kinds = [("assign", assign, lambda m: len(m[2]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    got = held(spark, folder, queries.op3_secret_scan, "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for d, t in pairs:
        found = sorted((m.start(), n, m.end()) for n, (_, p, fits) in enumerate(kinds) for m in p.finditer(t or "") if fits(m))
        named = [f"{kinds[n][0]}:{s}:{e}" for s, n, e in found]
        assert got[d][:4] == (*[sum(x[1] == n for x in found) for n in range(3)], sha(",".join(named)))
        assert set(named) <= set(got[d][4].split(",")) | {""}
    assert len(secret_scan.MORE_RULES) > 0


def test_op4(spark, folder, pairs):
    got = held(spark, folder, queries.op4_license_scan, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for d, t in pairs:
        n, hits = placed(t or "")
        starts = [i for i, _ in hits]
        assert got[d][:5] == (n, len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))
        assert set(got[d][4].split(",")) <= set(got[d][5].split(",")) | {""} and 0 <= got[d][6] <= 1


def test_op5(spark, folder, pairs):
    got = held(spark, folder, queries.op5_jaccard_join, "n_shingles", "component_id")
    assert sorted(((d, *v) for d, v in got.items()), key=repr) == brute_components(pairs)


def test_op6(spark, folder):
    rows = {r["page_id"]: r for r in queries.op6_url_filter(spark, folder).collect()}
    for i, (url, rule) in enumerate(URLS):
        assert rows[i]["rule"] == rule and rows[i]["verdict"] in ("allow", "block")
        if rule:
            assert rows[i]["verdict"] == {h + p: v for v, h, p in queries.URL_RULES}[rule] if "/" in rule[:-1] else rows[i]["verdict"] == "allow"
    assert (rows[2]["host"], rows[2]["path"]) == ("example.org", "/en/1") and (rows[6]["host"], rows[6]["path"]) == ("", "")


def test_op8(spark, folder, pairs):
    got = held(spark, folder, queries.op8_quality_mil, "held_out", "score", "predicted")
    for d, _ in pairs:
        out, score, predicted = got[d]
        assert out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == int(score >= 0.3)
    apart = [(got[d][1], d < 2000) for d, _ in pairs if d >= 1000 and got[d][0]]
    assert min(s for s, good in apart if good) > max(s for s, good in apart if not good)


def test_op9(spark, folder, pairs):
    windows = {}
    for item, t in ITEMS:
        w = NORMAL.findall(low(t))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    got = held(spark, folder, queries.op9_decontamination, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for d, t in pairs:
        w, hit, items = NORMAL.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[x]
        assert got[d] == (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))


def test_op10(spark, folder, pairs):
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in pairs}
    tokens = {d: [*WORD.findall(low(t)), None] for d, t in pairs}
    single = Counter(w for d, t in tokens.items() if not out[d] for w in t)
    n, v = sum(single.values()), len(single)
    got = held(spark, folder, queries.op10_ngram_lm, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for d, t in tokens.items():
        base = sum(math.log10((single[w] + 1) / (n + v + 1)) for w in t)
        assert got[d][:4] == (out[d], len(t), sum(single[w] > 0 for w in t), n)
        assert got[d][4] == pytest.approx(base, rel=1e-9)
        assert got[d][5] < 0


def test_queries_have_the_columns(spark, folder):
    for name, query in queries.queries().items():
        columns = query(spark, folder).columns
        assert len(columns) == len(set(columns)), name
