"""Each operator against a brute-force reading, over null, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec, decontaminate, jaccard_join, license_scan, ngram_lm, quality_mil, quality_rules, queries, secret_scan, token_counts, url_filter
from tidemark.llm.components import components
from tidemark.llm.rolling import Words

from .conftest import TEXTS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if c < "\x80" else c for c in t or "")


def rows(df, *cols):
    return sorted(((r["doc_id"], *(r[c] for c in cols)) for r in df.collect()), key=repr)


def same(df, texts, expected, *cols):
    assert rows(df, *cols) == sorted(((d, *expected(t or "")) for d, t in texts), key=repr)


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary_path())


def counted(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_rules(docs, texts, no_docs):
    same(quality_rules.apply(docs), texts, counted, *COUNTS)
    assert quality_rules.apply(no_docs).count() == 0


def test_quality_model_prefers_good():
    m = quality_rules.fit([((1, 1, 1), 900), ((-1, 1, 1), 50), ((1, -1, 1), 50), ((-1, -1, 1), 60), ((-1, -1, -1), 20), ((-1, 1, -1), 10)], 3)  # bad votes that meet tell of bad texts
    odds = lambda v: math.log(m.prior / (1 - m.prior)) + sum(m.weight(j, x) for j, x in enumerate(v))
    assert odds((1, 1, 1)) > 0 > odds((-1, -1, 1)) and odds((0, 0, 0)) == pytest.approx(math.log(m.prior / (1 - m.prior)))


def voted(n, good, blames, catches, seed, copies=()):
    """Simulated votes: true classes, votes, and whether a judge who knows all rates finds the class good."""
    r = np.random.default_rng(seed)
    truth, g, b = r.random(n) < good, np.array(blames), np.array(catches)
    votes = np.where(r.random((n, len(g))) < np.where(truth[:, None], g, b), -1, 1)
    votes[r.random(votes.shape) < 0.1] = 0
    for i, j in copies:
        votes[:, i] = votes[:, j]
    own = [j for j in range(len(g)) if j not in {i for i, _ in copies}]
    log = lambda rate: (np.where(votes < 0, np.log(rate), 0) + np.where(votes > 0, np.log1p(-rate), 0))[:, own].sum(axis=1)
    return truth, votes, np.log(good) + log(g) > np.log(1 - good) + log(b)


def fitted(votes):
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = quality_rules.fit([(tuple(map(int, p)), int(c)) for p, c in zip(patterns, counts)], votes.shape[1])
    like = [math.log(share) + sum(np.where(votes[:, j] > 0, m.power[j] * math.log1p(-r), np.where(votes[:, j] < 0, m.power[j] * math.log(r), 0)) for j, r in enumerate(rates)) for share, rates in zip(m.shares, m.rates)]
    return m, np.exp(like[0]) >= sum(map(np.exp, like[1:]))


@pytest.mark.parametrize("good, blames, catches", [(0.8, [0.05] * 6, [0.6] * 6), (0.8, [0.1] * 6, [0.7] * 6), (0.7, [0.2] * 6, [0.8] * 6), (0.8, [0.05] * 5 + [0.4], [0.6] * 6), (0.9, [0.02, 0.05, 0.1, 0.01, 0.05, 0.33], [0.3, 0.5, 0.6, 0.4, 0.2, 0.5])])
def test_quality_model_finds_the_rates(good, blames, catches):
    truth, votes, best = voted(100_000, good, blames, catches, 1)
    m, found = fitted(votes)
    assert m.prior == pytest.approx(good, abs=0.05) and len(m.shares) == 2 and m.rates[0] == pytest.approx(blames, abs=0.05) and m.rates[1] == pytest.approx(catches, abs=0.05)
    assert (found == truth).mean() > (best == truth).mean() - 0.02 and set(m.power) == {1.0}
    lone = ((votes < 0).sum(axis=1) == 1) & ((votes > 0).sum(axis=1) == 5)
    assert found[lone].mean() > 0.9  # one bad vote among good ones does not end a text


def test_quality_model_counts_copies_of_a_rule_once():
    truth, votes, best = voted(100_000, 0.8, [0.1] * 7, [0.6] * 7, 2, copies=[(5, 4), (6, 4)])
    m, found = fitted(votes)
    assert m.power == pytest.approx([1, 1, 1, 1, 1 / 3, 1 / 3, 1 / 3]) and (found == truth).mean() > (best == truth).mean() - 0.02


def test_quality_model_finds_kinds_of_bad_texts():
    kinds = ([0.04] * 6, [0.7, 0.7, 0.7, 0.04, 0.04, 0.04], [0.04, 0.04, 0.04, 0.7, 0.7, 0.7])
    r = np.random.default_rng(5)
    truth = r.choice(3, 100_000, p=(0.8, 0.12, 0.08))
    votes = np.where(r.random((100_000, 6)) < np.array(kinds)[truth], -1, 1)
    like = [math.log(share) + (np.where(votes < 0, np.log(k), 0) + np.where(votes > 0, np.log1p(-np.array(k)), 0)).sum(axis=1) for share, k in zip((0.8, 0.12, 0.08), kinds)]
    best = np.exp(like[0]) >= np.exp(like[1]) + np.exp(like[2])
    m, found = fitted(votes)
    assert len(m.shares) == 3 and m.shares == pytest.approx((0.8, 0.12, 0.08), abs=0.05) and m.rates[0] == pytest.approx(kinds[0], abs=0.05)
    assert (found == (truth == 0)).mean() > (best == (truth == 0)).mean() - 0.02


def test_quality_posterior_in_sql_equals_the_model(spark):
    _, votes, _ = voted(2000, 0.8, [0.05] * 4, [0.6] * 4, 3)
    m, found = fitted(votes)
    rows = spark.createDataFrame([tuple(map(int, v)) for v in votes], "a int, b int, c int, d int")
    assert [r[0] >= 0.5 for r in rows.select(quality_rules.posterior([F.col(c) for c in "abcd"], m)).collect()] == found.tolist()


def test_quality_rules_keep_clashing_columns(docs):
    out = quality_rules.apply(docs, keep=("doc_id", "n_words", "quality", "score") if "quality" in docs.columns else ("doc_id", "n_words", "score"))
    assert out.columns.count("n_words") == 1 and "score" in out.columns


def test_token_counts(docs, texts, no_docs, tokenizer):
    path = queries.vocabulary_path()
    same(token_counts.apply(docs, path), texts, lambda t: (len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)), "n_bytes", "n_tokens")
    assert token_counts.apply(no_docs, path).count() == 0


def test_whole_tokens_are_proven():
    v = token_counts.Vocabulary(queries.vocabulary_path())
    whole = token_counts.whole_tokens(queries.vocabulary_path())
    assert " the" in whole and all(len(v.merge(s.encode())) == 1 for s in random.Random(1).sample(sorted(whole - v.added.keys()), 500))


def test_bpe_round_trip(docs, texts, no_docs, tokenizer):
    path = queries.vocabulary_path()
    coded = bpe_codec.decode(bpe_codec.encode(docs.select("doc_id", "text"), path), path).select("doc_id", F.hex("ids").alias("h"), "decoded")
    ids = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
    same(coded, texts, lambda t: (ids(t).tobytes().hex().upper(), tokenizer.decode(ids(t).tolist(), skip_special_tokens=False)), "h", "decoded")
    assert bpe_codec.encode(no_docs, path).count() == 0


def test_backtracking_equals_merging():
    c = bpe_codec.codec(queries.vocabulary_path())
    r = random.Random(4)
    for _ in range(3000):
        piece = bytes(r.choice(b"abcdehinorst e\xc3\xa9\xe6") for _ in range(r.randint(1, 40)))
        assert c.encode_piece(piece) == c._v.merge(piece)
    long = bytes(r.choice(b"ab") for _ in range(3000))
    assert c.encode_piece(long) == c._v.merge(long) and c._v.merge(b"ab" * 40) == c._v._merge_long(list(b"ab" * 40))


def test_secret_scan(docs, texts, no_docs):
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    found = secret_scan.apply(docs, rules)
    same(found.withColumn("s", F.transform("spans", lambda s: F.array(s["start"], s["kind"], s["end"]))), texts, lambda t: ([list(x) for x in secret_scan.python_matches(t, rules)],), "s")
    assert secret_scan.apply(no_docs, rules).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "x password=abcdef0123456789abcdef0123 y"), (2, "clean")], "doc_id long, text string")
    out = {r["doc_id"]: r["t"] for r in secret_scan.apply(df).select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {1: "x [SECRET] y", 2: "clean"}


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token={i:06d} é{'ab' * (i % 3)}" for i in range(700)) + " end"
    got = secret_scan.apply(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("spans", secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).first()
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    assert [(s["start"], s["kind"], s["end"]) for s in got["spans"]] == secret_scan.python_matches(text, rules) and len(got["spans"]) >= 700
    assert got["t"] == re.sub(r"token=\d{6}", "[SECRET]", text)


@pytest.mark.parametrize("rule", secret_scan.BASE_RULES + secret_scan.MORE_RULES)
def test_trigram_queries_are_necessary(rule):
    query = secret_scan.trigram_query(rule.pattern)
    samples = ["password = x1y2z3", "PassWd:abc", "api_key=1", "apikey='q", "Secret=z", "token: t", "AKIAXYZ1", "ghp_" + "a" * 40, "xoxb-" + "1" * 12, "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10]
    for s in samples:
        if re.search(rule.pattern, s) and query:
            assert any(all(t in s.lower() for t in c) for c in query)
    assert bool(query) == (rule.kind != "hex")


def placed(t):
    w = NORMAL.findall(low(t))
    hits = [(i, x.label) for x in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(x.text.split())] == x.text.split()]
    return len(w), sorted(hits)


def test_license_scan(docs, texts, no_docs):
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["exact"]), lambda s: F.struct(s["first_word"], s["label"])))
    got = license_scan.apply(docs).withColumn("b", base)
    same(got.withColumn("b", F.transform("b", lambda s: F.concat_ws(":", s["first_word"], s["label"]))), texts, lambda t: (placed(t)[0], [f"{i}:{x}" for i, x in placed(t)[1]]), "n_words", "b")
    assert license_scan.apply(no_docs).count() == 0


def test_license_edits_stay_on_neighbouring_diagonals(spark):
    text = "intro words redistribution and use in source and binary forms with or without any modification are permitted provided that the following conditions are met"
    spans = license_scan.apply(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [s["label"] for s in spans] == ["bsd"] and spans[0]["first_word"] == 2 and 0.7 <= spans[0]["coverage"] < 1


def labels_of(spark, text):
    return [s["label"] for s in license_scan.apply(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"] if not s["exact"]]


def test_license_words_in_another_order_are_no_copy(spark):
    assert labels_of(spark, "license version apache license the apache under the licensed under") == []
    long = next(t for t in license_scan.STATEMENTS if t.label == "isc").text.split()
    assert labels_of(spark, " ".join(long)) == ["isc"]
    assert labels_of(spark, " ".join(long[i] for at in range(0, len(long), 4) for i in reversed(range(at, min(at + 4, len(long)))))) == []
    assert labels_of(spark, " ".join(long[len(long) // 2 :] + ["word"] * 9 + long[: len(long) // 2])) == []
    edited = [w for i, w in enumerate(long) if i % 40 != 7]
    edited[20:20] = ["new", "words"]
    assert labels_of(spark, "before " + " ".join(edited) + " after") == ["isc"]


def brute_chain(votes, shift):
    """Worth of the best chain, over all predecessors of every vote."""
    order, worth = sorted(set(votes)), {}
    for x, y in order:
        price = lambda v, w: 0 if abs((x - y) - (v - w)) <= shift else license_scan.JUMP + license_scan.PASSED * (x - v - 1)  # noqa: B023, E731
        worth[x, y] = 1 + max([worth[v, w] - price(v, w) for v, w in order if v < x and w < y], default=0)
        worth[x, y] = max(worth[x, y], 1)
    return worth


def test_license_chains_equal_brute_force():
    r = random.Random(6)
    for _ in range(400):
        votes = [(r.randint(0, 30), r.randint(0, 12)) for _ in range(r.randint(0, 40))]
        shift = r.randint(0, 3)
        got, best = license_scan.chains(votes, shift, 1), brute_chain(votes, shift)
        assert bool(got) == bool(votes)
        if votes:
            n, lo, hi = got[0]
            top = max(best.values())
            assert n >= top - 1e-9 and any(x == hi and abs(w - top) < 1e-9 for (x, _), w in best.items())
            assert all(a[2] < b[1] or b[2] < a[1] for i, a in enumerate(got) for b in got[:i])


def test_license_texts_survive_edits(spark):
    mit = max((t for t in license_scan.STATEMENTS if t.label == "mit"), key=lambda t: len(t.text)).text.split()
    found = lambda words: [s for s in license_scan.apply(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()["spans"] if s["label"] == "mit"]
    half = len(mit) // 2
    for n in (6, 10, 30):
        spans = found(["before", *mit[:half], *[f"new{i}" for i in range(n)], *mit[half:], "after"])
        whole = max(spans, key=lambda s: s["last_word"])  # a short statement inside has a span of its own
        assert whole["coverage"] > 0.9 and (whole["first_word"], whole["last_word"]) == (1, len(mit) + n)
    cut = max(found(mit[: half - 12] + mit[half:]), key=lambda s: s["last_word"])
    assert 0.7 < cut["coverage"] < 0.97 and cut["last_word"] == len(mit) - 13
    assert all(s["last_word"] - s["first_word"] < half for s in found(mit[half:] + mit[:half])) and found(mit[::-1]) == []


def test_license_chains_take_many_votes():
    votes = [(x, (x * 7 + y) % 170) for x in range(60_000) for y in (0, 40, 90)]
    began = time.process_time()
    license_scan.chains(votes, 3, 118)
    assert time.process_time() - began < 6  # n squared takes minutes


def test_license_spans_end_with_their_template(spark):
    text = " x ".join(["released under the mit license"] * 50)
    spans = [s for s in license_scan.apply(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"] if s["label"] == "mit"]
    assert [(s["first_word"], s["last_word"]) for s in spans] == [(6 * i, 6 * i + 4) for i in range(50)]


def brute_components(pairs, k=5):
    sets, parent = [], list(range(len(pairs)))
    for _, t in pairs:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(pairs):
        groups[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(pairs)), key=repr)


def test_jaccard_join(docs, texts, no_docs):
    assert rows(jaccard_join.apply(docs), "n_shingles", "component_id") == brute_components(texts)
    assert jaccard_join.apply(no_docs).count() == 0


def near_copies(groups: int, each: int, passages: int) -> list[tuple[int, str]]:
    """Groups of near copies that are chains of edits, and texts around a shared passage."""
    r, pairs = random.Random(9), []
    for g in range(groups):
        words = prose(r.randint(12, 120), 100 + g).split()
        for _ in range(each):
            for _ in range(r.randint(0, 2)):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            pairs.append((len(pairs), " ".join(words)))
    passage = prose(40, 77)
    return pairs + [(len(pairs) + i, f"{passage} {prose(r.randint(4, 30), 500 + i)}") for i in range(passages)]


@pytest.mark.parametrize("frequent", [(64, 1024), (1, 4)])
def test_jaccard_near_copies(spark, monkeypatch, frequent):
    pairs = near_copies(6, 25, 60)
    monkeypatch.setattr(jaccard_join, "CHUNK", 3000)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    assert rows(jaccard_join.apply(df, frequent=frequent, rounds=2), "n_shingles", "component_id") == brute_components(pairs)


def test_jaccard_without_broadcast(spark, monkeypatch):
    pairs = near_copies(3, 6, 5)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(2)
    assert rows(jaccard_join.apply(df), "n_shingles", "component_id") == brute_components(pairs)


def met(x, y, counts, frequent):
    """Whether two sets meet by an index signature of the smaller one and pass the filter on what stands behind it."""
    if (len(x), x.tobytes()) > (len(y), y.tobytes()):
        x, y = y, x
    a, b = (jaccard_join.signatures(s, counts(s), 75, frequent) for s in (x, y))
    behind = {int(s): int(r) for s, r in zip(b[0], b[1])}
    return any(i and int(s) in behind and min(int(r), behind[int(s)]) * 175 >= 75 * (len(x) + len(y)) for s, r, i in zip(*a))


def test_signatures_lose_no_link():
    r, linked = random.Random(6), 0
    for trial in range(400):
        n = r.randint(2, 200)
        x = np.unique(np.array([r.randrange(2**64) for _ in range(n)], np.uint64))
        keep = sorted(r.sample(range(len(x)), -(-r.choice([6, 7, 8, 9]) * len(x) // 10)))
        y = np.unique(np.concatenate([x[keep], np.array([r.randrange(2**64) for _ in range(r.randint(0, len(x) // 4))], np.uint64)]))
        both = np.intersect1d(x, y)
        shares = r.choice([[1, 0, 0], [0.7, 0.2, 0.1], [0.1, 0.4, 0.5], [0, 1, 0], [0, 0, 1], [0.15, 0.85, 0]])
        drawn = dict(zip(both.tolist(), np.random.default_rng(trial).choice([2, 100, 2000], len(both), p=shares)))
        counts = lambda s: np.array([drawn.get(v, 1 + (v % 3 == 0) * 80) for v in s.tolist()])
        if 100 * len(both) >= 75 * (len(x) + len(y) - len(both)) and not np.array_equal(x, y):
            linked += 1
            assert met(x, y, counts, jaccard_join.FREQUENT)
    assert linked > 100


def test_sets_without_a_partner_sign_nothing():
    s = np.arange(1, 201, dtype=np.uint64)
    assert not len(jaccard_join.signatures(s, np.where(np.arange(200) < 51, 1, 5000), 75)[0])
    sigs, rest, index = jaccard_join.signatures(s, np.where(np.arange(200) < 45, 1, 5000), 75)  # may have smaller partners, of which it can't be the smaller one
    assert len(sigs) and not index.any() and set(rest) == {155}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50 + i) for i in range(20)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {50 + i: 50 for i in range(20)} | {100: 50}


def test_word_windows():
    w = Words("  a B\tc\u00a0d  e ")
    assert w.n == 4 and len(w.windows(3)) == 2 and len(w.windows(9)) == 1 and not len(Words(None).windows(5))
    assert Words("x y z").windows(2)[1] == Words("q Y z").windows(2)[1] and Words("xy z").windows(2)[0] != Words("x yz").windows(2)[0]


def test_long_texts_are_hashed_by_stretches(monkeypatch):
    text = prose(500, 4) + " " + "x" * 300 + " " + prose(20, 5)
    whole = [Words(text).windows(k) for k in (1, 5, 10_000)]
    monkeypatch.setattr("tidemark.llm.rolling.STRETCH", 100)
    assert all(np.array_equal(w, Words(text).windows(k)) for w, k in zip(whole, (1, 5, 10_000)))


def test_url_filter(spark):
    urls = ["https://A.Example.org/es/x?q#f", "http://example.org/en/1", "http://example.org/en/2", "http://x.com/fr/", "http://com/de/9", "no scheme", None, "", "http://example.org", "ftp://net?x://y/z", "http://xorg/", "a\nb://h.com/p", "http://www.cheap-pills.example.com/buy", "http://www.cheap-pills.example.com/buy"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.apply(df, queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
        host = low(host)
        fits = [r for r in queries.URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[1] + rule[2])
        assert got[i]["verdict"] == (rule[0] if rule else "allow" if got[i]["score"] >= 0.5 else "block")
    assert url_filter.apply(df.limit(0), queries.URL_RULES).count() == 0


def wanted(model, url):
    f = url_filter.features(*url_filter._parts(url), 15)
    return model[1] + model[0][f].sum() / math.sqrt(len(f)) > 0


def test_url_model_learns_its_table():
    model = url_filter.train()
    rows = url_filter.table()
    assert 300 < len(rows) < 1000 and len({u for u, _ in rows}) == len(rows) and np.mean([wanted(model, u) == bool(y) for u, y in rows]) > 0.99
    assert url_filter.train([])[1] == 0.0


def test_url_model_judges_unseen_hosts():
    model, hosts = url_filter.train(), {url_filter._parts(u)[0] for u, _ in url_filter.table()}
    good = [f"https://{h}.example.{e}{p}" for h, e, p in [("blog.tandem", "com", "/en/12"), ("river-walks", "org", "/fr/8.html"), ("m.enthsh", "net", "/de/77?page=2"), ("www.kitchen", "org", "/es/4/"), ("astronomy-club", "net", "/papers/9"), ("thernd", "com", "/en/1#top"), ("choir", "org", "/"), ("tionati", "net", "/fr/5")]]
    bad = [f"http://{h}.example.{e}{p}" for h, e, p in [("buy-pills", "com", "/en/12"), ("best-casino-win", "org", "/fr/8.html"), ("m.free-bets-now", "net", "/de/77"), ("www.pokerroom", "org", "/es/4/"), ("spam-links", "net", "/en/9"), ("cheap-followers-shop", "com", "/en/1#top"), ("warez-torrents", "org", "/"), ("payday-cash", "net", "/fr/5")]]
    assert not {url_filter._parts(u)[0] for u in good + bad} & hosts
    assert [wanted(model, u) for u in good] == [True] * len(good) and sum(not wanted(model, u) for u in bad) >= len(bad) - 1


def test_quality_classifier(spark, docs, no_docs):
    good = [(i, prose(150, i), 1) for i in range(120)]
    bad = [(1000 + i, prose(150, i).replace(" ", "%%% ") if i % 2 else "buy " * 150, 0) for i in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    held = F.col("doc_id") % 4 == 0
    model = quality_mil.fit(table.where(~held).select("doc_id", "text"), table.select("doc_id", "quality"))
    got = quality_mil.score(table.where(held), model).collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["quality"]) for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in quality_mil.score(docs.select("doc_id", "text"), model).collect())
    empty = quality_mil.fit(no_docs, table)
    assert empty.share == 0.5 and quality_mil.score(no_docs.select("doc_id", "text"), empty).count() == 0


def test_decontamination(spark, docs, texts, no_docs):
    base = TEXTS[6].split()
    items = [(1, " ".join(base[5:25]).upper() + "!"), (2, "x y z"), (3, None), (4, "?!"), (5, " ".join(base[20:32])), (None, " ".join(base[40:52])), (10, " ".join(base[5:16])), (10, "one two three four")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = NORMAL.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)

    def brute(t):
        w, hit, found = NORMAL.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        return len(w), len(hit), sorted(str(x) for x in found if x is not None)

    same(decontaminate.apply(docs, bench), texts, brute, "n_words", "n_hit", "items")
    same(decontaminate.apply(docs, bench, block_words=9), texts, brute, "n_words", "n_hit", "items")
    assert decontaminate.apply(no_docs, bench).count() == 0 and decontaminate.apply(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    one = spark.createDataFrame([(1, "Say: X, y - Z! end")], "doc_id long, text string")
    clash = decontaminate.apply(docs, bench, keep=("doc_id", "n_words", "spans", "score"))
    assert clash.columns == ["doc_id", "score", "n_words", "n_hit", "items", "spans"] and clash.count() == len(texts)
    assert [tuple(s) for s in decontaminate.apply(one, bench).first()["spans"]] == [(5, 13)]


def test_language_model(docs, texts, no_docs):
    train = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 != 2
    mark = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    tokens = [(d, WORD.findall(low(t)) + [None]) for d, t in texts]
    single, pairs, context = Counter(), Counter(), Counter()
    for d, t in tokens:
        if train(d):
            single.update(t)
            pairs.update(zip([0, *t], t))
            context.update([0, *t[:-1]])
    n, v = sum(single.values()), len(single)
    got = sorted(ngram_lm.apply(docs, mark, n_blocks=3).collect(), key=lambda r: (repr(r["doc_id"]), r["n_tokens"]))
    for r, (d, t) in zip(got, sorted(tokens, key=lambda x: (repr(x[0]), len(x[1]))), strict=True):
        base = sum(math.log10((single[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(pairs[c, w] / (context[c] + 20) + 20 / (context[c] + 20) * (single[w] + 1) / (n + v + 1)) for c, w in zip([0, *t], t))
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d, len(t), sum(single[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and abs(r["score"] - score) <= 2e-4 * len(t)
    assert ngram_lm.apply(no_docs, mark).count() == 0
    assert {r["train_tokens"] for r in ngram_lm.apply(docs, F.lit(False), n_blocks=2).collect()} == {0}


def test_elias_fano():
    from tidemark.llm.ngram_trie import EliasFano

    rng = np.random.default_rng(1)
    for n, universe in ((0, 1), (1, 1 << 64), (1000, 1 << 64), (5000, 20_000), (3000, 1 << 50)):
        x = np.unique(rng.integers(0, min(universe, 1 << 63), n, dtype=np.uint64))
        e = EliasFano(EliasFano.write(x, universe))
        probe = np.concatenate([x, rng.integers(0, min(universe, 1 << 63), 500, dtype=np.uint64)])
        where = {int(v): i for i, v in enumerate(x)}
        assert e.find(probe).tolist() == [where.get(int(v), -1) for v in probe]
        assert np.array_equal(e.values(np.arange(len(x))), x)
        third = len(x) // 3
        inside = e.find(x, np.full(len(x), third), np.full(len(x), 2 * third))
        assert inside.tolist() == [i if third <= i < 2 * third else -1 for i in range(len(x))]
    repeated = np.sort(rng.integers(0, 50, 900)).astype(np.uint64)  # as pointers are: equal values, gaps
    for values in (repeated, np.zeros(70, np.uint64), repeated * np.uint64(1000)):
        assert np.array_equal(EliasFano(EliasFano.write(values, int(values.max()) + 1)).values(np.arange(len(values))), values)


def test_trie_reads_its_levels():
    from tidemark.llm.ngram_trie import NONE, VALUES, Trie

    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    pairs = np.unique((rng.integers(0, len(words), 4000).astype(np.uint64) << np.uint64(40)) | rng.integers(0, 1 << 40, 4000, dtype=np.uint64))
    pairs = pairs[(pairs >> np.uint64(40)) % np.uint64(7) != 3]  # words without followers
    counts, each = rng.integers(50, 1000, len(words)), rng.integers(1, 50, len(pairs))
    trie = Trie(words, counts, pairs, each, 20.0)
    at, got, _ = trie.find_words(np.append(words, np.uint64(5)))
    assert at.tolist() == [*range(len(words)), -1] and np.array_equal(got, np.append(counts, 0))
    place = (pairs >> np.uint64(40)).astype(np.int64)
    owners, sizes = np.unique(place, return_counts=True)
    codes = trie.find_followers(owners, sizes, pairs & np.uint64((1 << 40) - 1))
    assert np.allclose(VALUES[codes], each / (counts[place] + 20), rtol=1e-3)
    assert (trie.find_followers(np.array([-1, 3]), np.array([1, 1]), np.array([1, 2], np.uint64)) == NONE).all()
    assert (Trie(words[:0], counts[:0], pairs[:0], each[:0], 20.0).find_followers(np.array([-1]), np.array([1]), np.array([1], np.uint64)) == NONE).all()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    good = [(i, prose(120, i) + ".", "en", "s", 1) for i in range(40)]
    bad = [(100 + i, "buy " * 200, "en", "s", 1) for i in range(20)]
    copies = [(200 + i, good[i][1], "en", "s", 1) for i in range(5)]
    secret, leak = (300, prose(120, 900) + " password=abcdef123456", "en", "s", 1), (301, prose(120, 901), "en", "s", 1)
    spark.createDataFrame(good + bad + copies + [secret, leak, (None, prose(90, 902), None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(15)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak[1].split()[10:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(40), 300, None} and all(r["round_trip"] for r in got.values())
    assert got[300]["n_chars"] == len(secret[1]) - len("password=abcdef123456") + len("[SECRET]")
    assert hashlib.sha256(bytes(got[0]["ids"])).hexdigest() == hashlib.sha256(bpe_codec.codec(queries.vocabulary_path()).encode(good[0][1])).hexdigest()


def test_queries_registered(spark):
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in entry.queries()} and "pipeline" in entry.queries()


def test_rows_without_a_link_stay(spark):
    import corpus_pipeline

    rows = [(3, prose(80, 3)), (7, prose(80, 3)), (7, prose(80, 4)), (8, prose(80, 5)), (8, prose(80, 5)), (None, prose(80, 6)), (None, prose(80, 6)), (None, prose(80, 3)), (None, ""), (9, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([rows[0], rows[2], rows[3], rows[5], rows[8], rows[9]], key=repr)


def test_url_table_is_not_test_data():
    assert {url_filter._parts(u)[0].rsplit(".", 1)[1] for u, _ in url_filter.table()} == set(url_filter.ENDS)  # no page of the tables ends so


def test_quality_training_sees_single_passages(spark, monkeypatch):
    seen = []
    train = quality_mil.train
    monkeypatch.setattr(quality_mil, "train", lambda bags, labels: seen.extend((y, np.array(b)) for b, y in zip(bags, labels)) or train(bags, labels))
    long = prose(20_000, 7)
    table = spark.createDataFrame([(1, long, 1), (2, "buy " * 200, 0)], "doc_id long, text string, quality int")
    quality_mil.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    assert {y: len(b) for y, b in seen} == {1: 313, 0: 4}
    assert np.array_equal(dict(seen)[1], np.vstack(list(quality_mil.passages(long))).astype(np.float16))
