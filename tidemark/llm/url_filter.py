"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table of URLs (made by rule below, or the
caller's ``rows``), whose size bounds the work there; its weights are one vector of ``2 ** bits``
floats. Scoring is one pass without a shuffle.

A null url or one without ``://`` has an empty host and path, fits no rule and is judged by
the model's bias alone. Repeated rows are judged alike. An empty table of pages gives no rows, one of
labels a score of 0.5. A very long url is judged as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, python_tasks, unclashed

#: Words of invented hosts and paths of wanted pages and of unwanted ones (spam, shops for pills, gambling, link farms).
WANTED = "garden library museum history science school recipes weather health theatre orchard lighthouse python papers forum essays music travel council archive birds bridge climate maps ocean forest castle planet letters poetry harbour village walking market station painter".split()
UNWANTED = "pills casino bets poker slots viagra porn sex adult cams loans payday replica followers backlinks spam farm warez torrent keygen jackpot bonus cheap meds".split()
#: What hosts and paths of both kinds are made of, so that it tells nothing; no real domain ends so.
ENDS, SHAPES = ("test", "invalid", "local"), ("{a}-{b}.{e}", "www.{a}{b}.{e}", "m.{a}-{b}.{e}", "blog.{a}.{b}.{e}")
PATHS = ("/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}", "/page/{n}", "/{a}/{b}")


def table(per_word: int = 6) -> list[tuple[str, int]]:
    """Labelled URLs by rule: each word with ``per_word`` others of its kind, in turn over shapes, ends and paths; and as many wanted hosts of syllables without a meaning."""
    out, n = [], 0
    syllables = ("an", "the", "ti", "on", "er", "re", "st", "in", "ou", "ly", "sh", "nd", "ha", "or")
    pick = lambda n, i: syllables[(n * (2 * i + 3) + i) % len(syllables)]
    for label, words in ((1, WANTED), (0, UNWANTED)):
        for i, a in enumerate(words):
            for k in range(1, per_word + 1):
                n += 1
                b = words[(i + k) % len(words)]
                parts = {"a": a, "b": b, "e": ENDS[n % 3], "n": n * 37 % 9001}
                out.append((f"http{'s' * (n % 2)}://{SHAPES[n % 4]}{PATHS[n % 6]}".format(**parts), label))
                if label:
                    out.append((f"https://{SHAPES[n % 4]}{PATHS[(n + 1) % 6]}".format(**parts | {"a": pick(n, 0) + pick(n, 1), "b": pick(n, 2) + pick(n, 3)}), 1))
    return list(dict.fromkeys(out))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, null if none fits. Rules: (verdict, host, path); of equal length the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(host: str, path: str, bits: int, sizes: Sequence[int] = (2, 3, 4)) -> np.ndarray:
    """Distinct hashed character n-grams; host and path are told apart, ends are marked."""
    mask = (1 << bits) - 1
    out = set()
    for mark, part in (("h", host), ("p", path)):
        s = f"^{part}$".encode("utf-8", "surrogatepass")
        for n in sizes:
            out.update(zlib.crc32(s[i : i + n], ord(mark) * 31 + n) & mask for i in range(len(s) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    for end in "?#":
        rest = rest.split(end)[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), slash + path  # A-Z only


def train(rows: Sequence[tuple[str, int]] | None = None, bits: int = 15, rounds: int = 300, rate: float = 1.0, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent on the penalised log loss, both labels weighing the same; a URL's features have norm 1. Only set features are stored."""
    rows = table() if rows is None else rows
    if not rows:
        return np.zeros(1 << bits), 0.0
    own = [features(*_parts(u), bits) for u, _ in rows]
    y = np.array([label for _, label in rows], float)
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    at, row = np.concatenate(own), np.repeat(np.arange(len(own)), [len(f) for f in own])
    x = np.concatenate([np.full(len(f), 1 / np.sqrt(max(1, len(f)))) for f in own])
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        error = share * (1 / (1 + np.exp(-(np.bincount(row, w[at] * x, len(own)) + b))) - y)
        w -= rate * (np.bincount(at, error[row] * x, 1 << bits) * 10 + penalty * w)
        b -= rate * error.sum()
    return w, b


def apply(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", keep: Sequence[str] = ("page_id",), rows: Sequence[tuple[str, int]] | None = None, bits: int = 15, threshold: float = 0.5) -> DataFrame:
    """Columns of ``keep``, ``host``, ``path``, ``rule``, ``score`` (probability of a wanted page) and ``verdict`` (the rule's, else the model's)."""
    python_tasks(pages.sparkSession)
    weights, bias = train(rows, bits)
    sent = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2 ** bits floats

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = sent.value
        for hosts, paths in parts:
            logits = []
            for h, p in zip(hosts, paths):
                f = features(h, p, bits)
                logits.append(bias + float(w[f].sum()) / np.sqrt(max(1, len(f))))
            yield pd.Series(1 / (1 + np.exp(-np.array(logits, float))))

    keep = unclashed(keep, "host", "path", "rule", "score", "verdict")
    own = pages.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    own = own.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", score("host", "path"))
    return own.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("fit.rule").alias("rule"), "score", F.coalesce("fit.verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"))
